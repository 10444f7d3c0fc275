"""Helpers of the operators: row identity, shared intermediate tables, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir


def shared_path(df: DataFrame, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later reads survive lost executors, prune columns, and see one and the
    same result however often they are planned.
    """
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def long_id(df: DataFrame, doc_id: str) -> Column:
    return df[f"`{doc_id}`"].cast("bigint")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two long columns that identify a row by id and text, nulls included.

    Rows that repeat both an id and its text share a key, and so their fate.
    """
    flags = F.concat(F.when(doc_id.isNull(), "n").otherwise("i"), F.when(text.isNull(), "n").otherwise("t"))
    return [F.xxhash64(flags, doc_id, text).alias("__k1"), F.xxhash64(F.lit("2"), text, doc_id, flags).alias("__k2")]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes; null is empty."""
    if pa.types.is_large_string(column.type):
        return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict that fills itself with ``make(key)``.

    When full it keeps its entries as an older generation, from which those
    still asked for come back, so it never holds more than twice ``limit``.
    Keys longer than ``longest`` are made each time and not kept.
    """

    def __init__(self, make: Callable, limit: int = 150_000, longest: int = 256):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
