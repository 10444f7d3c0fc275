"""Substring deduplication by hashed units.

A text is cut into lines or paragraphs, and these, if asked, at sentence ends;
every unit is normalised and hashed, digests are grouped over all texts, and
the earliest occurrence in rank order stays.  All others are removed from their
texts, at the character offsets the unit has in the original.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from barloom.llm.shared import long_id, map_batches, row_key, stored

#: Separators by unit; sentences are lines cut again behind their end marks.
_CUTS = {"line": r"\n", "paragraph": r"\n[^\S\n]*\n\s*", "sentence": r"\n|(?<=[.!?])[^\S\n]+"}


def unit_spans(text: str, unit: str) -> list[tuple[int, int]]:
    """``(start, end)`` in characters of the units, without their separators."""
    out, at = [], 0
    for m in re.finditer(_CUTS[unit], text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def normalised(text: str) -> str:
    """NFKC, lower case, white space as single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def _key(doc_id: Column, text: Column) -> Column:
    """Half of ``row_key``: tells apart the rows of one id, which is all it is asked for."""
    return row_key(doc_id, text)[0].alias("key")


def _same_rows(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """Join on id, key and ``more``; ids may be null."""
    names = ["doc_id", "key", *more]
    right = right.withColumnsRenamed({n: f"__{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(right, on, how).drop(*[f"__{n}" for n in names])


def unit_rows(docs: DataFrame, *, unit: str, doc_id: str, text: str) -> DataFrame:
    """``(key, doc_id, at, start, end, n_words, h1, h2)`` of every unit with a word; ``at`` numbers those of a text."""
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    rows = docs.select(ident.alias("doc_id"), body.alias("text"), _key(ident, body)).where("text is not null")
    kinds = [("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]

    def run(batches):
        for batch in batches:
            out = []
            for doc, value, key in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "key"))):
                at = 0
                for start, end in unit_spans(value, unit):
                    plain = normalised(value[start:end])
                    if plain:
                        digest = xxhash.xxh3_128_digest(plain.encode("utf-8", "replace"))
                        n, at = plain.count(" ") + 1, at + 1
                        out.append((key, doc, at, start, end, n, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                if len(out) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])

    return rows.mapInArrow(run, "key bigint, doc_id bigint, at int, start bigint, end bigint, n_words bigint, h1 bigint, h2 bigint")


def _in_passages(gone: DataFrame, min_words: int) -> DataFrame:
    """The repeated units that lie in a passage of ``min_words`` words or more.

    A passage is a stretch of neighbouring repeated units whose first
    occurrences are in one and the same row, or a single long one; repeated
    units that adjoin a passage without a gap belong to it, wherever their own
    first occurrence is.  Windows are over the repeated units of one text.
    """
    text, source = ["doc_id", "key"], ["first.doc_id", "first.key"]
    marked = gone.withColumn("__part", F.col("at") - F.row_number().over(W.partitionBy(*text, *source).orderBy("at")))
    same = W.partitionBy(*text, *source, "__part")
    marked = marked.withColumn("__strong", F.sum("n_words").over(same) >= min_words)
    marked = marked.withColumn("__island", F.col("at") - F.row_number().over(W.partitionBy(*text).orderBy("at")))
    return marked.withColumn("__any", F.bool_or("__strong").over(W.partitionBy(*text, "__island"))).where("__any").drop("__part", "__strong", "__island", "__any")


def _later_copies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, key, more)`` of rows that repeat an id and its text: how many there are beside the first."""
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    keys = docs.select(ident.alias("doc_id"), _key(ident, body))
    return keys.groupBy("doc_id", "key").agg((F.count("*") - 1).alias("more")).where("more > 0")


def repeated_units(docs: DataFrame, *, unit: str = "line", min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, doc_id, start, end, n_words, kept_doc_id, kept_start, copy)`` of every unit that goes.

    Rank is doc_id (null last), then the row's hash and the offset; the unit of
    least rank stays.  A repeated unit goes if it lies in a passage of repeated
    units of at least ``min_words`` words; with 1 every one does.  Of rows that
    repeat an id and its text, ``copy`` 0 is judged as above, and the others
    (from 1) lose every unit.
    """
    units = stored(unit_rows(docs, unit=unit, doc_id=doc_id, text=text), "units")
    more = stored(_later_copies(docs, doc_id, text), "copies")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    first = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    names = ["key", "doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), "copy"]
    joined = units.join(first, ["h1", "h2"]).drop("h1", "h2")
    single = joined.where(place > F.col("first"))
    if more.isEmpty():
        once = single
    else:
        # a text that stands in several rows is one text here
        once = single.dropDuplicates(["doc_id", "key", "start"])
        joined = joined.dropDuplicates(["doc_id", "key", "start"])
    gone = (once if min_words <= 1 else _in_passages(once, min_words)).withColumn("copy", F.lit(0)).select(*names)
    copies = _same_rows(joined, more, "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("more").cast("int")))).select(*names)
    return gone.union(copies)


def drop_repeated_units(docs: DataFrame, *, unit: str = "line", min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, removed, kept_text`` per row of ``docs``; ``row`` holds its columns.

    ``removed`` has ``(start, end, kept_doc_id, kept_start)`` of the removed
    units, offsets counting characters of the original text; a removed unit's
    separator stays, so the others keep their lines.  A null text stays null, an
    empty one empty.  Of rows that repeat an id and its text any one is the
    first.  An empty table gives an empty result.
    """
    gone = repeated_units(docs, unit=unit, min_words=min_words, doc_id=doc_id, text=text)
    spans = gone.groupBy("doc_id", "key", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kept_doc_id", "kept_start"))).alias("removed"))
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), ident.alias("doc_id"), body.alias("text"), _key(ident, body))
    more = _later_copies(docs, doc_id, text)
    if more.isEmpty():
        rows = rows.withColumn("copy", F.lit(0))
    else:
        rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "key").orderBy(F.monotonically_increasing_id())) - 1)
    rows = _same_rows(rows, spans, "left", "copy")
    rows = rows.select("row", "doc_id", "removed", "text")
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "kept_doc_id", "kept_start")])
    schema = T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])

    def cut(batch):
        kept, removed = [], batch.column("removed").to_pylist()
        for value, spans in zip(batch.column("text").to_pylist(), removed):
            if value is not None and spans:
                bounds = [0, *(x for r in spans for x in (r["start"], r["end"])), len(value)]
                value = "".join(value[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            kept.append(value)
        spans = pa.array([r or [] for r in removed], batch.schema.field("removed").type)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), spans, pa.array(kept, pa.string())], names=["row", "doc_id", "removed", "kept_text"])

    return map_batches(rows, cut, schema)
