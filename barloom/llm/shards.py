"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are put in one global order by range partitioning, numbered and summed
inside their partition, and shifted by the totals of the partitions before.
With the bytes before every row known, cuts at equal targets give contiguous
shards.  Only narrow rows are shuffled; the text stays where it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, stored


def byte_shards(docs: DataFrame, *, shards: int = 24, overhead: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, bytes_before, grown_shard)`` per row.

    A row's size is the UTF-8 length of its text plus ``overhead``.  Rows are
    in the order of doc_id (null first), size, CRC and a hash of the row's place
    in the input, so repeated rows spread over partitions too.  A row belongs to
    the shard in whose equal share of all bytes its middle lies: shards differ
    by less than one row's size at either end.  ``slot`` counts a shard's rows
    from 0 in this order.  More shards than rows leave shards empty.

    A null text has no bytes and the CRC of none, 0.  ``law`` is "bytes" and
    ``grown_shard`` null, as the number of shards is fixed.  An empty table
    gives an empty result; other columns are left out.
    """
    body = docs[f"`{text}`"].cast("string")
    narrow = docs.select(long_id(docs, doc_id).alias("doc_id"),
                         (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("bigint").alias("size"),
                         F.coalesce(F.crc32(body), F.lit(0)).cast("bigint").alias("text_crc32"),
                         F.xxhash64(F.monotonically_increasing_id()).alias("__tie"))
    order = ["doc_id", "size", "text_crc32", "__tie"]
    # written once: partition numbers must be the same for the totals and the rows
    placed = stored(narrow.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "order")
    totals = placed.groupBy("__part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per partition
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows"))
    everything = totals.agg(F.sum("bytes").alias("__all"))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumns({"__b": F.coalesce(F.sum("size").over(inside), F.lit(0)), "__r": F.coalesce(F.count("*").over(inside), F.lit(0))})
    summed = summed.join(F.broadcast(starts), "__part").crossJoin(F.broadcast(everything))
    middle = 2 * (F.col("__b") + F.col("__bytes")) + F.col("size")
    # twice the bytes up to the row's middle, in exact decimal arithmetic
    shard = F.floor(middle.cast("decimal(28,0)") * F.lit(shards) / (2 * F.col("__all")).cast("decimal(28,0)")).cast("int")
    cut = stored(summed.select("doc_id", "size", "text_crc32", F.least(shard, F.lit(shards - 1)).alias("shard"),
                               (F.col("__b") + F.col("__bytes")).alias("bytes_before"), (F.col("__r") + F.col("__rows")).alias("__row")), "cut")
    first = cut.groupBy("shard").agg(F.min("__row").alias("__first"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__row") - F.col("__first")).alias("slot"), "bytes_before", F.lit(None).cast("int").alias("grown_shard"))
