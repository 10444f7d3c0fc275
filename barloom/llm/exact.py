"""Exact duplicates with a heavy-hitter split.

Only digests travel.  A Misra-Gries summary of the digests, which Spark's
``freqItems`` keeps and merges with at most ``1 / share`` counters, names every
digest that more than that share of all rows has, and some that it does not.
The named digests are counted exactly, and the verified ones, bounded by the
number of counters, are broadcast with their winner: their rows are settled
where they lie.  The rows of all other digests are grouped by an ordinary
shuffle, in which no key can hold more than that share.

Everything is DataFrame functions.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, row_key, stored

#: Share of all rows from which a digest is settled without a shuffle; its
#: inverse bounds the counters of the summary and the rows that are broadcast.
SHARE = 0.001


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased; without other scripts that is what ``lower`` does."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def heavy_digests(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """``(digest, first, group_size)`` of the digests that at least ``share`` of ``rows`` have.

    ``rows`` has ``digest`` and ``place``; ``first`` is the largest place.
    """
    named = rows.select(F.xxhash64("digest").alias("h")).stat.freqItems(["h"], share).select(F.explode("h_freqItems").alias("h"))
    named = rows.join(F.broadcast(named), F.xxhash64(rows["digest"]) == named["h"])  # at most 1 / share values
    counted = named.groupBy("digest").agg(F.max("place").alias("first"), F.count("*").alias("group_size"))
    everything = rows.agg(F.count("*").alias("__all"))
    return counted.crossJoin(F.broadcast(everything)).where(F.col("group_size") >= F.col("__all") * F.lit(share)).drop("__all")


def _grouped(docs: DataFrame, doc_id: str, text: str, share: float, keys: list[Column]) -> DataFrame:
    """``(place, digest, first, group_size)`` per row; ``place`` starts with the id, null least, and has ``keys``."""
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    place = F.struct(long_id(docs, doc_id).alias("doc_id"), *keys)
    rows = stored(docs.select(place.alias("place"), F.unhex(F.sha2(ascii_lower(body), 256)).alias("digest")), "digests")
    heavy = stored(heavy_digests(rows, share), "heavy")
    settled = rows.join(F.broadcast(heavy), "digest")
    others = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    counted = others.groupBy("digest").agg(F.max("place").alias("first"), F.count("*").alias("group_size"))
    names = ["place", "digest", "first", "group_size"]
    return settled.select(*names).union(others.join(counted, "digest").select(*names))


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``docs``.

    Texts are equal if they are after lower-casing A-Z; a null text is an empty
    one.  Of a group the row with the largest id stays, null ids being least;
    of rows that repeat that id one stays, by its place in the input.  A group
    without any id has a null ``keep_id`` and keeps one row as well.  Long
    texts are only hashed.  Other columns are left out.  An empty table gives an
    empty result.
    """
    found = _grouped(docs, doc_id, text, share, [F.monotonically_increasing_id().alias("row")])
    return found.select("place.doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("first")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, one of every group of equal texts, with all their columns.

    Ties as in ``exact_groups``, but between rows of one id with different
    spellings by a hash of the text; of rows that repeat both, one stays.
    """
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"]
    found = _grouped(docs, doc_id, text, share, row_key(ident, body))
    winners = found.where(F.col("place") == F.col("first")).select("place.__k1", "place.__k2").distinct()
    kept = docs.select("*", *row_key(ident, body)).join(winners, ["__k1", "__k2"], "left_semi")
    return kept.dropDuplicates(["__k1", "__k2"]).select(*[f"`{c}`" for c in docs.columns])
