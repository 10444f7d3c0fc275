"""Cross-site boilerplate lines by the number of distinct sites that carry them.

Lines are grouped by hash.  A HyperLogLog sketch of the sites per line merges
by aggregation, so a line on a third of all pages costs one small sketch per
task.  A sketch's estimate decides alone where it is far from the threshold;
lines near it get an exact count of distinct sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, row_key, stored

_WORD = r"[^\x20\x09-\x0D]+"
#: log2 of the sketch's registers, and the estimate's distance from the
#: threshold, in relative standard errors of 1.04 / sqrt(registers), within
#: which a line is counted exactly.
REGISTERS, ERRORS = 12, 6.0


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("2"), line).alias("h2")]


def line_rows(docs: DataFrame, *, doc_id: str, text: str, site: str, min_words: int) -> DataFrame:
    """``(k1, k2, doc_id, site, pos, h1, h2)`` of every line of at least ``min_words`` words."""
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    rows = docs.select(ident.alias("doc_id"), docs[f"`{site}`"].cast("string").alias("site"),
                       *[c.alias(n) for c, n in zip(row_key(ident, body), ("k1", "k2"))], F.posexplode_outer(F.split(body, "\n", -1)).alias("pos", "line"))
    trimmed = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = rows.withColumn("line", trimmed).where(F.regexp_count("line", F.lit(_WORD)) >= min_words)
    return rows.select("k1", "k2", "doc_id", "site", "pos", *_line_key(F.col("line")))


def site_spread(lines: DataFrame, *, sites: int, registers: int = REGISTERS) -> DataFrame:
    """``(h1, h2)`` of the lines on at least ``sites`` distinct sites; null is no site."""
    margin = ERRORS * 1.04 / (1 << registers) ** 0.5
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(registers)).alias("sketch"), F.count("site").alias("n"))
    spread = spread.where(F.col("n") >= sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about"))
    spread = stored(spread.where(F.col("about") >= sites * (1 - margin) - 1), "spread")
    sure = spread.where(F.col("about") > sites * (1 + margin) + 1).select("h1", "h2")
    near = spread.where(F.col("about") <= sites * (1 + margin) + 1).select("h1", "h2")
    # pairs of line and site are made distinct inside the map tasks before they are shuffled
    pairs = lines.where("site is not null").join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    return sure.union(pairs.groupBy("h1", "h2").count().where(F.col("count") >= sites).select("h1", "h2"))


def boilerplate_lines(docs: DataFrame, *, sites: int = 10, min_words: int = 3, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``(k1, k2, doc_id, drop)``: the numbers of the lines that go, from 0, per row that has any.

    A line is boilerplate if at least ``sites`` sites carry it, white space at
    its ends aside; the occurrence with the least doc_id (null last), then row
    hash and line number, stays.  Lines of fewer than ``min_words`` words stay.
    """
    lines = stored(line_rows(docs, doc_id=doc_id, text=text, site=site, min_words=min_words), "lines")
    wide = stored(site_spread(lines, sites=sites), "wide")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "pos")
    found = lines.join(wide, ["h1", "h2"]).select("h1", "h2", place.alias("at"))
    first = found.groupBy("h1", "h2").agg(F.min("at").alias("first"))
    gone = found.join(first, ["h1", "h2"]).where("at > first").select("at.k1", "at.k2", "at.doc_id", "at.pos").distinct()
    return gone.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("pos")).alias("drop"))


def drop_boilerplate(docs: DataFrame, *, sites: int = 10, min_words: int = 3, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``row, doc_id, n_lines, n_removed, kept_text`` per row of ``docs``; ``row`` holds its columns.

    A text keeps its other lines and their order; one of boilerplate alone
    becomes empty, a null text stays null and has no line.  Rows that repeat an
    id and its text lose the same lines.  Rows without a site count for none but
    lose boilerplate like any other.  An empty table gives an empty result.
    """
    gone = boilerplate_lines(docs, sites=sites, min_words=min_words, doc_id=doc_id, text=text, site=site).select("k1", "k2", "drop")
    ident, body = long_id(docs, doc_id), docs[f"`{text}`"].cast("string")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), ident.alias("doc_id"), body.alias("text"),
                       *[c.alias(n) for c, n in zip(row_key(ident, body), ("k1", "k2"))])
    rows = rows.join(gone, ["k1", "k2"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("drop", i))
    changed = F.col("drop").isNotNull()
    return rows.select("row", "doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
                       F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_removed"),
                       F.when(changed, F.concat_ws("\n", kept)).otherwise(F.col("text")).alias("kept_text"))
