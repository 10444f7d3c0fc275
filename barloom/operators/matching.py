"""Hand-labelled trades: normalization, bar alignment, candidate matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import ladder
from barloom.schemas import SESSION_KEY
from barloom.session import cut

# fixed values: words of the hand labels
YES_WORDS = ["", "yes", "y", "true", "valid"]
NO_WORDS = ["no", "n", "false", "invalid"]
TOP_TAGS = ["great_structure_strength", "perfect_strong_1m_continuation_candle"]
# fixed value: seconds within which a trade and a candidate may match
TOLERANCE = 90


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "unspecified").otherwise(s)


def reason_tags(x: Column) -> Column:
    """Comma list to slugs; blank parts are dropped."""
    parts = F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: slug(F.trim(p)))


def normalize_examples(trades: DataFrame, valid: str = "valid_reason", invalid: str = "invalid_reason", setup: str = "setup_valid") -> DataFrame:
    """Tags, yes / no and quality bucket of hand-labelled trades."""
    text = F.lower(F.trim(F.coalesce(F.col(setup), F.lit(""))))
    ok = ladder([(text.isin(YES_WORDS), "yes"), (text.isin(NO_WORDS), "no")], text)
    out = trades.withColumns({"__v": reason_tags(F.col(valid)), "__i": reason_tags(F.col(invalid)), "setup_valid_normalized": ok})
    top = F.arrays_overlap("__v", F.array(*[F.lit(x) for x in TOP_TAGS]))
    return out.withColumns(
        {
            "quality_bucket": ladder([(F.col("setup_valid_normalized") == "no", "avoid"), (F.coalesce(top, F.lit(False)), "high_quality")], "valid"),
            "valid_reason_tags": F.array_join("__v", "|"),
            "invalid_reason_tags": F.array_join("__i", "|"),
            "primary_valid_reason": F.coalesce(F.get("__v", F.lit(0)), F.lit("")),
            "primary_invalid_reason": F.coalesce(F.get("__i", F.lit(0)), F.lit("")),
        }
    ).drop("__v", "__i")


def align_to_bars(trades: DataFrame, bars: DataFrame, key: str, time: str = "sod") -> DataFrame:
    """Last session bar at or before the trade, else the first bar after it.

    Stacked bars and times of a session, one backward and one forward carry;
    trades of one time share their anchor, so a time is carried once.
    """
    b = bars.select(*SESSION_KEY, F.col("sod").alias("t"), F.lit(0).alias("side"), F.col("sod").alias("bar"))
    q = trades.select(*SESSION_KEY, F.col(time).alias("t")).distinct().select(*SESSION_KEY, "t", F.lit(1).alias("side"), F.lit(None).cast("int").alias("bar"))
    back = W.partitionBy(*SESSION_KEY).orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*SESSION_KEY).orderBy(F.col("t").desc(), F.col("side").desc()).rowsBetween(W.unboundedPreceding, 0)
    u = b.unionByName(q).withColumns(
        {"before": F.last("bar", ignorenulls=True).over(back), "after": F.last("bar", ignorenulls=True).over(ahead)}
    )
    hit = u.filter(F.col("side") == 1).select(*[F.col(c).alias(f"__{c}") for c in SESSION_KEY], F.col("t").alias("__t"), F.coalesce("before", "after").alias("anchor_sod"))
    on = F.col(time).eqNullSafe(F.col("__t"))
    for c in SESSION_KEY:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return trades.join(hit, on, "left").drop("__t", *[f"__{c}" for c in SESSION_KEY])


def context_windows(anchored: DataFrame, bars: DataFrame, key: str, *, before: int = 12, after: int = 24) -> DataFrame:
    """Bars around each anchor, inside its session, one row per bar.

    The window is exploded into bar positions, so the join is an equi-join.
    """
    pos = F.row_number().over(W.partitionBy(*SESSION_KEY).orderBy("sod")) - 1
    b = bars.withColumn("bar_index", pos).select(*SESSION_KEY, "bar_index", "sod", "open", "high", "low", "close", "volume")
    a = anchored.select(key, *SESSION_KEY, F.col("anchor_sod").alias("__a")).join(
        b.select(*SESSION_KEY, F.col("sod").alias("__a"), F.col("bar_index").alias("__p")), [*SESSION_KEY, "__a"]
    )
    want = a.withColumn("bars_from_entry_anchor", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn(
        "bar_index", F.col("__p") + F.col("bars_from_entry_anchor")
    )
    return want.join(b, [*SESSION_KEY, "bar_index"]).select(
        key, *SESSION_KEY, "bar_index", "bars_from_entry_anchor", "sod", "open", "high", "low", "close", "volume",
        (F.col("sod") == F.col("__a")).alias("is_entry_anchor"),
    )


def sequences(windows: DataFrame, key: str) -> DataFrame:
    """Nested bar array per example (at most before + after + 1 bars)."""
    bar = F.struct("bar_index", "bars_from_entry_anchor", "sod", "open", "high", "low", "close", "volume", "is_entry_anchor")
    return windows.groupBy(key, *SESSION_KEY).agg(F.array_sort(F.collect_list(bar)).alias("bars"))


def anchor_sequences(bars: DataFrame, **reach: int) -> DataFrame:
    """``sequences`` of every bar as an anchor, keyed by ``anchor_sod``.

    Windows follow from the bars alone: trades join the finished arrays, and no
    trade is repeated per bar of its window.
    """
    anchors = bars.select(*SESSION_KEY, F.col("sod").alias("anchor_sod"))
    return sequences(context_windows(anchors, bars, "anchor_sod", **reach), "anchor_sod")


def match_examples(manual: DataFrame, cands: DataFrame, *, by: list[str] | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """One-to-one match: each trade in time order takes the nearest free candidate.

    ``manual``: example_id, t (seconds), ``by`` columns; ``cands``: candidate_id,
    t, ``by`` columns.  Only pairs within the tolerance can match, so they come
    from an equi-join on time buckets.

    The ordered scan is settled in rounds.  Every trade names the nearest
    candidate it may still have, and a candidate goes to the earliest trade that
    names it; what the candidate might have been to later trades is struck out,
    as an earlier claim is never given up to them.  When no two trades name the
    same candidate, the pairs are those of the scan.
    """
    by = by or ["session_date", "direction"]
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = manual.select(*by, "example_id", F.col("t").alias("mt"), F.explode(F.array(*[cell("t") + i for i in (-1, 0, 1)])).alias("cell"))
    pairs = (
        near.join(cands.select(*by, "candidate_id", F.col("t").alias("ct"), cell("t").alias("cell")), [*by, "cell"])
        .withColumn("delta_seconds", F.abs(F.col("mt") - F.col("ct")).cast("double"))
        .filter(F.col("delta_seconds") <= tolerance)
        .select(*by, "example_id", "mt", "candidate_id", "delta_seconds")
    )
    while True:
        pairs = cut(pairs)
        named = pairs.groupBy(*by, "mt", "example_id").agg(F.min(F.struct("delta_seconds", "candidate_id")).alias("p"))
        holders = named.groupBy(*by, F.col("p.candidate_id").alias("candidate_id")).agg(F.min(F.struct("mt", "example_id")).alias("h"), F.count(F.lit(1)).alias("n"))
        holders = cut(holders)
        if holders.filter("n > 1").isEmpty():
            return named.select("example_id", "p.candidate_id", "p.delta_seconds")
        mine = F.struct("mt", "example_id")
        pairs = pairs.join(holders.drop("n"), [*by, "candidate_id"], "left").filter(F.col("h").isNull() | (mine <= F.col("h"))).drop("h")
