"""Aggregates and table-level statistics."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from barloom.functions.columns import c, ratio
from barloom.functions.scan import numeric_bucket, running


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function; Spark SQL has none."""
    cdf = NormalDist().cdf
    return x.map(lambda v: cdf(v) if pd.notna(v) else None)


def sharpe(x, n=None) -> Column:
    """mean / sample std * sqrt(n); null below two rows or without dispersion."""
    n = F.count(c(x)) if n is None else n
    sd = F.stddev_samp(c(x))
    return F.when((n >= 2) & (sd > 0), F.avg(c(x)) / sd * F.sqrt(n.cast("double")))


def standardized_moment(x, p: int, floor_n: int, default: float) -> Column:
    """Mean of ((x - mean) / sample std)^p as one pass of power sums.

    Spark's ``skewness``/``kurtosis`` use the population std and excess
    kurtosis, which is a different number.
    """
    v = c(x)
    n = F.count(v).cast("double")
    m = F.avg(v)
    s1, s2, s3, s4 = F.sum(v), F.sum(v * v), F.sum(v * v * v), F.sum(v * v * v * v)
    if p == 3:
        central = s3 - 3 * m * s2 + 3 * m * m * s1 - n * m * m * m
    else:
        central = s4 - 4 * m * s3 + 6 * m * m * s2 - 4 * m * m * m * s1 + n * m * m * m * m
    sd = F.stddev_samp(v)
    return F.when((n >= floor_n) & (sd > 0), central / n / F.pow(sd, F.lit(float(p)))).otherwise(F.lit(default))


def payoff_ratio(x) -> Column:
    """Mean win over mean absolute loss; 0 unless both sides exist."""
    v = c(x)
    win, loss = F.avg(F.when(v > 0, v)), F.avg(F.when(v < 0, -v))
    return F.coalesce(win / loss, F.lit(0.0))


def nearest_rank(values: Column, p: float) -> Column:
    """Element at round((n - 1) * p) of an ascending array, ties to even."""
    idx = F.bround((F.size(values) - 1) * F.lit(p)).cast("int")
    return F.coalesce(F.get(values, F.least(F.greatest(idx, F.lit(0)), F.size(values) - 1)), F.lit(0.0))


#: Rows that a task sorts at once for ranks.
RANK_ROWS = 1 << 20


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """One number per combination of values, nulls included."""
    out = np.zeros(table.num_rows, dtype=np.int64)
    for name in names:
        held = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        out = np.unique(out * (len(held.dictionary) + 1) + held.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return out


def _distinct_scores(code: np.ndarray, s: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts of the codes, code, score, positives, negatives, a row with them), by code and score, equal scores once."""
    order = np.lexsort((s, code))
    code, s, p, n = code[order], s[order], p[order], n[order]
    same = (s[1:] == s[:-1]) | ((s[1:] != s[1:]) & (s[:-1] != s[:-1]))
    at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | ~same))
    code = code[at]
    return np.flatnonzero(np.append(True, code[1:] != code[:-1])), code, s[at], np.add.reduceat(p, at), np.add.reduceat(n, at), order[at]


def rank_auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC per group from average ranks.

    Tasks sort their rows, count equal scores and hand over one row of lists per
    group and bucket of the score range.  Every bucket is ranked on its own, so
    a group that holds most of the data is not ranked in one task; what lies
    below a bucket follows from the table of buckets.
    """
    by = list(by or [])
    kind, y = df.schema[score].dataType.simpleString(), F.col(label)
    if kind.startswith("decimal"):
        df, kind = df.withColumn(score, F.col(score).cast("double")), "double"
    rows = df.filter(y.isNotNull() & F.col(score).isNotNull()).select(
        *by, F.when(F.isnan(F.col(score).cast("double")), F.lit(1 << 40)).otherwise(numeric_bucket(F.col(score))).cast("bigint").alias("__b"), F.col(score).alias("__s"),
        F.when(y == 1, 1).otherwise(0).alias("__p"), F.when(y == 0, 1).otherwise(0).alias("__n"))
    keys = [*by, "__b"]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)

    def sorted_lists(batches):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            first, _, s, p, n, row = _distinct_scores(_codes(table, keys), *(table.column(c).to_numpy() for c in ("__s", "__p", "__n")))
            ends = pa.array(np.append(first, len(s)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((s, table.schema.field("__s").type), (p, pa.int32()), (n, pa.int32()))]
            heads = table.select(keys).take(pa.array(row[first]))
            yield from pa.table([*heads.columns, *lists], names=[*keys, "s", "p", "n"]).to_batches()

        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= RANK_ROWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def ranked(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lists = [table.column(c).combine_chunks() for c in ("s", "p", "n")]
        at = np.repeat(np.arange(table.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
        s, p, n = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
        first, code, _, p, n, row = _distinct_scores(_codes(table, keys)[at], s, p.astype(np.int64), n.astype(np.int64))
        below = np.cumsum(n) - n
        below -= np.repeat(below[first], np.diff(np.append(first, len(code))))
        sums = [np.add.reduceat(v, first) for v in (p, n, p * (below + n / 2.0))]
        heads = table.select(keys).take(pa.array(at[row[first]]))
        yield from pa.table([*heads.columns, *map(pa.array, sums)], names=[*keys, "p", "n", "u"]).to_batches()

    packed = rows.mapInArrow(sorted_lists, f"{head}s array<{kind}>, p array<int>, n array<int>")
    buckets = packed.repartition(*keys).mapInArrow(ranked, f"{head}p bigint, n bigint, u double")
    # one row per group and bucket from here on
    lower = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = buckets.withColumn("__below", lower).groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("u") + F.col("p") * F.col("__below")).alias("__u"))
    return out.select(*by, "positives", "negatives", (F.col("__u") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("roc_auc"))


def confusion(prob, label, cut: float = 0.5) -> dict[str, Column]:
    """Precision, recall and Brier score as aggregates (0 when undefined)."""
    p, y = c(prob), c(label)
    tp = F.sum(F.when((p >= cut) & (y == 1), 1.0).otherwise(0.0))
    pp = F.sum(F.when(p >= cut, 1.0).otherwise(0.0))
    pos = F.sum(F.when(y == 1, 1.0).otherwise(0.0))
    return {
        "precision": ratio(tp, pp),
        "recall": ratio(tp, pos),
        "brier": F.avg((p - y) * (p - y)),
    }


def mode_smallest(x) -> Column:
    """Most frequent value; the smallest one on ties."""
    return F.mode(c(x), deterministic=True)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group (or of the table when ``by`` is empty)."""
    if not by:
        return df.orderBy(*order).limit(k)
    return (
        df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        .filter(F.col("__r") <= k)
        .drop("__r")
    )


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], *, mode: str = "linear"
) -> DataFrame:
    """Exact quantiles per group without holding a group in one aggregate.

    ``percentile`` keeps every distinct value of a group in one buffer.  Here a
    coarse histogram (tiny after the map-side combine) finds the buckets that
    contain the wanted ranks, and only the rows of those buckets are counted by
    value.  ``mode`` is ``linear`` (interpolated) or ``nearest`` (rank rounded
    half to even).
    """
    rows = df.filter(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("__v"), numeric_bucket(F.col(value)).alias("__b")
    )
    hist = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy(*by).orderBy("__b")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    hist = hist.withColumns(
        {
            "__before": F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"),
            "__total": F.sum("__n").over(whole),
        }
    )
    spots = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(float(p))
        ends = [F.floor(at), F.ceil(at)] if mode == "linear" else [F.bround(at, 0)] * 2
        for side, idx in zip(("lo", "hi"), ends):
            spots.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), idx.cast("bigint").alias("idx"),
                                  (at - F.floor(at)).alias("frac")))
    wanted = (
        hist.select(*by, "__b", "__before", "__n", F.explode(F.array(*spots)).alias("s"))
        .filter((F.col("s.idx") >= F.col("__before")) & (F.col("s.idx") < F.col("__before") + F.col("__n")))
        .select(*by, "__b", "__before", "s.*")
    )
    # the wanted buckets are a few rows per group
    on = [*by, "__b"]
    values = rows.join(wanted.select(*on).distinct(), on, "left_semi").groupBy(*on, "__v").agg(F.count(F.lit(1)).alias("__m"))
    w = W.partitionBy(*on).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("__upto", F.sum("__m").over(w))
    picked = (
        wanted.join(values, on)
        .filter(F.col("__before") + F.col("__upto") > F.col("idx"))
        .groupBy(*by, "name", "side")
        .agg(F.min("__v").alias("__v"), F.max("frac").alias("frac"))
    )
    pick = lambda n, side, c: F.max(F.when((F.col("name") == n) & (F.col("side") == side), F.col(c)))
    out = []
    for name in probs:
        lo, hi, frac = pick(name, "lo", "__v"), pick(name, "hi", "__v"), pick(name, "lo", "frac")
        out.append((lo + (hi - lo) * (frac if mode == "linear" else F.lit(0.0))).alias(name))
    return picked.groupBy(*by).agg(*out)


def _sorted_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, NaN last."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


def _known(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).drop_null().to_numpy(zero_copy_only=False)


#: Bits of a double that a coarse bucket leaves out: 256 buckets per octave remain.
_COARSE = 44


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """Exact interpolated quantiles of many columns: ``{column: {name: value}}``, without columns that are all null.

    As ``exact_quantiles``, but values are not turned into rows: tasks return a
    coarse histogram per column, and a second pass the counts by value of the
    buckets with the wanted ranks, of which each quantile has one or two.
    """
    if not cols:
        return {}
    data = df.select(*[F.col(x).cast("double").alias(f"__c{i}") for i, x in enumerate(cols)])

    def histogram(batches):
        held = [(np.array([], np.int64), np.array([], np.int64))] * len(cols)
        for batch in batches:
            for i, (b, n) in enumerate(held):
                new, count = np.unique(_sorted_bits(_known(batch, i)) >> _COARSE, return_counts=True)
                b, at = np.unique(np.append(b, new), return_inverse=True)
                held[i] = b, np.bincount(at, np.append(n, count), len(b)).astype(np.int64)
        for i, (b, n) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, np.int32)), pa.array(b), pa.array(n)], names=["i", "b", "n"])

    def ends(total: int) -> dict[str, tuple[int, int, float]]:
        at = {name: (total - 1) * float(p) for name, p in probs.items()}
        return {name: (math.floor(x), math.ceil(x), x - math.floor(x)) for name, x in at.items()}

    hist = data.mapInArrow(histogram, "i int, b bigint, n bigint").groupBy("i", "b").agg(F.sum("n").alias("n"))
    order = W.partitionBy("i").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy("i"))})
    ranks = [(F.col("total") - 1) * F.lit(float(p)) for p in probs.values()]
    spots = [f(r).cast("bigint") for r in ranks for f in (F.floor, F.ceil)]
    inside = reduce(lambda a, b: a | b, [(e >= F.col("upto") - F.col("n")) & (e < F.col("upto")) for e in spots])
    # one or two buckets per column and quantile
    rows = hist.filter(inside).collect()
    wanted = {i: np.array([r["b"] for r in rows if r["i"] == i]) for i in {r["i"] for r in rows}}

    def values(batches):
        for batch in batches:
            for i, b in wanted.items():
                x = _known(batch, i)
                v, m = np.unique(x[np.isin(_sorted_bits(x) >> _COARSE, b)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(m.astype(np.int64))], names=["i", "v", "m"])

    near = data.mapInArrow(values, "i int, v double, m bigint").groupBy("i", "v").agg(F.sum("m").alias("m"))
    near = near.withColumn("upto", F.sum("m").over(W.partitionBy("i").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    # the place of a wanted rank among the values of its column's wanted buckets
    places: dict[int, dict[int, int]] = {}
    total = {r["i"]: r["total"] for r in rows}
    for i, n in total.items():
        mine = sorted((r["b"], r["upto"] - r["n"], r["n"]) for r in rows if r["i"] == i)
        before = np.append(0, np.cumsum([n for _, _, n in mine]))
        places[i] = {e: int(before[k] + e - first) for lo, hi, _ in ends(n).values() for e in (lo, hi) for k, (_, first, n) in enumerate(mine) if first <= e < first + n}
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).cast("bigint").alias("k")) for i, p in places.items() for k in sorted(set(p.values()))])
    hit = F.filter(pairs, lambda s: (s["i"] == F.col("i")) & (s["k"] < F.col("upto")) & (s["k"] >= F.col("upto") - F.col("m")))
    found = {(r["i"], s["k"]): r["v"] for r in near.select("i", "v", hit.alias("s")).filter(F.size("s") > 0).collect() for s in r["s"]} if rows else {}
    at = lambda i, e: found[i, places[i][e]]
    return {cols[i]: {name: at(i, lo) + (at(i, hi) - at(i, lo)) * part for name, (lo, hi, part) in ends(n).items()} for i, n in total.items()}


#: Parts of a bucket that ``column_bins`` counts apart, and of one with a median, as bits.
_PARTS, _MIDDLE_PARTS = 4, 12


def _merged(key: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, rows, least, greatest) per key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.array([], np.int64)
    if not len(at):
        return key, n, lo, hi
    return key[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


def column_bins(df: DataFrame, cols: list[str], bins: int, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Exact medians (0 without values), and ends of up to ``bins`` bins per column, the last one without its end: ``value <= end``.

    Nulls of the ``total`` rows count as the column's median.  A column of up to
    ``bins`` values has a bin for each; others have bins of about equal numbers
    of rows.  Tasks count buckets of the values' bits; buckets that hold more
    than a quarter of a bin or a median, or any that hold several values while a
    column has few buckets, are counted again in parts between their least and
    greatest value.  An end is midway between neighbours.
    """
    data = df.select(*[F.col(x).cast("double").alias(f"__c{i}") for i, x in enumerate(cols)])
    # per column: rows, least and greatest value (as bits) of the buckets in order
    held = [np.zeros((0, 3), np.int64) for _ in cols]
    wanted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
    while wanted is None or any(len(w[0]) for w in wanted):

        def counted(batches, wanted=wanted):
            found = [(np.array([], np.int64),) * 4 for _ in cols]
            for batch in batches:
                for i in range(len(cols)):
                    if wanted is not None and not len(wanted[i][0]):
                        continue
                    v = np.sort(_sorted_bits(_known(batch, i)))
                    if wanted is None:
                        key = v >> _COARSE
                    else:
                        lo, hi, shift = wanted[i]
                        k = np.searchsorted(lo, v, side="right") - 1
                        inside = (k >= 0) & (v <= hi[k])
                        v, k = v[inside], k[inside]
                        key = (k << (_MIDDLE_PARTS + 1)) + ((v - lo[k]) >> shift[k])
                    if len(v):
                        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                        ends = np.append(at[1:], len(v))
                        found[i] = _merged(*[np.append(a, b) for a, b in zip(found[i], (key[at], ends - at, v[at], v[ends - 1]))])
            for i, part in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), i, np.int32)), *map(pa.array, part)], names=["i", "b", "n", "lo", "hi"])

        # some thousand buckets per column
        table = data.mapInArrow(counted, "i int, b bigint, n bigint, lo bigint, hi bigint").groupBy("i", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
        for i, old in enumerate(held):
            if wanted is not None:
                old = old[~np.isin(old[:, 1], wanted[i][0])]
            new = table.loc[table["i"] == i, ["n", "lo", "hi"]].to_numpy(np.int64)
            both = np.vstack([old, new])
            held[i] = both[np.argsort(both[:, 1])]
        wanted = []
        for n, lo, hi in (b.T for b in held):
            middle = np.isin(np.arange(len(n)), _middle(n))
            again = (lo < hi) & ((n > n.sum() / (4 * bins)) | (len(n) <= bins) | middle)
            # the values of a bucket are less than 2 ** 44 apart
            shift = [max(int(b - a).bit_length() - (_MIDDLE_PARTS if m else _PARTS), 0) for a, b, m in zip(lo[again], hi[again], middle[again])]
            wanted.append((lo[again], hi[again], np.array(shift, np.int64)))
    medians, ends = np.zeros(len(cols)), []
    for i, b in enumerate(held):
        if len(b):
            medians[i] = _doubles(b[_middle(b[:, 0]), 1]).sum() / 2.0
        nulls, m = total - b[:, 0].sum(), int(_sorted_bits(medians[i : i + 1])[0])
        at = np.flatnonzero((b[:, 1] <= m) & (m <= b[:, 2]))
        if nulls and len(at):
            b[at[0], 0] += nulls
        elif nulls:
            b = np.insert(b, np.searchsorted(b[:, 1], m), (nulls, m, m), axis=0)
        ends.append(_ends(*b.T, bins))
    return medians, ends


def _middle(n: np.ndarray) -> np.ndarray:
    """Places of the buckets with the lower and the upper middle row."""
    upto = np.cumsum(n)
    return np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right") if len(n) else np.array([], np.int64)


def _doubles(bits: np.ndarray) -> np.ndarray:
    """The doubles of ``_sorted_bits``."""
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits).view(np.float64)


def _ends(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Ends after all buckets but the last, or after those in which a quantile lies."""
    at = np.arange(len(n) - 1)
    if len(n) > bins:
        upto = np.cumsum(n)
        at = np.unique(np.searchsorted(upto, np.arange(1, bins) * (upto[-1] / bins), side="left"))
        at = at[at < len(n) - 1]
    a, b = _doubles(hi[at]), _doubles(lo[at + 1])
    with np.errstate(invalid="ignore"):
        middle = a / 2 + b / 2
    return np.where((middle >= a) & (middle < b), middle, a)


def unpivot_numeric(df: DataFrame, ids: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to (ids, name, value) rows."""
    return df.select(*ids, *[F.col(x).cast("double").alias(x) for x in cols]).unpivot(ids, cols, name, value)
