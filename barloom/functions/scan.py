"""Running aggregates that never need one group in one task.

``Window.partitionBy(g).orderBy(t)`` sorts a whole group in one task; with one
hot group that task is the job.  ``running`` splits each group into buckets
that follow the order, computes the window inside the buckets, one total per
bucket (partial aggregation), a carry over the small bucket table, and joins
the carry back on the bucket key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import micros

#: Width of a time bucket in seconds.
TIME_BUCKET = 6 * 3600
#: Buckets per octave of a numeric order column.
PER_OCTAVE = 256
#: Rows of an integer tie-breaker that share a bucket.
TIE_BUCKET = 1 << 16


def numeric_bucket(x: Column) -> Column:
    """Monotone bucket number of any double, 0.3 % wide at every magnitude."""
    d = x.cast("double")
    size = F.lit(300_000) + F.floor(F.log2(F.abs(d)) * PER_OCTAVE)
    return F.when(d > 0, size).when(d < 0, -size).when(d == 0, F.lit(0))


def _bucket(df: DataFrame, name: str, first: bool) -> Column | None:
    kind = df.schema[name].dataType.typeName()
    x = F.col(name)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.floor(micros(x, kind) / F.lit(TIME_BUCKET * 1_000_000))
    if kind == "date":
        return F.unix_date(x).cast("bigint")
    whole = kind in ("byte", "short", "integer", "long")
    if whole and not first:
        return F.floor(x / F.lit(TIE_BUCKET))
    if first and (whole or kind in ("double", "float", "decimal")):
        return numeric_bucket(x)
    return None


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, str | Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Add running aggregates ``{name: (fn, column)}`` along ``order`` per ``by``.

    ``fn`` is ``sum``, ``count``, ``max``, ``min`` or ``last`` (last non-null
    value).  ``inclusive=False`` leaves the current row out, ``reverse=True``
    runs from the end.  ``order`` must identify rows within a group.
    """
    buckets: dict[str, Column] = {}
    for i, name in enumerate(order):
        b = _bucket(df, name, i == 0)
        if b is None:
            break
        buckets[f"__b{i}"] = b
        # a deeper bucket level only splits rows that tie on the levels above
        if i == 0 and df.schema[name].dataType.typeName() != "date":
            break
    names = list(buckets)
    src = {f"__v{i}": (F.lit(1) if fn == "count" else (F.expr(col) if isinstance(col, str) else col))
           for i, (fn, col) in enumerate(aggs.values())}
    fns = [fn for fn, _ in aggs.values()]
    rows = df.withColumns({**buckets, **src})

    def dirs(cols):
        return [F.col(x).desc() if reverse else F.col(x).asc() for x in cols]

    end = 0 if inclusive else -1
    inner = W.partitionBy(*by, *names).orderBy(*dirs(order)).rowsBetween(W.unboundedPreceding, end)
    local, total, carry = {}, [], []
    outer = W.partitionBy(*by).orderBy(*dirs(names)).rowsBetween(W.unboundedPreceding, -1)
    for i, fn in enumerate(fns):
        v, t = F.col(f"__v{i}"), F.col(f"__t{i}")
        if fn == "last":
            local[f"__w{i}"] = F.last(v, ignorenulls=True).over(inner)
            key = F.when(v.isNotNull(), F.struct(*order, v.alias("__x")))
            total.append((F.min(key) if reverse else F.max(key)).alias(f"__t{i}"))
            carry.append(F.last(t, ignorenulls=True).over(outer)["__x"].alias(f"__c{i}"))
        else:
            g = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[fn]
            local[f"__w{i}"] = g(v).over(inner)
            total.append(g(v).alias(f"__t{i}"))
            carry.append(g(t).over(outer).alias(f"__c{i}"))
    totals = rows.groupBy(*by, *names).agg(*total)
    carried = totals.select(*[F.col(x).alias(f"__k_{x}") for x in by + names], *carry)
    on = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"__k_{x}")) for x in by + names])
    joined = rows.withColumns(local).join(carried, on, "left")
    out = {}
    for i, (name, fn) in enumerate(zip(aggs, fns)):
        w, k = F.col(f"__w{i}"), F.col(f"__c{i}")
        if fn in ("sum", "count"):
            merged = F.coalesce(w + k, w, k)
            out[name] = F.coalesce(merged, F.lit(0)) if fn == "count" else merged
        elif fn == "max":
            out[name] = F.greatest(w, k)
        elif fn == "min":
            out[name] = F.least(w, k)
        else:
            out[name] = F.coalesce(w, k)
    return joined.select(*df.columns, *[v.alias(n) for n, v in out.items()])


def running_drawdown(df: DataFrame, by: list[str], order: list[str], value: str, *, floor_zero: bool = True) -> DataFrame:
    """Add ``cum_pnl_r`` and ``drawdown_r`` along ``order`` per ``by`` in one pass.

    A bucket is summarised by its sum and the peak of its own running sum; both
    carries follow from the small bucket table.  With ``floor_zero`` the peak
    starts at 0, otherwise at the first cumulative value.
    """
    buckets: dict[str, Column] = {}
    for i, name in enumerate(order):
        b = _bucket(df, name, i == 0)
        if b is None:
            break
        buckets[f"__b{i}"] = b
        if i == 0 and df.schema[name].dataType.typeName() != "date":
            break
    names = list(buckets)
    inner = W.partitionBy(*by, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumns(buckets).withColumn("__cum", F.sum(value).over(inner)).withColumn("__top", F.max("__cum").over(inner))
    outer = W.partitionBy(*by).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    table = rows.groupBy(*by, *names).agg(F.sum(value).alias("__s"), F.max("__cum").alias("__m"))
    table = table.withColumn("__c", F.coalesce(F.sum("__s").over(outer), F.lit(0.0)))
    table = table.withColumn("__p", F.max(F.col("__c") + F.col("__m")).over(outer))
    carry = table.select(*[F.col(x).alias(f"__k_{x}") for x in by + names], "__c", "__p")
    on = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"__k_{x}")) for x in by + names])
    cum = F.col("__c") + F.col("__cum")
    peak = F.greatest(F.col("__c") + F.col("__top"), F.col("__p"), *([F.lit(0.0)] if floor_zero else []))
    return rows.join(carry, on, "left").select(*df.columns, cum.alias("cum_pnl_r"), (cum - peak).alias("drawdown_r"))
