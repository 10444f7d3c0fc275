"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Shift that keeps decimal ties from rounding by the order of a sum.
TIE = 1e-9


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def r6(x) -> Column:
    """Round for output; see ``round_doubles``."""
    return F.round(c(x) + TIE, 6) + F.lit(0.0)


def ratio(num, den, default: float | None = 0.0) -> Column:
    """``num / den``, with ``default`` where the divisor is zero or null."""
    q = c(num) / F.nullif(c(den), F.lit(0.0))
    return q if default is None else F.coalesce(q, F.lit(default))


def num0(x) -> Column:
    """Null and NaN count as zero, the convention for missing policy features."""
    return F.coalesce(F.nanvl(c(x).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds (null counts as false)."""
    return F.avg(flag(cond))


def ladder(rules: Iterable[tuple[Column, object]], default) -> Column:
    """Ordered ``when`` ladder: the first rule that holds decides."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    tail = default if isinstance(default, Column) else F.lit(default)
    return tail if out is None else out.otherwise(tail)


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(float(lo))), F.lit(float(hi)))


def micros(x, kind: str) -> Column:
    """Microseconds of a time column; local times do not pass through a zone."""
    t = c(x)
    if kind == "timestamp":
        return F.unix_micros(t)
    whole = F.unix_date(F.to_date(t)).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def hhmm(ts) -> Column:
    return F.date_format(c(ts), "HH:mm")


def at(session_date, sod) -> Column:
    """Wall-clock time of ``sod`` seconds into the session's local date."""
    return c(session_date).cast("timestamp_ntz") + F.make_dt_interval(secs=c(sod).cast("decimal(18,6)"))


def iso(session_date, sod) -> Column:
    return F.date_format(at(session_date, sod), "yyyy-MM-dd'T'HH:mm:ss")


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column for stable output.

    A tie in the last place would round by the order in which a sum was added;
    the shift moves ties away, and the added zero turns -0.0 into 0.0.
    """
    return df.select(
        *[
            (F.round(F.col(f.name) + TIE, places) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


#: Most rows a configured table (policies, thresholds, paths) may have.
MAX_CONFIG_ROWS = 1024


def fan_out(df: DataFrame, table: DataFrame) -> DataFrame:
    """Every row of ``df`` once per row of a configured table, without a join.

    The table is configuration (policies, thresholds, label settings); its
    rows become literals of an exploded array.  A larger table is refused.
    """
    rows = table.limit(MAX_CONFIG_ROWS + 1).collect()
    if len(rows) > MAX_CONFIG_ROWS:
        raise ValueError(f"configured table has more than {MAX_CONFIG_ROWS} rows")

    def lit(value, kind):
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).cast(kind)
        return F.lit(value).cast(kind)

    fields = table.schema.fields
    if not rows:
        return df.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    options = F.array(*[F.struct(*[lit(r[f.name], f.dataType).alias(f.name) for f in fields]) for r in rows])
    return df.withColumn("__o", F.explode(options)).select(*df.columns, *[F.col("__o")[f.name].alias(f.name) for f in fields])


def fan_out_small(df: DataFrame, small: DataFrame) -> DataFrame:
    """Like ``fan_out`` for a few rows that are computed from data (paths, names).

    The rows travel as one array in one broadcast row.
    """
    packed = small.agg(F.collect_list(F.struct(*small.columns)).alias("__s"))
    return df.crossJoin(F.broadcast(packed)).withColumn("__o", F.explode("__s")).select(*df.columns, "__o.*")
