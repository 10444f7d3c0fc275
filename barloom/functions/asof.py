"""As-of and bounded-window joins, built from unions and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scan import running


def asof(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    left_time: str,
    right_time: str,
    key: str,
    take: list[str],
    direction: str = "backward",
    strict: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Attach to each left row the nearest right row before or after it.

    Both sides are stacked and the last right row is carried along the order
    (time, side); the order of sides at equal times decides strict or
    non-strict.  ``key`` makes right rows unique at one time.
    """
    payload = F.struct(*[F.col(x).alias(x) for x in take])
    backward = direction == "backward"
    # at equal times a right row must come first for the left row to see it
    right_side = 1 if strict == backward else 0
    l = left.select(
        F.struct(*left.columns).alias("__l"), *by, F.col(left_time).alias("__t"), F.lit(1 - right_side).alias("__side"),
        F.lit(None).cast(right.schema[key].dataType).alias("__key"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"),
    )
    r = right.select(
        F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), *by, F.col(right_time).alias("__t"),
        F.lit(right_side).alias("__side"), F.col(key).alias("__key"), payload.alias("__r"),
    )
    both = running(
        l.unionByName(r), by, ["__t", "__side", "__key"], {"__hit": ("last", "__r")},
        inclusive=True, reverse=not backward,
    )
    return both.filter(F.col("__l").isNotNull()).select(
        *[F.col("__l")[x].alias(x) for x in left.columns],
        *[F.col("__hit")[x].alias(prefix + x) for x in take],
    )


def forward_window(events: DataFrame, bars: DataFrame, *, start: str, length: str, max_length: int, carry: list[str], bar_cols: list[str]) -> DataFrame:
    """Rows ``bars[start .. start + length)`` of each event, numbered by ``k``.

    Bars carry ``bar_no`` (running number per symbol), ``pos`` (number inside
    the session) and events carry the session of their first bar.  Bars of the
    event's own session are reached on the session key, which is how bars are
    already partitioned; only the part that runs past the session end goes
    through an exploded equi-join on ``(symbol, bar_no)``, and that join reads
    only the leading bars of each session.  ``max_length`` is the longest
    ``length`` among the events; a longer one fails instead of being cut.
    """
    events = events.withColumn(
        length,
        F.when(F.col(length) <= max_length, F.col(length)).otherwise(
            F.raise_error(F.lit(f"forward window longer than max_length={max_length}")).cast("int")
        ),
    )
    last = F.col(start) + F.col(length) - 1
    b = bars.select("symbol", "session_date", "bar_no", "pos", *bar_cols)
    own = (
        events.select("symbol", "session_date", start, length, *carry)
        .join(b.drop("pos"), ["symbol", "session_date"])
        .filter(F.col("bar_no").between(F.col(start), last))
    )
    spill = (
        events.filter(last > F.col("session_last_no"))
        .select(
            "symbol", start, length, *carry,
            F.explode(F.sequence(F.greatest(F.col(start), F.col("session_last_no") + 1), last)).alias("bar_no"),
        )
        # past the session end a window meets only the head of later sessions
        .join(b.filter(F.col("pos") <= F.lit(max_length)).drop("pos"), ["symbol", "bar_no"])
    )
    cols = ["symbol", start, length, *carry, "session_date", "bar_no", *bar_cols]
    both = own.select(*cols).unionByName(spill.select(*cols))
    return both.withColumn("k", (F.col("bar_no") - F.col(start) + 1).cast("int"))

