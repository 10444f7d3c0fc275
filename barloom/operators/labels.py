"""Forward labels: first touch of stop or target within a bar horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.asof import forward_window
from barloom.functions.columns import fan_out, iso
from barloom.operators.sessions import number_bars
from barloom.schemas import SESSION_KEY, SessionSpec
from barloom.session import cut


def entry_numbers(events: DataFrame, numbered: DataFrame, time: str = "decision_sod") -> DataFrame:
    """Number of the first bar at or after the event time (forward as-of).

    Events and bars of a session are stacked; the bars already passed are
    counted.  An event after the last bar lands on the next session's first.
    """
    marks = numbered.select(
        *SESSION_KEY, F.col("sod").alias("__t"), F.lit(1).alias("__side"), F.lit(1).alias("__bar"), "bar_no", "session_last_no",
        F.lit(None).cast("string").alias("__id"),
    )
    asks = events.select(
        *SESSION_KEY, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(0).alias("__bar"), F.lit(None).cast("bigint").alias("bar_no"),
        F.lit(None).cast("bigint").alias("session_last_no"), F.col("event_key").alias("__id"),
    )
    w = W.partitionBy(*SESSION_KEY).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*SESSION_KEY)
    found = (
        marks.unionByName(asks)
        .withColumns(
            {
                "__passed": F.sum("__bar").over(w),
                "__first": F.min("bar_no").over(whole),
                "__last": F.max("session_last_no").over(whole),
            }
        )
        .filter(F.col("__side") == 0)
        .select(
            *SESSION_KEY, F.col("__id").alias("event_key"), (F.col("__first") + F.col("__passed")).alias("start_no"),
            F.col("__last").alias("session_last_no"),
        )
    )
    return events.join(found, [*SESSION_KEY, "event_key"])


def triple_barrier(
    bars: DataFrame,
    cands: DataFrame,
    spec: SessionSpec,
    *,
    horizon: int = 20,
    stop_multiple: float = 1.0,
    target_multiple: float = 1.5,
    policies: DataFrame | None = None,
    max_horizon: int | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Label each candidate; ``policies`` (a configured list of label settings,
    columns label_policy, horizon_bars, stop_multiple, target_multiple) labels
    under many settings in one job.
    """
    key = key or ["candidate_id"]
    if policies is None:
        ev = cands.withColumns(
            {
                "horizon_bars": F.lit(horizon),
                "stop_multiple": F.lit(float(stop_multiple)),
                "target_multiple": F.lit(float(target_multiple)),
            }
        )
        pol = []
    else:
        ev = fan_out(cands, policies)
        pol = ["label_policy"]
    group = [*key, *pol]
    # a few events per session, read by four branches below: stored once
    ev = cut(ev.dropDuplicates(group).withColumn("event_key", F.concat_ws("\u0001", *group)))
    numbered = number_bars(bars)
    long = F.col("direction") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    ev = entry_numbers(ev, numbered).withColumns(
        {
            "risk": F.greatest(F.col("zone_width") * F.col("stop_multiple"), F.lit(spec.min_points)),
            "sign": sign,
        }
    )
    ev = ev.withColumns(
        {
            "stop_price": F.col("entry_price") - sign * F.col("risk"),
            "target_price": F.col("entry_price") + sign * F.col("zone_width") * F.col("target_multiple"),
        }
    )
    path = forward_window(
        ev, numbered, start="start_no", length="horizon_bars", max_length=max_horizon or horizon,
        carry=["event_key", "sign", "entry_price", "stop_price", "target_price", "session_last_no"],
        bar_cols=["sod", "high", "low", "close"],
    )
    up = F.col("sign") > 0
    fav = F.when(up, F.col("high") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("low"))
    adv = F.when(up, F.col("low") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("high"))
    stop = F.when(up, F.col("low") <= F.col("stop_price")).otherwise(F.col("high") >= F.col("stop_price"))
    target = F.when(up, F.col("high") >= F.col("target_price")).otherwise(F.col("low") <= F.col("target_price"))
    w = W.partitionBy("event_key").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    path = path.withColumns(
        {
            "mfe": F.greatest(F.max(fav).over(w), F.lit(0.0)),
            "mae": F.least(F.min(adv).over(w), F.lit(0.0)),
            "stop_hit": stop,
            "target_hit": target,
        }
    )
    at_row = F.struct("k", "mfe", "mae", "close", "stop_hit", "target_hit", "session_date", "sod")
    hit = F.col("stop_hit") | F.col("target_hit")
    ends = path.groupBy("event_key").agg(
        F.coalesce(F.min_by(F.when(hit, at_row), F.when(hit, F.col("k"))), F.max_by(at_row, "k")).alias("end")
    )
    out = ev.join(ends, "event_key", "left")
    s, t = F.coalesce(F.col("end.stop_hit"), F.lit(False)), F.coalesce(F.col("end.target_hit"), F.lit(False))
    exit_price = F.when(s, F.col("stop_price")).when(t, F.col("target_price")).otherwise(F.col("end.close"))
    pnl = F.col("sign") * (F.coalesce(exit_price, F.col("entry_price")) - F.col("entry_price"))
    return out.select(
        *key,
        *pol,
        "symbol",
        "session_date",
        "direction",
        F.when(t & ~s, 1).otherwise(0).alias("label"),
        F.when(s & t, "ambiguous_stop_first").when(s, "stop").when(t, "target").otherwise("timeout").alias("outcome"),
        iso("session_date", "decision_sod").alias("entry_time"),
        "decision_sod",
        "entry_price",
        "stop_price",
        "target_price",
        F.when(F.col("end").isNotNull(), iso("end.session_date", "end.sod")).alias("exit_time"),
        exit_price.alias("exit_price"),
        F.coalesce(F.col("end.k"), F.lit(0)).alias("bars_held"),
        F.coalesce(F.col("end.mfe"), F.lit(0.0)).alias("mfe"),
        F.coalesce(F.col("end.mae"), F.lit(0.0)).alias("mae"),
        (pnl / F.col("risk")).alias("pnl_r"),
    )


def label_summary(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, positive rate, mean R and outcome counts."""
    return labels.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("label").alias("positive_rate"),
        F.avg("pnl_r").alias("avg_pnl_r"),
        *[
            F.count(F.when(F.col("outcome") == o, 1)).alias(f"outcome_{o}")
            for o in ("target", "stop", "timeout", "ambiguous_stop_first")
        ],
    )
