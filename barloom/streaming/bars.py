"""Streaming twins of resampling and of the event-driven engine."""

from __future__ import annotations

from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.attempts import ATTEMPT_DDL, Break, step
from barloom.schemas import SessionSpec


def stream_resample(bars: DataFrame, seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """Coarse bars from a stream of fine bars (event time ``event_time``)."""
    at = F.col("event_time")
    return (
        bars.withWatermark("event_time", watermark)
        .groupBy("symbol", F.window("event_time", f"{seconds} seconds"))
        .agg(
            F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("event_time"), "open", "high", "low", "close", "volume")
    )


_STATE_DDL = (
    "side int, at int, done int, close double, high double, low double, reach double, reach_at int, pivot double, pivot_at int, "
    "pulls int, reclaims int, outside boolean, breaks int, tries_up int, tries_down int"
)


def stream_attempts(events: DataFrame, spec: SessionSpec, *, buffer: float = 0.0, cap: int = 0) -> DataFrame:
    """Attempts from a stream of zone-tagged events, state per (symbol, session).

    Each micro-batch must carry events in completion order per session, which
    is how bars arrive; the state of a session is dropped with its last bar.
    """
    names = [x.strip().split(" ")[0] for x in ATTEMPT_DDL.split(",")]

    def advance(key, frames, state: GroupState):
        s = Break(*[v if not pd.isna(v) else None for v in state.get]) if state.exists else Break()
        out = []
        pdf = pd.concat(list(frames))
        pdf = pdf.assign(rank=~pdf["coarse"]).sort_values(["t", "rank", "sod"], kind="stable")
        for ev in pdf.to_dict("records"):
            hit = step(s, ev, spec, buffer=buffer, cap=cap)
            if hit:
                out.append({"symbol": key[0], "session_date": key[1], **hit})
        if pdf["t"].max() >= spec.session_end:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(asdict(s).values()))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy("symbol", "session_date").applyInPandasWithState(
        advance, ATTEMPT_DDL, _STATE_DDL, "append", GroupStateTimeout.NoTimeout
    )
