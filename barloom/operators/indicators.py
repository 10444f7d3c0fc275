"""Bar indicators over a symbol's whole history, without a window per symbol.

Bars are cut into blocks by their running number.  Rolling indicators see the
last bars of the previous block (a halo); recursive ones (exponential and
Wilder averages) are affine recurrences, composed over stretches of bars.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.asof import asof
from barloom.operators.sessions import number_bars

BLOCK = 4096


def with_halo(numbered: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Rows of each block plus the ``width`` rows before it (tagged ``halo``)."""
    own = F.floor(F.col("bar_no") / block)
    nxt = F.when(F.pmod(F.col("bar_no"), F.lit(block)) >= block - width, own + 1)
    return numbered.withColumn("block", F.explode(F.array_compact(F.array(own, nxt)))).withColumn("halo", F.col("block") != own)


def rolling_indicators(bars: DataFrame, period: int = 14, block: int = BLOCK) -> DataFrame:
    """stddev, mfi, choppiness_index and simple-average atr per bar."""
    h = with_halo(number_bars(bars), period + 1, block)
    key = W.partitionBy("symbol", "block").orderBy("bar_no")
    win = key.rowsBetween(-(period - 1), 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    h = h.withColumns({"pc": F.lag("close").over(key), "tp": tp, "ptp": F.lag(tp).over(key)})
    # the first bar of a symbol has no previous close; the halo's first row is never kept
    h = h.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))))
    flow = F.col("tp") * F.col("volume")
    up = F.sum(F.when(F.col("tp") > F.col("ptp"), flow).otherwise(0.0)).over(win)
    down = F.sum(F.when(F.col("tp") < F.col("ptp"), flow).otherwise(0.0)).over(win)
    full = F.count("close").over(win) == period
    span = F.max("high").over(win) - F.min("low").over(win)
    chop = 100.0 * F.log10(F.sum("tr").over(win) / F.when(span > 0, span)) / F.log10(F.lit(float(period)))
    out = h.withColumns(
        {
            "atr": F.when(full, F.avg("tr").over(win)),
            "stddev": F.when(full, F.stddev_samp("close").over(win)),
            "mfi": F.when(full, F.when(up + down > 0, 100.0 * up / (up + down)).otherwise(50.0)),
            "choppiness_index": F.when(full, chop),
        }
    )
    return out.filter(~F.col("halo")).select("symbol", "session_date", "sod", "bar_no", "atr", "stddev", "mfi", "choppiness_index")


#: Largest weight of a row inside a stretch of a recurrence, and the share of an old value that counts as gone.
WEIGHT, GONE = 1e8, 1e-20


def recurrences(numbered: DataFrame, inputs: dict[str, tuple[str, float]], block: int = BLOCK) -> DataFrame:
    """y[t] = a x[t] + (1 - a) y[t-1] per symbol, seeded with the first input.

    ``inputs``: {name: (column, a)}.  Inside a stretch of bars y is a weighted
    running sum; a stretch as a whole maps the value before it to the value
    behind it by one pair (decay, sum).  The pairs of the stretches before it,
    as far back as their decay leaves anything of them, give a row's carry.
    ``block`` is the number of stretches one window sees.
    """
    decays = {n: 1 - a for n, (_, a) in inputs.items()}
    slow = [d for d in decays.values() if 0 < d < 1]
    width = max(1, min([64] + [int(math.log(WEIGHT) / -math.log(d)) for d in slow]))
    reach = max([1] + [math.ceil(math.log(GONE) / (width * math.log(d))) for d in slow])
    at = F.col("bar_no") - 1
    rows = numbered.select("symbol", "bar_no", F.floor(at / width).alias("stretch"), (F.pmod(at, F.lit(width)) + 1).alias("step"), *[F.col(c).alias(f"x_{n}") for n, (c, _) in inputs.items()])
    so_far = W.partitionBy("symbol", "stretch").orderBy("bar_no").rowsBetween(W.unboundedPreceding, 0)

    def local(n: str):
        a, d = inputs[n][1], decays[n]
        term = F.when(F.col("bar_no") == 1, F.col(f"x_{n}")).otherwise(a * F.col(f"x_{n}"))
        return term if d == 0 else F.sum(term * F.pow(F.lit(d), -F.col("step"))).over(so_far) * F.pow(F.lit(d), F.col("step"))

    loc = rows.select("symbol", "bar_no", "stretch", "step", *[local(n).alias(n) for n in inputs])
    ends = loc.groupBy("symbol", "stretch").agg(*[F.max_by(n, "step").alias(n) for n in inputs])
    near = with_halo(ends.withColumn("bar_no", F.col("stretch")), min(reach, block), block)
    before = W.partitionBy("symbol", "block").orderBy("bar_no").rowsBetween(-reach, -1)
    folded = lambda n: F.aggregate(F.collect_list(n).over(before), F.lit(0.0), lambda y, v: y * decays[n] ** width + v)
    carried = near.withColumns({f"c_{n}": folded(n) for n in inputs}).filter(~F.col("halo")).select("symbol", "stretch", *[f"c_{n}" for n in inputs])
    j = loc.join(carried, ["symbol", "stretch"])
    return j.select("symbol", "bar_no", *[(F.col(n) + F.pow(F.lit(d), F.col("step")) * F.col(f"c_{n}")).alias(n) for n, d in decays.items()])


def recursive_indicators(bars: DataFrame, *, rsi: int = 14, ema: int = 20, block: int = BLOCK) -> DataFrame:
    """Exponential average of the close and Wilder relative strength."""
    n = number_bars(bars)
    h = with_halo(n, 1, block)
    prev = F.lag("close").over(W.partitionBy("symbol", "block").orderBy("bar_no"))
    d = h.withColumn("d", F.coalesce(F.col("close") - prev, F.lit(0.0))).filter(~F.col("halo")).withColumns(
        {"gain": F.greatest("d", F.lit(0.0)), "loss": F.greatest(-F.col("d"), F.lit(0.0))}
    )
    r = recurrences(d, {"ema": ("close", 2.0 / (ema + 1)), "g": ("gain", 1.0 / rsi), "l": ("loss", 1.0 / rsi)}, block)
    strength = F.when(F.col("g") + F.col("l") > 0, 100.0 * F.col("g") / (F.col("g") + F.col("l"))).otherwise(50.0)
    return n.select("symbol", "session_date", "sod", "bar_no").join(r, ["symbol", "bar_no"]).select(
        "symbol", "session_date", "sod", "bar_no", "ema", strength.alias("rsi")
    )


def indicators(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """All six indicators per bar."""
    return rolling_indicators(bars, block=block).join(recursive_indicators(bars, block=block).drop("session_date", "sod"), ["symbol", "bar_no"])


def snapshot(cands: DataFrame, ind: DataFrame, cols: list[str]) -> DataFrame:
    """Last indicator row strictly before each candidate's cutoff, prefixed ``eng_``."""
    at = lambda d, s: F.timestamp_seconds(F.unix_date(F.col(d)).cast("bigint") * 86400 + F.col(s))
    c = cands.dropDuplicates(["candidate_id"]).select("candidate_id", "symbol", at("session_date", "decision_sod").alias("t"))
    r = ind.select("symbol", at("session_date", "sod").alias("bt"), *cols)
    out = asof(c, r, by=["symbol"], left_time="t", right_time="bt", key="bt", take=cols, strict=True, prefix="eng_")
    return out.drop("t")
