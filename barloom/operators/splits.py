"""Time-ordered splits: walk-forward folds, combinatorial paths, purging."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.functions.columns import fan_out_small, ladder, ratio
from barloom.functions.scan import running
from barloom.session import cut


def session_ranks(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ordinal of each session date (0-based), per ``by``: one row per date, never per event."""
    dates = rows.select(*(by or []), "session_date").filter(F.col("session_date").isNotNull()).distinct()
    return dates.withColumn("session_no", F.row_number().over(W.partitionBy(*(by or [])).orderBy("session_date")) - 1)


def fold_table(sessions: DataFrame, *, min_train: int = 10, test: int = 5, step: int | None = None) -> DataFrame:
    """Expanding walk-forward folds as session-number bounds."""
    step = step or test
    n = sessions.agg(F.count(F.lit(1)).alias("n"))
    last = F.col("n") - test
    return (
        n.filter(last >= min_train)
        .select(F.posexplode(F.sequence(F.lit(min_train).cast("bigint"), last, F.lit(step).cast("bigint"))).alias("i", "start"))
        .select((F.col("i") + 1).alias("fold"), F.col("start"), (F.col("start") + test).alias("stop"))
    )


#: Roles of a row in a fold, in the order in which they are looked for.
ROLES = ("test", "purged", "embargo", "train")


def _with(df: DataFrame, small: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join a table of one row per ``by``, or the one row there is."""
    return df.join(F.broadcast(small), by, how) if by else df.crossJoin(F.broadcast(small))


def _starts_by(fold_starts: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, __day, __before, __at)``: how many folds start before a day, and the starts on it.

    One row per day from the first start to the last, and one day at either end.
    """
    each = fold_starts.filter("test_start IS NOT NULL").withColumn("__day", F.to_date("test_start"))
    ends = each.groupBy(*by).agg(F.min("__day").alias("a"), F.max("__day").alias("b"))
    days = ends.filter("a IS NOT NULL").select(*by, F.explode(F.sequence(F.date_sub("a", 1), F.date_add("b", 1))).alias("__day"))
    per = days.join(each.groupBy(*by, "__day").agg(F.array_sort(F.collect_list("test_start")).alias("__at")), [*by, "__day"], "left")
    n = F.coalesce(F.size("__at"), F.lit(0))
    up_to = F.sum(F.greatest(n, F.lit(0))).over(W.partitionBy(*by).orderBy("__day"))
    return per.select(*by, "__day", F.coalesce("__at", F.array().cast(per.schema["__at"].dataType)).alias("__at"), (up_to - F.greatest(n, F.lit(0))).cast("int").alias("__before"))


def _fold_numbers(rows: DataFrame, min_train: int, test: int, step: int, by: list[str]) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Session ordinals, the number of folds per ``by``, and the first and last fold that test a session."""
    ranks = session_ranks(rows, by)
    spare = F.count(F.lit(1)) - test - min_train
    total = ranks.groupBy(*by).agg(F.when(spare >= 0, F.floor(spare / step) + 1).otherwise(0).cast("int").alias("__folds"))
    last = F.least(F.floor((F.col("session_no") - min_train) / step) + 1, F.col("__folds"))
    return ranks, total, F.greatest(F.floor((F.col("session_no") - test - min_train) / step) + 2, F.lit(1)), last


def _fold_starts(rows: DataFrame, ranks: DataFrame, total: DataFrame, first_test: Column, last_test: Column, by: list[str]) -> DataFrame:
    """``(*by, fold, test_start)``: the first entry a fold tests."""
    firsts = rows.groupBy(*by, "session_date").agg(F.min("entry_time").alias("__t")).join(ranks, [*by, "session_date"])
    tests = _with(firsts, total, by).filter((last_test >= first_test) & (last_test > 0))
    return tests.select(*by, F.explode(F.sequence(first_test, last_test)).alias("fold"), "__t").groupBy(*by, "fold").agg(F.min("__t").alias("test_start"))


def fold_spans(rows: DataFrame, *, min_train: int = 10, test: int = 5, step: int | None = None, embargo_seconds: int = 0, by: list[str] | None = None) -> DataFrame:
    """Rows with ``session_no`` and ``spans``: per role of ``ROLES`` the folds ``lo..hi`` (from 1) that give it.

    ``rows`` carry session_date, entry_time, exit_time.  In a fold that tests
    later sessions, a row whose exit reaches the first test entry is purged, one
    that exits within the embargo before it is embargoed, all others train.  As
    folds follow each other in time, a row has each role in one stretch of
    folds, found by arithmetic on its session and by a calendar of the folds'
    first entries; rows are not repeated.  Empty spans have ``lo > hi``.  A row
    without an exit trains.  With ``by`` (a few configured values) every value
    has sessions and folds of its own.
    """
    by = by or []
    ranks, total, first_test, last_test = _fold_numbers(rows, min_train, test, step or test, by)
    count = F.col("__folds")
    calendar = _starts_by(_fold_starts(rows, ranks, total, first_test, last_test, by), by)
    ends = calendar.groupBy(*by).agg(F.min("__day").alias("__a"), F.max("__day").alias("__b"))
    # one row per calendar date: far below the broadcast limit
    r = _with(_with(rows.join(F.broadcast(ranks), [*by, "session_date"]), total, by), ends, by, "left")
    reach = {"__hit": F.col("exit_time"), "__near": F.col("exit_time") + F.make_dt_interval(secs=F.lit(embargo_seconds).cast("decimal(18,6)"))}
    for name, until in reach.items():
        day = F.greatest(F.least(F.to_date(until), F.col("__b")), F.col("__a"))
        r = r.withColumns({"__day": day, "__until": until}).join(F.broadcast(calendar), [*by, "__day"], "left")
        inside = F.size(F.filter("__at", lambda t: t <= F.col("__until")))
        r = r.withColumn(name, F.when(F.col("__until").isNull() | F.col("__at").isNull(), 0).otherwise(F.col("__before") + inside)).drop("__day", "__until", "__at", "__before")
    later = F.greatest(last_test + 1, F.lit(1))
    lows = {"test": first_test, "purged": later, "embargo": F.greatest(later, F.col("__hit") + 1), "train": F.greatest(later, F.col("__near") + 1)}
    highs = {"test": last_test, "purged": F.col("__hit"), "embargo": F.col("__near"), "train": count}
    span = lambda n: F.struct(lows[n].cast("int").alias("lo"), highs[n].cast("int").alias("hi"))
    return r.select(*[F.col(f"`{c}`") for c in rows.columns], "session_no", F.struct(*[span(n).alias(n) for n in ROLES]).alias("spans"))


def walk_forward(
    rows: DataFrame, *, min_train: int = 10, test: int = 5, step: int | None = None, embargo_seconds: int = 0,
) -> DataFrame:
    """Rows once per fold, tagged ``(fold, test_start, role)``; ``fold_spans`` says the same without repeating them."""
    spans = fold_spans(rows, min_train=min_train, test=test, step=step, embargo_seconds=embargo_seconds)
    roles = F.filter(F.array(*[F.struct(F.lit(n).alias("role"), F.col(f"spans.{n}.lo").alias("lo"), F.col(f"spans.{n}.hi").alias("hi")) for n in ROLES]), lambda s: s["lo"] <= s["hi"])
    each = spans.withColumn("__r", F.explode(roles)).withColumn("fold", F.explode(F.sequence("__r.lo", "__r.hi")))
    starts = _fold_starts(rows, *_fold_numbers(rows, min_train, test, step or test, []), [])
    # one row per fold, of which there are fewer than dates
    return each.withColumn("role", F.col("__r.role")).drop("__r", "spans").join(F.broadcast(starts.select(F.col("fold").cast("int").alias("fold"), "test_start")), "fold")


def role_measures(spans: DataFrame, measures: dict[str, Column] | None = None) -> DataFrame:
    """``(fold, role, rows, *measures)``: counts and sums per fold and role.

    A row adds where its span of folds begins and takes away behind its end;
    running sums over the folds, a table of its own size, give every fold.
    """
    measures = {"rows": F.lit(1).cast("bigint"), **(measures or {})}
    ends = [F.struct(F.lit(n).alias("role"), F.col(f"spans.{n}.lo").alias("at"), F.lit(1).alias("sign")) for n in ROLES]
    ends += [F.struct(F.lit(n).alias("role"), (F.col(f"spans.{n}.hi") + 1).alias("at"), F.lit(-1).alias("sign")) for n in ROLES]
    held = F.array(*[F.when(F.col(f"spans.{n}.lo") <= F.col(f"spans.{n}.hi"), e) for n, e in zip(ROLES * 2, ends)])
    each = spans.select(*[m.alias(f"__{k}") for k, m in measures.items()], F.explode(F.filter(held, lambda e: e.isNotNull())).alias("e"))
    deltas = each.groupBy("e.role", "e.at").agg(*[F.sum(F.col(f"__{k}") * F.col("e.sign")).alias(k) for k in measures])
    # folds x roles rows from here on
    top = spans.agg(F.max("spans.train.hi").alias("n"))
    grid = top.filter("n > 0").select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at")).crossJoin(spans.sparkSession.createDataFrame([(n,) for n in ROLES], "role string"))
    w = W.partitionBy("role").orderBy("at")
    dense = grid.join(deltas, ["role", "at"], "left")
    return dense.select(F.col("at").alias("fold"), "role", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in measures]).filter("rows > 0")


def fold_summary(rows: DataFrame, *, min_train: int = 10, test: int = 5, step: int | None = None, embargo_seconds: int = 0) -> DataFrame:
    """Rows per role and sessions of every fold that has rows."""
    counts = role_measures(fold_spans(rows, min_train=min_train, test=test, step=step, embargo_seconds=embargo_seconds))
    n = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("rows"))), F.lit(0)).alias(f"{r}_rows")
    first = F.lit(min_train) + (F.col("fold") - 1) * (step or test)
    return counts.groupBy("fold").agg(n("train"), n("test"), n("purged"), n("embargo")).select(
        "*", first.cast("bigint").alias("train_sessions"), F.lit(test).cast("bigint").alias("test_sessions"))


def session_groups(sessions: DataFrame, n_groups: int) -> DataFrame:
    """Contiguous session groups of equal size; the last takes the rest."""
    total = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    size = F.greatest(F.floor(total / n_groups), F.lit(1))
    return sessions.withColumn(
        "session_group", F.least(F.floor(F.col("session_no") / size), F.lit(n_groups - 1)).cast("int")
    )


def cpcv_paths(spark: SparkSession, n_groups: int, *, limit: int | None = None, seed: int = 42) -> DataFrame:
    """All pairs of test groups in a seeded order, or the first ``limit``; configuration, drawn on the driver."""
    pairs = list(combinations(range(n_groups), 2))
    random.Random(seed).shuffle(pairs)
    rows = [(f"cpcv_{i:03d}", a, b) for i, (a, b) in enumerate(pairs[:limit], start=1)]
    return spark.createDataFrame(rows, "path_id string, group_a int, group_b int")


def cpcv_rows(
    rows: DataFrame, paths: DataFrame, n_groups: int, *, horizon: int = 20, embargo_bars: int = 0,
    per_group: bool = False, key: str = "candidate_id",
) -> DataFrame:
    """Rows tagged ``(path_id, role)``: test, train or purged.

    The purge zone runs from ``horizon`` rows before the first test row to
    ``embargo_bars`` rows after the last one; with ``per_group`` each test
    group has its own zone, so rows between distant groups stay usable.
    """
    numbered = running(rows, [], ["entry_time", key], {"row_no": ("count", F.lit(1))})
    grouped = numbered.join(F.broadcast(session_groups(session_ranks(rows), n_groups)), "session_date")
    span = grouped.groupBy("session_group").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    sides = paths.select("path_id", F.explode(F.array("group_a", "group_b")).alias("session_group"))
    zones = sides.join(F.broadcast(span), "session_group")
    if per_group:
        zone = zones.groupBy("path_id").agg(F.collect_list(F.struct("lo", "hi")).alias("zones"))
    else:
        zone = zones.groupBy("path_id").agg(F.array(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi"))).alias("zones"))
    # one row per pair of groups, with at most two zones each
    plan = paths.join(zone, "path_id")
    tagged = fan_out_small(grouped, plan)
    is_test = (F.col("session_group") == F.col("group_a")) | (F.col("session_group") == F.col("group_b"))
    near = F.exists(
        "zones", lambda z: (F.col("row_no") >= z["lo"] - horizon) & (F.col("row_no") <= z["hi"] + embargo_bars)
    )
    return tagged.withColumn("role", ladder([(is_test, "test"), (near, "purged")], "train")).drop("zones", "group_a", "group_b")


def _reach(rows: DataFrame, n_groups: int, horizon: int, embargo_bars: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups of the sessions, and ``(session_group, lo, hi)``: the places of the rows ``horizon`` before and ``embargo_bars`` after a group.

    A place is ``(entry_time, key)``.  Rows are counted per day; only those of
    the days around the ends of a group are numbered, without other columns.
    """
    at, day = F.struct("entry_time", key), F.coalesce(F.to_date("entry_time"), F.lit("0001-01-01").cast("date")).alias("__day")
    # one row per session and day of entry from here on
    table = cut(rows.groupBy("session_date", day).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("lo"), F.max(at).alias("hi")))
    groups = session_groups(session_ranks(table), n_groups)
    days = table.groupBy("__day").agg(F.sum("__n").alias("__n")).withColumn("__upto", F.sum("__n").over(W.orderBy("__day"))).withColumn("__before", F.col("__upto") - F.col("__n"))
    ends = table.join(F.broadcast(groups), "session_date").groupBy("session_group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = days.select(F.col("__day").alias("__d"), F.col("__before").alias("__from"), F.col("__upto").alias("__to"))
    on = lambda end: F.coalesce(F.to_date(F.col(f"{end}.entry_time")), F.lit("0001-01-01").cast("date")) == F.col("__d")
    before = days.join(F.broadcast(ends.join(F.broadcast(first), on("lo"))), (F.col("__day") <= F.col("__d")) & (F.col("__upto") > F.col("__from") - horizon))
    after = days.join(F.broadcast(ends.join(F.broadcast(first), on("hi"))), (F.col("__day") >= F.col("__d")) & (F.col("__before") < F.col("__to") + embargo_bars))
    near = before.select("__day", "__before").union(after.select("__day", "__before")).distinct()
    held = running(rows.select("entry_time", key, day).join(F.broadcast(near), "__day"), ["__day"], ["entry_time", key], {"__i": ("count", F.lit(1))})
    numbered = cut(held.select(at.alias("__at"), (F.col("__before") + F.col("__i")).alias("__no")))
    total = table.agg(F.sum("__n").alias("__all"))
    no = lambda end, fn: ends.join(numbered, F.col(end).eqNullSafe(F.col("__at"))).groupBy("session_group").agg(fn("__no").alias(f"__{end}"))
    wanted = no("lo", F.min).join(no("hi", F.max), "session_group").crossJoin(F.broadcast(total))
    wanted = wanted.select("session_group", F.greatest(F.col("__lo") - horizon, F.lit(1)).alias("__lo"), F.least(F.col("__hi") + embargo_bars, "__all").alias("__hi"))
    place = lambda end: numbered.select(F.col("__at").alias(end), F.col("__no").alias(f"__{end}"))
    return cut(groups), cut(wanted.join(place("lo"), "__lo").join(place("hi"), "__hi").select("session_group", "lo", "hi"))


def cpcv_spans(rows: DataFrame, paths: DataFrame, n_groups: int, *, horizon: int = 20, embargo_bars: int = 0, per_group: bool = False, key: str = "candidate_id") -> DataFrame:
    """Rows with ``train`` and ``test``: spans of path numbers (from 0, in the order of path_id) with that role.

    The rules are those of ``cpcv_rows``; rows are neither repeated per path nor
    shuffled.  ``rows`` are read more than once.
    """
    groups, reach = _reach(rows, n_groups, horizon, embargo_bars, key)
    # one row: the reach of the groups by number
    by_number = F.transform(F.sequence(F.lit(0), F.lit(n_groups - 1)), lambda g: F.get(F.filter("__g", lambda b: b["session_group"] == g), F.lit(0)))
    ends = cut(reach.agg(F.collect_list(F.struct("session_group", "lo", "hi")).alias("__g")).select(by_number.alias("__b")))
    bits = lambda rule: sum((F.when(rule(F.get("__b", F.lit(g))), 1 << g).otherwise(0) for g in range(n_groups)), F.lit(0))
    from_, until = (lambda at: bits(lambda b: at >= b["lo"])), (lambda at: bits(lambda b: at <= b["hi"]))
    at = F.struct("entry_time", key)
    r = rows.join(F.broadcast(groups.select("session_date", "session_group")), "session_date").crossJoin(F.broadcast(ends)).withColumns({"__from": from_(at), "__until": until(at)})
    # every combination of a group and the reaches a place can lie in, with its paths
    none = ends.sparkSession.range(1).select(F.lit(0).alias("__m"))
    masks = lambda end, fn: ends.select("__b", F.explode("__b").alias("e")).filter("e IS NOT NULL").select(fn(F.col(f"e.{end}")).alias("__m")).union(none).distinct()
    order = F.array_sort(F.collect_list(F.struct("path_id", "group_a", "group_b")))
    cases = groups.select("session_group").distinct().crossJoin(masks("lo", from_).withColumnRenamed("__m", "__from")).crossJoin(
        masks("hi", until).withColumnRenamed("__m", "__until")).crossJoin(paths.agg(order.alias("__z")))

    def near(z):
        inside = lambda mask, g: F.getbit(F.col(mask), g) == 1
        a, b = z["group_a"], z["group_b"]
        if per_group:
            return (inside("__from", a) & inside("__until", a)) | (inside("__from", b) & inside("__until", b))
        return (inside("__from", a) | inside("__from", b)) & (inside("__until", a) | inside("__until", b))

    is_test = lambda z: (F.col("session_group") == z["group_a"]) | (F.col("session_group") == z["group_b"])
    which = lambda rule: F.filter(F.transform("__z", lambda z, i: F.when(rule(z), F.struct(i.alias("lo"), i.alias("hi")))), lambda s: s.isNotNull())
    case = ["session_group", "__from", "__until"]
    cases = cut(cases.select(*case, which(lambda z: ~is_test(z) & ~near(z)).alias("train"), which(is_test).alias("test")))
    return r.join(F.broadcast(cases), case).select(*[F.col(f"`{x}`") for x in rows.columns], "session_group", "train", "test")


def label_overlap(labels: DataFrame, by: list[str], key: str = "candidate_id") -> DataFrame:
    """Share of adjacent labels (by entry) whose windows overlap."""
    r = running(labels.filter(F.col("entry_time").isNotNull() & F.col("exit_time").isNotNull()), by,
                ["entry_time", key], {"prev_exit": ("last", "exit_time")}, inclusive=False)
    over = F.count(F.when(F.col("entry_time") < F.col("prev_exit"), 1))
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("labels"),
        over.alias("overlapping_pairs"),
        (over / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("overlap_ratio"),
    )


def purging_status(overlap: DataFrame, purging_bars: int) -> DataFrame:
    return overlap.withColumn(
        "status", F.when((F.col("overlapping_pairs") == 0) | F.lit(purging_bars > 0), "pass").otherwise("fail")
    )


def holdout_split(rows: DataFrame, share: float = 0.7, key: str = "candidate_id") -> DataFrame:
    """First ``share`` of the rows in (session, id) order train, the rest test."""
    n = running(rows, [], ["session_date", key], {"row_no": ("count", F.lit(1))})
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    cut = F.greatest(F.floor(F.col("__n") * share), F.lit(1))
    return n.crossJoin(F.broadcast(total)).withColumn(
        "role", F.when(F.col("row_no") <= cut, "train").otherwise("test")
    ).drop("__n")


def holdout_roles(rows: DataFrame, share: float = 0.7, key: str = "candidate_id") -> DataFrame:
    """Rows with the ``role`` of ``holdout_split``; only rows of the session in which the first ``share`` ends are numbered."""
    order = W.orderBy("session_date")
    # one row per session
    days = rows.groupBy("session_date").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order))
    held = days.withColumn("first", F.greatest(F.floor(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share), F.lit(1)))
    end = held.filter("upto >= first").orderBy("upto").first()
    if end is None:
        return rows.withColumn("role", F.lit("test"))
    day = F.lit(end["session_date"]).cast(rows.schema["session_date"].dataType)
    here = F.col("session_date").eqNullSafe(day)
    earlier = F.col("session_date").isNull() | (F.col("session_date") < day)
    role = lambda first: F.when(first, "train").otherwise("test")
    at = running(rows.filter(here), [], ["session_date", key], {"__no": ("count", F.lit(1))})
    split = at.withColumn("role", role(F.col("__no") <= end["first"] - end["upto"] + end["n"])).drop("__no")
    return rows.filter(~here).withColumn("role", role(earlier)).unionByName(split)


def path_rollup(paths: DataFrame, by: list[str] | None = None, pnl: str = "total_pnl_r", upper_median: bool = True) -> DataFrame:
    """Roll-up over a handful of paths: non-positive share, centre, worst, status."""
    by = by or []
    arr = F.array_sort(F.collect_list(pnl))
    n = F.count(F.lit(1))
    g = paths.groupBy(*by).agg(
        n.alias("evaluated_paths"),
        F.avg(F.when(F.col(pnl) <= 0, 1.0).otherwise(0.0)).alias("pbo"),
        F.avg(pnl).alias("mean_total_pnl_r"),
        F.min(pnl).alias("min_path_pnl_r"),
        F.avg(F.when(F.col(pnl) > 0, 1.0).otherwise(0.0)).alias("path_positive_rate"),
        arr.alias("__p"),
    )
    mid = F.floor(F.size("__p") / 2).cast("int")
    upper = F.get("__p", mid)
    true_median = F.when(F.size("__p") % 2 == 1, upper).otherwise((F.get("__p", mid - 1) + upper) / 2)
    g = g.withColumn("median_total_pnl_r", upper if upper_median else true_median)
    from barloom.functions.stats import nearest_rank

    tail = F.aggregate(F.filter("__p", lambda x: x < 0), F.lit(0.0), lambda a, x: a + x)
    ok = (
        (F.col("pbo") <= 0.25) & (F.col("mean_total_pnl_r") > 0) & (F.col("median_total_pnl_r") > 0)
        & (F.col("min_path_pnl_r") > -5.0)
    )
    if upper_median:
        ok = ok & (F.col("path_positive_rate") >= 0.60)
    return g.select(
        *by, "evaluated_paths", "pbo", "mean_total_pnl_r", "median_total_pnl_r", "min_path_pnl_r", "path_positive_rate",
        *[nearest_rank(F.col("__p"), p).alias(f"p{int(p * 100)}_total_pnl_r") for p in (0.10, 0.25, 0.75, 0.90)],
        tail.alias("negative_tail_contribution_r"),
        F.when(ok, "pass").otherwise("fail").alias("status"),
    )


def extreme_paths(paths: DataFrame, k: int = 3, pnl: str = "total_pnl_r") -> DataFrame:
    """Worst and best ``k`` paths."""
    lo = W.orderBy(F.col(pnl), "path_id")
    hi = W.orderBy(F.col(pnl).desc(), F.col("path_id").desc())
    # one row per path
    r = paths.withColumns({"worst_rank": F.row_number().over(lo), "best_rank": F.row_number().over(hi)})
    return r.filter((F.col("worst_rank") <= k) | (F.col("best_rank") <= k))


def effect_floor(deltas: DataFrame) -> DataFrame:
    """75th-percentile positive delta (rank rounded down); half of a single one."""
    p = deltas.filter(F.col("net_delta_vs_baseline") > 0).agg(F.array_sort(F.collect_list("net_delta_vs_baseline")).alias("p"))
    idx = F.floor(F.lit(0.75) * (F.size("p") - 1)).cast("int")
    return p.select(
        F.when(F.size("p") == 0, 0.0).when(F.size("p") == 1, F.get("p", F.lit(0)) * 0.5).otherwise(F.get("p", idx)).alias("empirical_effect_floor")
    )


def familywise_pvalue(deltas: DataFrame, accepted: DataFrame, *, samples: int = 2000, seed: int = 42) -> DataFrame:
    """Bootstrap p-value of the accepted delta against the best centred delta.

    ``deltas`` is one row per trial of a governed batch (tens of rows), so the
    centred values travel as one array.
    """
    spark = deltas.sparkSession
    stats = deltas.agg(
        F.collect_list(F.col("net_delta_vs_baseline")).alias("d"), F.avg("net_delta_vs_baseline").alias("m")
    ).select(F.transform("d", lambda x: x - F.col("m")).alias("centred"))
    draws = (
        spark.range(samples).withColumnRenamed("id", "sample")
        .crossJoin(F.broadcast(stats))
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.size("centred"))))
        .withColumn("pick", F.pmod(F.xxhash64("sample", "j", F.lit(seed)), F.size("centred").cast("bigint")).cast("int"))
        .groupBy("sample")
        .agg(F.max(F.get("centred", F.col("pick"))).alias("best"))
    )
    acc = accepted.select("trial_id", F.col("net_delta_vs_baseline").alias("observed"), F.col("roc_auc_delta_vs_baseline").alias("roc_delta")).limit(1)
    n = deltas.agg(F.count(F.lit(1)).alias("trial_count"))
    hits = draws.crossJoin(F.broadcast(acc)).agg(F.count(F.when(F.col("best") >= F.col("observed"), 1)).alias("hits"))
    out = acc.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(effect_floor(deltas)))
    p = (
        F.when(F.col("observed") <= 0, 1.0)
        .when(F.col("trial_count") == 1, 0.0)
        .otherwise((F.col("hits") + 1) / F.lit(float(samples + 1)))
    )
    return out.withColumn("familywise_pvalue", p).withColumn(
        "status",
        F.when(
            (F.col("observed") > 0) & (F.coalesce("roc_delta", F.lit(0.0)) >= 0)
            & (F.col("observed") > F.col("empirical_effect_floor")) & (F.col("familywise_pvalue") <= 0.05),
            "pass",
        ).otherwise("fail"),
    ).drop("hits")


def shuffle_probabilities(preds: DataFrame, *, seed: int = 42, key: str = "candidate_id") -> DataFrame:
    """Random control: the same probabilities, permuted over the same signals.

    Two running row numbers, one in signal order and one in hash order, are
    joined; no task sees all rows.
    """
    a = running(preds, [], ["entry_time", key], {"__i": ("count", F.lit(1))})
    h = preds.select(F.xxhash64(F.col(key), F.lit(seed)).alias("__h"), F.col(key).alias("__k"), F.col("probability").alias("__p"))
    b = running(h, [], ["__h", "__k"], {"__i": ("count", F.lit(1))}).select("__i", "__p")
    return a.join(b, "__i").withColumn("probability", F.col("__p")).drop("__i", "__p")


def control_status(actual: DataFrame, control: DataFrame) -> DataFrame:
    """Pass when the real signals beat the permuted ones in R and in utility."""
    a = actual.select(*[F.col(x).alias(f"actual_{x}") for x in ("trade_count", "total_pnl_r", "utility_score")])
    b = control.select(*[F.col(x).alias(f"random_{x}") for x in ("trade_count", "total_pnl_r", "utility_score")])
    j = a.crossJoin(F.broadcast(b)).withColumn("utility_delta", F.col("actual_utility_score") - F.col("random_utility_score"))
    none = F.coalesce("random_trade_count", F.lit(0)) == 0
    win = (F.col("actual_total_pnl_r") > F.col("random_total_pnl_r")) & (
        F.col("utility_delta").isNull() | (F.col("utility_delta") > 0)
    )
    return j.withColumn("status", F.when(none | win, "pass").otherwise("fail"))


def overfitting_rollup(gates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """fail if any gate fails, pass if all pass, else pending."""
    s = F.coalesce("status", F.lit("pending"))
    return gates.groupBy(*(by or [])).agg(
        F.when(F.bool_or(s == "fail"), "fail").when(F.bool_and(s == "pass"), "pass").otherwise("pending").alias("status"),
        ratio(F.sum(F.when(s == "pass", 1.0).otherwise(0.0)), F.count(F.lit(1)).cast("double")).alias("pass_share"),
    )
