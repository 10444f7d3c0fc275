"""Single-position selection: keep a trade only if the previous kept one is closed.

The state is one value, the time until which the position is busy, so a slice
of a run is a step function from the busy time on entry to the busy time on
exit.  Every trade points to the next one that it allows; pointers composed by
doubling give the (compressed) step functions of all slices in parallel, the
small functions are chained per run, and powers of the pointers mark what each
slice takes from its known start.  No run is ever held by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import micros
from barloom.session import cut

_NEVER = -(1 << 62)


def _follow(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row, in (entry, key) order, the next one it allows; the number of rows if there is none.

    A trade of no length allows the next row, as that is not before its exit.
    """
    return np.maximum(np.searchsorted(start, end, side="left"), np.arange(len(start)) + 1)


def tails(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Exit of the last trade taken, if the first one taken is a given row: pointers composed by doubling."""
    n = len(start)
    follow, last = np.append(_follow(start, end), n), np.append(np.arange(n), n)
    while (follow[:n] < n).any():
        on = follow < n
        last = np.where(on, last[follow], last)
        follow = follow[follow]
    return end[last[:n]]


def taken(start: np.ndarray, end: np.ndarray, busy: int) -> np.ndarray:
    """Rows taken from a busy time on: powers of the pointer, the largest first, spread the set of rows taken."""
    n = len(start)
    follow = np.append(_follow(start, end), n)
    powers = [follow]
    while (powers[-1][:n] < n).any():
        powers.append(powers[-1][powers[-1]])
    on = np.zeros(n + 1, dtype=bool)
    on[np.searchsorted(start, busy, side="left")] = True
    for power in reversed(powers):
        on[power[on]] = True
    return on[:n]


def _runs_of(batch: pa.RecordBatch):
    """``(run, slice, rows)`` of each stretch of one run and slice in a batch."""
    run, part = batch.column("__run"), batch.column("__part").to_numpy(zero_copy_only=False)
    if not batch.num_rows:
        return
    codes = run.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cut_at = np.flatnonzero((np.diff(codes) != 0) | (np.diff(part) != 0)) + 1
    bounds = [0, *cut_at.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield run[a].as_py(), int(part[a]), slice(a, b)


def _times(batch: pa.RecordBatch, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("__in", "__out"))


def _possible(batches):
    """Rows without those that a trade of some length at the same entry and run, earlier in order, shuts out for good."""
    last, shut = None, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code = batch.column("__run").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        start, end = _times(batch, slice(0, n))
        new = np.append(True, (np.diff(code) != 0) | (np.diff(start) != 0))
        long = end > start
        before = np.cumsum(long) - long
        first = (batch.column("__run")[0].as_py(), int(start[0]))
        carried = int(shut and last == first)
        stretch = np.cumsum(new) - 1
        inside = before - before[new][stretch] + np.where(stretch == 0, carried, 0)
        last, shut = (batch.column("__run")[n - 1].as_py(), int(start[-1])), bool(inside[-1] or long[-1])
        yield batch.filter(pa.array(inside == 0))


def _step(run, part: int, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    tail = tails(start, end)
    # one step per run of equal tails, valid for every busy time up to its last entry
    edge = np.append(tail[1:] != tail[:-1], True)
    n = int(edge.sum())
    return pa.RecordBatch.from_arrays([pa.array([run] * n, kind), pa.array([part] * n, pa.int32()), pa.array(start[edge]), pa.array(tail[edge])],
                                      names=["__run", "__part", "__upto", "__tail"])


def _steps(batches):
    """Step function of every slice: the busy time behind it for every busy time before it."""
    held, times = None, []

    def flush():
        return _step(*held, *(np.concatenate(c) for c in zip(*times)), pa.string())

    for batch in batches:
        for run, part, rows in _runs_of(batch):
            if held is not None and held != (run, part):
                yield flush()
                times = []
            held = (run, part)
            times.append(_times(batch, rows))
    if held is not None:
        yield flush()


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    busy, out = _NEVER, []
    for s, g in pdf.sort_values(["__part", "__upto"]).groupby("__part", sort=True):
        out.append((pdf["__run"].iloc[0], s, busy))
        hit = np.searchsorted(g["__upto"].to_numpy(), busy, side="left")
        if hit < len(g):
            busy = int(g["__tail"].iloc[hit])
    return pd.DataFrame(out, columns=["__run", "__part", "__busy"])


def non_overlapping(trades: DataFrame, *, run: list[str], entry: str, exit_: str, key: str) -> DataFrame:
    """Rows of ``trades`` kept by the single-position rule, per ``run``.

    Trades are taken in (entry, key) order; one is kept when its entry is not
    before the exit of the last kept trade.  Rows are placed once, in ranges of
    (run, entry, key) of about equal numbers of rows; a slice is what a task
    holds of a run.
    """
    at = lambda x: micros(x, trades.schema[x].dataType.typeName())
    runs = F.concat_ws("\u0001", *[F.col(x).cast("string") for x in run]) if run else F.lit("")
    order = ["__run", "__in", key]
    placed = trades.withColumns({"__run": runs, "__in": at(entry), "__out": at(exit_)}).repartitionByRange(*order).sortWithinPartitions(*order)
    # of many trades at one entry only the first in order that lasts is stored
    placed = cut(placed.mapInArrow(_possible, placed.schema).withColumn("__part", F.spark_partition_id()))
    steps = placed.select("__run", "__part", "__in", "__out").mapInArrow(_steps, "__run string, __part int, __upto bigint, __tail bigint")
    starts = steps.groupBy("__run").applyInPandas(_chain, "__run string, __part int, __busy bigint")
    # one row per slice: no more than partitions and runs together
    known = {(r["__run"], r["__part"]): r["__busy"] for r in starts.collect()}
    busy = trades.sparkSession.sparkContext.broadcast(known)

    def select(batches):
        held, until = None, _NEVER
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for name, part, rows in _runs_of(batch):
                if held != (name, part):
                    held, until = (name, part), busy.value[name, part]
                start, end = _times(batch, rows)
                mine = taken(start, end, until)
                if mine.any():
                    until = int(end[np.flatnonzero(mine)[-1]])
                keep[rows] = mine
            yield batch.filter(pa.array(keep))

    return placed.mapInArrow(select, placed.schema).select(*trades.columns)


def _whole(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _listed(table: pa.Table, runs: str):
    """``(run, rows)`` of every run in the lists of a slice, rows in order, with their times."""
    lists = table.column(runs).combine_chunks()
    row = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    run = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(run, kind="stable")
    run, row = run[order], row[order]
    start, end = (table.column(c).to_numpy() for c in ("__in", "__out"))
    bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            mine = row[a:b]
            yield int(run[a]), mine, start[mine], end[mine]


def non_overlapping_lists(trades: DataFrame, *, runs: str, name: str, entry: str, exit_: str, key: str) -> DataFrame:
    """``non_overlapping`` on rows that are stored once, with an array of the run numbers they are signals of.

    Returns the rows taken, once per run that takes them, with the run ``name``
    in place of the array ``runs``.  A partition is one slice of every run.
    """
    at = lambda x: micros(x, trades.schema[x].dataType.typeName())
    keep, order = [c for c in trades.columns if c != runs], ["__in", key]
    placed = trades.filter(F.size(runs) > 0).withColumns({"__in": at(entry), "__out": at(exit_)}).repartitionByRange(*order).sortWithinPartitions(*order)

    def possible(batches):
        # without the runs in which a trade of some length at the same entry, earlier in order, shuts a row out for good
        table = _whole(batches)
        if table is None:
            return
        found = []
        for run, rows, start, end in _listed(table, runs):
            new = np.append(True, np.diff(start) != 0)
            long = end > start
            before = np.cumsum(long) - long
            rows = rows[before == before[new][np.cumsum(new) - 1]]
            found.append((np.full(len(rows), run, dtype=np.int32), rows))
        run, rows = (np.concatenate(c) for c in zip(*found))
        by_row = np.argsort(rows, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(rows, minlength=table.num_rows))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(run[by_row]))
        table = table.set_column(table.column_names.index(runs), runs, lists).filter(pa.array(np.diff(ends) > 0))
        yield from table.to_batches()

    placed = cut(placed.mapInArrow(possible, placed.schema).withColumn("__part", F.spark_partition_id()))

    def steps(batches):
        table = _whole(batches)
        if table is not None:
            for run, _, start, end in _listed(table, runs):
                yield _step(run, table.column("__part")[0].as_py(), start, end, pa.int32())

    kind = "__run int, __part int, __busy bigint"
    starts = placed.select(runs, "__part", "__in", "__out").mapInArrow(steps, "__run int, __part int, __upto bigint, __tail bigint").groupBy("__run").applyInPandas(_chain, kind)
    # one row per slice and run
    known = {(r["__run"], r["__part"]): r["__busy"] for r in starts.collect()}
    busy = trades.sparkSession.sparkContext.broadcast(known)

    def select(batches):
        table = _whole(batches)
        if table is not None:
            part = table.column("__part")[0].as_py()
            for run, rows, start, end in _listed(table, runs):
                mine = rows[taken(start, end, busy.value[run, part])]
                yield from table.select(keep).take(pa.array(mine)).append_column(name, pa.array(np.full(len(mine), run, dtype=np.int32))).to_batches()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in trades.select(*keep).schema], f"`{name}` int"])
    return placed.mapInArrow(select, schema)


def trailing_streak(df: DataFrame, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """Length of the run of equal ``value`` at the end of each group's order.

    Two aggregates instead of a window: the last value, then the last row that
    differs from it.
    """
    at = F.struct(*order)
    last = df.groupBy(*by).agg(F.max_by(value, at).alias("last_value"))
    joined = df.join(last, by) if by else df.crossJoin(F.broadcast(last))
    other = F.when(~F.col(value).eqNullSafe(F.col("last_value")), at)
    bound = joined.groupBy(*by).agg(F.max(other).alias("__bound"))
    full = joined.join(bound, by) if by else joined.crossJoin(F.broadcast(bound))
    return full.groupBy(*by).agg(
        F.max("last_value").alias("last_value"),
        F.count(F.when(F.col("__bound").isNull() | (at > F.col("__bound")), 1)).alias("streak"),
    )
