"""Boosted trees on binned features: a small job per level of a tree, one task for a table of few rows.

Features become bin numbers of one byte once.  Blocks of rows keep them with
the sums of their trees, so a level of a tree is one pass that returns a table
of gradients, curvatures and counts per node, feature and bin; of two children
the one with fewer rows is counted and the other is what remains.  The sums
move on every few rounds, in between tasks add the trees that are new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.stats import column_bins

#: Bins of a feature at most, and rows and curvature of a leaf at least.
BINS, LEAF, CURVATURE = 255, 20, 1e-3
#: Rows of a block.
BLOCK = 1 << 15
#: Up to so many rows one task fits all rounds: below, the jobs of the levels take longer than the rows.
ONE_TASK = 1 << 21
#: Rounds after which the sums of trees that rows carry move on.
CARRIED = 4
#: Gradients and curvatures are whole multiples of these: sums are exact in any order.
_UNITS = np.array([2.0**-26, 2.0**-23])
#: A row's place beside its curvature in one number; a block's curvatures stay below.
_ROW = 2.0**37
#: Width of a node's table per feature; a slot that no row counts for.
_WIDE, _NONE = 256, 255
_TINY = 1e-15


@dataclass
class Tree:
    """Splits in heap order, ``bin > cut`` goes right; a node without a split sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        return cls(np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, _NONE, np.uint8), np.zeros(1 << depth))

    def places(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Number of every row's node on a level: all splits are compared, and the bits so far choose one."""
        bits, place = [], np.zeros(x.shape[1], np.uint8)
        for level in range(levels):
            first = (1 << level) - 1
            right = [x[self.feature[i]] > self.cut[i] for i in range(first, 2 * first + 1)]
            for bit in reversed(bits):
                right = [a ^ (bit & (a ^ b)) for a, b in zip(right[::2], right[1::2])]
            bits.append(right[0])
            place = (place + place) | right[0].view(np.uint8)
        return place


def _depth(tree: Tree) -> int:
    return len(tree.value).bit_length() - 1


def _moved(f: np.ndarray, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Sums of trees with more trees."""
    return reduce(lambda held, t: held + t.value.take(t.places(x, _depth(t))), trees, f)


@dataclass
class Boosted:
    """Fitted trees on the bins of ``cols``; missing values are medians."""

    cols: list[str]
    medians: np.ndarray
    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def bins(self, table: pa.Table, names: list[str]) -> np.ndarray:
        """Bin numbers, a row per feature."""
        out = np.zeros((len(names), table.num_rows), np.uint8)
        for j, name in enumerate(names):
            v = table.column(name).to_numpy()
            out[j] = np.searchsorted(self.edges[j], np.where(np.isnan(v), self.medians[j], v), side="left")
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``probability``."""
        keep, names = rows.columns, [f"__x{j}" for j in range(len(self.cols))]
        each = rows.select(*[F.col(f"`{c}`") for c in keep], *[_number(c).alias(n) for c, n in zip(self.cols, names)])

        def run(batches):
            for table in _chunks(batches):
                x = self.bins(table, names)
                f = _moved(np.full(x.shape[1], self.base), x, self.trees)
                yield from table.select(keep).append_column("probability", pa.array(1.0 / (1.0 + np.exp(-f)))).to_batches()

        schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "probability double"]
        return each.mapInArrow(run, ", ".join(schema))


def _number(c: str) -> Column:
    """A feature as a double, NaN for what is missing."""
    return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows, the last one with what is left."""
    held, size = [], 0
    for batch in batches:
        while size + batch.num_rows >= rows:
            part = batch.slice(0, rows - size)
            yield pa.Table.from_batches([*held, part]).combine_chunks()
            held, size, batch = [], 0, batch.slice(part.num_rows)
        if batch.num_rows:
            held, size = [*held, batch], size + batch.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(x: np.ndarray, f: np.ndarray, tree: Tree, level: int, slots: np.ndarray, n: int) -> np.ndarray:
    """Gradients, curvatures (in units) and rows (3 x slots x features x bins) of the nodes of a level that have a slot.

    The last row of ``x`` is the label.
    """
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-f.astype(np.float32)))
    g, h = (np.rint(v / np.float32(unit)).astype(float) for v, unit in zip((p - x[-1], p * (1 - p)), _UNITS))
    h += _ROW
    if level:
        slot = slots.take(tree.places(x, level))
        rows = np.flatnonzero(slot != _NONE)
        g, h, base = g[rows], h[rows], slot[rows].astype(np.intp) * _WIDE
    out = np.empty((3, n, len(x) - 1, _WIDE))
    for j in range(len(x) - 1):
        at = base + x[j][rows] if level else x[j].astype(np.intp)
        for k, weights in enumerate((g, h)):
            out[k, :, j] = np.bincount(at, weights, n * _WIDE).reshape(n, _WIDE)
    np.floor(out[1] / _ROW, out=out[2])
    out[1] -= out[2] * _ROW
    return out


def _split(node: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(feature, last bin to the left, sums of either side) of the greatest gain, the first one of equal gains."""
    left = np.cumsum(node, axis=2) * np.append(_UNITS, 1.0)[:, None, None]
    whole = left[:, :, -1:]
    right = whole - left
    (gl, hl, nl), (gr, hr, nr), (g, h, _) = left, right, whole
    allowed = (nl >= LEAF) & (nr >= LEAF) & (hl >= CURVATURE) & (hr >= CURVATURE)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, gl * gl / (hl + _TINY) + gr * gr / (hr + _TINY) - g * g / (h + _TINY), -np.inf)
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(j), int(b), left[:, j, b], right[:, j, b]) if gain[j, b] > 0 else None


def _grown(histograms: Callable, rounds: int, depth: int, rate: float) -> list[Tree]:
    """Trees of all rounds; ``histograms(trees, tree, level, slots, n)`` sums ``_counted`` over all rows."""
    trees: list[Tree] = []
    for _ in range(rounds):
        tree = Tree.empty(depth)
        nodes = {0: histograms(trees, tree, 0, None, 1)[:, 0]}
        for level in range(depth):
            parents = {}
            for place, node in nodes.items():
                found = _split(node)
                ends = [(place << (depth - level), node[:, 0].sum(axis=1) * np.append(_UNITS, 1.0))]
                if found:
                    parents[place] = (node, *found[2:])
                    tree.feature[(1 << level) - 1 + place], tree.cut[(1 << level) - 1 + place] = found[:2]
                    ends = [((2 * place + side) << (depth - level - 1), sums) for side, sums in enumerate(found[2:])]
                for leaf, (g, h, _) in ends:
                    tree.value[leaf] = -rate * g / (h + _TINY)
            if not parents or level + 1 == depth:
                break
            slots = np.full(2 << level, _NONE, np.uint8)
            fewer = {p: int(right[2] < left[2]) for p, (_, left, right) in parents.items()}
            for slot, p in enumerate(parents):
                slots[2 * p + fewer[p]] = slot
            counted = histograms(trees, tree, level + 1, slots, len(parents))
            nodes = {}
            for slot, (p, (node, *_)) in enumerate(parents.items()):
                nodes[2 * p + fewer[p]], nodes[2 * p + 1 - fewer[p]] = counted[:, slot], node - counted[:, slot]
        trees.append(tree)
    return trees


def _fitted_here(blocks: list[np.ndarray], base: float, rounds: int, depth: int, rate: float) -> list[Tree]:
    """All rounds on blocks in memory."""
    sums, moved = [np.full(x.shape[1], base) for x in blocks], 0

    def histograms(trees, tree, level, slots, n):
        nonlocal sums, moved
        if moved < len(trees):
            sums, moved = [_moved(f, x, trees[moved:]) for x, f in zip(blocks, sums)], len(trees)
        return reduce(np.add, (_counted(x, f, tree, level, slots, n) for x, f in zip(blocks, sums)))

    return _grown(histograms, rounds, depth, rate)


def _fitted_by_jobs(blocks: RDD, width: int, base: float, rounds: int, depth: int, rate: float) -> list[Tree]:
    """All rounds on blocks that the executors hold on disk, a job per level; a heap would hold each as a huge object."""
    state = blocks.map(lambda x: (x, np.full(x.shape[1], base))).persist(StorageLevel.DISK_ONLY)
    moved = 0

    def histograms(trees, tree, level, slots, n):
        nonlocal state, moved
        before = None
        if len(trees) - moved >= CARRIED:
            before, late = state, trees[moved:]
            state = before.map(lambda s: (s[0], _moved(s[1], s[0], late))).persist(StorageLevel.DISK_ONLY)
            moved = len(trees)
        new = trees[moved:]

        def run(held):
            total = np.zeros((3, n, width, _WIDE))
            for x, f in held:
                total += _counted(x, _moved(f, x, new), tree, level, slots, n)
            yield total

        # one table per task, of a size that rows do not change; added in the order of the tasks
        out = reduce(np.add, state.mapPartitions(run).collect())
        if before is not None:
            before.unpersist()
        return out

    try:
        return _grown(histograms, rounds, depth, rate)
    finally:
        state.unpersist()


def fit_boosted(rows: DataFrame, cols: list[str], *, label: str = "label", rounds: int = 200, depth: int = 4, rate: float = 0.05) -> Boosted:
    """Boosted trees on the log loss: medians for missing values, Newton steps, all splits that gain down to ``depth``.

    A bin holds one value where a column has up to ``BINS`` values, an equal
    share of the rows otherwise; bins and medians are those of all rows.  A leaf
    has ``LEAF`` rows and a curvature of ``CURVATURE`` at least.  All rounds run
    on all rows, none are held back to stop early.
    """
    data = rows.filter(F.col(label).isNotNull()).select(*[_number(c).alias(f"x{j}") for j, c in enumerate(cols)], (F.col(label) == 1).cast("int").alias("y"))
    names = data.columns[:-1]
    total, positives = data.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not total:
        return Boosted(cols, np.zeros(len(cols)), [np.array([])] * len(cols))
    model = Boosted(cols, *column_bins(data.select(*[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names]), names, BINS, total))

    tiny = 10 * np.finfo(float).eps
    share = min(max(positives / total, tiny), 1 - tiny)
    model.base = float(np.log(share / (1 - share)))
    width, sizes = len(cols), (model.base, rounds, depth, rate)

    def binned(batches):
        for table in _chunks(batches):
            x = np.vstack([model.bins(table, names), table.column("y").to_numpy().astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    def block(held):
        return np.frombuffer(held, np.uint8).reshape(width + 1, -1)

    def whole(batches):
        held = [block(x) for b in batches for x in b.column("x").to_pylist()]
        for t in _fitted_here(held, *sizes):
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()]) for v in (t.feature, t.cut.astype(np.int64), t.value)], names=["feature", "cut", "value"])

    blocks = data.mapInArrow(binned, "x binary")
    if total <= ONE_TASK:
        found = blocks.repartition(1).mapInArrow(whole, "feature array<bigint>, cut array<bigint>, value array<double>").collect()
        model.trees = [Tree(np.array(r["feature"]), np.array(r["cut"], np.uint8), np.array(r["value"])) for r in found]
    else:
        # dealt out evenly: every level waits for its longest task
        spread = blocks.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        model.trees = _fitted_by_jobs(spread.rdd.map(lambda r: block(r["x"])), width, *sizes)
    return model
