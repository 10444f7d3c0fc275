"""Many balanced ridge-logistic fits at once: folds, paths and variants in one job.

Rows are never copied per fit.  A row says by spans of fit numbers which fits
train on it, and a task turns a block of rows into one product: the row's
feature products against the weights of all fits, which gives every fit its
Gram matrix.  Matrices are summed per fit, each fit is solved where its sum
lands, and only the coefficients come back.  An iteration of reweighted least
squares is one such aggregate, whatever the number of fits.

Missing values take the fit's own training median: the products carry the
missing flags as columns of their own, so a median enters only when a fit is
solved, and rows are the same for all fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import cut

#: Entries of one block's table of rows by fits.
CELLS = 1 << 22
#: Steps of the histogram behind the medians.
STEPS = 1000
#: Rounds of reweighting at most, and the change of coefficients that ends them.
ROUNDS, SMALL = 40, 1e-10


@dataclass
class Fits:
    """Coefficients of every fit, in units of the features; ``names`` by number."""

    cols: list[str]
    names: list[str]
    center: np.ndarray
    scale: np.ndarray
    medians: np.ndarray
    coefficients: np.ndarray  # fits x (1 + columns), on centred and scaled features
    fitted: np.ndarray
    rounds: int = 0
    missing: list[int] = field(default_factory=list)

    def theta(self) -> np.ndarray:
        """Coefficients on the columns of ``_design``."""
        beta = self.coefficients[:, 1:]
        return np.hstack([self.coefficients, beta[:, self.missing] * self.medians[:, self.missing]])

    def plain(self) -> np.ndarray:
        """Intercept and coefficients in the features' own units."""
        beta = self.coefficients[:, 1:] / self.scale
        return np.hstack([self.coefficients[:, :1] - (beta * self.center).sum(axis=1, keepdims=True), beta])


def _lists(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    if not width:
        return np.zeros((batch.num_rows, 0))
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _design(x: np.ndarray, center: np.ndarray, scale: np.ndarray, missing: list[int]) -> np.ndarray:
    """One, the features with 0 for what is missing, the flags of what is missing."""
    u = (x - center) / scale
    gap = np.isnan(u)
    return np.hstack([np.ones((len(x), 1)), np.where(gap, 0.0, u), gap[:, missing].astype(float)])


def _members(batch: pa.RecordBatch, rows: slice) -> tuple[slice, np.ndarray]:
    """The stretch of fits that some of the rows train, and 1 where a row trains a fit of it."""
    lo, hi = (batch.column(n).slice(rows.start, rows.stop - rows.start) for n in ("lo", "hi"))
    at = np.repeat(np.arange(len(lo)), lo.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lo, hi = (c.flatten().to_numpy(zero_copy_only=False) for c in (lo, hi))
    first, last = int(lo.min()), int(hi.max())
    marks = np.zeros((rows.stop - rows.start, last - first + 2))
    np.add.at(marks, (at, lo - first), 1)
    np.add.at(marks, (at, hi - first + 1), -1)
    return slice(first, last + 1), np.cumsum(marks, axis=1)[:, :-1]


def _blocks(batch: pa.RecordBatch, fits: int):
    step = max(1, CELLS // max(fits, 1))
    for a in range(0, batch.num_rows, step):
        rows = slice(a, min(a + step, batch.num_rows))
        yield rows, *_members(batch, rows)


def _summed(rows: DataFrame, block, width: int, fits: int, finish, schema: str) -> pd.DataFrame:
    """``finish(fit, summed vector)`` per fit, of ``block(batch, rows, stretch, members)`` vectors (width x stretch)."""

    def partial(batches):
        total = np.zeros((width, fits))
        for batch in batches:
            for part, stretch, members in _blocks(batch, fits):
                total[:, stretch] += block(batch, part, stretch, members)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[:, used].T), pa.list_(pa.float64()))], names=["fit", "v"])

    def per_fit(held: pd.DataFrame) -> pd.DataFrame:
        return finish(int(held["fit"].iloc[0]), np.sum(np.stack(held["v"].tolist()), axis=0))

    return rows.mapInArrow(partial, "fit int, v array<double>").groupBy("fit").applyInPandas(per_fit, schema).toPandas()


def prepared(rows: DataFrame, cols: list[str], label: str, train: Column) -> DataFrame:
    """``(x, y, lo, hi)``: features with NaN for null, the label, the spans of fits that train on the row."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]).cast("array<double>")
    spans = F.filter(train, lambda s: s["lo"] <= s["hi"])
    data = rows.filter(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("double").alias("y"), spans.alias("s"))
    spans = data.filter(F.size("s") > 0).select("x", "y", F.transform("s", lambda s: s["lo"].cast("int")).alias("lo"), F.transform("s", lambda s: s["hi"].cast("int")).alias("hi"))
    # dealt out evenly, as an input of few files would leave cores idle; rows of one stretch of fits together: a block then holds few fits
    return spans.repartition(F.rand(7)).sortWithinPartitions("lo")


def _medians(rows: DataFrame, fits: int, cols: int, missing: list[int], edges: list[np.ndarray]) -> np.ndarray:
    """Median of every fit and column with gaps: the least edge at or below which half of its rows lie."""
    out = np.zeros((fits, cols))
    for j in missing:
        edge = edges[j]

        def block(batch, part, stretch, members, j=j, edge=edge):
            x = _lists(batch, "x", cols)[part, j]
            known = ~np.isnan(x)
            spot = np.searchsorted(edge, x[known], side="left")
            counts = np.zeros((len(edge) + 1, members.shape[1]))
            order = np.argsort(spot, kind="stable")
            held, start = np.unique(spot[order], return_index=True)
            if len(held):
                counts[held] = np.add.reduceat(members[known][order], start, axis=0)
            return counts

        def finish(fit, v, edge=edge):
            half = np.searchsorted(np.cumsum(v), v.sum() / 2.0, side="left")
            return pd.DataFrame({"fit": [fit], "m": [float(edge[min(half, len(edge) - 1)]) if v.sum() else 0.0]})

        found = _summed(rows, block, len(edge) + 1, fits, finish, "fit int, m double")
        out[found["fit"].to_numpy(), j] = found["m"].to_numpy()
    return out


def fit_many(rows: DataFrame, cols: list[str], names: list[str], *, label: str = "label", train: str = "train", uses: list[set[str]] | None = None) -> Fits:
    """Fit one balanced logistic model per name.

    ``train`` is a column of spans ``array<struct<lo, hi>>`` of fit numbers (from
    0, both ends in) that train on the row.  Every fit imputes its own medians,
    weights its classes to equal sums, standardises by its own deviation and
    has a unit ridge on standardised coefficients, none on the intercept.  Fits
    without both classes are not fitted, and without columns a fit is its
    intercept.  Columns without variance in a fit
    have a zero coefficient there, and so do those that ``uses``, the columns of
    every fit, leaves out.  A median is a value of the column, or the
    nearest of ``STEPS`` quantiles if it has more values.
    """
    k, d = len(names), len(cols)
    data = cut(prepared(rows, cols, label, F.col(train)))
    # one row of ranges, gaps and quantiles
    probs = [(i + 1) / STEPS for i in range(STEPS)]
    known = [F.nanvl(F.get("x", F.lit(j)), F.lit(None).cast("double")) for j in range(d)]
    stats = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a{j}") for j, c in enumerate(known)], *[F.stddev_pop(c).alias(f"s{j}") for j, c in enumerate(known)],
                     *[F.count(F.when(F.isnan(F.get("x", F.lit(j))), 1)).alias(f"g{j}") for j in range(d)]).first()
    center = np.array([stats[f"a{j}"] or 0.0 for j in range(d)])
    scale = np.array([stats[f"s{j}"] or 1.0 for j in range(d)])
    missing = [j for j in range(d) if stats[f"g{j}"]]
    edges = [np.array([])] * d
    if missing:
        found = data.agg(*[F.percentile_approx(known[j], probs, 10_000).alias(f"q{j}") for j in missing]).first()
        for j in missing:
            edges[j] = np.unique(found[f"q{j}"] or [center[j]])
    raw = _medians(data, k, d, missing, edges)
    fits = Fits(cols, names, center, scale, np.where(np.isin(np.arange(d), missing), (raw - center) / scale, 0.0), np.zeros((k, 1 + d)), np.zeros(k, dtype=bool), missing=missing)
    p = 1 + d + len(missing)
    left, right = np.triu_indices(p)

    def reduction(fit: int) -> np.ndarray:
        a = np.zeros((p, 1 + d))
        a[: 1 + d] = np.eye(1 + d)
        for at, j in enumerate(missing):
            a[1 + d + at, 1 + j] = fits.medians[fit, j]
        return a

    def unpacked(fit: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.zeros((p, p))
        g[left, right] = g[right, left] = v[: len(left)]
        a = reduction(fit)
        return a.T @ g @ a, a.T @ v[len(left) :]

    def moments(batch, part, stretch, members):
        z = _design(_lists(batch, "x", d)[part], center, scale, missing)
        y = batch.column("y").to_numpy(zero_copy_only=False)[part]
        return np.vstack([(z[:, left] * z[:, right]).T @ members, z.T @ (members * y[:, None])])

    def facts(fit, v):
        gram, sums = unpacked(fit, v)
        n, mean = gram[0, 0], gram[0] / gram[0, 0]
        ridge = np.maximum(np.diag(gram) - n * mean**2, 0.0) / max(n - 1, 1)
        ridge[0] = 0.0
        return pd.DataFrame({"fit": [fit], "n": [n], "positives": [sums[0]], "ridge": [ridge.tolist()]})

    width = len(left) + p
    found = _summed(data, moments, width, k, facts, "fit int, n double, positives double, ridge array<double>")
    ridge, weights = np.zeros((k, 1 + d)), np.zeros((k, 2))
    for fit, n, positives, r in found.itertuples(index=False):
        if 0 < positives < n:
            fits.fitted[fit] = True
            ridge[fit], weights[fit] = r, (n / (2 * (n - positives)), n / (2 * positives))
    if uses is not None:
        ridge[:, 1:] *= np.array([[c in use for c in cols] for use in uses], dtype=float).reshape(k, d)
    active = np.flatnonzero(fits.fitted)
    while len(active) and fits.rounds < ROUNDS:
        theta, now = fits.theta(), fits.coefficients

        def reweighted(batch, part, stretch, members, theta=theta, active=active):
            z = _design(_lists(batch, "x", d)[part], center, scale, missing)
            y = batch.column("y").to_numpy(zero_copy_only=False)[part].astype(int)
            mine = active[(active >= stretch.start) & (active < stretch.stop)]
            at = 1.0 / (1.0 + np.exp(-np.clip(z @ theta[mine].T, -500, 500)))
            w = members[:, mine - stretch.start] * weights[mine][:, y].T
            out = np.zeros((width, members.shape[1]))
            out[:, mine - stretch.start] = np.vstack([(z[:, left] * z[:, right]).T @ (w * at * (1 - at)), z.T @ (w * (y[:, None] - at))])
            return out

        def step(fit, v, now=now):
            gram, gradient = unpacked(fit, v)
            fixed = np.flatnonzero(ridge[fit][1:] <= 1e-14) + 1
            gram, gradient = gram + np.diag(ridge[fit]), gradient - ridge[fit] * now[fit]
            gram[fixed], gram[:, fixed], gradient[fixed] = 0.0, 0.0, 0.0
            gram[fixed, fixed] = 1.0
            move = np.linalg.solve(gram, gradient)
            return pd.DataFrame({"fit": [fit], "b": [(now[fit] + move).tolist()], "moved": [float(np.abs(move).max())]})

        found = _summed(data, reweighted, width, k, step, "fit int, b array<double>, moved double")
        fits.coefficients = now.copy()
        fits.coefficients[found["fit"].to_numpy()] = np.stack(found["b"].tolist())
        active = np.sort(found.loc[found["moved"] > SMALL, "fit"].to_numpy())
        fits.rounds += 1
    return fits


def predict_lists(rows: DataFrame, fits: Fits, *, test: str = "test", drop: set[str] = frozenset()) -> DataFrame:
    """Rows once, without the columns ``drop``, with ``__p``: number ``f`` and probability ``p`` of every fitted fit of their ``test`` spans."""
    d, theta = len(fits.cols), fits.theta()
    keep = [c for c in rows.columns if c not in ("probability", "prediction", test) and c not in drop]
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in fits.cols]).cast("array<double>")
    numbers = F.flatten(F.transform(F.filter(test, lambda s: s["lo"] <= s["hi"]), lambda s: F.sequence(s["lo"].cast("int"), s["hi"].cast("int"))))
    each = rows.select(*keep, x.alias("__x"), F.coalesce(numbers, F.array().cast("array<int>")).alias("__f"))

    def run(batches):
        for batch in batches:
            lists = batch.column("__f")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            at, f = np.repeat(np.arange(batch.num_rows), size), lists.flatten().to_numpy(zero_copy_only=False)
            done = fits.fitted[f]
            at, f = at[done], f[done]
            z = _design(_lists(batch, "__x", d), fits.center, fits.scale, fits.missing)
            p = np.zeros(len(f))
            for a in range(0, len(f), 1 << 16):
                part = slice(a, a + (1 << 16))
                p[part] = 1.0 / (1.0 + np.exp(-np.clip((z[at[part]] * theta[f[part]]).sum(axis=1), -500, 500)))
            ends = np.append(0, np.cumsum(np.bincount(at, minlength=batch.num_rows))).astype(np.int32)
            held = pa.StructArray.from_arrays([pa.array(f.astype(np.int32)), pa.array(p)], names=["f", "p"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), held)], names=[*keep, "__p"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in each.select(*keep).schema], "`__p` array<struct<f:int,p:double>>"])
    return each.mapInArrow(run, schema)


def each_fit(lists: DataFrame, name: str, names: list[str]) -> DataFrame:
    """Rows of ``predict_lists`` once per fit, with ``name`` out of ``names``, ``probability`` and ``prediction``."""
    keep = [c for c in lists.columns if c not in ("__p", name)]
    options = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    each = lists.withColumn("__p", F.explode("__p"))
    return each.select(*keep, F.get(options, F.col("__p.f")).alias(name), F.col("__p.p").alias("probability"), (F.col("__p.p") >= 0.5).cast("int").alias("prediction"))


def predict_many(rows: DataFrame, fits: Fits, *, test: str = "test", name: str = "fit") -> DataFrame:
    """Rows once per fitted fit of their ``test`` spans, with ``name``, ``probability`` and ``prediction``."""
    return each_fit(predict_lists(rows, fits, test=test, drop={name}), name, fits.names)
