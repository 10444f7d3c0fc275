"""Whitening of embeddings by a bidiagonal qd solver.

Tasks reduce their centred rows block by block to one triangular factor, and
factors are reduced to one in rounds of ``FAN``.  What follows depends on the
dimensions alone: the factor is brought to bidiagonal form by Householder
reflections, the dqds recurrence finds its singular values to high relative
accuracy, and a twisted factorisation of the bidiagonal's normal matrix gives
each direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import long_id, stored

#: Factors that are reduced in one task.
FAN = 16
#: Entries whose scaled value is no exact integer in a double make a row unusable.
LARGEST = float(1 << 53)
_EPS = float(np.finfo(float).eps)
_TINY = (8 * _EPS) ** 2


def integers(vector: Column, scale: float, shift: int) -> Column:
    """``floor(scale * c) + shift`` of every entry, or null for a vector that cannot be used."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGEST))
    return F.when(ok & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift)))


def _rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def scaled_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: in long arithmetic where that holds it, else in Python integers."""
    if len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) >= 1 << 62:
        return x.astype(object) * n - sums.astype(object)
    return x * n - sums


def fit_sums(fit: DataFrame) -> tuple[int, int, np.ndarray]:
    """Dimensions, number of rows and sums per dimension of the vectors of the most frequent length."""

    def partial(batches):
        total: dict[int, list] = {}
        for batch in batches:
            column = batch.column("x")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                x = _rows_of(column.filter(pa.array(sizes == d)), d)
                held = total.setdefault(d, [0, np.zeros(d, dtype=np.int64)])
                held[0] += len(x)
                held[1] += x.sum(axis=0)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s)], names=["d", "i", "n", "s"])

    sums = fit.select("x").mapInArrow(partial, "d int, i int, n bigint, s bigint").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # one row, as long as a vector
    found = sums.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s")))["s"].alias("s")).orderBy(F.desc("n"), F.desc("d")).first()
    return (0, 0, np.zeros(0, dtype=np.int64)) if found is None else (found["d"], found["n"], np.array(found["s"], dtype=np.int64))


def triangular_factor(fit: DataFrame, dims: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, up to signs."""

    def packed(part: int, r: np.ndarray) -> dict:
        return {"part": [part] * len(r), "row": list(range(len(r))), "v": list(r)}

    def blocks(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            x = _rows_of(batch.column("x"), dims)
            r = np.linalg.qr(np.vstack([r, (scaled_deviation(x, n, sums) / n).astype(float)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict(packed(TaskContext.get().partitionId(), r), pa.schema([("part", pa.int64()), ("row", pa.int32()), ("v", pa.list_(pa.float64()))]))

    def reduced(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["part", "row"])
        return pd.DataFrame(packed(int(held["part"].iloc[0]) // FAN, np.linalg.qr(np.stack(held["v"].tolist()), mode="r")))

    schema = "part bigint, row int, v array<double>"
    factors = stored(fit.select("x").mapInArrow(blocks, schema), "factors")
    while factors.select("part").distinct().count() > 1:
        factors = stored(factors.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(reduced, schema), "factors")
    # dims rows of dims values
    rows = sorted(factors.select("row", "v").collect())
    r = np.zeros((dims, dims))
    r[: len(rows)] = np.array([v for _, v in rows]).reshape(-1, dims)
    return r


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector of the reflection that leaves only the first entry of ``x``."""
    norm = np.linalg.norm(x)
    if norm == 0:
        return None
    v = x / norm
    v[0] += math.copysign(1.0, v[0])
    return v / np.linalg.norm(v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor ``v`` of ``u' r v``, by Householder reflections."""
    a, n = r.astype(float).copy(), r.shape[1]
    v = np.eye(n)
    for k in range(n):
        h = _reflector(a[k:, k])
        if h is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        if k + 2 < n:
            h = _reflector(a[k, k + 1 :])
            if h is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ h, h)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform with shift ``s``; none if the shift is too large."""
    d, qs, es = q[0] - s, [], []
    least = d
    for qk, ek in zip(q[1:], e):
        if d < 0:
            return None
        top = d + ek
        t = qk / top
        qs.append(top)
        es.append(ek * t)
        d = d * t - s
        least = min(least, d)
    if d < 0:
        return None
    return [*qs, d], es, least


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal, falling."""
    found, stack = [], [((diagonal**2).tolist(), (upper**2).tolist(), 0.0, None)]
    while stack:
        q, e, sigma, least = stack.pop()
        if len(q) == 1:
            found.append(sigma + q[0])
            continue
        cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _TINY * max(sigma + min(q[k], q[k + 1]), 0.0)), None)
        if cut is not None:
            stack += [(q[: cut + 1], e[:cut], sigma, None), (q[cut + 1 :], e[cut + 1 :], sigma, None)]
            continue
        if 1.5 * q[0] < q[-1]:
            q, e, least = q[::-1], e[::-1], None
        # an estimate of the least value from the last two rows, then safer ones
        gap = q[-2] - q[-1]
        tries = [q[-1] * (1 - 2 * e[-1] / gap)] if gap > 2 * e[-1] else []
        if least is not None:
            tries += [least * (1 - 1e-3), least * 0.75, least * 0.25]
        for s in [t for t in tries if t > 0 and t <= (least if least is not None else t)] + [0.0]:
            moved = _sweep(q, e, s)
            if moved is not None:
                stack.append((moved[0], moved[1], sigma + s, moved[2]))
                break
    return np.sort(np.array(found))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Vectors of ``L D L'`` for an eigenvalue, by falling quality of the twist."""
    n = len(d)
    safe = lambda x: x if x != 0 else _EPS * max(value, 1e-300)
    down, up = np.zeros(n), np.zeros(n)
    lp, um = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    down[0] = -value
    for i in range(n - 1):
        top = safe(down[i] + d[i])
        lp[i] = d[i] * low[i] / top
        down[i + 1] = lp[i] * low[i] * down[i] - value
    up[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        bottom = safe(d[i] * low[i] ** 2 + up[i + 1])
        um[i] = low[i] * d[i] / bottom
        up[i] = up[i + 1] * d[i] / bottom - value
    gamma = np.abs(down + up + value)
    for r in np.argsort(gamma, kind="stable"):
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lp[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -um[i] * z[i]
        yield z / np.linalg.norm(z)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``r`` and their right singular vectors as columns.

    Values that rounding alone may have made are left out.
    """
    diagonal, upper, v = bidiagonal(r)
    values = dqds(diagonal, upper)
    top = values[0] if len(values) else 0.0
    if not top > 0:
        return np.zeros(0), np.zeros((len(r), 0))
    values = values[: most][values[:most] > (len(r) * _EPS) ** 2 * top]
    # a zero on the diagonal, moved by less than rounding
    floor = 1e-3 * _EPS * math.sqrt(top)
    diagonal = np.where(np.abs(diagonal) < floor, floor, diagonal)
    d, low = diagonal**2, upper / diagonal[:-1]
    vectors: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [z for z, other in zip(vectors, values[:i]) if other - value <= 1e-3 * other]
        for z in _twisted(d, low, float(value)):
            for _ in range(2):
                for other in near:
                    z = z - (z @ other) * other
            norm = np.linalg.norm(z)
            # values that lie together share a space: another twist for what is already in it
            if norm > 0.1:
                vectors.append(z / norm)
                break
    z = v @ np.array(vectors).T
    sign = np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return values, z * sign


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per row and component.

    Vectors that are null, empty, or have a null, non-finite or (2**53 / scale
    and more) entry are dropped, as are those that are not of the most frequent
    length among distinct vectors (of equals the longest).  Entries become
    integers, ``floor(scale * c) + shift``.  The fit is on every distinct
    integer vector once: ``n`` of them with exact sums.  Components are numbered
    by falling variance; those without variance are left out, so one distinct
    vector gives no row at all, nor does an empty table.  The entry of largest
    size of a component is positive.  ``deviation`` is the exact squared
    distance from the mean, times n squared; more than a long raises
    OverflowError.  Null ids and repeated rows are kept; other columns are left
    out.
    """
    body = vectors[f"`{vector}`"].cast("array<double>")
    ready = vectors.select(long_id(vectors, vec_id).alias("vec_id"), integers(body, scale, shift).alias("x")).where("x is not null")
    ready = stored(ready, "integers")
    fit = stored(ready.select("x").distinct(), "fit")
    dims, n, sums = fit_sums(fit)
    if n:
        fit, ready = fit.where(F.size("x") == dims), ready.where(F.size("x") == dims)
        r = triangular_factor(fit, dims, n, sums)
        squares, basis = directions(r, components)
    else:
        squares, basis = np.zeros(0), np.zeros((0, 0))
    kept, trace = len(squares), float((r**2).sum()) if n else 0.0
    weights = basis / np.sqrt(squares / n) if n else basis

    def gram(batches):
        total = np.zeros((kept, kept))
        for batch in batches:
            y = (scaled_deviation(_rows_of(batch.column("x"), dims), n, sums) / n).astype(float) @ weights
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(kept * kept), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    error = 0.0
    if kept:
        # components squared values
        cells = fit.select("x").mapInArrow(gram, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        error = max(abs(c["v"] / n - (c["at"] // kept == c["at"] % kept)) for c in cells)
    explained = squares / trace if kept else squares

    def project(batches):
        for batch in batches:
            if not kept:
                return
            d = scaled_deviation(_rows_of(batch.column("x"), dims), n, sums)
            y = (d / n).astype(float) @ weights
            if len(d) and float((d.astype(float) ** 2).sum(axis=1).max()) >= 1 << 62:
                far = [sum(int(c) ** 2 for c in row) for row in d]
                if max(far) >= 1 << 63:
                    raise OverflowError("a squared deviation is more than a long holds")
            else:
                far = (d.astype(np.int64) ** 2).sum(axis=1)
            m = len(d)
            ids = pc.take(batch.column("vec_id"), pa.array(np.repeat(np.arange(m), kept)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, dtype=np.int64)), pa.array(np.repeat(np.asarray(far, dtype=np.int64), kept)),
                 pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return ready.mapInArrow(project, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
