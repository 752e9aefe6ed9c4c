"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Components become ``x = floor(scale * c)``, c as double. The fit list holds each distinct vector once. Three passes over it give
the exact sums, the scatter of the centred vectors (a matrix a task, added up row by row), and the covariance of what was
whitened. The scatter's factor ``L`` of ``V = L L'`` is rotated from the right until its columns are at right angles: their squared norms are
V's eigenvalues and the columns, scaled to one, its eigenvectors. Only the ``components`` first ones leave the task.

Vectors that are null, hold null or non-finite components or components whose x leaves the range of a long take no part. Vectors
of different lengths share no covariance: each length has its own fit list and components, in the same jobs as long as their
scatters together hold ``SCATTER_CELLS`` numbers, else in several. Directions without variance can't be whitened, so a fit list
of rank r gives r components at most: none for one distinct vector. Repeated rows and null vec_ids are rows like others. Empty tables
give empty results. Deviations beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.io import settle
from foliant.llm.topk import scaled

SCATTER_CELLS = 4_000_000
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """Of one length of vectors: size, sums and means of the fit list, and its components, a row each."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes.T / np.sqrt(self.values)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` with ``v = L L'`` in the rows' own order, a column for each pivot, the largest one left first."""
    left, columns = v.astype(float).copy(), []
    least = len(v) * np.finfo(float).eps * max(float(np.diag(v).max(initial=0.0)), 0.0)
    for _ in range(len(v)):
        p = int(np.argmax(np.diag(left)))
        if left[p, p] <= least:
            break
        column = left[:, p] / np.sqrt(left[p, p])
        columns.append(column)
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0.0
    return np.array(columns).T.reshape(len(v), len(columns))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` rotated from the right until all its columns are at right angles. A sweep meets every pair of columns once, in
    rounds of disjoint pairs."""
    a = factor.copy()
    n = a.shape[1] + a.shape[1] % 2
    ring = list(range(n))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(n - 1):
            pairs = np.array([(p, q) for p, q in zip(ring[: n // 2], ring[: n // 2 - 1 : -1], strict=True) if max(p, q) < a.shape[1]], int).reshape(-1, 2)
            x, y = a[:, pairs[:, 0]], a[:, pairs[:, 1]]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx * yy)
            far = np.abs(xy) > 1e-16 * scale
            worst = max(worst, float(np.max(np.abs(xy[far]) / scale[far], initial=0.0)))
            tau = (yy - xx) / np.where(far, 2 * xy, 1.0)
            t = np.where(far, np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, pairs[:, 0]], a[:, pairs[:, 1]] = c * x - c * t * y, c * t * x + c * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst < 4e-16 * max(len(a), 8) ** 0.5:
            break
    return a


def factorize(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v`` and their unit eigenvectors, a row each."""
    turned = jacobi(pivoted_cholesky(v))
    norms = np.sqrt((turned * turned).sum(0))
    order = np.argsort(-norms, kind="stable")[:components]
    return norms[order] ** 2, (turned[:, order] / norms[order]).T


def _by_length(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) of the vectors of each length."""
    column = batch.column(batch.schema.get_field_index(name))
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), d)


def _bound(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the rows of ``x`` with the row or rows ``y``, as Python integers where longs are too short."""
    if _bound(x) * _bound(y) * max(x.shape[1], 1) < 1 << 62:
        return (x * y).sum(1).astype(object)
    return (x.astype(object) * y.astype(object)).sum(1)


def fit_sums(fit: DataFrame) -> dict[int, list[int]]:
    """Exact sums of each place of the vectors x of every length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for rows, x in _by_length(b):
                own = x.sum(0).astype(object) if _bound(x) * len(rows) < 1 << 62 else x.astype(object).sum(0)
                held[x.shape[1]] = held.get(x.shape[1], 0) + own
        rows = [(d, i, Decimal(int(s))) for d, own in held.items() for i, s in enumerate(own)]
        kinds = (("d", pa.int32()), ("i", pa.int32()), ("s", pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    parts = fit.select("x").mapInArrow(add, "d int, i int, s decimal(38,0)")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("s").alias("s")).orderBy("d", "i").collect():  # a row per place of a length
        out.setdefault(r["d"], []).append(int(r["s"]))
    return out


def scatters(fit: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(d, i, row): the rows of the centred scatter of each length in ``models``; a task adds up its own vectors' first."""
    means = {d: m.mean for d, m in models.items()}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _by_length(b):
                y = x - means[x.shape[1]]
                held[x.shape[1]] = held.get(x.shape[1], 0) + y.T @ y
        part = TaskContext.get().partitionId()
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, part, np.int32)), pa.array(list(m), pa.list_(pa.float64()))], ["d", "i", "part", "row"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = None, None
        made: dict[str, list] = {"d": [], "i": [], "row": []}
        for b in batches:
            for d, i, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                own = own.values.to_numpy(zero_copy_only=False)
                if at == (d, i):
                    row = row + own
                    continue
                if at is not None:
                    [c.append(v) for c, v in zip(made.values(), (*at, row), strict=True)]
                at, row = (d, i), own
        if at is not None:
            [c.append(v) for c, v in zip(made.values(), (*at, row), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(made["d"], pa.int32()), pa.array(made["i"], pa.int32()), pa.array(made["row"], pa.list_(pa.float64()))], list(made))

    parts = fit.select("x").mapInArrow(scatter, "d int, i int, part int, row array<double>")
    return parts.repartition("d", "i").sortWithinPartitions("d", "i", "part").mapInArrow(total, "d int, i int, row array<double>")


def add_axes(fit: DataFrame, models: dict[int, Model], components: int) -> None:
    """Fit the components of every length in ``models`` and measure how far what they whiten is from unit covariance."""
    sizes = {d: m.n for d, m in models.items()}

    def solve(t: pa.Table) -> pa.Table:
        d = t.column("d")[0].as_py()
        v = np.zeros((d, d))
        for i, row in zip(t.column("i").to_pylist(), t.column("row"), strict=True):
            v[i] = row.values.to_numpy(zero_copy_only=False)
        v = (v + v.T) / 2 / sizes[d]
        values, axes = factorize(v, components)
        return pa.table({"d": pa.array([d] * len(values), pa.int32()), "k": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values), "trace": pa.array(np.full(len(values), np.trace(v))), "axis": pa.array(list(axes), pa.list_(pa.float64()))})

    found = scatters(fit, models).groupBy("d").applyInArrow(solve, "d int, k int, value double, trace double, axis array<double>")
    for r in found.orderBy("d", "k").collect():  # ``components`` rows a length
        m = models[r["d"]]
        m.trace = r["trace"]
        m.values = np.append(m.values if m.values is not None else [], r["value"])
        m.axes = np.vstack([*([] if m.axes is None else [m.axes]), np.array(r["axis"])[None, :]])
    solved = {d: m for d, m in models.items() if m.axes is not None}

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _by_length(b):
                if m := solved.get(x.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(list(m.apply(x)), pa.list_(pa.float64()))], ["d", "w"])

    made = fit.select("x").mapInArrow(whiten, "d int, w array<double>")
    pairs = [(a, b) for a in range(components) for b in range(a + 1)]
    for r in made.groupBy("d").agg(*[F.covar_pop(F.get("w", F.lit(a)), F.get("w", F.lit(b))).alias(f"c{a}_{b}") for a, b in pairs]).collect():  # a row a length
        got = [abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if r[f"c{a}_{b}"] is not None]
        models[r["d"]].identity_error = max(got)


def fit_models(fit: DataFrame, components: int) -> list[dict[int, Model]]:
    """Models by length, in parts whose scatters hold ``SCATTER_CELLS`` numbers together, or of one length."""
    sums = fit_sums(fit)
    parts: list[dict[int, Model]] = []
    held = 0
    for r in fit.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect():  # a row a length
        d, n = r["d"], r["n"]
        held += d * d
        if not parts or held > SCATTER_CELLS:
            parts, held = [*parts, {}], d * d
        parts[-1][d] = Model(n, sums[d], np.array([s / n for s in sums[d]]))
    for models in parts:
        add_axes(fit.where(F.col("d").isin(list(models))), models, components)
    return parts


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Rows (``WHITENED``) of every vector of ``vectors`` (vec_id, embedding) and every component."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("x")).where("x is not null and size(x) > 0")
    rows = rows.withColumn("d", F.size("x"))
    fit = settle(rows.select("d", "x").distinct(), "fit-list")
    names = [x.split()[0] for x in WHITENED.split(", ")]
    out = vectors.sparkSession.createDataFrame([], WHITENED)
    for models in fit_models(fit, components):
        solved = {d: m for d, m in models.items() if m.axes is not None}

        def apply(batches: Iterator[pa.RecordBatch], solved=solved) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, x in _by_length(b):
                    m = solved.get(x.shape[1])
                    if m is None:
                        continue
                    k, sums = len(m.values), np.array(m.sums, object)
                    if max(map(abs, m.sums)) < 1 << 62:
                        sums = sums.astype(np.int64)
                    squares = sum(s * s for s in m.sums)
                    exact = [m.n * m.n * a - 2 * m.n * c + squares for a, c in zip(_dots(x, x), _dots(x, sums), strict=True)]
                    deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                    ids = b.column(0).take(pa.array(np.repeat(at, k)))
                    n = len(at)
                    columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), n), np.full(n * k, m.n), deviation, m.apply(x).reshape(-1), np.tile(m.values / m.trace, n), np.full(n * k, m.identity_error)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

        out = out.unionByName(rows.where(F.col("d").isin(list(models))).select("vec_id", "x").mapInArrow(apply, WHITENED))
    return out
