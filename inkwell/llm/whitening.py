"""Whitening of embeddings along their leading principal components, by spectrum slicing.

Spark does what grows with the rows: exact sums per dimension, then the covariance from centred whole numbers (every task
adds up its own matrix, whose rows are summed by row number in two rounds), then the projection and the check of its
covariance. The covariance, as wide as a vector, is solved on the driver: inertia counts of an LDL^T factorisation of the shifted
matrix say how many eigenvalues lie above a shift, bisection isolates one eigenvalue after another, Rayleigh quotient iteration
converges inside its interval, and two more counts around the value prove its number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.llm.common import checkpointed

EPS = np.finfo(float).eps


# -- the spectrum --


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``: the positive pivots of LDL^T of the shifted
    matrix (Sylvester), with blocks of two where a single pivot would be too small. A pivot of zero counts as not above."""
    a = matrix - shift * np.eye(len(matrix))
    n, i, above = len(a), 0, 0
    tiny, alpha = EPS * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny), (1 + 17**0.5) / 8

    def swap(p: int, q: int) -> None:
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while i < n:
        below = np.abs(a[i + 1 :, i])
        r = i + 1 + int(below.argmax()) if len(below) else i
        most, two = below.max(initial=0.0), False
        if most > tiny and abs(a[i, i]) < alpha * most:
            row = np.abs(a[r, i:])
            row[r - i] = 0
            if abs(a[i, i]) * row.max() < alpha * most * most:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(i, r)
                else:
                    swap(i + 1, r)
                    two = True
        if two:  # such a block has one positive and one negative eigenvalue
            c = a[i + 2 :, i : i + 2]
            a[i + 2 :, i + 2 :] -= c @ np.linalg.solve(a[i : i + 2, i : i + 2], c.T)
            above, i = above + 1, i + 2
            continue
        d = a[i, i] if abs(a[i, i]) > tiny else -tiny
        above += d > 0
        c = a[i + 1 :, i]
        a[i + 1 :, i + 1 :] -= np.outer(c, c / d)
        i += 1
    return int(above)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as rows.

    Eigenvalues that rounding cannot tell apart get an orthonormal basis of their space. Raises ArithmeticError if the
    counts do not confirm a number.
    """
    n = len(matrix)
    scale = max(float(np.abs(matrix).sum(axis=1).max(initial=0.0)), np.finfo(float).tiny)  # no eigenvalue is larger
    tol = 8 * n * EPS * scale
    counts: dict[float, int] = {-2 * scale: n, 2 * scale: 0}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    values, vectors = np.zeros(k), np.zeros((k, n))
    rng = np.random.default_rng(5)
    for j in range(k):
        low = max(s for s, c in counts.items() if c > j)
        high = min(s for s, c in counts.items() if c <= j)
        while True:
            alone = above(low) == j + 1 and above(high) == j
            close = high - low <= tol
            if alone or close:
                value, vector, left = _rayleigh(matrix, (low + high) / 2, vectors[:j], scale, rng, fixed=close)
                if close or (low - tol <= value <= high + tol and left <= tol):
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > j else (low, middle)
        margin = max(left, tol)
        if not (count_above(matrix, value - margin) > j >= count_above(matrix, value + margin)):
            raise ArithmeticError(f"eigenvalue {j + 1} is not confirmed at {value}")
        values[j], vectors[j] = value, vector
    return values, vectors


def _rayleigh(matrix: np.ndarray, shift: float, found: np.ndarray, scale: float, rng: np.random.Generator, fixed: bool) -> tuple[float, np.ndarray, float]:
    """Inverse iteration from ``shift``, then with the Rayleigh quotient as shift (unless ``fixed``), orthogonal to ``found``.
    Returns the value, the unit vector and the length of the residual."""
    n = len(matrix)

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    def step(v: np.ndarray, s: float) -> np.ndarray:
        for _ in range(3):
            try:
                out = np.linalg.solve(matrix - s * np.eye(n), v)
                if np.isfinite(out).all():
                    return clean(out)
            except np.linalg.LinAlgError:
                pass
            s += EPS * scale  # exactly an eigenvalue
        return v

    v = clean(rng.standard_normal(n))
    for _ in range(3):
        v = step(v, shift)
    best = (np.inf, 0.0, v)
    for _ in range(12):
        value = float(v @ matrix @ v)
        left = float(np.linalg.norm(matrix @ v - value * v))
        if left >= best[0]:
            break
        best = (left, value, v)
        v = step(v, shift if fixed else value)
    return best[1], best[2], best[0]


# -- the rows --


@dataclass
class Fit:
    """``n`` vectors of ``dim`` entries, their ``sums``, the leading ``values`` and ``vectors`` (rows), the trace of the covariance,
    and the largest error of the whitened covariance (over components with a positive value; null without one)."""

    n: int
    dim: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values]

    @property
    def weights(self) -> np.ndarray:
        """What a centred vector is multiplied by; not-a-number for a component without spread."""
        none = self.values <= 8 * self.dim * EPS * max(self.trace, np.finfo(float).tiny)
        return self.vectors / np.sqrt(np.where(none, np.nan, self.values))[:, None]


def whole_numbers(df: DataFrame, vector_col: str, carry: Sequence[str], scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``carry`` columns and ``__x``, the vector as floor(scale * entry) + shift; rows whose vector is null, empty or holds a null
    or non-finite entry go."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.size(v) > 0
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c * scale) + shift)
    return df.where(v.isNotNull() & good & ~bad).select(*[F.col(f"`{c}`") for c in carry], x.alias("__x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(x: DataFrame) -> DataFrame:
    """Rows (size, at, n, s): the vectors of each length and their sums per dimension. A task gives one row per length and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            col = b.column("__x")
            sizes = np.diff(col.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                own = total.setdefault(size, [0, np.zeros(size, np.int64)])
                m = _matrix(col.filter(pa.array(sizes == size)), size)
                own[0] += len(m)
                own[1] += m.sum(axis=0)
        rows = [(size, at, n, int(s)) for size, (n, sums) in total.items() for at, s in enumerate(sums)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["size", "at", "n", "s"])

    made = x.select("__x").mapInArrow(run, "size long, at long, n long, s long")
    return made.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _added(part: DataFrame, by: list[str], out: str) -> DataFrame:
    """Matrix rows of doubles, added up by key."""

    def add(table: pa.Table) -> pa.Table:
        rows = np.stack([np.frombuffer(v, "<f8") for v in table.column("row").to_pylist()])
        keys = [table.column(c).slice(0, 1).combine_chunks() for c in out.split() if c != "row"]
        return pa.Table.from_arrays([*keys, pa.array([rows.sum(axis=0).astype("<f8").tobytes()], pa.binary())], names=out.split())

    return part.groupBy(*by).applyInArrow(add, ", ".join(f"{c} {'binary' if c == 'row' else 'long'}" for c in out.split()))


def _gram(x: DataFrame, dim: int, width: int, project) -> np.ndarray:
    """Sum over rows of p pᵀ, p = project(x) with ``width`` entries. A task sends ``width`` rows; they are added up by row number and
    a part of the tasks, then by row number, so no group holds a row of every task of a large job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros((width, width)), False
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = project(_matrix(b.column("__x").slice(at, 4096), dim))
                total += p.T @ p
                some = True
        if some:
            slot = TaskContext.get().partitionId() % 256
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array([slot] * width, pa.int64()), pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())], names=["at", "slot", "row"])

    part = x.where(F.size("__x") == dim).select("__x").mapInArrow(run, "at long, slot long, row binary")
    rows = _added(_added(part, ["at", "slot"], "at slot row"), ["at"], "at row").collect()  # ``width`` rows
    out = np.zeros((width, width))
    for r in rows:
        out[r["at"]] = np.frombuffer(r["row"], "<f8")
    return out


def fit(x: DataFrame, components: int = 8) -> Fit | None:
    """Fit on all rows of :func:`whole_numbers`. If lengths differ, the commonest one counts, of equally common ones the longest.
    None without rows. The driver holds a matrix of dim x dim, whatever the number of rows."""
    sums = checkpointed(_sums(x))
    top = sums.orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return None
    n, dim = top["n"], top["size"]
    s = [r["s"] for r in sums.where(F.col("size") == dim).orderBy("at").collect()]
    centre = np.array([round(v / n) for v in s], np.int64)
    off = np.array([v - n * int(c) for v, c in zip(s, centre, strict=True)], float) / n  # the mean less its whole part
    gram = _gram(x, dim, dim, lambda m: (m - centre).astype(float))
    cov = gram / n - np.outer(off, off)
    cov = (cov + cov.T) / 2
    k = min(components, dim)
    values, vectors = leading(cov, k)
    made = Fit(n, dim, s, values, vectors, float(np.trace(cov)), None)
    keep = np.isfinite(made.weights).all(axis=1)
    if keep.any():
        w = made.weights[keep]
        seen = _gram(x, dim, len(w) + 1, lambda m: np.column_stack([((m - centre) - off) @ w.T, np.ones(len(m))])) / n
        mean = seen[-1, :-1]
        made.identity_error = float(np.abs(seen[:-1, :-1] - np.outer(mean, mean) - np.eye(len(w))).max())
    return made


def transform(x: DataFrame, model: Fit, carry: Sequence[str]) -> DataFrame:
    """``carry`` columns, ``deviation`` decimal(38,0) (sum over dimensions of (n x - S)^2, exact) and ``whitened`` array<double>, one
    entry per component, null for a component without spread. Rows of another length than the fit's go."""
    n, dim, weights = model.n, model.dim, model.weights
    centre = np.array([round(v / n) for v in model.sums], np.int64)
    rest = np.array([v - n * int(c) for v, c in zip(model.sums, centre, strict=True)], np.int64)
    passed = [c for c in carry if c not in ("deviation", "whitened")]
    src = x.where(F.size("__x") == dim).select(*[F.col(f"`{c}`") for c in passed], "__x")
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in passed), "deviation string, whitened array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                y = _matrix(b.column("__x"), dim) - centre
                most = n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max(initial=0))
                d = n * (y if dim * most * most < 1 << 62 else y.astype(object)) - rest
                w = ((y - rest / n) @ weights.T).astype(float)
                flat = pa.array(w.ravel(), mask=~np.isfinite(w.ravel()))
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, len(weights)), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array([str(v) for v in (d * d).sum(axis=1).tolist()], pa.string()), whitened], names=[*passed, "deviation", "whitened"])

    made = src.mapInArrow(run, schema)
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(df: DataFrame, vector_col: str = "embedding", carry: Sequence[str] = ("vec_id",), components: int = 8) -> tuple[DataFrame, Fit | None]:
    """Fit and transform all rows of ``df``. Null vectors, vectors with null or non-finite entries, empty vectors and vectors of another
    length than most have go. Repeated rows, ids and nulls in carried columns stay as they are; carried columns named like a
    result are replaced. With fewer dimensions than ``components`` there are as many as dimensions; without rows, no result.
    Components without spread (fewer different vectors than dimensions) explain 0 and whiten to null."""
    x = whole_numbers(df, vector_col, carry)
    model = fit(x, components)
    if model is None:
        kept = [c for c in carry if c not in ("deviation", "whitened")]
        none = x.where("false").select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return none, None
    return transform(x, model, carry), model
