"""Whitening components by shifted Cholesky QR.

* The fit list is every distinct integer vector once. Its rows, centred, are the matrix to factor.
* A pass over the rows sums the Gram matrix of the rows as orthogonalised so far, in every task for itself; the tasks'
  sums are added up row of the matrix by row. The Cholesky factor of the Gram matrix (with a shift where it isn't
  safely positive) is one more triangular factor, and the next pass solves the rows through all of them.
* It ends when the orthogonalised rows' own Gram matrix has no eigenvalues but ones and zeros (for dimensions that
  depend on others). The square root of this last matrix times the composed triangular factors is R; the singular value
  decomposition of R gives the components and their variances, to full precision also where the Gram matrix of the
  rows themselves would lose the small ones.

Only matrices of dimensions by dimensions reach the driver. Each length of vectors is a matrix of its own.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import stored
from barfold.llm.hard_negatives import integer_vector

#: Passes of orthogonalisation at most.
PASSES = 8
#: How far an eigenvalue of the orthogonalised rows may be from 1; up to ``_ZERO`` it counts as 0.
_NEAR, _ZERO = 0.1, 1e-8
#: Standard deviations under this share of the largest one are rounding errors of dependent dimensions.
LEAST_SHARE = 1e-13
#: Rows that are worked on in one go.
_ROWS = 4_096
_UNIT = 2.0**-53


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    scale: np.ndarray | None = None
    factors: list[np.ndarray] = field(default_factory=list)
    trace: float = 0.0
    components: np.ndarray | None = None  # a column each
    variances: np.ndarray | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def orthogonalised(self, x: np.ndarray) -> np.ndarray:
        out = self.centred(x) if self.scale is None else self.centred(x) * self.scale
        for r in self.factors:
            out = solved(out, r)
        return out

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly; null where it does not fit a long."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach**2 * max(1, x.shape[1]) < 1 << 63 else object
        d = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)] if x.shape[1] else [0] * len(x)


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, column by column."""
    out = rows.copy(order="F")
    for j in range(r.shape[1]):
        if j:
            out[:, j] -= out[:, :j] @ r[:j, j]
        out[:, j] /= r[j, j]
    return out


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of ``gram`` plus a shift, the given one or, if that fails, ever larger ones."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, _UNIT * len(gram) * max(float(np.abs(gram).max()), 1e-300))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            sizes = np.asarray(part.column("x").value_lengths())
            for d in np.unique(sizes):
                own = part.filter(pa.array(sizes == d))
                yield int(d), own, np.asarray(own.column("x").flatten()).reshape(own.num_rows, int(d))


def gram_rows(rows: DataFrame, turned: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """Per length the Gram matrix of ``turned(length, x)``: summed in every task, then over the tasks in their order."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, _, x in _by_length(batches):
            y = turned(d, x)
            if y is not None:
                sums[d] = sums.get(d, 0.0) + y.T @ y
        part = TaskContext.get().partitionId()
        for d, g in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([d] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array([part] * len(g), pa.int32()),
                pa.array(list(g), pa.list_(pa.float64()))], names=["dims", "i", "part", "g"])

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        g = np.asarray(table.column("g").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"dims": table.column("dims")[:1], "i": table.column("i")[:1], "g": pa.array([g], pa.list_(pa.float64()))})

    partials = rows.select("x").mapInArrow(partial, "dims int, i int, part int, g array<double>")
    found: dict[int, dict[int, list]] = {}
    for r in partials.groupBy("dims", "i").applyInArrow(total, "dims int, i int, g array<double>").toLocalIterator():
        found.setdefault(r.dims, {})[r.i] = r.g
    return {d: np.array([g[i] for i in sorted(g)]) for d, g in found.items()}


def sums_of(rows: DataFrame) -> dict[int, Fit]:
    """Per length how many rows there are and their exact sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, _, x in _by_length(batches):
            s = x.sum(axis=0) if x.size == 0 or int(np.abs(x).max()) < 1 << 40 else x.astype(object).sum(axis=0)
            yield pa.RecordBatch.from_arrays([
                pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()),
                pa.array([len(x), *map(int, s)]).cast(pa.decimal128(38, 0))], names=["dims", "i", "s"])

    sums = rows.select("x").mapInArrow(partial, "dims int, i int, s decimal(38,0)").groupBy("dims", "i").agg(F.sum("s").alias("s"))
    found: dict[int, dict[int, int]] = {}
    for r in sums.toLocalIterator():  # one row for each dimension
        found.setdefault(r.dims, {})[r.i] = int(r.s)
    return {d: Fit(s[-1], [s[i] for i in range(d)]) for d, s in found.items() if d > 0}


def fit(rows: DataFrame, components: int = 4) -> dict[int, Fit]:
    """Components of the (distinct) ``x`` vectors in ``rows``, per length; none of variance 0."""
    fits = sums_of(rows)
    open_, last = set(fits), {}
    for number in range(PASSES):
        if not open_:
            break
        asked = {d: fits[d] for d in open_}
        grams = gram_rows(rows, lambda d, x, asked=asked: asked[d].orthogonalised(x) if d in asked else None)
        for d, g in grams.items():
            f = fits[d]
            if number == 0:
                f.trace = float(np.trace(g))
                norms = np.sqrt(np.diag(g))
                f.scale = np.where(norms > 0, 2.0 ** -np.round(np.log2(np.where(norms > 0, norms, 1.0))), 1.0)
                g = g * f.scale[:, None] * f.scale
                shift = min(1e-3, 11 * (f.n * d + d * (d + 1)) * _UNIT) * float(np.trace(g))
            else:
                shift = 0.0
                values = np.linalg.eigvalsh(g)
                if number > 1 and np.all((np.abs(values - 1) < _NEAR) | (values < _ZERO)):
                    last[d] = g
                    open_.discard(d)
                    continue
            last[d] = g
            if not np.any(g):
                open_.discard(d)
            elif number < PASSES - 1:
                f.factors.append(cholesky(g, shift))
    for d, f in fits.items():
        values, vectors = np.linalg.eigh(last[d])
        r = np.eye(d)
        for factor in f.factors:
            r = factor @ r
        r = (np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T) @ r / f.scale
        _, s, vt = np.linalg.svd(r)
        keep = int(np.sum((s > LEAST_SHARE * s[0]) & (s > 0)))
        v = vt[: min(components, keep)].T
        f.components = v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1.0, 1.0)
        f.variances = s[: v.shape[1]] ** 2 / f.n
    return fits


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length the largest entry of the whitened rows' covariance minus the identity."""
    def turned(d: int, x: np.ndarray) -> np.ndarray | None:
        return None if d not in fits else np.column_stack([fits[d].whitened(x), np.ones(len(x))])

    errors = {}
    for d, g in gram_rows(rows, turned).items():
        n, mean = g[-1, -1], g[-1, :-1] / g[-1, -1]
        errors[d] = float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(g) - 1)).max(initial=0.0))
    return errors


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    Entries become x = floor(256 c). The components are those of the distinct x vectors' covariance (divisor n),
    numbered from 1 by falling variance, each with its largest entry positive; ``whitened`` is the centred row on the
    component over its standard deviation, ``explained`` the component's share of the whole variance, ``deviation``
    the exact sum of (n x - S)^2 (null where it exceeds a long). Rows with a null vector or an entry that is null or not
    finite are left out; repeated rows and null ids stay; vectors of different lengths are fitted apart. Components
    without variance can't be whitened and give no row, so a length with one distinct vector has none; neither has
    the empty vector, nor an empty table.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    given = stored(rows.select(F.col(id_col).alias("vec_id"), integer_vector(F.col(vector_col)).alias("x")).where("x is not null"), "integers")
    listed = stored(given.select("x").distinct(), "fit-list")
    fits = {d: f for d, f in fit(listed, components).items() if f.components.shape[1]}
    errors = identity_errors(listed, fits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, own, x in _by_length(batches):
            if d not in fits:
                continue
            f = fits[d]
            k, n = f.components.shape[1], len(x)
            yield pa.RecordBatch.from_arrays([
                own.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                pa.array(np.full(n * k, f.n)), pa.array(f.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(f.whitened(x).ravel()), pa.array(np.tile(f.variances * f.n / f.trace, n)), pa.array(np.full(n * k, errors[d]))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return given.mapInArrow(judge, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
