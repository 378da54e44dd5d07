"""Whitening of embeddings on their leading principal components.

A randomised range finder gives the components: a random block with some columns more
than are wanted is multiplied by the covariance again and again, each time in one pass
over all centred rows, and made orthonormal in between. Rayleigh-Ritz on the block
gives eigenvalues and vectors, and the pass itself tells their residuals. Where these
don't come down, the block is expanded to the full dimension, whose Ritz vectors are
the eigenvectors. Rows never leave their tasks: a pass sums one small matrix for each
vector length, in tasks first and then by matrix entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import arrow_rows, stash

COMPONENTS = 16
#: Columns of the block beyond the components, passes before it is expanded, and residuals that need no expansion,
#: as a share of the distance to the next eigenvalue (that share bounds the angle to the eigenvector).
OVERSAMPLING, PASSES, RESIDUAL = 10, 6, 1e-10
#: Columns of the expanded block that one pass multiplies.
COLUMNS = 256
#: Eigenvalues under this share of the largest are rounding errors of zero.
ZERO = 1e-12
#: Whole numbers: floor(SCALE * c) + SHIFT of an entry c; what is multiplied is held within +-2^62.
SCALE, SHIFT, MOST = 64, 1_000_000, 2.0**62
#: Numbers in an Arrow batch, about, and numbers that a task sums before it passes them on.
BATCH_NUMBERS, HELD_NUMBERS = 1_000_000, 4_000_000
SEED = 42


def whole_entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector has entries and no null or non-finite one."""
    e = F.col("embedding").cast("array<double>")
    odd = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c * SCALE))
    rows = vectors.select("vec_id", e.alias("e")).where((F.size("e") > 0) & ~odd)
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(held(c)) + SHIFT).alias("x"))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, its rows' places, matrix of whole numbers) for each length in a list column."""
    lengths = np.diff(column.offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dim)
        own = column if len(places) == len(lengths) else column.take(pa.array(places))
        yield dim, places, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Centre:
    """n vectors of one length with sums S: the mean as a whole part and a rest, so that centring rounds once."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.left = np.array([s % n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over each row, exactly; None where that is beyond a long."""
        off = x - self.whole
        most = self.n * (float(np.abs(off).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2.0**62:
            d = self.n * off - self.left
            return (d * d).sum(axis=1).tolist()
        left = self.left.tolist()
        exact = [sum((self.n * o - r) ** 2 for o, r in zip(row, left, strict=True)) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def centres(fit: DataFrame) -> dict[int, Centre]:
    """The centre of each vector length of fit(x); sums are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _by_length(batch.column("x")):
                small = float(np.abs(x).max()) * len(x) < 2.0**62
                sums = x.sum(axis=0).tolist() if small else [sum(c) for c in zip(*x.tolist(), strict=True)]
                totals = pa.array(list(map(Decimal, [len(x), *sums])), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array([dim] * (dim + 1), pa.int32()), pa.array(np.arange(-1, dim, dtype=np.int32)), totals], ["dim", "place", "total"])

    parts = fit.mapInArrow(run, "dim int, place int, total decimal(38,0)")
    sums: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("dim", "place").agg(F.sum("total").alias("total")).collect():  # one number a dimension
        sums.setdefault(r.dim, {})[r.place] = int(r.total)
    return {dim: Centre(s[-1], [s[i] for i in range(dim)]) for dim, s in sums.items()}


def _summed(fit: DataFrame, centre: dict[int, Centre], product: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length the sum over all rows of product(length, centred rows), a matrix."""

    def rows(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for dim, z in held.items():
            i, j = (pa.array(a.ravel().astype(np.int32)) for a in np.indices(z.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(z.size, dim, np.int32)), i, j, pa.array(z.ravel())], ["dim", "i", "j", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch.column("x")):
                z = product(dim, centre[dim](x))
                held[dim] = held[dim] + z if dim in held else z
            if sum(z.size for z in held.values()) > HELD_NUMBERS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    parts = fit.mapInArrow(run, "dim int, i int, j int, z double").groupBy("dim", "i", "j").agg(F.sum("z").alias("z"))
    table = parts.toArrow()
    dims, i, j, z = (table.column(c).to_numpy() for c in ("dim", "i", "j", "z"))
    out = {}
    for dim in np.unique(dims).tolist():
        own = dims == dim
        out[dim] = np.zeros((i[own].max() + 1, j[own].max() + 1))
        out[dim][i[own], j[own]] = z[own]
    return out


def _times(fit: DataFrame, centre: dict[int, Centre], blocks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Covariance times block for each length that has one: one pass over all rows."""
    some = fit.where(F.size("x").isin(list(blocks)))
    sums = _summed(some, centre, lambda dim, c: c.T @ (c @ blocks[dim]))
    return {dim: z / centre[dim].n for dim, z in sums.items()}


def ritz(q: np.ndarray, vq: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Largest Ritz values above zero of an orthonormal block with their vectors, and whether their residuals are small."""
    small = q.T @ vq
    values, w = np.linalg.eigh((small + small.T) / 2)
    values, w = values[::-1], w[:, ::-1]
    k = min(most, int((values > ZERO * max(values[0], 0)).sum()))
    gaps = np.minimum(np.append(np.inf, values[: len(values) - 1] - values[1:]), np.append(values[:-1] - values[1:], np.inf))[:k]
    values, vectors = values[:k], q @ w[:, :k]
    residuals = np.linalg.norm(vq @ w[:, :k] - vectors * values, axis=0)
    return values, vectors, bool((residuals <= RESIDUAL * gaps).all())


def principal_components(fit: DataFrame, centre: dict[int, Centre], most: int = COMPONENTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance of each length, by falling eigenvalue, those of zero left out.

    The driver holds length x (most + OVERSAMPLING) numbers a pass, and length^2 where
    the block is expanded.
    """
    random = np.random.Generator(np.random.PCG64(SEED))
    blocks = {dim: np.linalg.qr(random.normal(size=(dim, min(dim, most + OVERSAMPLING))))[0] for dim in sorted(centre)}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def settle(dim: int, values: np.ndarray, vectors: np.ndarray) -> None:
        found[dim] = values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])

    for _ in range(PASSES):
        for dim, z in (_times(fit, centre, blocks) if blocks else {}).items():
            values, vectors, settled = ritz(blocks[dim], z, most)
            if settled:
                settle(dim, values, vectors)
                del blocks[dim]
            else:
                blocks[dim] = np.linalg.qr(z)[0]
    for dim in blocks:
        full = [_times(fit, centre, {dim: np.eye(dim)[:, a : a + COLUMNS]})[dim] for a in range(0, dim, COLUMNS)]
        settle(dim, *ritz(np.eye(dim), np.concatenate(full, axis=1), most)[:2])
    return found


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of vectors(vec_id, embedding, ...) and component.

    Vectors that are null, empty or hold null or non-finite entries are left out; rows
    without a vec_id and repeated rows stay. The fit takes each distinct vector of whole
    numbers once. Vectors of different lengths are fitted apart. Components whose
    eigenvalue is zero aren't given, so there are fewer where vectors span fewer
    dimensions, and none where all are equal. ``deviation`` is null where it is beyond
    a long. Entries beyond 2^56 are held there. Other columns are ignored; an empty
    table gives none.
    """
    own = whole_entries(vectors)
    spark = vectors.sparkSession
    fit = stash(own.select("x").distinct(), "whiten-fit")
    longest = fit.agg(F.max(F.size("x"))).first()[0] or 1
    with arrow_rows(spark, max(64, min(10_000, BATCH_NUMBERS // longest))):
        centre = centres(fit)
        model = principal_components(fit, centre, most)
        project = {dim: vectors / np.sqrt(values) for dim, (values, vectors) in model.items()}
        squares = _summed(fit, centre, lambda dim, c: np.array([[(c * c).sum()]]))
        grams = _summed(fit, centre, lambda dim, c: (c @ project[dim]).T @ (c @ project[dim]))
    explained = {dim: (values / (squares[dim][0, 0] / centre[dim].n)).tolist() if len(values) else [] for dim, (values, _) in model.items()}
    error = {dim: float(np.abs(g / centre[dim].n - np.eye(len(g))).max(initial=0)) for dim, g in grams.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places, x in _by_length(batch.column("x")):
                k = len(explained[dim])
                if k:
                    ids = batch.column("vec_id").take(pa.array(np.repeat(places, k)))
                    deviation = pa.array(centre[dim].deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                    values = (centre[dim](x) @ project[dim]).ravel()
                    columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, centre[dim].n)), deviation]
                    columns += [pa.array(values), pa.array(np.tile(explained[dim], len(x))), pa.array(np.full(len(x) * k, error[dim]))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
