"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become fixed-point integers x = floor(scale * c) + offset. Mean and
covariance V come from the fit list, each distinct x vector once. A block of
vectors Q is multiplied by V in distributed passes: every task adds up
X'(XQ) over its centred rows, an aggregate adds the tasks' entries, and the
driver sees only dims x block numbers. Between two Rayleigh-Ritz steps a Chebyshev
recurrence in V, small on the unwanted part of the spectrum [0, a] and large
above it, filters the block; a is the block's smallest Ritz value. Then the
block is orthonormalised by QR and rotated by the eigenvectors of Q'VQ. The
loop ends when the residuals |Vq - eq| of all wanted pairs certify them.

The fit list is staged in the shared folder as packed integer blocks, so a
pass re-reads a few bytes a component and a lost executor costs a re-read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

COMPONENTS = 16
GUARD = 32                          # further block columns, which speed up the wanted ones
SCALE = 64
OFFSET = 1_000_000
LARGEST = 2.0 ** 56                 # |c| beyond this counts as this, so that x stays a long
PACK = 4096
TOLERANCE = 1e-13                   # residual, as a share of the largest eigenvalue
SETTLED = 1e-11                     # a residual that stops falling below this is rounding
MAX_ROUNDS = 60
SEED = 42
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def vectors_by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of the vectors that are neither null nor hold null or non-finite entries."""
    valid = np.asarray(column.is_valid())
    sizes = np.where(valid, np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)      # a null entry becomes NaN
    ends = np.cumsum(sizes)
    for dims in np.unique(sizes[valid & (sizes > 0)]).tolist():
        rows = np.flatnonzero(valid & (sizes == dims))
        whole = flat[(ends[rows] - dims)[:, None] + np.arange(dims)] if len(flat) != len(rows) * dims else flat.reshape(len(rows), dims)
        fine = np.isfinite(whole).all(axis=1)
        if fine.any():
            yield rows[fine], whole[fine]


def _narrow(y: np.ndarray) -> list[bytes]:
    """Each row in the smallest of 2, 4 or 8 bytes an entry that holds it, so equal vectors have equal bytes."""
    top = np.maximum(y.max(axis=1), ~y.min(axis=1))
    out: list[bytes] = [b""] * len(y)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", (1 << 15) - 1, 1 << 31), ("<i8", (1 << 31) - 1, 1 << 63)):
        at = np.flatnonzero((top > low) & (top < high))
        for i, row in zip(at.tolist(), y[at].astype(kind)):
            out[i] = row.tobytes()
    return out


def _fixed_point(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, c in vectors_by_length(batch.column(1)):
                y = np.floor(scale * np.clip(c, -LARGEST, LARGEST)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), c.shape[1], np.int32)), pa.array(_narrow(y), pa.binary())],
                    names=["id", "dims", "y"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dims, width, data): up to PACK vectors of one length and one width of entries."""
    held: dict[tuple[int, int], list[bytes]] = {}

    def out(key, rows):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([b"".join(rows)], pa.binary())],
                                          names=["dims", "width", "data"])

    for batch in batches:
        for dims, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = held.setdefault((dims, len(y) // dims), [])
            rows.append(y)
            if len(rows) == PACK:
                yield out((dims, len(y) // dims), rows)
                rows.clear()
    for key, rows in held.items():
        if rows:
            yield out(key, rows)


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for dims, width, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
        yield np.frombuffer(data, f"<i{width}").reshape(-1, dims)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, dimension, total) of a task; totals as decimal text, exact at any size."""
    n, total = 0, None
    for batch in batches:
        for y in _blocks(batch):
            part = y.sum(axis=0, dtype=np.int64).tolist() if y.itemsize < 8 else [sum(c) for c in y.T.tolist()]
            n, total = n + len(y), part if total is None else [a + b for a, b in zip(total, part)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()),
                                          pa.array([str(t) for t in total])], names=["n", "i", "total"])


class _Fit:
    """The fit list of one vector length: exact count and sums, and passes over its centred rows."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.spark, self.dims = blocks.sparkSession, dims
        self.blocks = blocks.where(F.col("dims") == dims)
        sums = (self.blocks.mapInArrow(_exact_sums, "n long, i int, total string").groupBy("i")
                .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).collect())
        self.n = sums[0]["n"]
        self.total = [0] * dims
        for r in sums:
            self.total[r["i"]] = int(r["total"])
        self.base = [t // self.n for t in self.total]
        self.rest = [t - self.n * b for t, b in zip(self.total, self.base)]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part (taken off exactly) and fraction."""
        return np.array(self.base, np.int64), np.array([r / self.n for r in self.rest])

    def _reduced(self, make, shape: tuple[int, int], value) -> np.ndarray:
        """Sum over all tasks of ``make(centred rows, value)``: each task gives its entries, which an aggregate adds by their place."""
        shared = self.spark.sparkContext.broadcast((self.centre(), value))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (whole, fraction), given = shared.value
            total = None
            for batch in batches:
                for y in _blocks(batch):
                    part = make((y - whole) - fraction, given)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

        added = self.blocks.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()      # one row an entry
        shared.unpersist()
        out = np.zeros(math.prod(shape))
        out[added.column("at").to_numpy()] = added.column("v").to_numpy()
        return out.reshape(shape)

    def times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """(V q, trace of V), by one pass."""
        out = self._reduced(_product, (self.dims, q.shape[1] + 1), q)
        return out[:, :-1] / self.n, float(out[:, -1].sum()) / self.n

    def covariance_of(self, axes: np.ndarray) -> np.ndarray:
        """Covariance of the centred rows times ``axes``, by one pass over the products."""
        k = axes.shape[1]
        out = self._reduced(_gram, (k + 1, k), axes) / self.n
        return out[:k] - np.outer(out[k], out[k])


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.hstack([x.T @ (x @ q), (x * x).sum(axis=0)[:, None]])


def _gram(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = x @ axes
    return np.vstack([z.T @ z, z.sum(axis=0)])


def _filtered(fit: _Fit, u: np.ndarray, vu: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """The degree's Chebyshev polynomial of V, for [0, low] and scaled to 1 at ``high``, times u (``vu`` is V u)."""
    half = low / 2
    first = sigma = half / (high - half)
    before, now = u, (vu - half * u) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        moved, _ = fit.times(now)
        before, now = now, (moved - half * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def principal_axes(fit: _Fit, components: int = COMPONENTS, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, axes as columns, trace of V) of the largest components, to double precision."""
    block = min(fit.dims, components + guard)
    q = np.linalg.qr(np.random.default_rng([SEED, fit.dims]).normal(size=(fit.dims, block)))[0]
    last = np.inf
    for _ in range(MAX_ROUNDS):
        vq, trace = fit.times(q)
        e, w = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, w = e[::-1], w[:, ::-1]
        u, vu = q @ w, vq @ w
        wanted = min(components, block)
        if e[0] <= 0:
            return np.zeros(0), np.zeros((fit.dims, 0)), trace
        residual = float(np.linalg.norm(vu[:, :wanted] - u[:, :wanted] * e[:wanted], axis=0).max() / e[0])
        if residual <= TOLERANCE or (residual <= SETTLED and residual > last / 4):
            real = e[:wanted] > 1e-12 * e[0]                             # a lower rank has fewer components
            axes = u[:, :wanted][:, real]
            axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
            return e[:wanted][real], axes, trace
        last = residual
        low, high = max(float(e[-1]), 1e-9 * float(e[0])), float(e[0])
        growth = math.acosh(max(1.0 + 1e-9, 2 * float(e[wanted - 1]) / low - 1))
        degree = int(min(24, max(4, math.ceil(math.acosh(max(2.0, 10 * residual / TOLERANCE)) / growth))))
        q = np.linalg.qr(_filtered(fit, u, vu, low, high, degree))[0]
    raise RuntimeError("the subspace iteration was not certified")


def _whitened(shared, schema: pa.Schema):
    """Over (id, y) of one length: a row for each component."""
    def deviations(y: np.ndarray, n: int, whole: np.ndarray, rest: list[int]) -> pa.Array:
        z = y - whole
        if n * (float(np.abs(z.astype(float)).max(initial=0)) + 1) < math.sqrt((1 << 62) / y.shape[1]):
            t = n * z - np.array(rest, np.int64)
            return pa.array((t * t).sum(axis=1))
        exact = [sum((n * (int(a) - int(w)) - r) ** 2 for a, w, r in zip(row, whole.tolist(), rest)) for row in y.tolist()]
        return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, n, whole, fraction, rest, axes, explained, error = shared.value
        k = axes.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                some = batch.slice(at, PACK)
                data = some.column(1).to_pylist()
                y = np.empty((len(data), dims), np.int64)
                widths = np.array([len(d) // dims for d in data])
                for width in np.unique(widths).tolist():
                    rows = np.flatnonzero(widths == width)
                    y[rows] = np.frombuffer(b"".join(data[i] for i in rows), f"<i{width}").reshape(-1, dims)
                z = ((y - whole) - fraction) @ axes
                each = pa.array(np.repeat(np.arange(len(y)), k))
                columns = [some.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                           pa.array(np.full(len(y) * k, n, np.int64)), deviations(y, n, whole, rest).take(each), pa.array(z.ravel()),
                           pa.array(np.tile(explained, len(y))), pa.array(np.full(len(y) * k, error))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable input row and component: (id_col, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or holds null or non-finite entries go, and so
    do empty vectors; a null id stays a null id. Repeated vectors count once
    in the fit and each keep their rows. Vectors of different lengths are
    fitted apart, each length as its own list. There are as many components
    as V has rank, ``components`` at most: one vector, or equal vectors only,
    give no rows. Entries beyond 2^56 count as 2^56; a deviation beyond the
    range of a long is null. An empty table gives no rows. Other columns are
    not read, so their names cannot clash.
    """
    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    spark, name = df.sparkSession, kind.simpleString()
    units = staged(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
                   .mapInArrow(_fixed_point(scale), f"id {name}, dims int, y binary"), "fixed")
    blocks = staged(units.select("dims", "y").distinct().mapInArrow(_packed, "dims int, width int, data binary"), "fit")
    schema = pa.schema([("id", to_arrow_type(kind)), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    out = spark.createDataFrame([], f"id {name}, {OUT}")
    for dims in sorted(r["dims"] for r in blocks.select("dims").distinct().collect()):          # the lengths of vectors
        fit = _Fit(blocks, dims)
        e, axes, trace = principal_axes(fit, components)
        if not len(e):
            continue
        axes = axes / np.sqrt(e)
        error = float(np.abs(fit.covariance_of(axes) - np.eye(len(e))).max())
        shared = spark.sparkContext.broadcast((dims, fit.n, *fit.centre(), fit.rest, axes, e / trace, error))
        out = out.unionByName(units.where(F.col("dims") == dims).select("id", "y").mapInArrow(_whitened(shared, schema), f"id {name}, {OUT}"))
    return out.withColumnRenamed("id", id_col)
