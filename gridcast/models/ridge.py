"""Two-phase ridge regression per series (the model fit of M1 and M3).

Phase 1 (``mapInPandas``): each task reduces its rows of each series, over
all its Arrow batches, to the sufficient statistics ``X'X`` (upper
triangle), ``X'y``, ``y'y`` and ``n``; memory is one batch plus the running
statistics (flushed past a cap). Wherever a series' rows sit (one task
after a per-series window, as in the hourly models, or many tasks for raw
input), each task emits one partial per series, so what is shuffled does
not grow with the number of rows.

Phase 2 (Spark aggregate): the partials are summed entry by entry with a
``groupBy(series, entry)`` sum (partial aggregation, distributed). The same
sum merges the entries of several batches (:mod:`gridcast.models.sums`).

Phase 3 (``applyInPandas``): each series receives exactly its
``p(p+1)/2 + p + 2`` summed entries and solves ``(X'X + diag(penalty)) b = X'y`` with numpy,
or the problem with an absolute penalty on some columns. The residual variance comes from the same statistics:
``sigma^2 = (y'y - 2 b'X'y + b'X'X b) / (n - p)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


FLUSH_DOUBLES = 20_000_000   # accumulated statistics per task before they are emitted (~160 MB)


def _given(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Design matrix and target of rows that carry their design row ``x``."""
    return np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["y"].to_numpy(dtype=np.float64)


def _partials(keys: list[str], p: int, flush_doubles: int = FLUSH_DOUBLES, build=_given):
    """Per task: running ``X'X`` (upper triangle), ``X'y``, ``y'y``, ``n`` per series over all its batches.

    One partial per (task, series) is emitted at the end of the task, or
    earlier when the accumulated statistics pass ``FLUSH_DOUBLES`` (so a task
    holding very many series stays within memory).
    """
    iu = np.triu_indices(p)
    per_key = len(iu[0]) + p + 2

    def emit(acc):
        rows = []
        for kv, (xtx, xty, yty, n) in acc.items():
            row = {k: v for k, v in zip(keys, kv)}
            row.update(xtx=xtx.tolist(), xty=xty.tolist(), yty=float(yty), n=int(n))
            rows.append(row)
        return pd.DataFrame(rows)

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            for kv, g in pdf.groupby(keys, sort=False, dropna=False):
                kv = kv if isinstance(kv, tuple) else (kv,)
                X, y = build(g)
                part = ((X.T @ X)[iu], X.T @ y, float(y @ y), len(g))
                if kv in acc:
                    a = acc[kv]
                    acc[kv] = (a[0] + part[0], a[1] + part[1], a[2] + part[2], a[3] + part[3])
                else:
                    acc[kv] = part
            if len(acc) * per_key > flush_doubles:
                yield emit(acc)
                acc = {}
        if acc:
            yield emit(acc)
    return run


def entries_of(p: int) -> int:
    """How many numbers the sums of ``p`` columns are: X'X (upper triangle), X'y, y'y and n."""
    return p * (p + 1) // 2 + p + 2


def _summed(rows: DataFrame, keys: list[str], p: int, flush_doubles: int, build) -> DataFrame:
    part_schema = T.StructType([f for f in rows.schema.fields if f.name in keys] + [
        T.StructField("xtx", T.ArrayType(T.DoubleType())),
        T.StructField("xty", T.ArrayType(T.DoubleType())),
        T.StructField("yty", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ])
    parts = rows.mapInPandas(_partials(keys, p, int(flush_doubles), build), part_schema)
    entries = F.concat("xtx", "xty", F.array(F.col("yty"), F.col("n").cast("double")))
    return parts.select(*keys, F.posexplode(entries).alias("i", "v"))


def partial_sums(df: DataFrame, keys: Sequence[str], p: int, flush_doubles: int = FLUSH_DOUBLES) -> DataFrame:
    """``(keys..., i, v)``: the entries of the normal equations of each key, to be added by (keys, i).

    ``df`` has the key columns, ``x ARRAY<DOUBLE>`` (length p) and ``y``. Each
    task adds up its own rows first, so what is shuffled does not grow with them.
    """
    keys = list(keys)
    rows = df.select(*keys, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.size("x") == p))
    return _summed(rows, keys, p, flush_doubles, _given)


def built_sums(df: DataFrame, keys: Sequence[str], p: int, build, flush_doubles: int = FLUSH_DOUBLES) -> DataFrame:
    """The same where ``build(rows of one key)`` gives the design matrix and the target, so only its inputs go to Python."""
    return _summed(df, list(keys), p, flush_doubles, build)


class Sums:
    """The normal equations of one key, from its entries."""

    def __init__(self, entries: np.ndarray, p: int):
        m = p * (p + 1) // 2
        upper = np.zeros((p, p))
        upper[np.triu_indices(p)] = entries[:m]
        self.xtx = upper + np.triu(upper, 1).T
        self.xty = entries[m: m + p].copy()
        self.yty = float(entries[m + p])
        self.n = int(round(entries[m + p + 1]))

    def scaled(self, a: np.ndarray, scale: float, shift: float) -> Sums:
        """The sums of ``A x`` and ``scale * y + shift``, where the first column of x is 1."""
        out = object.__new__(Sums)
        xt1, yt1 = self.xtx[:, 0], self.xty[0]
        out.xtx = a @ self.xtx @ a.T
        out.xty = a @ (scale * self.xty + shift * xt1)
        out.yty = scale * scale * self.yty + 2 * scale * shift * yt1 + shift * shift * self.n
        out.n = self.n
        return out

    def rss(self, b: np.ndarray) -> float:
        return max(0.0, self.yty - 2.0 * float(b @ self.xty) + float(b @ self.xtx @ b))

    def sigma(self, b: np.ndarray) -> float:
        return math.sqrt(self.rss(b) / max(self.n - len(b), 1))

    def ridge(self, penalty: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.xtx + np.diag(penalty), self.xty)

    def ridge_and_laplace(self, penalty: np.ndarray, sparse: slice, weight: float, sweeps: int = 20_000) -> np.ndarray:
        """Least squares with a squared penalty and, for the ``sparse`` columns, an absolute one of ``weight``.

        The other columns are solved for exactly, which leaves a small problem
        in the sparse ones; coordinate descent finds which of them are zero,
        and the others' own equations then give their values.
        """
        p = len(self.xty)
        s = np.arange(p)[sparse]
        o = np.setdiff1d(np.arange(p), s)
        full = self.xtx + np.diag(penalty)
        inner = np.linalg.solve(full[np.ix_(o, o)], np.c_[full[np.ix_(o, s)], self.xty[o]])
        g = full[np.ix_(s, s)] - full[np.ix_(s, o)] @ inner[:, :-1]
        r = self.xty[s] - full[np.ix_(s, o)] @ inner[:, -1]
        d, diag = np.zeros(len(s)), np.diag(g)
        diag = np.where(diag > 1e-12 * diag.max(initial=0.0), diag, np.inf)          # a column without data stays 0
        for sweep in range(sweeps):
            before = d.copy()
            for j in range(len(s)):
                c = r[j] - g[j] @ d + g[j, j] * d[j]
                d[j] = math.copysign(max(abs(c) - weight, 0.0), c) / diag[j]
            if np.abs(d - before).max(initial=0.0) <= 1e-12 * max(1.0, np.abs(d).max(initial=0.0)):
                break
            if sweep % 20 == 19:
                exact = self._of_active(g, r, d, weight)
                if exact is not None:
                    d = exact
                    break
        exact = self._of_active(g, r, d, weight)
        d = d if exact is None else exact
        out = np.zeros(p)
        out[s] = d
        out[o] = inner[:, -1] - inner[:, :-1] @ d
        return out

    @staticmethod
    def _of_active(g, r, d, weight):
        """The solution with the signs of ``d``, if it meets the conditions of the whole problem."""
        on = np.flatnonzero(d)
        out = np.zeros(len(d))
        if len(on):
            out[on] = np.linalg.solve(g[np.ix_(on, on)], r[on] - weight * np.sign(d[on]))
        slack = np.abs(r - g @ out)
        off = np.setdiff1d(np.arange(len(d)), on)
        fits = (np.sign(out[on]) == np.sign(d[on])).all() and (slack[off] <= weight * (1 + 1e-9)).all()
        return out if fits else None


def solve_sums(entries: DataFrame, keys: Sequence[str], p: int, solve) -> DataFrame:
    """One fit per key from ``(keys..., i, v)`` rows: ``(keys..., coef, sigma, n, penalty_weight)``.

    The entries are added by (keys, i) first, wherever they come from, so
    those of many tasks or many batches can be given together.
    ``solve(sums, row)`` returns (coefficients, sigma, weight of an absolute penalty).
    """
    keys = list(keys)
    added = entries.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    key_fields = [f for f in entries.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("penalty_weight", T.DoubleType()),
    ])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(entries_of(p))
        v[pdf["i"].to_numpy()] = pdf["v"].to_numpy()
        sums = Sums(v, p)
        row = {k: pdf[k].iloc[0] for k in keys}
        coef, sigma, weight = solve(sums, row)
        row.update(coef=coef.tolist(), sigma=sigma, n=sums.n, penalty_weight=weight)
        return pd.DataFrame([row])

    return added.groupBy(*keys).applyInPandas(one, out_schema)


def ridge_solver(penalty: Sequence[float]):
    pen = np.asarray(penalty, dtype=np.float64)

    def solve(sums: Sums, row) -> tuple[np.ndarray, float, float]:
        b = sums.ridge(pen)
        return b, sums.sigma(b), 0.0

    return solve


def fit_ridge(df: DataFrame, keys: Sequence[str], penalty: Sequence[float], flush_doubles: int = FLUSH_DOUBLES) -> DataFrame:
    """Ridge fit per key. ``df`` has the key columns, ``x ARRAY<DOUBLE>`` (length p) and ``y``.

    Returns ``keys..., coef ARRAY<DOUBLE>, sigma DOUBLE, n BIGINT, penalty_weight DOUBLE``. Extra key
    columns that are constant within a series (bounds, last time) pass
    through the fit unchanged, so they need no join back.
    """
    p = len(penalty)
    return solve_sums(partial_sums(df, keys, p, flush_doubles), keys, p, ridge_solver(penalty))


def normal_residual(design: DataFrame, model: DataFrame, penalty: Sequence[float], key: str = "series_id",
                    sparse: range = range(0)) -> DataFrame:
    """``(key, residual, n)``: how far a fit is from its optimality conditions, relative to the right side of its equations.

    With g = ``X'(y - X b) - penalty * b``, from the design rows themselves and
    without the solver's sums: g is 0; in the ``sparse`` columns it is the
    model's ``penalty_weight`` with the sign of b, or no larger where b is 0.
    The largest miss is divided by the largest of ``X'y``.
    """
    pen = F.array(*[F.lit(float(v)) for v in penalty])
    carried = ["coef"] + (["penalty_weight"] if len(sparse) else [])
    rows = design.where(F.col("x").isNotNull() & F.col("y").isNotNull()).join(model.select(key, "coef"), key)
    error = F.col("y") - dot(F.col("x"), F.col("coef"))
    long = rows.select(key, error.alias("e"), "y", F.posexplode("x").alias("i", "v"))
    sums = long.groupBy(key, "i").agg(F.sum(F.col("v") * F.col("e")).alias("g"), F.sum(F.col("v") * F.col("y")).alias("b"), F.count("*").alias("n"))
    left = sums.join(model.select(key, *carried), key)
    own = F.get("coef", "i")
    g = F.col("g") - F.get(pen, "i") * own
    miss = F.abs(g)
    if len(sparse):
        inside = F.col("i").between(sparse.start, sparse.stop - 1)
        at_zero = F.greatest(F.abs(g) - F.col("penalty_weight"), F.lit(0.0))
        miss = F.when(inside & (own == 0), at_zero).when(inside, F.abs(g - F.signum(own) * F.col("penalty_weight"))).otherwise(miss)
    return left.withColumn("r", miss).groupBy(key).agg((F.max("r") / F.max(F.abs("b"))).alias("residual"), F.max("n").alias("n"))


def dot(x, coef):
    """Catalyst dot product of two ``ARRAY<DOUBLE>`` columns (no UDF)."""
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
