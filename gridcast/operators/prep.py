"""Cleaning and rescaling, keyed by ``series_id``.

Per-series statistics are grouped aggregates, one row per series, joined
back by key: small enough to be broadcast at run time, and both sides read
the same shuffled hours.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import not_missing, rnd


def select_model_columns(df: DataFrame, mapping: dict[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Rename to model column names and keep only those (plus ``keep``)."""
    renamed = df.withColumnsRenamed(mapping)
    return renamed.select(*keep, *mapping.values())


def drop_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is null, or NaN for floating columns."""
    cols = list(cols)
    types = dict(df.dtypes)
    cond = None
    for c in cols:
        ok = not_missing(c) if types.get(c) in ("double", "float") else F.col(c).isNotNull()
        cond = ok if cond is None else cond & ok
    return df.where(cond) if cond is not None else df


def time_range(df: DataFrame, start=None, end=None, ts: str = "ds") -> DataFrame:
    """Rows with ``start <= ts < end`` (either bound optional); pushes down to Parquet."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df.where(cond)


def facet_filter(df: DataFrame, **facets) -> DataFrame:
    """Equality filter on named columns, e.g. ``facet_filter(df, respondent="ERCO", type="D")``."""
    for col, value in facets.items():
        if value is not None:
            df = df.where(F.col(col) == F.lit(value))
    return df


def series_quantiles(df: DataFrame, value: str, ps=C.RESCALE_QUANTILES, key: str = "series_id") -> DataFrame:
    """Exact linear-interpolation quantiles per series, one column per p (``q_<p>``).

    ``percentile`` keeps a value->count map per group; on hourly series the
    map is bounded by the number of hours in the history, whatever the raw
    reading volume.
    """
    qs = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in ps]))
    agg = df.where(not_missing(value)).groupBy(key).agg(qs.alias("_q"))
    return agg.select(key, *[F.col("_q")[i].alias(_qname(p)) for i, p in enumerate(ps)])


def _qname(p: float) -> str:
    return "q_" + f"{p:g}".replace(".", "_")


def rescale_minmax(df: DataFrame, value: str = "load", out: str = "load_mw", cfg: C.GridConfig = C.GridConfig(),
                   key: str = "series_id") -> DataFrame:
    """Rescale each series to the district range (no noise).

    Clip to the series' p1..p99, map linearly to ``[base, peak]``, clip to
    ``[0.5 base, 1.1 peak]``, round to 3 decimals. A constant series
    (p1 = p99) maps to ``base`` instead of dividing by zero.
    """
    lo_p, hi_p = C.RESCALE_QUANTILES
    # One row per series from a partial aggregate, joined back: the rows of a large series stay spread over tasks.
    q = series_quantiles(df, value, (lo_p, hi_p), key).toDF(key, "_lo", "_hi")
    x = F.col(value)
    clipped = F.least(F.greatest(x, F.col("_lo")), F.col("_hi"))
    norm = F.coalesce(F.try_divide(clipped - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0.0))
    scaled = F.lit(cfg.base_mw) + norm * F.lit(cfg.peak_mw - cfg.base_mw)
    bounded = F.least(F.greatest(scaled, F.lit(cfg.rescale_floor)), F.lit(cfg.rescale_cap))
    return (
        df.join(q, key, "left")
        .withColumn(out, F.when(not_missing(value), rnd(bounded, 3)))
        .drop("_lo", "_hi")
    )


def minmax_bounds(df: DataFrame, cols: Iterable[str], key: str = "series_id") -> DataFrame:
    """Per-series min and max of each column (the fitted scaler, as a table)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(key).agg(*aggs)


def minmax_scale(df: DataFrame, cols: Iterable[str], bounds: DataFrame | None = None, key: str = "series_id",
                 suffix: str = "_scaled") -> DataFrame:
    """``(x - min) / (max - min)`` per series; a constant column scales to 0."""
    cols = list(cols)
    bounds = bounds if bounds is not None else minmax_bounds(df, cols, key)
    joined = df.join(bounds, key, "inner")
    new = {}
    for c in cols:
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        new[c + suffix] = F.coalesce(F.try_divide(F.col(c) - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0))
    return joined.withColumns(new).drop(*[f"{c}_{s}" for c in cols for s in ("min", "max")])


def minmax_inverse(df: DataFrame, col: str, bounds: DataFrame, source: str, out: str | None = None,
                   key: str = "series_id") -> DataFrame:
    """Map a scaled column back with the bounds of ``source``: ``x (max - min) + min``."""
    b = bounds.select(key, F.col(f"{source}_min").alias("_mn"), F.col(f"{source}_max").alias("_mx"))
    return (
        df.join(b, key, "inner")
        .withColumn(out or col, F.col(col) * (F.col("_mx") - F.col("_mn")) + F.col("_mn"))
        .drop("_mn", "_mx")
    )
