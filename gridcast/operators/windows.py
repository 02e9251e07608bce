"""Lags, sequences and hold-out splits (all keyed by ``series_id``).

Lags are taken **by time**, not by row position: ``lag k`` of hour ``ds`` is
the value at ``ds - k hours`` (null when that hour is missing), so a gap
never shifts a window. Windows run over blocks of hours that overlap by the
reach of the lag, and splits count rows by time buckets, so no step gathers
the whole of a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .grid import BLOCK_H, hour_block, overlapping_blocks

BUCKET_H = 1024   # hours of a bucket in which rows are counted


def lag_features(df: DataFrame, value: str = "load", lags=range(1, 25), key: str = "series_id",
                 ts: str = "ds", prefix: str = "lag_") -> DataFrame:
    """``lag_k`` = value ``k`` hours earlier, from a window over the complete hourly grid.

    ``df`` must be on a complete grid (see ``hourly_spine``); then row offset
    and hour offset agree.
    """
    lags = list(lags)
    w = Window.partitionBy(key, "_block").orderBy(ts)
    rows = overlapping_blocks(df, max(lags, default=0), BLOCK_H, ts).withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in lags})
    return rows.where("_mine").drop("_block", "_mine")


def make_sequences(df: DataFrame, features, n: int = C.SEQUENCE_LEN, target: str = "load", key: str = "series_id",
                   ts: str = "ds") -> DataFrame:
    """Training windows: the previous ``n`` hours' feature structs and the next target.

    ``x`` is ``ARRAY<STRUCT<features>>`` of the ``n`` hours before ``ds``; a
    window touching a missing hour (or a null feature) is dropped, so no
    window spans a gap.
    """
    feats = list(features)
    w = Window.partitionBy(key, "_block").orderBy(ts).rowsBetween(-n, -1)
    complete = F.forall(F.col("_x"), lambda r: F.lit(True) if not feats else _all_present(r, feats))
    return (
        overlapping_blocks(df, n, BLOCK_H, ts).withColumn("_x", F.collect_list(F.struct(*feats)).over(w))
        .where(F.col("_mine") & (F.size("_x") == n) & complete & F.col(target).isNotNull())
        .select(key, ts, F.col("_x").alias("x"), F.col(target).alias("y"))
    )


def _all_present(r, feats):
    cond = None
    for f in feats:
        c = r[f].isNotNull()
        cond = c if cond is None else cond & c
    return cond


def times_at(df: DataFrame, places: dict, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Per series, the time of the k-th row in time order for each place: ``(key, name...)``, null where k < 1.

    ``places`` maps names to functions of the series' number of rows (a
    Column) that give k. Rows are counted by time buckets; the bucket that
    holds the k-th row is found from these counts, and only its rows are
    looked at. A row an hour at most makes a bucket small.
    """
    bucket = hour_block(ts, BUCKET_H)
    counts = df.groupBy(key, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    per = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_bucket", "_n"))).alias("_c"), F.sum("_n").alias("_all"))

    def found(name, k):
        k = k(F.col("_all")).cast("long")

        def step(acc, c):
            here = acc["b"].isNull() & (acc["before"] + c["_n"] >= k) & (k >= 1)
            return F.struct((acc["before"] + c["_n"]).alias("before"), F.when(here, c["_bucket"]).otherwise(acc["b"]).alias("b"),
                            F.when(here, k - acc["before"]).otherwise(acc["k"]).alias("k"))

        none = F.lit(None).cast("long")
        got = F.aggregate("_c", F.struct(F.lit(0).cast("long").alias("before"), none.alias("b"), none.alias("k")), step)
        return F.struct(F.lit(name).alias("_name"), got["b"].alias("_bucket"), got["k"].cast("int").alias("_k"))

    wanted = per.select(key, F.inline(F.array(*[found(name, k) for name, k in places.items()])))
    rows = df.select(key, ts, bucket.alias("_bucket")).join(wanted.where(F.col("_bucket").isNotNull()), [key, "_bucket"])
    times = rows.groupBy(key, "_name", "_k").agg(F.array_sort(F.collect_list(ts)).alias("_t")).select(
        key, "_name", F.element_at("_t", F.col("_k")).alias("_t"))
    return (wanted.select(key, "_name").join(times, [key, "_name"], "left").groupBy(key)
            .agg(*[F.max(F.when(F.col("_name") == name, F.col("_t"))).alias(name) for name in places]))


def holdout_split(df: DataFrame, ratio: float = C.TEST_RATIO, key: str = "series_id", ts: str = "ds",
                  label: str = "part", names=("train", "test")) -> DataFrame:
    """Row position below ``int(n (1 - ratio))`` is train, the rest test (per series, by time).

    The split is the time of the last training row, so rows of one time stay together.
    """
    cut = times_at(df, {"_cut": lambda n: F.floor(n * F.lit(1.0 - ratio))}, key, ts)
    train = F.coalesce(F.col(ts) <= F.col("_cut"), F.lit(False))
    return df.join(cut, key).withColumn(label, F.when(train, F.lit(names[0])).otherwise(F.lit(names[1]))).drop("_cut")


def validation_split(df: DataFrame, ratio: float = C.VALIDATION_RATIO, key: str = "series_id", ts: str = "ds",
                     label: str = "part") -> DataFrame:
    """Training windows split into fit / validation (last ``ratio`` of rows)."""
    return holdout_split(df, ratio, key, ts, label, ("fit", "validation"))


def seasonal_naive(df: DataFrame, value: str = "load", season: int = 24, key: str = "series_id", ts: str = "ds",
                   out: str = "predicted") -> DataFrame:
    """Value one season (``season`` hours) earlier, joined by time (null when missing)."""
    prev = df.select(
        key,
        (F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(int(season)), F.lit(0), F.lit(0.0))).alias(ts),
        F.col(value).alias(out),
    )
    return df.join(prev, [key, ts], "left")
