"""Model fits from sums that are kept per micro-batch (mergeable normal equations).

Every batch of closed hours adds one row per series and model to a table:
the entries of X'X, X'y, y'y and n over the batch's own rows, the smallest and
largest features, and the newest hour. The rows lie in ``batch_id``
partitions, so a replayed batch replaces its own. A fit adds the rows up and
solves; history is never read again, and what a fit reads does not grow with
the hours behind a sum. :func:`compact` adds up old batches into one row a series.

Sums can only be added if all batches use the same columns, so they are kept
in a form that no later hour changes:

* additive: time runs from 0 to 1 over a *frame* (t0, t1) that a series gets
  with its first batch. Hours beyond t1 go on with t > 1; a frame that the
  history has outgrown is renewed from the history (:func:`rebuild`).
* autoregressive: features are not scaled. The fit maps the sums to the
  features scaled by the smallest and largest values seen so far, which is
  exact, because the scaling is linear and the first column is 1.

The 24 hours before a batch are kept as the *border* table, one partition a
batch, so the first hours of the next one have their lags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import add_hours, epoch_days, not_missing
from ..session import materialize
from . import additive as ADD
from . import autoregressive as AR
from .ridge import built_sums, entries_of, solve_sums

FRAME_DAYS = 365.0
P_ADDITIVE = len(ADD.penalties())
P_AUTO = len(AR.penalties())
SUMS = ("series_id STRING, model STRING, entries ARRAY<DOUBLE>, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>, t0 DOUBLE, t1 DOUBLE, "
        "last_ds TIMESTAMP_NTZ, batch_id BIGINT")
BORDER = "series_id STRING, ds TIMESTAMP_NTZ, load_mw DOUBLE, temp_c DOUBLE, batch_id BIGINT"
HOURS = ("series_id", "ds", "load_mw", "temp_c")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` (empty where there is none yet)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes ``df`` as the partition of its batch; a replayed batch replaces what it wrote before."""
    (df.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _border_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The border that the newest earlier batch left."""
    rows = read_table(spark, path, BORDER).where(F.col("batch_id") < int(batch_id))
    newest = rows.agg(F.max("batch_id").alias("b")).first()["b"]
    return rows.where(F.col("batch_id") == F.lit(newest)).select(*HOURS)


def additive_sums(hours: DataFrame, frames: DataFrame, carry=()) -> DataFrame:
    """``(series_id, carry..., i, v)`` of the additive design over ``hours``, each series in its frame (series_id, t0, t1)."""
    rows = hours.where(not_missing("load_mw")).join(frames.select("series_id", "t0", "t1"), "series_id")
    rows = rows.select("series_id", "t0", "t1", *carry, epoch_days("ds").alias("day"), F.col("load_mw").alias("y"))
    return built_sums(rows, ["series_id", *carry], P_ADDITIVE, ADD.matrix_builder())


def _dense(entries: DataFrame) -> DataFrame:
    """``(series_id, entries)`` from (series_id, i, v), which has every entry of a series."""
    added = entries.groupBy("series_id", "i").agg(F.sum("v").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "v")))                     # as many numbers as the sums have
    return added.groupBy("series_id").agg(F.transform(pairs, lambda e: e["v"]).alias("entries"))


def add_batch(hours: DataFrame, batch_id: int, path: str, frame_days: float = FRAME_DAYS) -> None:
    """Adds a batch of closed hours ``(series_id, ds, load_mw, temp_c)`` to the tables under ``path``.

    ``hours`` is read several times (persist it). Hours must not come twice
    under different batch ids; the hourly stream emits each once.
    """
    spark, base = hours.sparkSession, path.rstrip("/")
    hours = hours.select(*HOURS).where(not_missing("load_mw"))
    past = read_table(spark, base + "/sums", SUMS).where((F.col("batch_id") < int(batch_id)) & (F.col("model") == "additive"))
    known = past.groupBy("series_id").agg(F.max("t0").alias("t0"), F.max("t1").alias("t1"))
    first = hours.groupBy("series_id").agg(F.min(epoch_days("ds")).alias("_first"), F.max("ds").alias("last_ds"))
    frames = materialize(first.join(known, "series_id", "left").select(          # one row a series; read by sums and table
        "series_id", "last_ds", F.coalesce("t0", "_first").alias("t0"), F.coalesce("t1", F.col("_first") + F.lit(float(frame_days))).alias("t1")))
    border = _border_before(spark, base + "/border", batch_id)

    ends = AR.feature_bounds(hours).select("series_id", "low", "high")
    add = _dense(additive_sums(hours, frames)).withColumn("model", F.lit("additive"))
    auto = _dense(AR.lagged_sums(hours, border)).withColumn("model", F.lit("autoregressive"))
    none = F.array_repeat(F.lit(0.0), entries_of(P_AUTO))                        # the bounds of hours without lags count too
    auto = ends.select("series_id").join(auto, "series_id", "left").select(
        "series_id", F.coalesce("entries", none).alias("entries"), F.lit("autoregressive").alias("model"))
    rows = add.unionByName(auto).join(ends, "series_id").join(frames, "series_id")
    write_batch(rows.select("series_id", "model", "entries", "low", "high", "t0", "t1", "last_ds"), base + "/sums", batch_id)

    both = border.unionByName(hours)
    newest = both.groupBy("series_id").agg(F.max("ds").alias("_newest"))
    kept = both.join(newest, "series_id").where(F.col("ds") > add_hours("_newest", -C.SEQUENCE_LEN)).select(*HOURS)
    write_batch(kept, base + "/border", batch_id)


def read_sums(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The rows that a fit of ``model`` adds up: the newest compacted ones and the batches after them."""
    base = path.rstrip("/")
    merged = read_table(spark, base + "/merged", SUMS).where(F.col("model") == model)
    upto = merged.agg(F.max("batch_id").alias("b")).first()["b"]
    later = read_table(spark, base + "/sums", SUMS).where(F.col("model") == model)
    if upto is None:
        return later
    return later.where(F.col("batch_id") > int(upto)).unionByName(merged.where(F.col("batch_id") == int(upto)))


def _bounds(rows: DataFrame, arrays: int) -> DataFrame:
    """Per series: frame, newest hour and the smallest and largest features over all rows."""
    ends = [f(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(arrays)]
    per = rows.groupBy("series_id").agg(F.max("t0").alias("t0"), F.max("t1").alias("t1"), F.max("last_ds").alias("last_ds"), *ends)
    return per.select("series_id", "t0", "t1", "last_ds", *[F.array(*[F.col(f"{c}{k}") for k in range(arrays)]).alias(c) for c in ("low", "high")])


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Adds up the batches up to ``upto`` into one row per series and model; later fits read that row instead.

    The merged rows are a partition of their own table, so a compaction that
    is repeated or broken off changes no result. Batches after ``upto`` can still be replayed.
    """
    base = path.rstrip("/")
    out = None
    for model in ("additive", "autoregressive"):
        rows = read_sums(spark, path, model).where(F.col("batch_id") <= int(upto))
        added = _dense(rows.select("series_id", F.posexplode("entries").alias("i", "v")))
        part = added.join(_bounds(rows, len(AR.FEATURES)), "series_id").withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    columns = ("series_id", "model", "entries", "low", "high", "t0", "t1", "last_ds")
    write_batch(out.select(*columns), base + "/merged", upto)


def rebuild(history: DataFrame, path: str, batch_id: int, frame_days: float = FRAME_DAYS) -> None:
    """Renews sums, frames and border from the whole history ``(series_id, ds, load_mw, temp_c)`` under a new, empty ``path``."""
    add_batch(history, batch_id, path, frame_days)


def fit_from_sums(spark: SparkSession, path: str, model: str = "additive", prior: str = "laplace", fitted_at=None) -> DataFrame:
    """The model table (as of :func:`fit_additive` or :func:`fit_autoregressive`) from the sums alone."""
    rows = read_sums(spark, path, model)
    bounds = _bounds(rows, len(AR.FEATURES))
    long = rows.select("series_id", F.posexplode("entries").alias("i", "v")).groupBy("series_id", "i").agg(F.sum("v").alias("v"))
    if model == "additive":
        return solve_additive(long, bounds, prior, fitted_at)
    if model != "autoregressive":
        raise ValueError(f"unknown model {model!r}")
    return AR.solve_autoregressive(long, bounds, fitted_at=fitted_at)


def solve_additive(entries: DataFrame, bounds: DataFrame, prior: str = "laplace", fitted_at=None) -> DataFrame:
    """The additive model table from ``(series_id, i, v)`` and ``(series_id, t0, t1, last_ds)``."""
    framed = entries.join(bounds.select("series_id", "t0", "t1", "last_ds"), "series_id").withColumn("y_scale", F.lit(1.0))
    fit = solve_sums(framed, ["series_id", *ADD.GROUP], P_ADDITIVE, ADD.additive_solver(prior))
    return ADD.model_table(fit, "series_id", C.N_CHANGEPOINTS, fitted_at)
