"""Hourly grids, gaps, latest rows, paging and unions (keyed by ``series_id``)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import add_hours, epoch_hours
from ..session import shared_path

BLOCK_H = 4096   # hours of a series that one task takes in a window


def _one_hour():
    return F.expr("INTERVAL 1 HOUR")


def hour_block(ts: str = "ds", hours: int = BLOCK_H):
    """Number of the block of ``hours`` hours that a time lies in."""
    return F.floor(epoch_hours(ts) / F.lit(float(hours)))


def overlapping_blocks(df: DataFrame, overlap: int, hours: int = BLOCK_H, ts: str = "ds") -> DataFrame:
    """``df`` with ``_block`` and ``_mine``: each row in its block, and the last ``overlap`` hours of a block in the next ones too.

    A window partitioned by (series, ``_block``) sees the ``overlap`` hours before
    every row of its own (``_mine``), so a series of any length is dealt over many tasks.
    """
    own, later = hour_block(ts, hours), F.floor((epoch_hours(ts) + F.lit(int(overlap))) / F.lit(float(hours)))
    return df.withColumn("_home", own).withColumn("_block", F.explode(F.sequence(own, later))).withColumn(
        "_mine", F.col("_home") == F.col("_block")).drop("_home")


def block_borders(df: DataFrame, key: str = "series_id", ts: str = "ds", hours: int = BLOCK_H) -> DataFrame:
    """``(key, _last, _next)``: the last hour of each block that has rows and the first hour of the next such block.

    The table behind it has one row a block; only that is gathered by series.
    """
    ends = df.groupBy(key, hour_block(ts, hours).alias("_block")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    per = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_block", "_first", "_last"))).alias("_b"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda i: F.struct(
        F.get(F.col("_b"), i - 1)["_last"].alias("_last"), F.get(F.col("_b"), i)["_first"].alias("_next")))
    return per.where(F.size("_b") > 1).select(key, F.inline(pairs))


def _gap_expand(df: DataFrame, key: str, ts: str, cols: list[str], hours: int = BLOCK_H) -> DataFrame:
    """Each row plus the missing hours up to the series' next row (``_present`` marks real rows).

    The next row inside a block of hours comes from a window over (series,
    block); gaps between blocks come from the table of the blocks' ends.
    """
    w = Window.partitionBy(key, "_block").orderBy(ts)
    with_next = df.select(key, ts, *cols, hour_block(ts, hours).alias("_block")).withColumn("_next", F.lead(ts).over(w))
    span_end = F.greatest(F.coalesce(add_hours("_next", -1), F.col(ts)), F.col(ts))   # duplicates: no gap
    rows = with_next.select(key, F.col(ts).alias("_t"), *cols,
                            F.explode(F.sequence(F.col(ts), span_end, _one_hour())).alias("_g"))
    present = F.col("_g") == F.col("_t")
    inside = rows.select(key, F.col("_g").alias(ts), *[F.when(present, F.col(c)).alias(c) for c in cols],
                         present.alias("_present"))
    gaps = block_borders(df, key, ts, hours).where(add_hours("_last", 1) < F.col("_next")).select(
        key, F.explode(F.sequence(add_hours("_last", 1), add_hours("_next", -1), _one_hour())).alias(ts))
    types = {f.name: f.dataType for f in df.schema.fields}
    between = gaps.select(key, ts, *[F.lit(None).cast(types[c]).alias(c) for c in cols], F.lit(False).alias("_present"))
    return inside.unionByName(between)


def hourly_spine(df: DataFrame, key: str = "series_id", ts: str = "ds", values: list[str] | None = None) -> DataFrame:
    """Complete hourly grid from each series' first to last hour (both included).

    Rows missing in ``df`` appear with null values; ``values`` lists the
    columns carried over (default: all non-key columns). ``df`` holds at most
    one row per (series, hour).
    """
    values = values if values is not None else [c for c in df.columns if c not in (key, ts)]
    return _gap_expand(df.select(key, ts, *values), key, ts, values).drop("_present")


def missing_hours(df: DataFrame, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Hours inside each series' span with no row (gap report)."""
    return _gap_expand(df.select(key, ts), key, ts, []).where(~F.col("_present")).select(key, ts)


def future_grid(df: DataFrame, hours: int, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """The ``hours`` hourly stamps after each series' last row, with ``step`` 1..hours."""
    if int(hours) < 1:
        raise ValueError("hours must be positive")
    last = df.groupBy(key).agg(F.max(ts).alias("_last"))
    return last.select(
        key, F.col("_last").alias("origin"),
        F.posexplode(F.sequence(add_hours("_last", 1), add_hours("_last", int(hours)), _one_hour())).alias("step", ts),
    ).withColumn("step", (F.col("step") + 1).cast("int"))


def latest_reading(df: DataFrame, as_of=None, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Most recent row of each series not after ``as_of`` (partial aggregate, no sort)."""
    if as_of is not None:
        df = df.where(F.col(ts) <= F.lit(as_of).cast("timestamp_ntz"))
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r")).select(key, "_r.*")


def last_window(df: DataFrame, n: int = 24, key: str = "series_id", ts: str = "ds") -> DataFrame:
    """Last ``n`` rows of each series, with ``pos`` 1 = newest.

    ``row_number() <= n`` is planned with a partial per-task group limit
    before the shuffle (WindowGroupLimit), so a hot series sends only ``n``
    rows per map task.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= int(n))


def head(df: DataFrame, n: int = 5, order=("ds",)) -> DataFrame:
    """First ``n`` rows by ``order`` (a top-k, not a sample)."""
    return df.orderBy(*order).limit(int(n))


class PageIndex:
    """A table in ranges of an order, with the place where each range starts.

    The ranges are written once (one shuffle, no range in one task); a page
    then reads and sorts only the ranges it lies in, however deep it is.
    """

    def __init__(self, df: DataFrame, order=("series_id", "ds"), ranges: int | None = None):
        spark = df.sparkSession
        self.order = list(order)
        dealt = df.repartitionByRange(ranges, *self.order) if ranges else df.repartitionByRange(*self.order)
        path = shared_path(spark, f"pages-{uuid.uuid4().hex}")
        dealt.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        self.rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
        counts = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}   # a row a range
        self.starts, self.total = {}, 0
        for number in sorted(counts):
            self.starts[number] = self.total
            self.total += counts[number]

    def page(self, offset: int, length: int = 5000) -> DataFrame:
        """Rows ``offset .. offset+length-1`` of the order; fewer or none past the end."""
        offset, length = max(0, int(offset)), max(0, int(length))
        ends = dict(zip(self.starts, [*list(self.starts.values())[1:], self.total]))
        holding = [n for n, start in self.starts.items() if start < offset + length and ends[n] > offset]
        rows = self.rows.where(F.col("_range").isin(holding)).drop("_range")
        first = self.starts[holding[0]] if holding else 0
        return rows.orderBy(*self.order).offset(max(0, offset - first)).limit(length)


def page(df: DataFrame, offset: int, length: int = 5000, order=("series_id", "ds")) -> DataFrame:
    """Rows ``offset .. offset+length-1`` in ``order`` (keep a :class:`PageIndex` to read more pages of one table)."""
    return PageIndex(df, order).page(offset, length)


def combine_pages(*pages: DataFrame, key=("series_id", "period"), order: str = "page") -> DataFrame:
    """Append pages; a repeated key keeps the row with the largest ``order`` (newest page).

    ``max_by`` is a partial aggregate, so repeats are reduced map-side.
    """
    allp = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)
    rest = [c for c in allp.columns if c not in key]
    return allp.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def combine_models(*forecasts: DataFrame) -> DataFrame:
    """One table of several models' forecasts (columns matched by name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), forecasts)
