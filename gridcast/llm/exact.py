"""Exact deduplication by two-pass Bloom filtering.

Pass one sets, for each text hash, ``HASHES`` positions of a bit table that
also remembers which positions were hit by two rows or more. A text that
occurs twice hits all its positions twice, so a hash with any position hit
only once is certainly unique. Pass two tests each row: only possibly
repeated rows are shuffled and grouped by their full SHA-256; all others pass
straight through. False positives cost shuffled rows, never results.

The bit table has 16 bits a row up to ``max_filter_bits`` (default 2**29: a
64 MB broadcast at most, whatever the input). Above that many rows it fills
up, more rows take the grouping path, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

HASHES = 3
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 29
SEGMENT_BITS = 1 << 20


def normalised(text_col: str) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", "")


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) distinct positions of each hash; ``bits`` is a power of two."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)])


def _segment_hits(bits: int):
    """Per task: for each segment, the positions hit once at least and twice at least, as packed bits."""
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    width = min(bits, SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, n = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits), return_counts=True)
            seg = (pos // np.uint64(width)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.empty(0, int)
            for a, b in zip(starts, np.r_[starts[1:], len(seg)]):
                at = (pos[a:b] % np.uint64(width)).astype(np.uint32)
                yield pa.record_batch([pa.array([seg[a]], pa.int32()), pa.array([at.tobytes()], pa.binary()),
                                       pa.array([at[n[a:b] > 1].tobytes()], pa.binary())], schema=schema)

    return run


def _merge_hits(bits: int):
    """Combine the hits of a segment over all tasks; rows arrive one at a time, state is two bit tables a segment."""
    schema = pa.schema([("segment", pa.int32()), ("twice", pa.binary())])
    width = min(bits, SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = state.setdefault(seg, (np.zeros(width, bool), np.zeros(width, bool)))
                at = np.frombuffer(once, np.uint32)
                b[at[a[at]]] = True
                b[np.frombuffer(twice, np.uint32)] = True
                a[at] = True
        for seg, (_, b) in state.items():
            yield pa.record_batch([pa.array([seg], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())],
                                  schema=schema)

    return run


def repeat_filter(hashes: DataFrame, col: str, max_filter_bits: int = MAX_FILTER_BITS):
    """A function ``Column -> Column``: true for every hash that occurs twice or more, and for few others."""
    spark = hashes.sparkSession
    rows = hashes.count()
    bits = 1 << 16
    while bits < min(rows * BITS_PER_ROW, max_filter_bits):
        bits <<= 1
    width = min(bits, SEGMENT_BITS)
    parts = max(1, min(bits // width, 256))
    merged = (hashes.select(F.col(col).cast("long")).mapInArrow(_segment_hits(bits), "segment int, once binary, twice binary")
              .repartition(parts, "segment").mapInArrow(_merge_hits(bits), "segment int, twice binary"))
    table = np.zeros(bits // 8, np.uint8)
    for seg, packed in merged.toLocalIterator():       # at most max_filter_bits / 8 bytes in all
        table[seg * width // 8:(seg + 1) * width // 8] = np.frombuffer(packed, np.uint8)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        pos = _positions(h.to_numpy(), bits).astype(np.int64)
        hit = (shared.value[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=0))

    return repeated


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha"),
                     F.length(text_or_empty(text_col)).cast("long").alias("n"))


def _first() -> Column:
    """Sort key of the row that stays: most code points, then smallest id (null last)."""
    return F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical without ASCII white space; null is the
    empty text. The longest original text stays, then the smallest id. Rows
    that repeat an id with equal text count in ``group_size`` and share one
    decision. A text of any length is compared by its whole digest. An empty
    table gives no rows. Other columns are not read.
    """
    d = staged(_digests(df, id_col, text_col), "digests")
    probe = repeat_filter(d.select(F.xxhash64("sha").alias("h")), "h", max_filter_bits)
    flagged = staged(d.withColumn("maybe", probe(F.xxhash64("sha"))), "flagged")
    alone = flagged.where(~F.col("maybe")).select(
        "id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = flagged.where("maybe")
    # written first, so that the join's two sides are plain exchanges and a hot text's rows can be split
    groups = staged(again.groupBy("sha").agg(F.min(_first()).alias("first"), F.count("*").alias("group_size")), "groups")
    grouped = again.join(groups, "sha").select("id", "sha", F.col("first.id").alias("keep_id"), "group_size")
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_duplicates_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows that stay, whole and with all their columns: one of each group of equal texts.

    Rows whose hash is certainly unique are passed on by the task that read
    them. Of the others each task keeps its best row a group before the
    shuffle (partial ``min_by``), so a group of any size meets as one row a
    task.
    """
    keys = _digests(df, id_col, text_col)
    row = df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in (
        ("id", F.col(id_col)), ("sha", F.sha2(normalised(text_col), 256)),
        ("n", F.length(text_or_empty(text_col)).cast("long")))])
    d = staged(keys.select(F.xxhash64("sha").alias("h")), "hashes")
    probe = repeat_filter(d, "h", max_filter_bits)
    flagged = row.withColumn("maybe", probe(F.xxhash64("sha")))
    alone = flagged.where(~F.col("maybe")).select("row.*")
    best = flagged.where("maybe").groupBy("sha").agg(F.min_by("row", _first()).alias("row")).select("row.*")
    return alone.unionByName(best)
