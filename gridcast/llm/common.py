"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: ASCII white space that separates words: space, and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark's reader touches the path, so any store that Spark can read works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not
    a recomputation, and several later plans share one result. The folder is
    removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def batches_of(batch: pa.RecordBatch, text_index: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``max_bytes`` of text each (one row at least), to bound a worker's memory."""
    import numpy as np

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_index)), 0)).astype(np.int64)
    group = np.cumsum(sizes) // max_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int,
                  id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame | None:
    """A bounded training sample (id, y, text): whole texts of labelled rows outside fold 0; None if there is none.

    At most ``per_class`` documents of each label, those with the smallest
    hash of the id, and at most ``max_bytes`` of text in all; a document that
    does not fit is passed over. A label is 0 or 1, anything else is no label;
    where an id repeats, its largest label and smallest text count.
    """
    usable = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (id_bucket(id_col, folds) != 0))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y")))
    h = F.xxhash64("id")
    picks = [usable.where(F.col("y") == y).orderBy(h, "id").limit(per_class) for y in (0, 1)]
    pick = staged(picks[0].unionByName(picks[1]), "picked")
    body = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sample = staged(body.join(F.broadcast(pick), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "sample")
    # F.broadcast: at most 2 * per_class (id, label) pairs
    sizes = sample.select("id", "y", F.octet_length("text").alias("b")).orderBy(h, "id").collect()
    chosen, used = [], 0
    for r in sizes:
        if used + r["b"] <= max_bytes:
            chosen.append(r["id"])
            used += r["b"]
    return sample.where(F.col("id").isin(chosen)) if chosen else None


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int,
                    id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> list[tuple[bytes, int]]:
    """The rows of ``labelled_rows`` on the driver, as (text, label) pairs."""
    rows = labelled_rows(docs, labels, label, per_class, max_bytes, id_col, text_col, folds)
    if rows is None:
        return []
    return [(r["text"].encode(), r["y"]) for r in rows.orderBy(F.xxhash64("id"), "id").select("text", "y").collect()]
