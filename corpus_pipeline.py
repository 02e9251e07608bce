"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and
returns a DataFrame with the columns of ``docs``; the last one adds its own.
An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import exact, mixing, sentencepiece_codec, simhash, toxicity
from gridcast.llm.common import read_table, staged


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), threshold=0.5)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space one stays: the longest, then the smallest doc_id."""
    return exact.drop_duplicates_exact(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (3-word shingles, 3 bits) the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix to the sources' target weights takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its piece ids (``ids``, ``n_tokens``) and the text they decode to (``decoded``)."""
    return sentencepiece_codec.round_trip(docs).drop("normalized")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("simhash_dedup", remove_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: SQL cannot express the trained, hashed and random stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
