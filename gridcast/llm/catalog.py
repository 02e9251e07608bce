"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (conversations, embeddings, exact, lattice_lm, licenses, mixing, neighbours, quality, sentencepiece_codec, sharding, simhash,
               toxicity, whitening)
from .common import read_table


def op1_simhash(spark, sf):
    return simhash.simhash_groups(read_table(spark, sf, "documents"))


def op2_quality(spark, sf):
    return quality.score_quality(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op3_license_scan(spark, sf):
    return licenses.scan(read_table(spark, sf, "documents"))


def op4_sentencepiece(spark, sf):
    """Piece ids of every whole text, and whether decoding them gives the text back."""
    out = sentencepiece_codec.round_trip(read_table(spark, sf, "documents"))
    return out.select("doc_id", "ids", "n_tokens", F.col("decoded").eqNullSafe(F.col("normalized")).alias("exact"))


def op5_exact_dedup(spark, sf):
    return exact.duplicate_groups(read_table(spark, sf, "documents"))


def op6_mix_sources(spark, sf):
    return mixing.mix_sources(read_table(spark, sf, "documents"))


def op7_sharding(spark, sf):
    out = sharding.shard_rows(read_table(spark, sf, "documents"), 8)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_lattice_lm(spark, sf):
    return lattice_lm.score_documents(read_table(spark, sf, "documents"))


def op9_toxicity(spark, sf):
    return toxicity.score_toxicity(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op10_embedding_dedup(spark, sf):
    return embeddings.embedding_groups(read_table(spark, sf, "embeddings"))


def op11_neighbours(spark, sf):
    return neighbours.nearest_neighbours(read_table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


def op12_conversations(spark, sf):
    return conversations.repair_report(read_table(spark, sf, "conversations"))


def op13_whitening(spark, sf):
    return whitening.whiten(read_table(spark, sf, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_sharding": op7_sharding,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_neighbours": op11_neighbours,
    "op12_conversations": op12_conversations,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op3_license_scan": licenses.oracle_sql(),
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha AS text_sha256
FROM d WINDOW g AS (PARTITION BY sha ORDER BY n DESC, doc_id)""",
}
