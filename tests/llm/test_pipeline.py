"""The pipeline's stages one by one, and the registered queries."""

import corpus_pipeline
from gridcast.llm import mixing, toxicity
from gridcast.llm.catalog import QUERIES, SQL

from .conftest import squeeze, words_of

SF = "/root/testdata/sf0.001"


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mix_sources", "sentencepiece"]


def test_stages_follow_each_other(spark, rows):
    docs = spark.read.parquet(SF + "/documents.parquet")
    labels = spark.read.parquet(SF + "/labels.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    given, clean, single, distinct, mixed, encoded = [rows(d) for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    low = {r["doc_id"] for r in rows(toxicity.score_toxicity(docs, labels)) if r["score"] < 0.5}
    assert {r["doc_id"] for r in clean} == low
    assert sorted(squeeze(r["text"]) for r in single) == sorted({squeeze(r["text"]) for r in clean})
    assert {r["doc_id"] for r in distinct} <= {r["doc_id"] for r in single}
    taken = sum(r["taken"] for r in rows(mixing.mix_sources(seen[3])))
    assert sum(len(words_of(r["text"])) for r in mixed) == taken
    assert len(encoded) == len(mixed) and all(r["decoded"] == r["text"] for r in encoded)


def test_empty_table_passes(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registry():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(SQL) <= set(QUERIES)
