"""Mixing and sharding: their laws, and the mix against a plain version."""

import math

import pytest
from pyspark.sql import functions as F

from gridcast.llm import mixing, sharding
from gridcast.llm.catalog import op7_sharding

from .conftest import words_of


def _targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while True:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > cap * sizes[s]]
        if not over:
            return {**out, **{s: share * w[s] for s in free}}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            free.remove(s)


def test_mix(awkward, empty, rows):
    got = rows(mixing.mix_sources(awkward))
    given = rows(awkward.select("doc_id", "text", "source"))
    assert len(got) == len(given)
    sizes, longest = {}, {}
    for r in given:
        n = len(words_of(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    targets = _targets(sizes)
    of = {r["doc_id"]: r["source"] for r in given if r["doc_id"] is not None}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        if r["doc_id"] is not None:
            assert math.isclose(r["target"], targets[of[r["doc_id"]]]) and r["source_size"] == sizes[of[r["doc_id"]]]
            taken[of[r["doc_id"]]] += r["taken"]
    for s, n in taken.items():
        if s != "src1":                                                # the null id's words are not in ``taken``
            assert abs(n - targets[s]) <= 2 * longest[s]
    again = mixing.mix_sources(awkward.repartition(9))
    assert sorted(map(str, rows(again))) == sorted(map(str, got))
    assert mixing.mix_sources(empty).count() == mixing.mixed_rows(empty).count() == 0


def test_mix_is_exact_up_to_one_document(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                  F.repeat(F.lit("w "), (F.xxhash64("id") % 40 + 41).cast("int")).alias("text"))
    by = mixing.mix_sources(df).groupBy("target").agg(F.sum("taken").alias("taken"), F.countDistinct("source_size").alias("n"))
    per = mixing.mix_sources(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert by.count()
    assert all(abs(r["taken"] - r["target"]) <= r["most"] for r in per)


def test_mix_keeps_expectations(spark):
    """Every document of a source is taken equally often over many seeds, long or short."""
    df = spark.createDataFrame([(i, "a", "w " * (1 + i % 5 * 4)) for i in range(60)] + [(100 + i, "b", "w " * 10) for i in range(30)], "doc_id long, source string, text string")
    copies = [0.0] * 60
    seed = mixing.SEED
    try:
        for mixing.SEED in range(12):
            for r in mixing.mix_sources(df).where("doc_id < 60").collect():
                copies[r["doc_id"]] += r["taken"] / r["size"] / 12
                want = r["target"] / r["source_size"]
    finally:
        mixing.SEED = seed
    assert all(abs(c - want) < 0.45 for c in copies) and abs(sum(copies) / 60 - want) < 0.05


def test_mixed_rows_repeat_documents(awkward, rows):
    out = mixing.mixed_rows(awkward)
    assert out.schema == awkward.schema
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mix_sources(awkward)) if r["doc_id"] not in (None, 210)}     # ids that repeat
    copies = {}
    for r in rows(out):
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + len(words_of(r["text"]))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in copies.items() if i not in (None, 210)}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(awkward, empty, rows, shards):
    out = rows(sharding.shard_rows(awkward, shards))
    assert sorted(str(r["row"]) for r in out) == sorted(str(r) for r in rows(awkward))
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 1
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    assert set(by) <= set(range(shards))
    assert sharding.shard_rows(empty, shards).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(
        F.concat(F.lit("t"), (F.col("id") / 4).cast("long"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("text"))
    out = sharding.shard_rows(df, 8).select("row.*", "shard", "size", "slot").cache()
    sums = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.02 * sum(sums) / 8
    assert {r["text"] for r in out.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").collect()} <= {"hot text"}


def test_sharding_query(spark):
    r = op7_sharding(spark, "/root/testdata/sf0.001")
    assert r.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and r.count() == 200


def test_written_shards(awkward, tmp, spark):
    sharding.write_shards(sharding.shard_rows(awkward.select("doc_id", "text"), 2), tmp + "/shards")
    assert spark.read.parquet(tmp + "/shards").count() == awkward.count()


@pytest.mark.parametrize("rows_of_one", [300, 3001])
def test_mix_of_null_and_repeated_ids_in_bulk(spark, rows_of_one):
    rows = [(None, "a", "w " * 10)] * rows_of_one + [(7, "a", "v " * 10)] * 50 + [(i, "b", "x " * (i % 9 + 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix_sources(df).collect()
    per, most = {}, {}
    for r in got:
        per.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and len(per) == 2
    for (_, target), taken in per.items():
        assert abs(sum(taken) - target) <= 10                          # less than one document
    copies = [r["taken"] // 10 for r in got if r["doc_id"] is None]
    assert max(copies) - min(copies) <= 1                              # spread over the rows, not one block
    words = {s: sum(len(words_of(r["text"])) for r in mixing.mixed_rows(df).where(F.col("source") == s).collect()) for s in "ab"}
    assert sorted(words.values()) == sorted(sum(t) for t in per.values())


def test_shards_of_equal_rows_in_bulk(spark):
    rows = [(None, "equal row " * 9)] * 5000 + [(None, f"text {i} " * (i % 30)) for i in range(2500)] + [(i, f"other {i} " * (i % 20 + 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard_rows(df, 8).select("shard", "size", "slot").cache()
    sums = {r["shard"]: r for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top"),
                                                            F.countDistinct("slot").alias("slots")).collect()}
    ideal = sum(r["b"] for r in sums.values()) / 8
    assert len(sums) == 8 and all(abs(r["b"] - ideal) <= 0.01 * ideal + 400 for r in sums.values())
    assert all(r["top"] == r["n"] - 1 and r["slots"] == r["n"] for r in sums.values()) and sum(r["n"] for r in sums.values()) == len(rows)
