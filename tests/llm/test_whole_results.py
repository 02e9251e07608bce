"""Whole results recomputed by plain code: quality features and scores, toxicity scores, targets and takings, shards, passes alone."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import embeddings, mixing, quality, sharding, toxicity
from gridcast.llm.catalog import op6_mix_sources, op7_sharding

from .conftest import words_of
from .test_dedup import _vectors
from .test_mix_shard import _targets

SMALL = "/root/testdata/sf0.001"


def plain_features(text):
    """The features by counting characters and words one by one (bytes as latin-1 characters)."""
    t = text.decode("latin-1")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(words)
    if not n:
        return [0.0] * len(quality.FEATURES)
    ink = sum(len(w) for w in words)
    low = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words]
    stops = {s.decode("latin-1") for s in quality.STOP_WORDS}
    lines = [x for x in (x.strip(" \t\n\r\x0b\x0c") for x in t.split("\n")) if x]
    fives = [tuple(low[i:i + 5]) for i in range(n - 4)]
    top = max(low.count(w) for w in set(low)) / n if n >= 5 else 0.0

    def share(test, of):
        return sum(map(test, t)) / of

    return [math.log1p(n), ink / n, share(lambda c: "A" <= c <= "Z", ink), share(lambda c: c.isascii() and c.isalpha() or c >= "\x80", ink),
            share(lambda c: c in "0123456789", ink), share(lambda c: "!" <= c <= "~" and not c.isalnum() and c not in ".,;:'\"!?()-|", ink),
            t.count("!") / ink, t.count("|") / n, sum(w[-1] in ".,;:!?" for w in words) / n, sum(w in stops for w in low) / n,
            math.log1p(len(set(low))) / math.log1p(n), top, sum(a == b for a, b in zip(low, low[1:])) / n,
            1 - len(set(fives)) / len(fives) if n >= 10 else 0.0, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
            sum("A" <= w[0] <= "Z" for w in words) / n, sum(len(w) > 14 for w in words) / n]


def test_quality_features_against_plain_counts(spark, awkward):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet(SMALL + "/documents.parquet").collect() + awkward.collect()]
    for t in texts:
        if len(t) < 20_000:
            assert np.allclose(quality.features(t), plain_features(t), atol=1e-9)


def test_quality_scores_against_the_tables(spark):
    """Every document's score is the sum of its table entries, one by one, from a model that is fitted on the same labels."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, "quality")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    for d in docs.collect():
        x = plain_features((d["text"] or "").encode())
        z = model.bias
        for j, (edge, table) in enumerate(zip(model.edges, model.tables)):
            z += table[sum(e <= x[j] for e in edge)]
        at = [sum(e <= x[j] for e in edge) for j, edge in enumerate(model.pair_edges)]
        z += sum(table[at[a], at[b]] for (a, b), table in zip(model.pairs, model.pair_tables))
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_toxicity_scores_against_the_table(spark):
    """Every document's score from the trained table: n-gram values averaged by word, words by document."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    table, bias = toxicity.fitted(docs, labels, "toxic", toxicity.PER_CLASS, toxicity.MAX_BYTES, "doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}

    def bucket(gram):
        h = gram[0]
        for b in gram[1:]:
            h = (h * 16777619 + b) & 0xFFFFFFFF
        return (h * 2654435761 & 0xFFFFFFFF) >> (32 - toxicity.BUCKET_BITS)

    seen = {}
    for d in docs.collect():
        means = []
        for w in (d["text"] or "").encode().lower().split():
            if w not in seen:
                p = b" " + w + b" "
                seen[w] = np.mean([float(table[bucket(p[i:i + n])]) for n in range(3, 7) for i in range(len(p) - n + 1)])
            means.append(seen[w])
        z = (np.mean(means) if means else 0.0) + bias
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_mix_of_the_whole_table(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(SMALL + "/documents.parquet").collect()}
    sizes = {}
    for d in docs.values():
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(words_of(d["text"]))
    targets, taken, longest = _targets(sizes), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    got = op6_mix_sources(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        n = len(words_of(docs[r["doc_id"]]["text"]))
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and math.isclose(r["target"], targets[s])
        want = targets[s] / sizes[s]                                     # a document is taken as often as wanted, rounded down or up
        assert r["taken"] in (n * math.floor(want), n * math.ceil(want))
        taken[s] += r["taken"]
        longest[s] = max(longest[s], n)
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in sizes)


def test_shards_of_the_whole_table(spark):
    """Shards and slots recomputed: rows in order of their keys, cut where the bytes before reach the eighths."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(SMALL + "/documents.parquet").collect()}
    got = op7_sharding(spark, SMALL).collect()
    keyed = sharding._keyed(spark.read.parquet(SMALL + "/documents.parquet"), "doc_id", "text")
    keys = {r["row"]["doc_id"]: (r["k1"], r["k2"]) for r in keyed.collect()}
    total = sum(len(t.encode()) + 1 for t in docs.values())
    for r in got:
        t = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    in_order = sorted(got, key=lambda r: keys[r["doc_id"]])
    assert [r["shard"] for r in in_order] == sorted(r["shard"] for r in got)         # shards are ranges of the keys
    below, largest = 0, max(r["size"] for r in got)
    for a, b in zip(in_order, in_order[1:]):
        below += a["size"]
        for j in range(a["shard"] + 1, b["shard"] + 1):
            assert abs(below - j * total / 8) <= largest + 0.05 * total / 8
    for s in range(8):
        members = [r["slot"] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: keys[r["doc_id"]][::-1])]
        assert members == list(range(len(members)))


def test_passes_alone_find_the_links(spark, monkeypatch):
    """Nothing but the sorted passes, at a small size, with the parameters of the query."""
    monkeypatch.setattr(embeddings, "_all_links", lambda active, rows, threshold: active.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    vectors = _vectors()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(df).collect()}
    u = np.array(vectors)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    assert sum(got.values()) >= 0.9 * links.sum() and all(got[i] <= links[i] for i in got)


def test_mix_decisions_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(SMALL + "/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix_sources(df.repartition(n)).collect())) for n in (2, 7))
    assert one == two


def test_very_long_vectors(spark):
    """Vectors of 20,000 components link by the same threshold."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 20_000))
    close, far = 0.96 * a + math.sqrt(1 - 0.96 ** 2) * b, 0.94 * a + math.sqrt(1 - 0.94 ** 2) * b
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate((a, close, far, -a))], "vec_id long, embedding array<double>")
    u = np.array([v / np.linalg.norm(v) for v in (a, close, far, -a)])
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(df).collect()}
    assert [got[i] for i in range(4)] == links.tolist() and links[0] == 1
