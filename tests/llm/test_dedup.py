"""Exact, SimHash and embedding dedup against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from gridcast.llm import components, embeddings, exact, simhash

from .conftest import closure, squeeze, words_of


@pytest.mark.parametrize("bits", [1 << 29, 1 << 8])               # a roomy and an overfull filter
def test_exact_groups(awkward, rows, bits):
    texts = rows(awkward.select("doc_id", "text"))
    got = rows(exact.duplicate_groups(awkward, max_filter_bits=bits))
    groups = {}
    for r in texts:
        groups.setdefault(squeeze(r["text"]), []).append(r)
    want = []
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        want += [(str(r["doc_id"]), str(best), len(members), r["doc_id"] == best, hashlib.sha256(key.encode()).hexdigest()) for r in members]
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want)


def test_exact_rows_keep_columns(awkward, empty, rows):
    out = exact.drop_duplicates_exact(awkward)
    assert out.schema == awkward.schema
    kept = rows(out)
    assert len(kept) == len({squeeze(r["text"]) for r in rows(awkward)}) == len({squeeze(r["text"]) for r in kept})
    assert exact.drop_duplicates_exact(empty).count() == exact.duplicate_groups(empty).count() == 0


def test_repeat_filter_misses_no_repeat(spark):
    df = spark.range(20_000).selectExpr("xxhash64(id % 15000) as h").repartition(7)
    probe = exact.repeat_filter(df, "h")
    twice = df.groupBy("h").count().where("count > 1")
    flagged = df.distinct().where(probe("h"))
    assert twice.join(flagged, "h", "left_anti").count() == 0
    assert flagged.count() < 1.05 * twice.count()                      # few rows shuffle in vain


def _fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lowered)
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(awkward, empty, rows):
    texts = sorted(rows(awkward.where("doc_id is not null").select("doc_id", "text")), key=lambda r: r["doc_id"])
    fps = [_fingerprint(r["text"]) for r in texts]
    root = closure(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    want = sorted((r["doc_id"], f"{fp:016x}", texts[g]["doc_id"]) for r, fp, g in zip(texts, fps, root))
    got = rows(simhash.simhash_groups(awkward.where("doc_id is not null")))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.simhash_groups(awkward).count() == awkward.count()
    kept = simhash.drop_near_duplicates(awkward.where("doc_id is not null"))
    assert kept.schema == awkward.schema
    assert {r["doc_id"] for r in rows(kept)} == {texts[g]["doc_id"] for g in root}
    assert simhash.simhash_groups(empty).count() == simhash.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_by_row_not_by_id(spark, rows):
    a, b = "one two three four five six", "a wholly different text about nothing at all"
    df = spark.createDataFrame([(1, a), (7, a), (7, b), (7, b), (None, "alone here " * 3), (None, "alone here " * 3), (None, a)], "doc_id long, text string")
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in rows(simhash.drop_near_duplicates(df))))
    assert kept == [(0, "alone here " * 3), (1, a), (7, b)]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows(simhash.simhash_groups(df))}
    assert got[(7, f"{_fingerprint(a):016x}")] == 1 and got[(7, f"{_fingerprint(b):016x}")] == 7


def test_null_ids_link_their_neighbours(spark):
    """Fingerprints two apart on either side of one that only a null id has are one group."""
    fps = spark.createDataFrame([(5, 0b0111), (None, 0), (9, 0b111000)], "id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash._components(fps, 3).collect()}
    assert got == {0b0111: 5, 0: 5, 0b111000: 5}


def test_golay_keys_meet_at_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, ra = simhash.keys_of(a)
    kb, rb = simhash.keys_of(b)
    met = set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))
    assert {r for r, _ in met} == set(range(3000))
    assert np.bincount(ra).max() <= 48


def test_simhash_links_of_a_large_family(spark, rows, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for _ in range(400)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    monkeypatch.setattr(simhash, "BLOCK", 50)                          # in this process only: the spanning forest itself
    a, b = simhash.spanning_links(np.array(fps, np.uint64), 3)
    assert len(a) < len(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    found = {(at[r["a"]], at[r["b"]]) for r in links}
    assert all((fps[x] ^ fps[y]).bit_count() <= 3 for x, y in found)
    assert closure(len(fps), lambda x, y: (x, y) in found or (y, x) in found) == closure(len(fps), lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 3)


def test_runs_split_into_blocks():
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 14, 6000, dtype=np.uint64))
    out = list(simhash._run_links(np.zeros(len(fp), np.int64), fp, 1))
    tasks = [b for b in out if b.column(0).null_count]
    assert len(fp) > simhash.BLOCK and tasks
    links = [b for t in tasks for b in simhash._block_links(1)([t.select(["left", "right"])])]
    pairs = {frozenset(p) for b in links for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    up = {int(f): int(f) for f in fp}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in pairs:
        x, y = (find(v) for v in p)
        up[x] = y
    have = set(up)
    assert all(find(f) == find(f ^ (1 << b)) for f in have for b in range(14) if f ^ (1 << b) in have)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def _vectors():
    rng = np.random.default_rng(11)
    out = []
    for _ in range(25):
        centre = rng.normal(size=16)
        out += [centre + rng.normal(size=16) * 0.06 for _ in range(rng.integers(1, 8))]
    out += [rng.normal(size=16) for _ in range(300)]
    family = rng.normal(size=16)
    out += [family + rng.normal(size=16) * 0.04 for _ in range(900)]
    out += [out[0], out[0] * 3.0]
    return [v.astype(np.float32).astype(float).tolist() for v in out]


def test_embedding_groups_against_brute_force(spark):
    vectors = _vectors()
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors + odd)], "vec_id long, embedding array<double>, vec string").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.embedding_groups(df).collect()}
    u = np.array(vectors)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    found = np.array([got[i]["n_links"] for i in range(len(u))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    root = closure(len(u), lambda a, b: near[a, b])
    assert sum(got[i]["component_id"] == root[i] for i in range(len(u))) >= 0.9 * len(u)
    for i in range(len(vectors), len(vectors) + len(odd)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_passes_grow_slowly():
    assert embeddings.passes_for(10, 0.95) == 1
    assert embeddings.passes_for(10**6, 0.95) <= embeddings.passes_for(10**9, 0.95) <= embeddings.MAX_PASSES
    agree = 1 - math.acos(0.95) / math.pi
    n = 51_282
    meet = agree ** math.log2(n / embeddings.WINDOW)
    assert 1 - (1 - meet) ** embeddings.passes_for(n, 0.95) >= embeddings.RECALL


@pytest.mark.parametrize("exact_a_pass", [embeddings.EXACT_A_PASS, 0])   # as it is, and by passes alone until few rows are left
def test_embedding_pairs_in_a_crowded_cone(spark, monkeypatch, exact_a_pass):
    rng = np.random.default_rng(8)
    n, dims, pairs = 6000, 64, 200
    v = math.sqrt(0.9) * np.eye(dims)[0] + math.sqrt(0.1 / (dims - 1)) * np.c_[np.zeros(n), rng.normal(size=(n, dims - 1))]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, dims))
    side -= (side * u[:pairs]).sum(axis=1, keepdims=True) * u[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.96, size=(pairs, 1))
    u = np.r_[u, cosine * u[:pairs] + np.sqrt(1 - cosine ** 2) * side]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embeddings, "EXACT_ROWS", 500)
    monkeypatch.setattr(embeddings, "EXACT_A_PASS", exact_a_pass)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(u.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["component_id"] for r in embeddings.embedding_groups(df).collect()}
    a, b = np.nonzero(np.triu(near))
    assert len(a) >= pairs and np.mean([got[x] == got[y] for x, y in zip(a, b)]) >= 0.97
