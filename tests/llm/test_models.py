"""Quality, toxicity and language-model scores: held-out accuracy, brute force and edge cases."""

import itertools
import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from gridcast.llm import lattice_lm as lm
from gridcast.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def _held_out(spark, score, label):
    docs, labels = spark.read.parquet(SF + "/documents.parquet"), spark.read.parquet(SF + "/labels.parquet")
    out = score(docs, labels).cache()
    assert out.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out.limit(500).collect())
    both = out.where("held_out").join(labels, "doc_id").where(f"{label} is not null").select("predicted", label).collect()
    right = {c: [r["predicted"] == c for r in both if r[label] == c] for c in (0, 1)}
    return [sum(right[c]) / len(right[c]) for c in (0, 1)]


def test_toxicity_held_out(spark):
    clean, toxic = _held_out(spark, toxicity.score_toxicity, "toxic")
    assert clean >= 0.97 and toxic >= 0.9


def test_quality_held_out(spark):
    poor, good = _held_out(spark, quality.score_quality, "quality")
    assert good >= 0.98 and poor >= 0.9


def test_classifiers_on_awkward_tables(awkward, empty, labels, rows):
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = rows(score(awkward, labels, per_class=50))
        assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (203, 204, 205)}) == 1
        assert len({r["score"] for r in got if r["doc_id"] == 210}) == 1
        assert score(empty, labels).count() == 0
        assert score(awkward, labels.limit(0)).count() == awkward.count()
    assert toxicity.drop_toxic(awkward, labels.limit(0)).schema == awkward.schema
    assert toxicity.drop_toxic(awkward, labels.limit(0)).count() == awkward.count()


def test_word_means_by_hand():
    rng = np.random.default_rng(2)
    table = rng.normal(size=1 << toxicity.BUCKET_BITS)

    def bucket(gram):
        h = gram[0]
        for b in gram[1:]:
            h = (h * 16777619 + b) & 0xFFFFFFFF
        return (h * 2654435761 & 0xFFFFFFFF) >> (32 - toxicity.BUCKET_BITS)

    texts = ["An  idiöt\there".encode(), b"", b"a"]
    values, counts = toxicity.word_means(table, texts)
    words = [w for t in texts for w in t.lower().split()]
    want = []
    for w in words:
        p = b" " + w + b" "
        grams = [p[i:i + n] for n in range(3, 7) for i in range(len(p) - n + 1)]
        want.append(np.mean([table[bucket(g)] for g in grams]))
    assert counts == [3, 0, 1] and np.allclose(values, want)


def test_toxic_terms_of_one_text_in_a_hundred():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    common, toxic = (["".join(rng.choice(letters, rng.integers(5, 10))) for _ in range(n)] for n in (1500, 100))

    def texts(n, label):
        for i in range(n):
            words = [common[j] for j in (rng.random(40) ** 2 * len(common)).astype(int)]
            if label:                                                  # each toxic term is in 1 % of the toxic texts
                words[7] = words[31] = toxic[i % len(toxic)]
            yield " ".join(words).encode(), label

    table, bias = toxicity.train([*texts(1500, 0), *texts(1500, 1)])
    for label in (0, 1):
        score = toxicity.predict(table, bias, [t for t, _ in texts(300, label)])
        assert ((score >= 0.5) == label).mean() >= 0.95


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, np.ones(len(y)))
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def _segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def test_lattice_against_all_segmentations():
    pieces, log_p = lm.lattice_pieces(lm.DEFAULT_MODEL)
    weight = dict(zip(pieces, np.exp(log_p)))
    words = [b"hello", b"a", "naïve".encode(), b"xqzj", b"the"]
    got = lm.lattice_log_likelihood(words, pieces, log_p[:, None])[:, 0]
    uses = dict.fromkeys(pieces, 0.0)
    for w, g in zip(words, got):
        ways = [(math.prod(weight[p] for p in s), s) for s in _segmentations(b" " + w) if all(p in weight for p in s)]
        total = sum(p for p, _ in ways)
        assert math.isclose(g, math.log(total), rel_tol=1e-9)
        for p, s in ways:
            for piece in s:
                uses[piece] += p / total
    counts = lm.expected_counts(words, pieces, log_p[:, None])
    assert np.allclose(counts, [uses[p] for p in pieces])
    assert math.isclose(np.exp(log_p).sum(), 1.0)


def test_language_model(awkward, empty, rows):
    docs = rows(awkward.select("doc_id", "text"))
    got = rows(lm.score_documents(awkward, hot_words=8))               # most words take the join
    plain = rows(lm.score_documents(awkward))
    counts = {}
    tokens = {}
    for i, r in enumerate(docs):
        tokens[i] = (r["text"] or "").encode().lower().split() + [b""]
        if zlib.crc32((str(r["doc_id"]) if r["doc_id"] is not None else "").encode()) % 10:
            for w in tokens[i]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)

    def base(w):
        return math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1)))

    want = sorted((str(r["doc_id"]), len(tokens[i]), sum(w in counts for w in tokens[i]), n, round(sum(map(base, tokens[i])), 6)) for i, r in enumerate(docs))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    a, b = (sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in x) for x in (got, plain))
    assert all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 * (1 + abs(x[2])) for x, y in zip(a, b))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_kinds_come_from_all_training_documents(spark):
    """One rare document among more than 1,500 is a kind of its own, wherever its id hashes to."""
    rare = [(i, False, "ωψχ φυτ σρπ " * 9) for i in range(3000, 3002)]
    rows = [(i, False, "the cat sat on the mat " * 3 + str(i % 7)) for i in range(3000)] + rare
    centres = lm.document_kinds(spark.createDataFrame(rows, "id long, held_out boolean, text string").repartition(3), 2)
    assert len(centres) == 2
    assert (centres @ lm.profile(rare[0][2].encode())).max() > 0.99
    held = spark.createDataFrame([(i, True, t) for i, _, t in rows[:5]], "id long, held_out boolean, text string")
    assert not lm.document_kinds(held, 2).any()


def test_word_probabilities_are_a_distribution():
    """With a tiny vocabulary, all words up to a length and the tail sum to one, kind by kind."""
    pieces = (b" ", b" a", b"a", b"b", b"ab")
    p = np.array([0.3, 0.2, 0.2, 0.2, 0.1])
    words = [bytes(w) for n in range(0, 13) for w in itertools.product(b"ab", repeat=n)]
    lattice = np.exp(lm.lattice_log_likelihood(words, pieces, np.log(p)[:, None])[:, 0])
    assert 0.97 < lattice.sum() <= 1.0 + 1e-9
    random.seed(1)
    c = np.zeros((len(words), 2))
    c[[1, 2, 5], 0] = [3, 1, 2]
    c[[1, 4], 1] = [2, 5]
    tokens, types = c.sum(axis=0), (c > 0).sum(axis=0).astype(float)
    q = lm.word_log10(words, c, pieces, np.log(np.c_[p, p]), tokens, types, int((c.sum(axis=1) > 0).sum()), 0.5)
    assert np.all(np.abs((10.0 ** q).sum(axis=0) - 1) < 0.03)


def test_written_profiles_hold_only_what_is_not_zero():
    """A k-means pass reads a bit an entry and the entries of the text, not the whole width, and gets the same rows."""
    texts = ["the cat sat on the mat", "", "ab", "Über naïve " * 5, "x" * 70000, "a b c d e f g " * 3]
    written = list(lm._written_profiles(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert [b.num_rows for b in written] == [4]                          # texts without a trigram have no profile
    assert max(len(v) for v in written[0].column(0).to_pylist()) < lm.PROFILE // 4
    (rows, lengths), = lm._profiles(iter(written))
    for row, length, text in zip(rows, lengths, [t for t in texts if len(t) > 2]):
        b = text.lower().encode() if text.isascii() else text.encode().lower()
        want = np.zeros(lm.PROFILE)
        for i in range(len(b) - 2):
            want[(b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % lm.PROFILE] += 1
        want = np.rint(255 * np.sqrt(want / (len(b) - 2)))
        assert (row == want).all() and math.isclose(length, math.sqrt((want * want).sum()), rel_tol=1e-6)


def test_tokens_are_those_of_plain_splitting():
    texts = ["", " ", "a", " A\tb\x0b\x0cB\r\n", "x\x1cy \x1d\x85", "É ÀB\u2003c\u3000d  a", None, "a " * 9]
    column = pa.array(["skipped", *texts]).slice(1)
    n, words, codes = lm._tokens(column)
    words = words.to_pylist()
    assert len(set(words)) == len(words)
    ends = np.cumsum(n)
    got = [[words[c] for c in codes[e - k:e]] for k, e in zip(n, ends)]
    assert got == [(t or "").encode().lower().split() for t in texts]
    shared = SimpleNamespace(value=np.eye(2, lm.PROFILE))
    held = pa.array([i % 3 == 0 for i in range(len(texts))])
    counted = {}
    for b in lm._counted(shared)(iter([pa.RecordBatch.from_arrays([held, column], names=["held_out", "text"])])):
        for r in b.to_pylist():
            counted[r["word"], r["kind"]] = counted.get((r["word"], r["kind"]), 0) + r["c"]
    want = {}
    for t, h in zip(texts, held.to_pylist()):
        t = (t or "").encode()
        for w in [*t.lower().split(), lm.END]:
            key = w, -1 if h else int((shared.value @ lm.profile(t)).argmax())
            want[key] = want.get(key, 0) + 1
    assert counted == want
    assert lm._byte_list(pa.array([b"no", b"a", b"", b"bc"]).slice(1)) == [b"a", b"", b"bc"]
    assert lm._byte_list(pa.array([], pa.binary())) == []


def test_token_parts_join_small_batches_and_cut_large_ones(monkeypatch):
    monkeypatch.setattr(lm, "TOKEN_BYTES", 1000)
    texts = ["short", "", None, "x" * 5000, *["w " * 90] * 12, *["tiny"] * 100]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], names=["i", "text"]) for i, t in enumerate(texts)]
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
    for given in (batches, whole):
        parts = list(lm._token_parts(iter(given), 1))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts
        assert 3 < len(parts) < len(texts) // 4
    assert list(lm._token_parts(iter([whole[0].slice(0, 0)]), 1)) == []


def test_lattice_sums_of_probabilities_equal_sums_of_logs(monkeypatch):
    """Words on both sides of the length up to which plain sums cannot underflow."""
    pieces, log_p = lm.lattice_pieces(lm.DEFAULT_MODEL)
    random.seed(3)
    weights = np.c_[log_p, log_p + [random.uniform(-4, 0) for _ in pieces]]
    words = [bytes(random.choice(b"abcetio\xff\xc3") for _ in range(k)) for k in (0, 1, 5, 12, 20, 30, 60, 500, 3000)] + [b"ab" * 4000]
    assert lm._plain(np.zeros((1, 6)), weights.min()) and not lm._plain(np.zeros((1, 500)), weights.min())
    got = lm.lattice_log_likelihood(words, pieces, weights), lm.expected_counts(words, pieces, weights[:, [1]])
    each = np.array([lm.lattice_log_likelihood([w], pieces, weights)[0] for w in words])       # chunks of one word: short ones sum plainly
    monkeypatch.setattr(lm, "LEAST_LOG", -1.0)
    want = lm.lattice_log_likelihood(words, pieces, weights), lm.expected_counts(words, pieces, weights[:, [1]])
    assert np.isfinite(got[0]).all() and np.allclose(got[0], want[0], rtol=1e-12, atol=0) and np.allclose(each, want[0], rtol=1e-12, atol=0)
    assert np.allclose(got[1], want[1], rtol=1e-9, atol=1e-12)
