"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams (3 to 6 bytes of the lower-cased UTF-8
word between two word borders), each hashed to a bucket with an embedding
vector. A word's vector is the mean of its n-grams', a document's the mean of
its words'; a softmax layer over two classes follows. Embeddings and softmax
weights are trained together. An unseen misspelling or inflection still
shares most n-grams, and so vectors, with the words seen.

Training runs in one task over a bounded sample (``per_class`` documents of
each label and ``max_bytes`` of text); the driver only receives the result. Scoring runs over every whole text in
Arrow batches. As mean and softmax input are linear, each bucket's vector
meets the class weights once, before the scan; what is broadcast is one float
a bucket (``2**BUCKET_BITS`` floats, 1 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, binary_texts, id_bucket, labelled_rows, text_or_empty

MIN_N, MAX_N = 3, 6
BUCKET_BITS = 18
DIMENSIONS = 8
PER_CLASS = 1500
MAX_BYTES = 12 << 20
STEPS = 80
RATE = 0.1
ODDITY = 2.5                        # least association with a class, in standard deviations, at any sample size
DOUBT = 8.0                         # association that halves the weight
MIN_SEEN = 5
WORDS_AT_ONCE = 20_000
ENTRIES_AT_ONCE = 200_000
SHARPNESS = 50.0
SLICE_BYTES = 2 << 20               # text scored at once
SEED = 42


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All words in one byte array with single spaces between and around; the spaces' places; words per text."""
    split = [t.lower().split() for t in texts]
    body = np.frombuffer(b" " + b" ".join(w for ws in split for w in ws) + b" ", np.uint8)
    return body, np.flatnonzero(body == 32), [len(ws) for ws in split]


def _ngrams(body: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the positions where an n-gram of one word starts, and its buckets."""
    room = np.repeat(gaps[1:], np.diff(gaps)).astype(np.int32) - np.arange(gaps[-1], dtype=np.int32)
    h = body[:len(room)].astype(np.uint32)
    for n in range(2, MAX_N + 1):
        nxt = body[n - 1:n - 1 + len(room)]
        h[:len(nxt)] = h[:len(nxt)] * np.uint32(16777619) + nxt
        if n >= MIN_N:
            at = np.flatnonzero(room >= n - 1)
            yield at, (h[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def word_means(table: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Mean of ``table`` over the n-grams of each word, and the number of words of each text."""
    body, gaps, words = _stream(texts)
    if not sum(words):
        return np.zeros(0), words
    total, count = np.zeros(gaps[-1]), np.zeros(gaps[-1], np.float32)
    for at, bucket in _ngrams(body, gaps):
        total[at] += table[bucket]
        count[at] += 1
    return np.add.reduceat(total, gaps[:-1]) / np.add.reduceat(count, gaps[:-1]), words


def text_means(values: np.ndarray, words: list[int]) -> np.ndarray:
    """Mean of word values per text; 0 for a text without words."""
    ends = np.cumsum(words)
    sums = np.r_[0.0, np.cumsum(values)]
    n = np.asarray(words)
    return (sums[ends] - sums[ends - n]) / np.maximum(n, 1)


def _word_grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of every n-gram of some words, a few thousand words at a time, to bound memory."""
    for first in range(0, len(words), WORDS_AT_ONCE):
        body, gaps, _ = _stream(words[first:first + WORDS_AT_ONCE])
        parts = list(_ngrams(body, gaps))
        word = np.concatenate([np.searchsorted(gaps, at, side="right") - 1 for at, _ in parts])
        yield np.concatenate([bucket for _, bucket in parts]).astype(np.int32), (first + word).astype(np.int32)


class _Sparse:
    """Row-normalised incidence of rows and columns; products in both directions by sorted segment sums."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray):
        self.by_row = self._sorted(rows, cols, weights)
        self.by_col = self._sorted(cols, rows, weights)

    @staticmethod
    def _sorted(key, other, weights):
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[starts], starts, other[order].astype(np.int32), weights[order, None].astype(np.float32)

    @staticmethod
    def _times(side, x, n):
        """Segment sums, some segments at a time, so that no product of all entries is held."""
        out = np.zeros((n, x.shape[1]), np.float32)
        keys, starts, other, weights = side
        ends, at = np.r_[starts[1:], len(other)], 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + ENTRIES_AT_ONCE, side="right")))
            part = slice(starts[at], ends[to - 1])
            out[keys[at:to]] = np.add.reduceat(x[other[part]] * weights[part], starts[at:to] - starts[at], axis=0)
            at = to
        return out

    def dot(self, x, n):
        return self._times(self.by_row, x, n)

    def back(self, x, n):
        return self._times(self.by_col, x, n)


def train(sample: list[tuple[bytes, int]], steps: int = STEPS, rate: float = RATE, dims: int = DIMENSIONS,
          seed: int = SEED) -> tuple[np.ndarray, float]:
    """(value per bucket, bias): the log-odds of class 1 is the mean value of the text's words plus the bias.

    With one class only, or no sample, every value is 0 and the bias gives
    that class (none: class 0).
    """
    y = np.array([c for _, c in sample], int)
    table = np.zeros(1 << BUCKET_BITS, np.float64)
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()], np.int64) for t, _ in sample]
    words = list(vocabulary)
    vocabulary.clear()
    if len(set(y.tolist())) < 2 or not words:
        return table, 20.0 if len(y) and y.mean() > 0.5 else -20.0

    length = np.array([len(x) for x in ids])
    pair, times = np.unique(np.repeat(np.arange(len(y)), length) * len(words) + np.concatenate(ids), return_counts=True)
    del ids
    doc, word = pair // len(words), pair % len(words)

    # n-grams spread over the classes as chance would have it carry no evidence; their vectors stay at zero.
    # The others count by their evidence, so the many that chance made odd weigh little.
    texts_with = [np.bincount(word[y[doc] == c], minlength=len(words)) for c in (0, 1)]
    seen = np.zeros((2, 1 << BUCKET_BITS))
    for bucket, owner in _word_grams(words):
        for c in (0, 1):
            seen[c] += np.bincount(bucket, texts_with[c][owner], minlength=1 << BUCKET_BITS)
    total = seen.sum(axis=0)
    share = seen[1].sum() / total.sum()
    odd = np.abs(seen[1] - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    telling = (odd >= ODDITY) & (total >= MIN_SEEN)
    if not telling.any():
        return table, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))

    kept, owners, n_of_word = [], [], np.zeros(len(words))
    for bucket, owner in _word_grams(words):
        n_of_word += np.bincount(owner, minlength=len(words))
        keep = telling[bucket]
        kept.append(bucket[keep])
        owners.append(owner[keep])
    grams, local = np.unique(np.concatenate(kept), return_inverse=True)
    telling_words, owner = np.unique(np.concatenate(owners), return_inverse=True)
    n_words = len(telling_words)
    trust = odd[grams] ** 2 / (odd[grams] ** 2 + DOUBT ** 2)
    del kept, owners, seen, texts_with
    to_word = _Sparse(owner, local, trust[local] / n_of_word[telling_words][owner])
    del owner, local
    place = np.full(len(words), -1, np.int64)
    place[telling_words] = np.arange(n_words)
    inside = place[word] >= 0
    doc, word, times = doc[inside], place[word[inside]], times[inside]
    to_doc = _Sparse(doc, word, times / length[doc])

    rng = np.random.default_rng(seed)
    e = np.zeros((len(grams), dims), np.float32)
    w = (rng.normal(size=(dims, 2)) * 0.5).astype(np.float32)
    b = np.zeros(2, np.float32)
    params = [e, w, b]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))[:, None]
    for step in range(1, steps + 1):
        v = to_doc.dot(to_word.dot(params[0], n_words), len(y))
        z = v @ params[1] * SHARPNESS + params[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = (p * weight).astype(np.float32)
        gv = g @ params[1].T * SHARPNESS
        grads = [to_word.back(to_doc.back(gv, n_words), len(grams)), v.T @ g * SHARPNESS, g.sum(axis=0)]
        for k, (q, d) in enumerate(zip(params, grads)):
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.99 * m2[k] + 0.01 * d * d
            q -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-4)
    side = (params[1][:, 1] - params[1][:, 0]).astype(np.float64) * SHARPNESS
    table[grams] = (params[0].astype(np.float64) @ side) * trust
    return table, float(params[2][1] - params[2][0])


def predict(table: np.ndarray, bias: float, texts: list[bytes]) -> np.ndarray:
    """Probability of class 1 for each text."""
    z = text_means(*word_means(table, texts)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(values, bias): the model of all (text, y) of the partition."""
    sample: list[tuple[bytes, int]] = []
    for batch in batches:
        sample += zip(binary_texts(batch.column(0)), batch.column(1).to_pylist())
    values, bias = train(sample)
    yield pa.RecordBatch.from_arrays([pa.array([values.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["table", "bias"])


def fitted(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, id_col: str, text_col: str) -> tuple[np.ndarray, float]:
    """(value per bucket as 4-byte floats, bias), trained by one task on the bounded sample."""
    sample = labelled_rows(docs, labels, label, per_class, max_bytes, id_col, text_col)
    if sample is None:
        values, bias = train([])
        return values.astype(np.float32), bias
    one = (sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y")      # max_bytes at most
           .mapInArrow(_fitted, "table binary, bias double").first())
    return np.frombuffer(bytes(one["table"]), np.float32), one["bias"]


def _scored(shared, bias: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, 2, SLICE_BYTES):
                score = predict(shared.value, bias, binary_texts(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: (id_col, held_out, score, predicted).

    Labels of fold 0 (``held_out``) are never read. Null and wordless texts
    score the bias alone. A null id is scored but has no label; repeated rows
    get equal scores; an empty table gives no rows; other columns are not
    read, and id, source, language and labels are no inputs of a score. A
    text of any length is scored whole.
    """
    table, bias = fitted(docs, labels, label, per_class, max_bytes, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (id_bucket(id_col, 5) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(_scored(shared, bias, threshold), f"id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns; texts are scored where they are read."""
    table, bias = fitted(docs, labels, label, per_class, max_bytes, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in batches_of(batch, at, SLICE_BYTES):
                score = predict(shared.value, bias, binary_texts(part.column(at)))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(keep, docs.schema)
