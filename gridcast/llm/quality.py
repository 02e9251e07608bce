"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text (shares of letters, symbols, repeated words and lines,
word and line lengths, ...) is cut into quantile bins. Training visits the
features in turn, round after round; each visit fits a shallow tree (two cuts
at most) to the current residuals over the feature's bins and adds a small
step of it to the feature's lookup table. Then the pairs of features whose
joint bins still explain most residual get tables of their own, boosted in
the same cyclic way with trees of one cut on each feature. A score is the
sigmoid of added table entries, so scoring is vectorised bin lookups.

Features are computed by Spark tasks over whole texts. Training sees the
feature rows of at most ``per_class`` labelled documents of each label,
weighted to the labels' own shares; no text reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, binary_texts, id_bucket, staged, text_or_empty

PER_CLASS = 8000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
RIDGE = 5.0
SLICE_BYTES = 2 << 20

#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this are from or an at not have "
    "der die und das den von zu mit ist ein eine im des auf für nicht "
    "le la les de des et un une que est en du pour dans qui sur "
    "el los las y del por con para se su una".encode().split())
FEATURES = (
    "log_words", "word_length", "upper", "letters", "digits", "symbols", "exclaim", "bars", "ends_marked", "stops",
    "distinct", "top_word", "echo", "repeat5", "line_words", "repeated_lines", "capitalised", "long_words",
)
_UPPER, _DIGIT, _SYMBOL, _LETTER = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[ord("A"):ord("Z") + 1] = 1
_DIGIT[ord("0"):ord("9") + 1] = 1
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = _LETTER[128:] = 1
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-|"]] = 1


def features(text: bytes) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    ink = max(1, sum(map(len, words)))
    lower = [w.lower() for w in words]
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in lower], np.uint64)
    uses = np.bincount(seq.astype(np.int64))
    repeat5 = 0.0
    if n >= 10:
        h = seq[:-4].copy()
        for k in range(1, 5):
            h = h * np.uint64(1099511628211) + seq[k:n - 4 + k] + np.uint64(1)
        repeat5 = 1.0 - len(np.unique(h)) / len(h)
    lines = [x for x in (x.strip() for x in text.split(b"\n")) if x]
    return [
        float(np.log1p(n)), ink / n, counts @ _UPPER / ink, counts @ _LETTER / ink, counts @ _DIGIT / ink, counts @ _SYMBOL / ink,
        counts[33] / ink, counts[124] / n, sum(w[-1] in b".,;:!?" for w in words) / n, sum(uses[ids[w]] for w in ids.keys() & STOP_WORDS) / n,
        float(np.log1p(len(ids)) / np.log1p(n)), uses.max() / n if n >= 5 else 0.0, float((seq[1:] == seq[:-1]).sum()) / n, repeat5,
        n / max(1, len(lines)), 1.0 - len(set(lines)) / max(1, len(lines)), sum(65 <= w[0] <= 90 for w in words) / n, sum(len(w) > 14 for w in words) / n,
    ]


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; ``score`` adds table entries."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edge, x[:, j], side="right")]
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            z += table[coarse[a], coarse[b]]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _shallow_tree(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """Leaf value per bin of a tree with at most ``cuts`` cuts over ordered bins, grown greedily by gain."""
    bounds = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(cuts):
        best, at = 1e-9, None
        for lo, hi in zip(bounds, bounds[1:]):
            mid = np.arange(lo + 1, hi)
            if not len(mid):
                continue
            gains = (_gain(cg[mid] - cg[lo], ch[mid] - ch[lo]) + _gain(cg[hi] - cg[mid], ch[hi] - ch[mid])
                     - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo]))
            if gains.max() > best:
                best, at = gains.max(), int(mid[gains.argmax()])
        if at is None:
            break
        bounds = sorted(bounds + [at])
    out = np.empty(len(g))
    for lo, hi in zip(bounds, bounds[1:]):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of each axis of a grid: (gain, leaf value per cell)."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def corners(c):
        all_, top, left = c[-1, -1], c[1:-1, -1][:, None], c[-1, 1:-1][None, :]
        inner = c[1:-1, 1:-1]
        return inner, top - inner, left - inner, all_ - top - left + inner

    parts = list(zip(corners(cg), corners(ch)))
    gains = sum(_gain(a, b) for a, b in parts) - _gain(cg[-1, -1], ch[-1, -1])
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    out = np.empty_like(g)
    for (a, b), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                  (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = a[i, j] / (b[i, j] + RIDGE)
    return float(gains.max()), out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS,
        pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> AdditiveModel:
    """Cyclic boosting of single features, then of the strongest pairs. With one class only: that class's share."""
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    model = AdditiveModel([np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(np.unique(y)) < 2:
        return model
    weight = weight / weight.mean()
    model.edges = _edges(x, BINS)
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.bias)

    def residuals():
        p = 1.0 / (1.0 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(bins):
            g, h = residuals()
            size = len(model.tables[j])
            step = rate * _shallow_tree(np.bincount(b, g, minlength=size), np.bincount(b, h, minlength=size))
            model.tables[j] += step
            z += step[b]

    model.pair_edges = _edges(x, PAIR_BINS)
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a, b, values):
        return np.bincount(coarse[a] * sizes[b] + coarse[b], values, minlength=sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = residuals()
    ranked = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)))
    model.pairs = [(a, b) for gain, a, b in ranked[:pairs] if gain < 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = residuals()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[k] += step
            z += step[coarse[a], coarse[b]]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batches_of(batch, 1, SLICE_BYTES):
            rows = [features(t) for t in binary_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
          per_class: int = PER_CLASS, folds: int = 5) -> AdditiveModel:
    """Fit on the feature rows of a bounded sample of labelled documents outside fold 0.

    The sample holds the ``per_class`` documents of each label with the
    smallest hash of the id. A label is 0 or 1; where an id repeats, its
    largest label counts.
    """
    usable = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (id_bucket(id_col, folds) != 0))
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y")))
    h = F.xxhash64("id")
    picks = [usable.where(F.col("y") == y).orderBy(h, "id").limit(per_class) for y in (0, 1)]
    pick = staged(picks[0].unionByName(picks[1]), "picked")
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    body = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # F.broadcast: at most 2 * per_class (id, label) pairs; a repeated id counts once, by its smallest text
    sample = body.join(F.broadcast(pick), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = sample.select("y", "text").mapInArrow(_feature_batches, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, y))                              # the fit does not depend on the order rows arrive in
    x, y = x[order], y[order]
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, totals.get(1, 0) / seen[1], totals.get(0, 0) / seen[0])
    return fit(x, y, weight)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: (id_col, held_out, score, predicted).

    Labels of fold 0 (``held_out``) are never read. Null and wordless texts
    have all features 0 and are scored like any other. A null id is scored
    but has no label; repeated rows get equal scores; an empty table gives no
    rows; other columns are not read. A text of any length is counted whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, id_col, text_col, per_class))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, 2, SLICE_BYTES):
                x = np.array([features(t) for t in binary_texts(part.column(2))]).reshape(part.num_rows, len(FEATURES))
                score = model.value.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), (id_bucket(id_col, 5) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
