"""Language-model scores: marginal likelihood of the subword lattice.

The lattice of a word has a node at each byte border and an edge for every
piece of an existing SentencePiece vocabulary that matches there, weighted
with the piece's unigram probability. A log-space forward recursion sums over
all segmentations. The vocabulary's scores are the starting weights; they are
re-estimated by forward-backward expected counts over all word types of the
training documents. A word that the training documents hold has one more
edge, from its start to its end, with its discounted relative frequency, and
the subword edges share what the discount leaves.

Documents of different kinds (languages, tables, ...) use different words, so
the edge weights are those of one of ``COMPONENTS`` kinds, and the document's
probability is also summed over the kinds:

    p(text)   = sum over k of share(k) * product over words of p_k(word)
    p_k(word) = max(c_k - D, 0) / N_k + D * V_k / N_k * q_k(word)
    q_k(word) = max(c - D, 0) / N + D * V / N * lattice_k(word)

Kinds are clusters of byte-trigram profiles, found by k-means over all
training documents: the profiles (a bit for each of ``PROFILE`` entries and a
byte for those that are not 0) are written once, and in each round a task sums
those nearest to each centre. Every training document is counted for the kind
nearest to it. Pieces never cross a word border, so a document's
recursion breaks at each word start and its log probability under a kind is
the sum over its words, plus the end.

What is learned is counted over all training documents: word counts (grouped
with partial counts in each task), their totals, and the pieces' expected
counts. Scoring meets the ``HOT_WORDS`` most frequent words at most in a
broadcast table; the other words of each document, none of them frequent,
are joined with the whole count table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, binary_texts, id_bucket, staged, text_or_empty
from .vocabulary import DEFAULT_MODEL, SPACE, read_pieces

HOT_WORDS = 1 << 18
TOKEN_BYTES = 2 << 20
CHUNK_CELLS = 1 << 17
LEAST_LOG = 650.0                                          # exp(-650) is far from the least normal double
ROUNDS = 2
COMPONENTS = 8
KIND_ROUNDS = 12
PROFILE = 4096
PROFILES = 64
END = b""
SEED = 42


@lru_cache(maxsize=2)
def _trie(pieces: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Transition table (state, byte) -> state, with 0 for none and 1 for the root, and the piece that ends at a state."""
    move: list[dict[int, int]] = [{}, {}]
    ends = [-1, -1]
    for number, piece in enumerate(pieces):
        at = 1
        for byte in piece:
            if byte not in move[at]:
                move[at][byte] = len(move)
                move.append({})
                ends.append(-1)
            at = move[at][byte]
        ends[at] = number
    table = np.zeros((len(move), 257), np.int32)          # column 256: padding after a word's end
    for at, step in enumerate(move):
        for byte, to in step.items():
            table[at, byte] = to
    return table, np.array(ends, np.int32)


def lattice_pieces(model_path: str) -> tuple[tuple[bytes, ...], np.ndarray]:
    """Pieces that can lie in a word, as bytes with a space for the word mark, and starting log probabilities.

    Scores that are ranks, as in BPE models, become Zipf weights; scores of a
    unigram model are log probabilities already. Bytes without a piece of
    their own take the model's byte piece or one like it, so every word has a path.
    """
    scored: dict[bytes, float] = {}
    worst = 0.0
    for piece in read_pieces(model_path):
        if piece.kind != "piece":
            continue
        body = piece.text.replace(SPACE, " ").encode()
        worst = min(worst, piece.score)
        if b" " not in body[1:]:
            scored[body] = max(piece.score, scored.get(body, -math.inf))
    ranks = worst < -1000
    log = {b: -math.log(10 - s) if ranks else s for b, s in scored.items()}
    low = min(log.values(), default=0.0)
    for byte in range(256):
        log.setdefault(bytes([byte]), low)
    pieces = tuple(sorted(log))
    p = np.array([log[b] for b in pieces])
    return pieces, p - np.logaddexp.reduce(p)


def _chunks(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, bytes, lengths): words of about the same length, each after a space, padded with 256."""
    length = np.array([len(w) + 1 for w in words])
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        end = at + max(1, min(len(order) - at, CHUNK_CELLS // int(length[order[at]])))
        while end > at + 1 and (end - at) * int(length[order[end - 1]]) > CHUNK_CELLS:
            end = at + max(1, (end - at) // 2)
        rows = order[at:end]
        width = int(length[rows[-1]])
        cells = np.full((len(rows), width), 256, np.int16)
        flat = np.frombuffer(b"".join(b" " + words[i] for i in rows), np.uint8)
        cells[np.arange(width)[None, :] < length[rows][:, None]] = flat
        yield rows, cells, length[rows]
        at = end


def _plain(cells: np.ndarray, least: float) -> bool:
    """Whether sums of probabilities of these words stay normal numbers.

    Each byte is a piece, so no node has less than the least weight to the power of the word's length; what
    underflows beside it is below the rounding. Longer words keep to sums of logs.
    """
    return cells.shape[1] * -least < LEAST_LOG


def _forward(cells: np.ndarray, lengths: np.ndarray, trie, log_p: np.ndarray, edges: list | None = None,
             p: np.ndarray | None = None) -> np.ndarray:
    """Log of the sum over all segmentations, for each word and each column of the weights ``log_p``.

    ``edges`` collects (words, from, to, pieces), and at last the sums up to each node. Given ``p``, the
    probabilities themselves, sums are of these and not of logs; ``_plain`` tells which chunks allow it.
    """
    table, ends = trie
    m, width = cells.shape
    alpha = np.full((width + 1, m, log_p.shape[1]), -np.inf if p is None else 0.0)
    alpha[0] = 0.0 if p is None else 1.0
    for i in range(width):
        rows = np.flatnonzero(lengths > i)
        state = np.ones(len(rows), np.int32)
        for j in range(i + 1, width + 1):
            state = table[state, cells[rows, j - 1]]
            live = state > 0
            if not live.all():
                rows, state = rows[live], state[live]
            if not len(rows):
                break
            piece = ends[state]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                to, piece = rows[hit], piece[hit]
                if p is None:
                    alpha[j, to] = np.logaddexp(alpha[j, to], alpha[i, to] + log_p[piece])
                else:
                    alpha[j, to] += alpha[i, to] * p[piece]
                if edges is not None:
                    edges.append((to, i, j, piece))
    if edges is not None:
        edges.append(alpha)
    total = alpha[lengths, np.arange(m)]
    return total if p is None else _log(total)


def lattice_log_likelihood(words: list[bytes], pieces: tuple[bytes, ...], log_p: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each word summed over all its segmentations, a column for each of ``log_p``."""
    out = np.zeros((len(words), log_p.shape[1]))
    p, least = np.exp(log_p), log_p.min()
    for rows, cells, lengths in _chunks(words):
        out[rows] = _forward(cells, lengths, _trie(pieces), log_p, p=p if _plain(cells, least) else None)
    return out


def expected_counts(words: list[bytes], pieces: tuple[bytes, ...], log_p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the words, by forward and backward recursion with one column of weights."""
    counts = np.zeros(len(pieces))
    weights, p, least = log_p[:, 0], np.exp(log_p), log_p.min()
    for _, cells, lengths in _chunks(words):
        edges: list = []
        uses: list = []
        plain = _plain(cells, least)
        total = _forward(cells, lengths, _trie(pieces), log_p, edges, p if plain else None)[:, 0]
        alpha = edges.pop()[:, :, 0]
        beta = np.full(alpha.shape, 0.0 if plain else -np.inf)
        beta[lengths, np.arange(len(lengths))] = np.exp(-total) if plain else -total
        for rows, i, j, piece in reversed(edges):
            if plain:
                tail = p[piece, 0] * beta[j, rows]
                beta[i, rows] += tail
                uses.append(alpha[i, rows] * tail)
            else:
                tail = weights[piece] + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], tail)
                uses.append(np.exp(alpha[i, rows] + tail))
        counts += np.bincount(np.concatenate([e[3] for e in reversed(edges)]), np.concatenate(uses), minlength=len(pieces))
    return counts


def packed_profiles(texts: list[bytes]) -> np.ndarray:
    """A row a text: square roots of the shares of hashed byte trigrams of the lower-cased text, in steps of 1/255."""
    packed = np.zeros((len(texts), PROFILE), np.uint8)
    sizes = [len(t) for t in texts]
    b = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint16)
    key = ((b[:-2] * 31 + b[1:-1]) * 31 + b[2:]) & (PROFILE - 1)          # PROFILE is a power of 2 that divides 2 ** 16
    at = 0
    for row, size in enumerate(sizes):
        if size > 2:
            counts = np.bincount(key[at:at + size - 2], minlength=PROFILE)
            steps = np.rint(255 * np.sqrt(np.arange(counts.max() + 1) / (size - 2))).astype(np.uint8)
            packed[row] = steps[counts]
        at += size
    return packed


def profile(text: bytes) -> np.ndarray:
    """The packed profile as a vector of unit length, or 0."""
    packed = packed_profiles([text])[0].astype(np.float64)
    return packed / max(1.0, math.sqrt(float(packed @ packed)))


def _some(items: list) -> Iterator[list]:
    """Slices of so many items that their profiles stay in a cache."""
    for at in range(0, len(items), PROFILES):
        yield items[at:at + PROFILES]


def _written_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' packed profiles, without those that are 0: a bit for each entry, 1 if it is not 0, then these entries."""
    for batch in batches:
        for part in batches_of(batch, 0, 1 << 20):
            found = []
            for texts in _some(binary_texts(part.column(0))):
                packed = packed_profiles(texts)
                live = packed > 0
                ends = np.cumsum(np.count_nonzero(live, axis=1))
                bits, entries = np.packbits(live, axis=1), packed.reshape(-1)[np.flatnonzero(live)]
                found += [bits[i].tobytes() + entries[ends[i - 1] if i else 0:ends[i]].tobytes() for i in np.flatnonzero(live.any(axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["profile"])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, lengths): written profiles as 4-byte floats and the lengths to divide them by, some at a time."""
    head = PROFILE // 8
    for batch in batches:
        for data in _some(batch.column(0).to_pylist()):
            live = np.unpackbits(np.frombuffer(b"".join([d[:head] for d in data]), np.uint8)).view(bool)
            entries = np.frombuffer(b"".join([d[head:] for d in data]), np.uint8).astype(np.float32)
            rows = np.zeros((len(data), PROFILE), np.float32)
            rows.reshape(-1)[np.flatnonzero(live)] = entries
            starts = np.cumsum([0] + [len(d) - head for d in data[:-1]])
            yield rows, np.sqrt(np.add.reduceat(entries * entries, starts))


def _extreme(shared, farthest: bool):
    """(near, vec): of a task's profiles, the one farthest from all centres, or the one nearest to the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, centres = None, shared.value.astype(np.float32).T
        for rows, length in _profiles(batches):
            near = (rows @ centres).max(axis=1) / length * (1 if farthest else -1)
            at = int(near.argmin())
            found = float(near[at]), (rows[at].astype(np.float64) / length[at]).tobytes()
            best = found if best is None else min(best, found)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], names=["near", "vec"])

    return run


def _centre_sums(shared):
    """(centre, vec): sums of a task's profiles by the centre nearest to them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.astype(np.float32).T
        sums = np.zeros(shared.value.shape)
        for rows, length in _profiles(batches):
            nearest = (rows @ centres).argmax(axis=1)
            for c in np.unique(nearest):
                own = np.flatnonzero(nearest == c)
                sums[c] += (1 / length[own]) @ rows[own]
        live = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([sums[c].tobytes() for c in live], pa.binary())],
                                         names=["centre", "vec"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each centre of a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[c] = sums.get(c, 0.0) + np.frombuffer(v.as_buffer(), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                     names=["centre", "vec"])


def document_kinds(rows: DataFrame, components: int, rounds: int = KIND_ROUNDS) -> np.ndarray:
    """At most ``components`` centres by spherical k-means over all training documents, from farthest-first starts."""
    spark = rows.sparkSession
    learn = staged(rows.where(~F.col("held_out")).select("text").mapInArrow(_written_profiles, "profile binary"), "profiles")

    def moved(centres: np.ndarray) -> np.ndarray:
        parts = learn.mapInArrow(_centre_sums(spark.sparkContext.broadcast(centres)), "centre int, vec binary")
        added = parts.repartition("centre").mapInArrow(_added, "centre int, vec binary").collect()      # one row a centre
        sums = np.frombuffer(b"".join(bytes(r["vec"]) for r in sorted(added, key=lambda r: r["centre"]))).reshape(-1, PROFILE)
        return sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))

    def extreme(centres: np.ndarray, farthest: bool):
        found = learn.mapInArrow(_extreme(spark.sparkContext.broadcast(centres), farthest), "near double, vec binary")
        return found.agg(F.min(F.struct("near", "vec")).alias("best")).first()["best"]

    mean = moved(np.zeros((1, PROFILE)))
    if not len(mean):
        return np.zeros((1, PROFILE))
    centres = np.frombuffer(bytes(extreme(mean, False)["vec"]))[None, :]
    while len(centres) < components:
        far = extreme(centres, True)
        if far["near"] > 1 - 1e-6:                             # every profile is a centre
            break
        centres = np.r_[centres, np.frombuffer(bytes(far["vec"]))[None, :]]
    for _ in range(rounds):
        last, centres = centres, moved(centres)
        if last.shape == centres.shape and np.allclose(last, centres, rtol=0, atol=1e-6):
            break
    return centres


def _token_parts(batches: Iterator[pa.RecordBatch], text_index: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``TOKEN_BYTES``, however short the texts, so that work done once a part stays small.

    Only small batches are joined: the end of a large one would keep all of it in memory while the next is read.
    """
    held, size = [], 0
    for batch in batches:
        parts = list(batches_of(batch, text_index, TOKEN_BYTES))
        for part in parts:
            own = 16 * part.num_rows + (pc.sum(pc.binary_length(part.column(text_index))).as_py() or 0)
            if held and size + own > TOKEN_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
        if len(parts) > 1:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(n, words, codes): each text's number of words, the distinct lower-cased words, and the place of each text's words there."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    n = np.diff(lists.offsets.to_numpy())
    full = np.asarray(pc.binary_length(flat)) > 0              # white space at a text's ends leaves an empty string there
    if not full.all():
        ends = np.cumsum(np.r_[0, full])
        n = np.diff(ends[lists.offsets.to_numpy()])
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return n.astype(np.int64), coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()


def _byte_list(words: pa.Array) -> list[bytes]:
    """The items of a binary column without nulls, cut from its one buffer, which is much faster than ``to_pylist``."""
    if not len(words):
        return []
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _counted(shared):
    """(word, kind, c): uses in the documents of a kind, kind -1 for documents held out; summed over some texts at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        kinds = len(centres) + 1
        for part in _token_parts(batches, 1):
            nearest = [(packed_profiles(texts).astype(np.float64) @ centres.T).argmax(axis=1) for texts in _some(binary_texts(part.column(1)))]
            kind = np.where(part.column(0).to_numpy(zero_copy_only=False), 0, 1 + np.concatenate(nearest))
            n, words, codes = _tokens(part.column(1))
            uses = np.bincount(codes.astype(np.int64) * kinds + np.repeat(kind, n), minlength=kinds * len(words))
            live = np.flatnonzero(uses)
            ends = np.bincount(kind, minlength=kinds)
            for at in range(0, len(live), 50_000):
                own = live[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(own // kinds)), pa.array((own % kinds - 1).astype(np.int32)),
                                                  pa.array(uses[own].astype(np.int64))], names=["word", "kind", "c"])
            own = np.flatnonzero(ends)
            yield pa.RecordBatch.from_arrays([pa.array([END] * len(own), pa.binary()), pa.array((own - 1).astype(np.int32)),
                                              pa.array(ends[own].astype(np.int64))], names=["word", "kind", "c"])

    return run


def _counts_of(batch: pa.RecordBatch) -> np.ndarray:
    """Uses of each word by kind, from an array column."""
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _expected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_p = shared.value
        total = np.zeros(log_p.shape)
        for batch in batches:
            words, c = _byte_list(batch.column(0)), _counts_of(batch)
            for k in range(log_p.shape[1]):
                own = [words[i] for i in np.flatnonzero(c[:, k])]
                if own:
                    total[:, k] += expected_counts(own, pieces, log_p[:, [k]])
        piece, kind = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(total[piece, kind])],
                                         names=["piece", "kind", "uses"])

    return run


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log(x)


def word_log10(words: list[bytes], c: np.ndarray, pieces, log_p, tokens: np.ndarray, types: np.ndarray, all_types: int,
               discount: float) -> np.ndarray:
    """log10 p_k(word), a column a kind; ``c`` has the words' uses by kind, ``tokens`` and ``types`` the kinds' totals."""
    q = lattice_log_likelihood(words, pieces, log_p)
    n = tokens.sum()
    if n:
        q = np.logaddexp(_log(np.maximum(c.sum(axis=1) - discount, 0.0) / n)[:, None], q + _log(discount * max(1, all_types) / n))
        q = np.logaddexp(_log(np.maximum(c - discount, 0.0) / tokens), q + _log(discount * np.maximum(types, 1) / tokens))
    return q / math.log(10)


def _word_scores(shared, *totals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_p = shared.value
        for batch in batches:
            c = _counts_of(batch)
            score = word_log10(_byte_list(batch.column(0)), c.astype(float), pieces, log_p, *totals)
            columns = [batch.column(0), batch.column(2), pa.array(c.sum(axis=1)), *(pa.array(x.astype(np.float32)) for x in score.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "c", *(f"s{k}" for k in range(score.shape[1]))])

    return run


class _HotTable:
    """Hot words with their values, a row a column."""

    def __init__(self, rows: pa.Table, columns: list[str]):
        self.words = rows.column("word").combine_chunks().cast(pa.binary())
        self.values = np.zeros((len(columns), len(self.words) + 1))      # the last of a row, 0, is for words that are not hot
        for i, c in enumerate(columns):
            self.values[i, :-1] = rows.column(c).to_numpy()

    def places(self, words: pa.Array) -> np.ndarray:
        """The words' places among the hot words, or -1."""
        found = pc.index_in(words, value_set=self.words)
        return pc.fill_null(found, -1).to_numpy()


def _hot_sums(shared, columns: list[str]):
    """A row per document: its tokens, the sums over its hot words, and its other words for the join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        row = TaskContext.get().partitionId() << 36
        for part in _token_parts(batches, 2):
            n, words, codes = _tokens(part.column(2))
            at = hot.places(words)
            sums = np.zeros((len(columns), len(n)))
            full = np.flatnonzero(n)
            if len(full):
                for i, values in enumerate(hot.values):
                    sums[i, full] = np.add.reduceat(values[at][codes], (np.cumsum(n) - n)[full])
            miss = np.flatnonzero((at < 0)[codes])
            ends = np.searchsorted(miss, np.r_[0, np.cumsum(n)]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(codes[miss])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(n))), part.column(0), part.column(1), pa.array(n + 1), *(pa.array(s) for s in sums),
                 rest], names=["row", "id", "held_out", "n_tokens", *columns, "rest"])
            row += len(n)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None,
                    hot_words: int = HOT_WORDS, rounds: int = ROUNDS, components: int = COMPONENTS,
                    folds: int = 10) -> DataFrame:
    """One row per document: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Documents of fold 0 are held out of all counts. Null counts as the empty
    text, which is its end token alone. Repeated rows are rows of their own;
    a null id falls into the fold of the empty id; an empty table gives no
    rows; other columns are not read. Without training documents the words
    keep the vocabulary's own weights. Texts and words of any length are
    scored whole.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    held = id_bucket(id_col, folds) == 0
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    centres = document_kinds(rows, components)
    kinds = range(len(centres))
    by_kind = F.array(*[F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)) for k in kinds])
    counts = staged(rows.select("held_out", "text").mapInArrow(_counted(spark.sparkContext.broadcast(centres)), "word binary, kind int, c long")
                    .groupBy("word").agg(F.sum("c").alias("n"), by_kind.alias("by")), "counts")
    c = F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x)
    word = F.col("word") != F.lit(END)

    def number(of):
        return F.sum((word & of).cast("long"))

    s = counts.withColumn("c", c).agg(
        number(F.col("c") > 0).alias("types"), number(F.col("c") == 1).alias("once"), number(F.col("c") == 2).alias("twice"),
        *[F.sum(F.col("by")[k]).alias(f"n{k}") for k in kinds], *[number(F.col("by")[k] > 0).alias(f"v{k}") for k in kinds],
        *[F.max(F.when(~word, F.col("by")[k])).alias(f"e{k}") for k in kinds]).first()
    tokens, types, ends = (np.array([s[f"{x}{k}"] or 0 for k in kinds], float) for x in "nve")
    n, words, once, twice = int(tokens.sum()), s["types"] or 0, s["once"] or 0, s["twice"] or 0
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    pieces, start = lattice_pieces(model_path or DEFAULT_MODEL)
    live = np.flatnonzero(tokens)                              # kinds with a training document
    chosen = live.tolist() or [0]
    log_p = np.repeat(start[:, None], len(chosen), axis=1)
    by = F.array(*[F.col("by")[k] for k in chosen])
    learned = counts.where(word & (c > 0)).select("word", by.alias("by"))
    for _ in range(rounds if words else 0):
        shared = spark.sparkContext.broadcast((pieces, log_p))
        uses = (learned.mapInArrow(_expected(shared), "piece int, kind int, uses double")
                .groupBy("piece", "kind").agg(F.sum("uses").alias("uses")))
        p = np.full(log_p.shape, 0.1)
        for r in uses.toLocalIterator():                       # one row a vocabulary piece and kind at most
            p[r["piece"], r["kind"]] += r["uses"]
        log_p = np.log(p / p.sum(axis=0))

    known = words + int(ends.sum() > 0)
    base = F.log10((F.col("c") + F.lit(0.1)) / F.lit(n + 0.1 * (known + 1)))
    scores = [f"s{i}" for i in range(len(chosen))]
    columns = ["known", "base", *scores]
    totals = (tokens[chosen], types[chosen], words, discount)
    table = staged(counts.where(word).select("word", by.alias("by"), "n")
                   .mapInArrow(_word_scores(spark.sparkContext.broadcast((pieces, log_p)), *totals),
                               "word binary, n long, c long, " + ", ".join(f"{x} float" for x in scores))
                   .select("word", "n", (F.col("c") > 0).cast("int").alias("known"), base.alias("base"), *scores), "words")
    band = F.floor(F.log2("n"))
    bands = {r["band"]: r["words"] for r in table.groupBy(band.alias("band")).agg(F.count("*").alias("words")).collect()}
    least, room = 64, hot_words
    for b in sorted(bands, reverse=True):                      # whole bands of frequency, while they fit
        room -= bands[b]
        if room < 0:
            break
        least = b
    hot = _HotTable(table.where(band >= least).select("word", *columns).toArrow(), columns)
    sums = staged(rows.mapInArrow(_hot_sums(spark.sparkContext.broadcast(hot), columns),
                                  f"row long, id {kind}, held_out boolean, n_tokens long, "
                                  + ", ".join(f"{x} double" for x in columns) + ", rest array<binary>"), "documents")
    rest = (sums.select("row", F.explode("rest").alias("word")).join(table.where(band < least).select("word", *columns), "word")
            .groupBy("row").agg(*[F.sum(x).alias(f"r_{x}") for x in columns]))
    end_base = math.log10((ends.sum() + 0.1) / (n + 0.1 * (known + 1)))
    fixed = [math.log10(ends[k] / ends.sum() * ends[k] / tokens[k]) for k in live] or [end_base]     # share of the kind, and its end

    def total(x):
        return F.col(x) + F.coalesce(F.col(f"r_{x}"), F.lit(0.0))

    each = F.array(*[total(x) + f for x, f in zip(scores, fixed)])
    out = sums.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (total("known") + int(ends.sum() > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (total("base") + end_base).alias("base_score"), each.alias("each"))
    top = F.array_max("each")
    score = top + F.log10(F.aggregate("each", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top)))
    return out.withColumn("score", score).drop("each")
