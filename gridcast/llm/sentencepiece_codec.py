"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can cross (before a run of spaces),
and the distinct chunks not met before are laid out as one byte text. Its
suffixes are sorted; a binary search finds, for every piece of the
vocabulary, the range of suffixes that begin with it, which is all its
occurrences at once. The occurrences are edges of the chunks' lattices; they
are sorted by position and relaxed to the model's segmentation:

* unigram models: the path of the best total score, position by position;
* BPE models (the vocabulary at hand): rounds over all chunks together, each
  joining in every chunk the two neighbouring segments whose joint edge has
  the best score, leftmost first, until none is left. A best-path relaxation
  would give other ids than the model's own encoder.

Characters without a piece become byte pieces (or the unknown piece).
Decoding joins the pieces' bytes and drops the leading dummy space. A worker
keeps the chunks it has encoded in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, binary_texts
from .vocabulary import DEFAULT_MODEL, SPACE, Piece, Rules, read_pieces, read_rules

SLICE_BYTES = 2 << 20
INDEX_BYTES = 1 << 18                                          # text indexed at once
KEPT_CHUNKS = 250_000
LONG_CHUNK = 96                                                # characters; longer chunks are merged one by one
_NONE = np.int32(-1)
_FAR = np.int32(2**31 - 1)
_CHUNK = re.compile(rb" *[^ ]+| +")


class Codec:
    """Encoder and decoder for one vocabulary; texts and pieces are bytes with a space for the space mark."""

    def __init__(self, pieces: list[Piece], rules: Rules):
        self.rules = rules
        self.bytes_of = [b""] * len(pieces)
        self.byte_ids = np.full(256, _NONE)
        self.unknown = next((i for i, p in enumerate(pieces) if p.text == "<unk>"), 0)
        text_ids = []
        for i, p in enumerate(pieces):
            if p.kind == "byte":
                value = int(p.text[1:-1], 16)
                self.bytes_of[i] = bytes([value])
                self.byte_ids[value] = i
            elif p.kind == "piece":
                self.bytes_of[i] = p.text.replace(SPACE, " ").encode()
                text_ids.append(i)
        text_ids.sort(key=lambda i: self.bytes_of[i])
        self.ids = np.array(text_ids, np.int32)
        self.lengths = np.array([len(self.bytes_of[i]) for i in text_ids], np.int32)
        self.width = int(self.lengths.max())
        padded = f"S{self.width}"
        self.lower = np.array([self.bytes_of[i] for i in text_ids], padded)
        self.upper = np.array([self.bytes_of[i].ljust(self.width, b"\xff") for i in text_ids], padded)
        self.score = np.array([p.score for p in pieces])
        _, self.rank = np.unique(-self.score, return_inverse=True)      # equal scores share a rank
        self.rank = self.rank.astype(np.int32)
        self.crossing = any(b" " in self.bytes_of[i].lstrip(b" ") for i in text_ids)
        self.kept: dict[bytes, bytes] = {}

    # ------------------------------------------------------------------ index and edges
    def edges(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every occurrence of every piece, sorted by start and length."""
        n = len(body)
        padded = np.concatenate([body, np.zeros(self.width + 8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        keys = [np.ascontiguousarray(words[k:k + n]).view(">u8").ravel().astype(np.uint64) for k in range(0, self.width, 8)]
        suffixes = np.lexsort(keys[::-1])
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[suffixes]
        windows = np.ascontiguousarray(windows).view(f"S{self.width}").ravel()
        first = np.searchsorted(windows, self.lower, side="left")
        count = np.searchsorted(windows, self.upper, side="right") - first
        found = np.flatnonzero(count > 0)
        count, first = count[found], first[found]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = suffixes[np.repeat(first, count) + offset]
        length, ids = np.repeat(self.lengths[found], count), np.repeat(self.ids[found], count)
        order = np.argsort(start * (self.width + 1) + length)
        return start[order], length[order], ids[order]

    # ------------------------------------------------------------------ relaxation
    def _joined(self, body: np.ndarray, table: np.ndarray, chunk_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """BPE: (chunk, start, end) of the final segments of all chunks."""
        start = np.flatnonzero(((body & 0xC0) != 0x80) & (chunk_of >= 0))
        if not len(start):                                     # all chunks are relaxed one by one
            return start, start, start
        chunk = chunk_of[start]
        end = np.r_[start[1:], len(body)]
        last = np.r_[chunk[1:] != chunk[:-1], True]
        end[last] = np.flatnonzero(np.r_[chunk_of[1:] != chunk_of[:-1], True] & (chunk_of >= 0))[:last.sum()] + 1
        done = []
        while len(start):
            span = np.zeros(len(start), np.int64)
            span[:-1] = end[1:] - start[:-1]
            pair = np.zeros(len(start), bool)
            pair[:-1] = (chunk[1:] == chunk[:-1]) & (span[:-1] <= self.width)
            at = np.flatnonzero(pair)
            piece = table[start[at], span[at]]
            rank = np.full(len(start), _FAR)
            rank[at] = np.where(piece >= 0, self.rank[piece], _FAR)
            first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            size = np.diff(np.r_[first, len(chunk)])
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == _FAR, size)
            if over.any():
                done.append((chunk[over], start[over], end[over]))
            hit = np.flatnonzero((rank == np.repeat(best, size)) & ~over)
            hit = hit[np.r_[True, chunk[hit][1:] != chunk[hit][:-1]]] if len(hit) else hit
            end[hit] = end[hit + 1]
            keep = ~over
            keep[hit + 1] = False
            chunk, start, end = chunk[keep], start[keep], end[keep]
        parts = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64)] * 3
        order = np.argsort(parts[1], kind="stable")
        return parts[0][order], parts[1][order], parts[2][order]

    def _joined_long(self, text: bytes) -> list[tuple[int, int]]:
        """BPE of one long chunk with a queue of joinable neighbours; edges are looked up piece by piece."""
        places = [i for i, b in enumerate(text) if b & 0xC0 != 0x80] + [len(text)]
        n = len(places) - 1
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self._rank_of()
        queue: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = right[a] if a >= 0 else n
            if a >= 0 and b < n and places[right[b]] - places[a] <= self.width:
                rank = rank_of.get(text[places[a]:places[right[b]]])
                if rank is not None:
                    heapq.heappush(queue, (rank, a, b, right[b]))

        for a in range(n):
            offer(a)
        alive = [True] * n
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if not (alive[a] and alive[b] and right[a] == b and right[b] == c):
                continue
            alive[b] = False
            right[a] = c
            if c < n:
                left[c] = a
            offer(left[a])
            offer(a)
        return [(places[a], places[right[a]]) for a in range(n) if alive[a]]

    @lru_cache(maxsize=1)  # noqa: B019  one codec lives in a worker
    def _rank_of(self) -> dict[bytes, int]:
        return {self.bytes_of[i]: int(self.rank[i]) for i in self.ids}

    def _best_path(self, body: np.ndarray, table: np.ndarray, begin: int, end: int) -> list[tuple[int, int]]:
        """Unigram: segments of the path of best total score; characters without a piece cost more than any piece."""
        penalty = float(self.score[self.ids].min()) - 10.0
        best, back = {begin: 0.0}, {}
        at = begin
        while at < end:
            step = at + 1
            while step < end and body[step] & 0xC0 == 0x80:
                step += 1
            for length in np.flatnonzero(table[at] >= 0).tolist() + [step - at]:
                to, piece = at + length, int(table[at, length]) if length <= self.width else -1
                value = best[at] + (float(self.score[piece]) if piece >= 0 else penalty)
                if to <= end and value > best.get(to, -np.inf):
                    best[to], back[to] = value, at
            at = step
        path = []
        while at > begin:
            path.append((back[at], at))
            at = back[at]
        return path[::-1]

    # ------------------------------------------------------------------ chunks and texts
    def _segment_ids(self, body: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, and how many each segment has: one, or one a byte for a character without a piece."""
        span = end - start
        ids = np.where(span <= self.width, table[start, np.minimum(span, self.width)], _NONE)
        plain = (ids >= 0) | (self.byte_ids[0] < 0)
        ids = np.where((ids < 0) & plain, self.unknown, ids)
        count = np.where(plain, 1, span)
        out = np.repeat(ids, count)
        offset = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
        raw = np.flatnonzero(out < 0)
        out[raw] = self.byte_ids[body[np.repeat(start, count)[raw] + offset[raw]]]
        return out.astype(np.int32), count

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks and keep the result; they are indexed together."""
        body = np.frombuffer(b"\0".join(chunks) + b"\0", np.uint8)
        sizes = np.array([len(c) for c in chunks])
        begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        start, length, ids = self.edges(body)
        table = np.full((len(body), self.width + 1), _NONE)
        table[start, length] = ids
        letters = np.array([sum(b & 0xC0 != 0x80 for b in c) if len(c) > LONG_CHUNK else 0 for c in chunks])
        one_by_one = np.flatnonzero(letters > LONG_CHUNK) if self.rules.kind == "bpe" else np.arange(len(chunks))
        chunk_of = np.full(len(body), -1, np.int64)
        together = np.ones(len(chunks), bool)
        together[one_by_one] = False
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        chunk_of[inside] = np.repeat(np.where(together, np.arange(len(chunks)), -1), sizes)
        owner, a, b = self._joined(body, table, chunk_of)
        flat, count = self._segment_ids(body, table, a, b)
        per = np.bincount(owner, count, minlength=len(chunks)).astype(np.int64)
        ends = np.cumsum(per) * 4
        raw = flat.tobytes()
        for i in np.flatnonzero(together).tolist():
            self.kept[chunks[i]] = raw[ends[i] - per[i] * 4:ends[i]]
        for i in one_by_one.tolist():
            if self.rules.kind == "bpe":
                segments = np.array(self._joined_long(chunks[i])) + begin[i]
            else:
                segments = np.array(self._best_path(body, table, int(begin[i]), int(begin[i] + sizes[i])))
            self.kept[chunks[i]] = self._segment_ids(body, table, segments[:, 0], segments[:, 1])[0].tobytes()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text; an empty text has none."""
        mark = SPACE.encode()
        front = b" " if self.rules.dummy_prefix else b""
        lines = [front + t.replace(mark, b" ") if t else b"" for t in texts]
        split = [([x] if x else []) if self.crossing else _CHUNK.findall(x) for x in lines]
        new = {c for chunks in split for c in chunks} - self.kept.keys()
        if len(self.kept) + len(new) > KEPT_CHUNKS:
            self.kept.clear()
            new = {c for chunks in split for c in chunks}
        some, size = [], 0
        for c in sorted(new):
            some.append(c)
            size += len(c) + 1
            if size > INDEX_BYTES:
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)
        kept = self.kept
        return [np.frombuffer(b"".join([kept[c] for c in chunks]), np.int32) for chunks in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters, control pieces nothing."""
        body = b"".join([self.bytes_of[i] for i in ids.tolist()])
        if self.rules.dummy_prefix and body.startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value)
    return _codecs[key]


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row per input row, its columns and: ids, n_tokens, decoded, normalized.

    ``ids`` are the model's own; ``normalized`` is the text as the model reads
    it (its space mark counts as a space), which ``decoded`` must equal. Null
    and empty texts have no ids and decode to the empty text. Columns of the
    input named like a result give way to it; an empty table gives no rows.
    Repeated rows each get the same result. A text of any length is encoded
    whole; its chunks are indexed some at a time, but one unbroken chunk is
    indexed as a whole, with about 100 bytes of memory a byte.
    """
    path = model_path or DEFAULT_MODEL
    shared = df.sparkSession.sparkContext.broadcast((read_pieces(path), read_rules(path)))
    results = ("ids", "n_tokens", "decoded", "normalized")
    kept = df.drop(*results)
    text_at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, shared)
        for batch in batches:
            for part in batches_of(batch, text_at, SLICE_BYTES):
                texts = binary_texts(part.column(text_at))
                ids = codec.encode(texts)
                ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends)),
                           pa.array([codec.decode(x) for x in ids], pa.string()),
                           pa.array([t.decode().replace(SPACE, " ") for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *results])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, ids array<int>, n_tokens int, decoded string, normalized string")
