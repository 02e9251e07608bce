"""SimHash near-deduplication with Golay-code keys.

Fingerprints are 64-bit SimHashes of word shingles. Two link when at most
three bits differ. Candidates come from the perfect binary Golay code
[23, 12]: every 23-bit word lies within three bits of exactly one codeword,
and the codewords that a word and its 23 one-bit neighbours decode to are few
(one or six). Words that differ in at most one bit (two, in fact) share at
least one of these codeword indices.

Pigeonhole: the fingerprint is cut into four blocks of 16 bits, and for each
block the other 48 bits give two 23-bit words (two bits are left out). With
three differing bits or fewer, at least one block is equal, and of its two
words at least one differs in at most one bit. So the keys (block, word, block
value, codeword index), at most 48 a fingerprint and 28 bits each, bring every
linked pair together at least once, and each pair met is verified bit by bit.

Only distinct fingerprints are joined. Fingerprints that share a key are met
in sorted runs: short runs pair by pair, longer ones as a spanning forest, so
output never grows with the square of a family, and runs beyond ``BLOCK``
fingerprints are dealt out as pairs of blocks to other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, binary_texts, staged
from .components import connected_components

SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
SHORT_RUN = 8
BLOCK = 2048
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``k`` words of the lower-cased text (fewer words: of all of them; none: empty)."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is 1 if more than half its shingle hashes have it; no words: 0.

    Bits are counted in byte lanes: of each hash, every eighth bit is added
    to one of eight one-byte counters, at most 255 hashes at a time.
    """
    out = np.zeros(len(texts), np.uint64)
    per = [np.array(shingle_hashes(t, k), np.uint64) for t in texts]
    n = np.array([len(p) for p in per], np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    hashes = np.concatenate([per[i] for i in full])
    size = n[full]
    chunks = -(-size // 255)
    owner = np.repeat(np.arange(len(full)), chunks)
    first = np.cumsum(chunks) - chunks
    begin = np.repeat(np.cumsum(size) - size, chunks) + 255 * (np.arange(len(owner)) - first[owner])
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        major = (2 * counts > size[:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= major[:, byte] << np.uint64(8 * byte + bit)
    return out


def _fingerprint_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, 1):
                fp = fingerprints(binary_texts(part.column(1)), k).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["id", "fp"])

    return run


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """Codeword index (12 bits) of the codeword nearest to each 23-bit word."""
    generator = 0b110001110101                       # FIXED: a generator polynomial of the [23, 12, 7] Golay code
    index = np.arange(1 << 12, dtype=np.uint32)
    codeword = np.zeros_like(index)
    for i in range(12):
        codeword ^= ((index >> np.uint32(i)) & np.uint32(1)) * np.uint32(generator << i)
    table = np.empty(1 << 23, np.uint16)
    for weight in range(4):
        for places in combinations(range(23), weight):
            table[codeword ^ np.uint32(sum(1 << p for p in places))] = index
    return table


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices that each 23-bit word and its one-bit neighbours decode to."""
    flips = np.r_[np.uint32(0), np.uint32(1) << np.arange(23, dtype=np.uint32)]
    near = np.sort(golay_table()[words[:, None] ^ flips[None, :]], axis=1)
    new = np.c_[np.ones(len(words), bool), near[:, 1:] != near[:, :-1]]
    row, at = np.nonzero(new)
    return row, near[row, at]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): all keys of each fingerprint."""
    keys, rows = [], []
    mask = np.uint64((1 << 23) - 1)
    for block in range(4):
        at = np.uint64(16 * block)
        value = (fp >> at) & np.uint64(0xFFFF)
        low = fp & ((np.uint64(1) << at) - np.uint64(1))
        high = (fp >> (at + np.uint64(16))) if block < 3 else np.zeros_like(fp)
        rest = low | (high << at)
        for half in range(2):
            row, index = golay_indices(((rest >> np.uint64(23 * half)) & mask).astype(np.uint32))
            family = np.uint64(2 * block + half) << np.uint64(28)
            keys.append(family | (value[row] << np.uint64(12)) | index.astype(np.uint64))
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 4096):
            fp = fps[at:at + 4096]
            key, row = keys_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["key", "fp"])


def spanning_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: same groups, fewest links."""
    n = len(fp)
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at:at + 256] = np.bitwise_count(fp[at:at + 256, None] ^ fp[None, :]) <= distance
    left, right = [], []
    open_ = np.ones(n, bool)
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        stack = [root]
        while stack:
            v = stack.pop()
            new = np.flatnonzero(near[v] & open_)
            open_[new] = False
            left += [v] * len(new)
            right += new.tolist()
            stack += new.tolist()
    return fp[left], fp[right]


_LINK_SCHEMA = "a long, b long, left binary, right binary"


def _link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none],
                                      names=["a", "b", "left", "right"])


def _run_links(key: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys (sorted); block pairs of runs that are too long for one task."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[starts, len(key)])
    short = np.repeat((length > 1) & (length <= SHORT_RUN), length)
    for d in range(1, SHORT_RUN):
        at = np.flatnonzero(short[:-d] & (key[d:] == key[:-d])) if len(key) > d else np.zeros(0, int)
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        yield _link_rows(fp[at], fp[at + d])
    for i in np.flatnonzero(length > SHORT_RUN):
        run = np.unique(fp[starts[i]:starts[i] + length[i]])
        if len(run) <= BLOCK:
            yield _link_rows(*spanning_links(run, distance))
            continue
        blocks = [run[j:j + BLOCK].tobytes() for j in range(0, len(run), BLOCK)]
        for j, left in enumerate(blocks):
            for right in blocks[j:]:
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([left], pa.binary()),
                                       pa.array([right], pa.binary())], names=["a", "b", "left", "right"])


def _linked(distance: int):
    """Over rows sorted by key: a run may go on over batches, so the last one is held back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (held and held[0][0][0] != key[-1]):
                parts = held + [(key[:cut], fp[:cut])]
                yield from _run_links(*(np.concatenate(x) for x in zip(*parts)), distance)
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield from _run_links(*(np.concatenate(x) for x in zip(*held)), distance)

    return run


def _block_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both = np.unique(np.r_[np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)])
                yield _link_rows(*spanning_links(both, distance))

    return run


def fingerprint_links(fps: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that span all groups at the distance."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError("the keys cover distances from 0 to 3")
    keys = fps.select("fp").mapInArrow(_key_batches, "key long, fp long")
    met = staged(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(distance), _LINK_SCHEMA), "links")
    blocks = met.where("left is not null").select("left", "right")
    more = blocks.repartition(F.xxhash64("left", "right")).mapInArrow(_block_links(distance), _LINK_SCHEMA)
    return met.where("left is null").select("a", "b").unionByName(more.select("a", "b")).distinct()


def _components(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, root, component_id): for each fingerprint its component, named by a fingerprint, and that component's smallest id.

    Fingerprints are the nodes, so neither null nor repeated ids change what is linked.
    """
    reps = staged(fps.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    nodes = connected_components(fingerprint_links(reps, distance), "a", "b")
    placed = staged(reps.join(nodes, reps["fp"] == nodes["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "placed")
    low = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return placed.select("fp", "root").join(low, "root")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: (id_col, fingerprint as 16 hex digits, component_id).

    ``component_id`` is the smallest id reachable over links of ``distance``
    differing bits or fewer. Null and wordless texts have fingerprint zero,
    which links like any other. Rows that repeat an id stay rows of their
    own, each with the component of its text; a group of null ids only has a
    null component, but links its neighbours like any other. Texts of any
    length count with all their shingles. An empty table gives no rows; other
    columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fps = staged(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                 .mapInArrow(_fingerprint_batches(shingle), f"id {kind}, fp long"), "fingerprints")
    return fps.join(_components(fps, distance), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                                             "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group, with the columns of ``df``: the one with the smallest id, a null id only where there is no other.

    Rows are told apart by a number that is written with them, so a repeated
    id loses no text of another group, and of repeated rows one stays.
    """
    rows = staged(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    fps = staged(rows.select(F.struct("number", F.col(f"row.{id_col}").alias("id")).alias("own"), F.col(f"row.{text_col}").cast("string").alias("text"))
                 .mapInArrow(_fingerprint_batches(shingle), f"id struct<number: long, id: {df.schema[id_col].dataType.simpleString()}>, fp long")
                 .select("id.number", "id.id", "fp"), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number"))
    kept = fps.join(_components(fps, distance), "fp").groupBy("root").agg(best.alias("best")).select(F.col("best.number").alias("number"))
    gone = fps.select("number").join(kept, "number", "left_anti")
    return rows.join(gone, "number", "left_anti").select("row.*")
