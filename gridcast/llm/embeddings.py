"""Embedding near-deduplication by sorted projection passes.

Each pass hashes every vector to the signs of ``HASH_BITS`` random
projections and orders the vectors lexicographically by the concatenated
hashes, so vectors at a small angle are often close in the order. Each vector
is compared with its next ``WINDOW`` neighbours; pairs whose cosine reaches
the threshold are united over all passes. Every other pass hashes the vectors
less their mean, which spreads those that lie in one cone.

Passes come in rounds, and how many there are is measured. A neighbour of x
that shares more leading bits with x than the row ``WINDOW`` places from x
does has been compared with x. So the bits that x shares with those two rows
(before and after it) give the probability that a neighbour just at the
threshold was met in the pass, and x leaves after the round in which these
have added up to ``RECALL``. The others go through further rounds, with a new
mean, without a limit; where comparing all of these with each other is less
work than the passes they need, as in a crowded cone, that is done instead.
The first round is taken at every size.

Families larger than a window need no larger window: the passes only have to
connect them. An exact check of each connected group then counts every
direct link, in cells of bounded size, so no pair within a group is missed
and no pair is ever written out. Exact copies are one vector with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

HASH_BITS = 63
WINDOW = 32
RECALL = 0.995
MAX_PASSES = 64                     # in one round
EXACT_ROWS = 4096                   # so many rows that a round has left are compared with each other
EXACT_A_PASS = 500                  # or so many for each pass they still need
EXACT_CELL = 2048
ROWS_A_PART = 20_000
CELL = 512
SEED = 42


def passes_for(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    meet = agree ** max(0.0, math.log2(max(1, rows) / window))
    return 1 if meet >= recall else min(MAX_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, unit vector as doubles, or null where a vector cannot be compared)."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if x is not None and len(x) and np.isfinite(x).all():
                top = np.abs(x).max()
                x = x / top if top else x                                # no overflow or underflow in the norm
                norm = math.sqrt(float(x @ x))
                out.append(((x / norm) + 0.0).tobytes() if norm else None)
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _mean_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, n, sum) of the vectors of a task, a row for each length."""
    sums: dict[int, list] = {}
    for batch in batches:
        vectors = batch.column(0).to_pylist()
        length = np.array([len(v) // 8 for v in vectors], np.int64)
        for dims in np.unique(length).tolist():
            some = _matrix([vectors[i] for i in np.flatnonzero(length == dims)])
            part = sums.setdefault(dims, [0, np.zeros(dims)])
            part[0] += len(some)
            part[1] += some.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()),
                                      pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["dims", "n", "total"])


def _means(active: DataFrame) -> dict[int, np.ndarray]:
    """Mean of the vectors of each length."""
    parts: dict[int, list] = {}
    for r in active.select("vec").mapInArrow(_mean_parts, "dims long, n long, total binary").toLocalIterator():
        part = parts.setdefault(r["dims"], [0, 0.0])
        part[0] += r["n"]
        part[1] = part[1] + np.frombuffer(bytes(r["total"]))
    return {dims: total / n for dims, (n, total) in parts.items()}


def _agreement(cosine):
    """Probability that a random projection gives two vectors the same sign."""
    return 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi


def _projected(passes: int, turn: int, threshold: float, means, schema: pa.Schema):
    """(pass, key, rep, vec, agree) of each vector for each pass; vectors of different lengths never share a pass.

    ``agree`` is the probability of an equal bit for a neighbour just at the
    threshold; around the mean, for one as far from it as the vector itself.
    """
    bit = np.int64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            length = np.array([len(v) // 8 for v in vectors], np.int64)
            for dims in np.unique(length).tolist():
                rows = np.flatnonzero(length == dims)
                if dims not in planes:
                    planes[dims] = np.random.default_rng([SEED, dims, turn]).normal(size=(dims, passes * HASH_BITS))
                mean = means.value[dims]
                lift = (mean @ planes[dims]).reshape(passes, HASH_BITS)
                lift[1::2] = 0                                           # every other pass is around the mean
                for at in range(0, len(rows), 1024):
                    some = rows[at:at + 1024]
                    u = _matrix([vectors[i] for i in some])
                    signs = (u @ planes[dims]).reshape(len(some), passes, HASH_BITS) > lift
                    keys = signs @ bit
                    around = np.maximum(((u - mean) ** 2).sum(axis=1), 1e-12)
                    agree = [_agreement(1 - (1 - threshold) / around), np.full(len(some), _agreement(threshold))]
                    take = batch.take(pa.array(some))
                    for p in range(passes):
                        number = pa.array(np.full(len(some), dims * passes + p, np.int64))
                        yield pa.RecordBatch.from_arrays([number, pa.array(np.ascontiguousarray(keys[:, p])), take.column(0), take.column(1),
                                                          pa.array(agree[p % 2])], schema=schema)

    return run


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return HASH_BITS - np.frexp((a ^ b).astype(np.float64))[1]


def log_misses(number: np.ndarray, key: np.ndarray, agree: np.ndarray, window: int) -> np.ndarray:
    """For each row of a sorted partition: log of the probability that a pass did not compare it with a neighbour at the threshold.

    At the partition's ends, whose seams are compared elsewhere, only what the partition shows counts.
    """
    met = np.zeros(len(number))
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(number)]):
        k, i = key[a:b], np.arange(b - a)
        for far, open_end in ((np.minimum(i + window, b - a - 1), b == len(number)), (np.maximum(i - window, 0), a == 0)):
            bits = _shared_bits(k, k[far]) + 1.0
            if not open_end:
                bits[np.abs(far - i) < window] = 0                       # all on this side were compared
            met[a:b] += 0.5 * np.where(bits > HASH_BITS, 0.0, agree[a:b] ** bits)
    return np.log1p(-np.minimum(met, 1 - 1e-12))


class _Forest:
    """Keeps only links that join two parts not yet joined."""

    def __init__(self):
        self.up: dict = {}

    def joins(self, a, b) -> bool:
        root = []
        for x in (a, b):
            while self.up.get(x, x) != x:
                self.up[x] = self.up.get(self.up[x], self.up[x])
                x = self.up[x]
            root.append(x)
        if root[0] == root[1]:
            return False
        self.up[root[0]] = root[1]
        return True


def _window_links(number: np.ndarray, ids: list, vectors: list[bytes], threshold: float, window: int, forest: _Forest) -> list[tuple]:
    """Linked pairs at most ``window`` apart in the order, within a pass; only those the forest needs."""
    links = []
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(number)]):
        u = _matrix(vectors[a:b])
        for d in range(1, min(window, len(u) - 1) + 1):
            for i in np.flatnonzero(np.einsum("ij,ij->i", u[:-d], u[d:]) >= threshold):
                x, y = ids[a + i], ids[a + i + d]
                if forest.joins(x, y):
                    links.append((x, y))
    return links


def _pass_links(threshold: float, window: int, schema: pa.Schema):
    """Over a sorted partition: links of neighbours, its first and last ``window`` rows for the seams, and each row's log miss."""
    def row(a, b, seam, take=None, miss=None):
        n = len(a)
        empty = pa.nulls(n)
        columns = [pa.array(a), pa.array(b)] if take is None and miss is None else [empty if miss is None else a, empty]
        columns += [pa.array([seam] * n) if seam is not None else empty]
        columns += [take.column(i) for i in range(4)] if take is not None else [empty] * 4
        columns += [empty if miss is None else pa.array(miss)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, forest, head, seen = None, _Forest(), 0, []
        for batch in batches:
            seen.append((batch.column(2), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))))
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                if head < window:
                    take = some.slice(0, window - head)
                    head += take.num_rows
                    yield row([None] * take.num_rows, None, part, take)
                both = some if held is None else pa.Table.from_batches([held, some]).combine_chunks().to_batches()[0]
                links = _window_links(both.column(0).to_numpy(zero_copy_only=False), both.column(2).to_pylist(),
                                      both.column(3).to_pylist(), threshold, window, forest)
                if links:
                    yield row([x for x, _ in links], [y for _, y in links], None)
                held = both.slice(max(0, both.num_rows - window))
        if held is not None:
            yield row([None] * held.num_rows, None, part + 1, held)
            miss, at = log_misses(*(np.concatenate([s[i] for s in seen]) for i in (1, 2, 3)), window), 0
            for ids, *_ in seen:
                yield row(ids, None, None, miss=miss[at:at + len(ids)])
                at += len(ids)

    return run


def _seam_links(threshold: float, window: int, schema: pa.Schema):
    """Links across the seam of two partitions, from their last and first rows (sorted by seam, pass and key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest = None, _Forest()
        for batch in batches:
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            seam = both.column(0).to_numpy(zero_copy_only=False)
            number = both.column(1).to_numpy(zero_copy_only=False)
            links = _window_links(seam * (1 << 40) + number, both.column(2).to_pylist(), both.column(3).to_pylist(),
                                  threshold, window, forest)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links]).cast(schema.field(0).type),
                                                  pa.array([y for _, y in links]).cast(schema.field(1).type)], schema=schema)
            held = both.slice(max(0, both.num_rows - window))

    return run


def _round_links(active: DataFrame, passes: int, turn: int, threshold: float, window: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that ``passes`` passes over (rep, vec) find, and (rep, miss): the log miss of each vector, summed over the passes."""
    spark = active.sparkSession
    kind = active.schema["rep"].dataType
    name = kind.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    ident = to_arrow_type(kind)
    rows = [("pass", pa.int64()), ("key", pa.int64()), ("rep", ident), ("vec", pa.binary())]
    spread = pa.schema([*rows, ("agree", pa.float64())])
    met = pa.schema([("a", ident), ("b", ident), ("seam", pa.int64()), *rows, ("miss", pa.float64())])
    rows_sql = f"pass long, key long, rep {name}, vec binary"
    parts = max(1, min(active.count() * passes // ROWS_A_PART, 20_000), int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    order = ["pass", "key", "rep"]
    means = spark.sparkContext.broadcast(_means(active))
    ordered = (active.select("rep", "vec").mapInArrow(_projected(passes, turn, threshold, means, spread), f"{rows_sql}, agree double")
               .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    found = staged(ordered.mapInArrow(_pass_links(threshold, window, met), f"a {name}, b {name}, seam long, {rows_sql}, miss double"), "passes")
    seams = (found.where("seam is not null").select("seam", "pass", "rep", "vec", "key")
             .repartition("seam").sortWithinPartitions("seam", *order))
    pairs = pa.schema([("a", ident), ("b", ident)])
    across = seams.mapInArrow(_seam_links(threshold, window, pairs), f"a {name}, b {name}")
    links = found.where("seam is null and miss is null").select("a", "b").unionByName(across)
    return links, found.where("miss is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("miss").alias("miss"))


def _cell_links(threshold: float, schema: pa.Schema):
    """Over rows sorted by cell: the links of the cell's two blocks that connect what all of them connect."""
    def links(cell: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, ids = cell.column(3).to_numpy(zero_copy_only=False), cell.column(4).to_pylist()
        left = np.flatnonzero(block == cell.column(1)[0].as_py())
        right = np.flatnonzero(block == cell.column(2)[0].as_py())
        u, forest = _matrix(cell.column(5).to_pylist()), _Forest()
        for at in range(0, len(left), 512):
            x, y = np.nonzero(u[left[at:at + 512]] @ u[right].T >= threshold)
            found = [(ids[a], ids[b]) for a, b in zip(left[at + x], right[y]) if a != b and forest.joins(ids[a], ids[b])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]).cast(schema.field(0).type),
                                                  pa.array([b for _, b in found]).cast(schema.field(1).type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in _runs(batch):
                if held and _cell(held[-1]) != _cell(part):
                    yield from links(_joined(held))
                    held = []
                held.append(part)
        if held:
            yield from links(_joined(held))

    return run


def _all_links(active: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Links (a, b) from comparing all vectors of one length with each other, in cells of two blocks."""
    kind = active.schema["rep"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = -(-rows // EXACT_CELL)
    cells = (active.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(F.octet_length("vec").alias("length"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "block", "rep", "vec"))
    schema = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind))])
    return (cells.repartition("length", "low", "high").sortWithinPartitions("length", "low", "high")
            .mapInArrow(_cell_links(threshold, schema), f"a {kind.simpleString()}, b {kind.simpleString()}"))


def projection_links(classes: DataFrame, threshold: float, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """Verified links (a, b) between the vectors of (rep, vec) that connect the groups found by all rounds."""
    active = classes.select("rep", "vec", F.lit(0.0).alias("missed"))
    rows, turn, found = active.count(), 0, []
    passes = need = passes_for(rows, threshold, window, recall)
    while rows > 1 and (turn == 0 or rows > max(EXACT_ROWS, EXACT_A_PASS * need)):        # a round of passes at every size
        links, misses = _round_links(active, passes, turn, threshold, window)
        found.append(links)
        left = active.join(misses, "rep").withColumn("missed", F.col("missed") + F.col("miss"))
        active = staged(left.where(F.col("missed") > math.log(1 - recall)), "active")
        more = (F.col("missed") - math.log(1 - recall)) / F.greatest(-F.col("miss") / passes, F.lit(1e-6))
        rows, need = active.agg(F.count("*"), F.percentile_approx(more, 0.75, 1000)).first()
        need = math.ceil(need or 0)
        passes, turn = max(1, min(MAX_PASSES, need)), turn + 1
        active = active.drop("miss")
    if rows > 1:
        found.append(_all_links(active, rows, threshold))
    if not found:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    out = found[0]
    for links in found[1:]:
        out = out.unionByName(links)
    return out


def _cell_counts(threshold: float, schema: pa.Schema):
    """Over rows sorted by cell: for each vector of a cell, its links (with copies) to the other vectors of the cell's two blocks."""
    def counts(cell: pa.RecordBatch) -> pa.RecordBatch:
        block = cell.column(3).to_numpy(zero_copy_only=False)
        same = bool((cell.column(1).to_numpy(zero_copy_only=False) == cell.column(2).to_numpy(zero_copy_only=False)).all())
        u, m = _matrix(cell.column(6).to_pylist()), cell.column(5).to_numpy(zero_copy_only=False)
        n = np.zeros(len(u), np.int64)
        for at in range(0, len(u), 1024):
            linked = u[at:at + 1024] @ u.T >= threshold
            if same:
                linked[np.arange(len(linked)), at + np.arange(len(linked))] = False
            else:
                linked &= block[at:at + 1024, None] != block[None, :]
            n[at:at + 1024] = linked @ m
        return pa.RecordBatch.from_arrays([cell.column(4), pa.array(n)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in _runs(batch):
                if held and _cell(held[-1]) != _cell(part):
                    yield counts(_joined(held))
                    held = []
                held.append(part)
        if held:
            yield counts(_joined(held))

    return run


def _cell(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(i)[0].as_py() for i in range(3))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    keys = [batch.column(i).to_pylist() for i in range(3)]
    rows = list(zip(*keys))
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[at]:
            yield batch.slice(at, i - at)
            at = i


def direct_links(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): for each vector of (component, rep, m, vec), the copies of the other vectors of its component linked to it.

    A component of g vectors is cut into about g / CELL blocks; each pair of
    blocks is one cell, compared by one task.
    """
    kind = members.schema["rep"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = (members.join(sizes, "component").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "block", "rep", "m", "vec"))
    schema = pa.schema([("rep", to_arrow_type(kind)), ("n", pa.int64())])
    counted = (cells.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
               .mapInArrow(_cell_counts(threshold, schema), f"rep {kind.simpleString()}, n long"))
    return counted.groupBy("rep").agg(F.sum("n").alias("n"))


def embedding_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                     window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept).

    Links join vectors whose cosine in double precision is ``threshold`` or
    more. Null, empty and zero vectors, vectors with null or non-finite
    components and rows with a null id link with nothing; vectors of
    different lengths are never linked. Rows repeating a vector are copies,
    linked with each other. An empty table gives no rows; other columns are
    not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    units = staged(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
                   .mapInArrow(_unit_batches, f"id {kind}, vec binary"), "units")
    usable = F.col("vec").isNotNull() & F.col("id").isNotNull()
    classes = staged(units.where(usable).groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    nodes = staged(connected_components(projection_links(classes, threshold, window, recall), "a", "b"), "components")
    members = classes.join(nodes, classes["rep"] == nodes["node"]).select("component", "rep", "m", "vec")
    linked = nodes.join(direct_links(members, threshold), nodes["node"] == F.col("rep"), "left").select("node", "component", "n")
    known = staged(classes.join(linked, classes["rep"] == linked["node"], "left").select(
        "vec", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "known")
    one = units.where(usable).join(known, "vec").select("id", "n_links", "component_id")
    rest = units.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return one.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id",
                                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
