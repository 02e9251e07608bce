"""Approximate nearest neighbours by learned partitions.

For each node of a tree (the root of a vector length first) a bounded sample
of its vectors gives an exact neighbour graph. The graph is partitioned in
balanced parts: spectral bisection, whose halves are refined by swaps that
lower the cut, down to the asked number of parts. A small network with one
hidden layer learns how a vector's neighbours are spread over the parts. It
then sends every vector of the node to its most probable part, and a query to
the most probable parts that together reach a probability mass. The mass is
measured on sample vectors kept out of the graph: it is the smallest at which
they find ``recall`` of their neighbours. Parts of more than ``leaf`` vectors
are nodes of the next level.

Only the fit uses a sample (``SAMPLE`` vectors a node, by hash of the
vector); every row is indexed, and each probed leaf is compared exactly, in
cells of bounded size. Models, rows and queries of a node meet in tasks by a
shuffle dealt over salts, so no node, leaf or model is gathered in one place.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .whitening import vectors_by_length

SAMPLE = 8192                       # vectors of a node that its model is fitted on
LEAF = 2048
PARTS = 32                          # most parts of a node
NEIGHBOURS = 10
HIDDEN = 128
RECALL = 0.97                       # asked of each level, on vectors kept out of the fit
CELL = 4096
ROWS_A_TASK = 20_000
SEED = 42


# ---------------------------------------------------------------- fit of one node, on its sample

def _nearest(points: np.ndarray, queries: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Row numbers of the k nearest points of each query."""
    size, out = (points * points).sum(axis=1), []
    for at in range(0, len(queries), 512):
        d = size[None, :] - 2 * queries[at:at + 512] @ points.T
        if skip_self:
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.vstack(out)


def _fiedler(a: np.ndarray, b: np.ndarray, n: int, rng) -> np.ndarray:
    """A vector that varies slowly along the edges (a, b), by power iteration on the lazy random walk."""
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    root = np.sqrt(degree)
    trivial = root / np.linalg.norm(root)
    v = rng.normal(size=n)
    for _ in range(80):
        v -= trivial * (trivial @ v)
        v = v + np.bincount(a, weights=v[b] / root[b], minlength=n) / root
        v /= max(np.linalg.norm(v), 1e-300)
    return v / root


def _refined(side: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Swaps equal numbers of nodes between both sides while the cut falls, so the sides keep their sizes."""
    cut = int((side[a] != side[b]).sum())
    for _ in range(rounds):
        gain = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=len(side))
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        while swaps:
            trial = side.copy()
            trial[left[:swaps]], trial[right[:swaps]] = 1, 0
            now = int((trial[a] != trial[b]).sum())
            if now < cut:
                side, cut = trial, now
                break
            swaps //= 2
        if not swaps:
            break
    return side


def balanced_parts(neighbours: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """A part for each node of the neighbour lists; sizes differ by the rounding of the halvings only."""
    n, label = len(neighbours), np.zeros(len(neighbours), np.int64)
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(n), neighbours.shape[1])
    b = neighbours.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    open_parts = [(np.arange(n), 0, parts)]
    while open_parts:
        nodes, first, count = open_parts.pop()
        if count < 2 or len(nodes) < 2:
            label[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[a] >= 0) & (place[b] >= 0)
        x, y = place[a[inside]], place[b[inside]]
        half = count // 2
        order = np.argsort(_fiedler(x, y, len(nodes), rng), kind="stable")
        side = np.ones(len(nodes), np.int64)
        side[order[:round(len(nodes) * half / count)]] = 0
        side = _refined(side, x, y)
        open_parts += [(nodes[side == 0], first, half), (nodes[side == 1], first + half, count - half)]
    return label


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(((x - model["mean"]) / model["spread"]) @ model["w1"] + model["b1"], 0)
    return _softmax(h @ model["w2"] + model["b2"])


def _trained(x: np.ndarray, target: np.ndarray, rng, epochs: int = 40, batch: int = 256) -> dict:
    """The network, by Adam on the cross-entropy with the neighbours' spread over the parts."""
    mean = x.mean(axis=0)
    spread = max(float(np.sqrt(((x - mean) ** 2).mean())), 1e-300)
    z = (x - mean) / spread
    w = [rng.normal(size=(x.shape[1], HIDDEN)) * math.sqrt(2 / x.shape[1]), np.zeros(HIDDEN),
         rng.normal(size=(HIDDEN, target.shape[1])) * math.sqrt(1 / HIDDEN), np.zeros(target.shape[1])]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs)
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at:at + batch]
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            g = (_softmax(h @ w[2] + w[3]) - target[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            step += 1
            for p, d, m, v in zip(w, (z[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)), first, second):
                d = d + 1e-4 * p
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "spread": np.array(spread), "w1": w[0], "b1": w[1], "w2": w[2], "b2": w[3]}


def _probed(p: np.ndarray, mass: float) -> np.ndarray:
    """Which parts a query visits: the most probable ones until their sum reaches ``mass``."""
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
    out = np.empty(p.shape, bool)
    np.put_along_axis(out, order, before < mass, 1)
    return out


def _needed_mass(model: dict, held: np.ndarray, fit: np.ndarray, k: int, recall: float) -> float:
    """The smallest mass at which vectors outside the fit find ``recall`` of their neighbours in the fit."""
    part = _probabilities(model, fit).argmax(axis=1)[_nearest(fit, held, k, False)]
    p = _probabilities(model, held)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.empty(p.shape)
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1), 1)
    reached = np.sort(np.take_along_axis(before, part, 1).ravel())       # a neighbour is met once the mass exceeds this
    return float(reached[min(len(reached) - 1, math.ceil(recall * len(reached)) - 1)]) + 1e-9


def fit_node(x: np.ndarray, parts: int, recall: float = RECALL, seed: int = SEED) -> dict:
    """A node's model from its sample: the network and the mass that a query visits."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    out = min(1024, len(x) // 5)
    held, fit = x[order[:out]], x[order[out:]]
    k = min(NEIGHBOURS, len(fit) - 1)
    near = _nearest(fit, fit, k, True)
    label = balanced_parts(near, parts, seed)
    target = np.zeros((len(fit), parts))
    np.add.at(target, (np.arange(len(fit))[:, None], label[near]), 0.5 / k)
    target[np.arange(len(fit)), label] += 0.5
    model = _trained(fit, target, rng)
    model["mass"] = np.array(_needed_mass(model, held if out else fit, fit, k, recall))
    return model


def _stored(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def _loaded(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _fit_group(recall: float):
    def run(table: pa.Table) -> pa.Table:
        data = sorted(table.column("vec").to_pylist())
        x = np.frombuffer(b"".join(data)).reshape(len(data), -1)
        model = fit_node(x, table.column("parts")[0].as_py(), recall)
        return pa.table({"node": table.column("node").slice(0, 1), "vec": pa.array([_stored(model)], pa.binary())})

    return run


# ---------------------------------------------------------------- distributed index and search

def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows that agree in the first ``keys`` columns."""
    rows = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
    at = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[at]:
            yield rows[at], batch.slice(at, i - at)
            at = i


def _matrix(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data)).reshape(len(data), -1)


def _routed(every: bool, schema: pa.Schema):
    """Over rows sorted by (node, salt, kind), the model first: each vector with its part's node (``every``: with all it visits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = None, None
        for batch in batches:
            for (node, salt, kind), some in _runs(batch, 3):
                if kind == 0:
                    at, model = (node, salt), _loaded(some.column(3)[0].as_py())
                    continue
                assert at == (node, salt), "a model comes before its rows"
                for low in range(0, some.num_rows, 1024):
                    rows = some.slice(low, 1024)
                    p = _probabilities(model, _matrix(rows.column(3)))
                    if every:
                        row, part = np.nonzero(_probed(p, float(model["mass"])))
                    else:
                        row, part = np.arange(len(p)), p.argmax(axis=1)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{node}.{x}" for x in part.tolist()]), rows.column(3).take(take),
                                                      rows.column(4).take(take)], schema=schema)

    return run


def _route(rows: DataFrame, models: DataFrame, every: bool) -> DataFrame:
    """(node, vec, ids) one level down; ``models`` is (node, vec), and all rows are of its nodes."""
    salts = rows.groupBy("node").agg(F.ceil(F.count("*") / ROWS_A_TASK).cast("int").alias("salts"))
    dealt = rows.join(salts, "node").select("node", F.pmod(F.xxhash64("vec"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"),
                                            "vec", "ids")
    lead = models.join(salts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
                                             "vec", F.lit(None).cast("array<long>").alias("ids"))
    schema = pa.schema([("node", pa.string()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])
    return (dealt.unionByName(lead).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind")
            .mapInArrow(_routed(every, schema), "node string, vec binary, ids array<long>"))


def learned_index(classes: DataFrame, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE) -> tuple[DataFrame, list[DataFrame]]:
    """(leaves, models of each level) for distinct vectors (vec, ids): every vector with the leaf it belongs to."""
    rows = staged(classes.select((F.octet_length("vec") / 8).cast("int").cast("string").alias("node"), "vec", "ids"), "root")
    sizes = rows.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > 32)
    leaves, models, top = [], [], True
    while True:
        parts = F.least(F.lit(PARTS), F.greatest(F.lit(4 if top else 2), F.ceil(F.col("rows") / leaf))).cast("int")
        split = staged(sizes.select("node", "rows", parts.alias("parts")), "split")
        if split.isEmpty():
            break
        ready = rows.join(split, "node")
        share = F.lit(float(sample)) / F.col("rows")
        chosen = ready.where(F.xxhash64("vec", F.lit(SEED)) / F.lit(2.0 ** 64) + 0.5 < share).select("node", "parts", "vec")
        models.append(staged(chosen.groupBy("node").applyInArrow(_fit_group(recall), "node string, vec binary"), "models"))
        leaves.append(rows.join(split, "node", "left_anti"))
        known = models[-1].select("node")                                # a node whose sample came out empty stays a leaf
        leaves.append(ready.join(known, "node", "left_anti").select("node", "vec", "ids"))
        rows = staged(_route(ready.join(known, "node").select("node", "vec", "ids"), models[-1], False), "rows")
        parent = F.expr("substring_index(node, '.', size(split(node, '[.]')) - 1)")
        sizes = (rows.groupBy("node").agg(F.count("*").alias("n")).withColumn("parent", parent)
                 .join(split.select(F.col("node").alias("parent"), F.col("rows").alias("of")), "parent")
                 .where((F.col("n") > leaf * 2) & (F.col("n") < 0.9 * F.col("of"))).select("node", F.col("n").alias("rows")))
        top = False
    leaves.append(rows)
    out = leaves[0]
    for part in leaves[1:]:
        out = out.unionByName(part)
    return staged(out, "leaves"), models


def _best_in_cell(k: int, schema: pa.Schema):
    """Over rows sorted by (node, cell, kind), candidates first: each query's k nearest ids of the cell, with all ties of the last vector."""
    def best(x, size, ids, q) -> Iterator[pa.RecordBatch]:
        data = q.to_pylist()
        y = _matrix(q)
        for low in range(0, len(y), 256):
            part = y[low:low + 256]
            near = size[None, :] + (part * part).sum(axis=1)[:, None] - 2 * part @ x.T
            m = min(k, len(x))
            slack = 1e-9 * (size.max() + (part * part).sum(axis=1))
            bound = np.partition(near, m - 1, axis=1)[:, m - 1] + slack
            found: tuple[list, list, list] = ([], [], [])
            for i, row in enumerate(part):
                at = np.flatnonzero(near[i] <= bound[i])
                score = np.sqrt(((x[at] - row) ** 2).sum(axis=1))
                hits = sorted((s, v) for s, c in zip(score.tolist(), at.tolist()) for v in ids[c])[:k]
                found[0].extend([data[low + i]] * len(hits))
                found[1].extend(s for s, _ in hits)
                found[2].extend(v for _, v in hits)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.int64())],
                                             schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vecs, ids, x, size = None, [], [], None, None
        for batch in batches:
            for (node, cell, kind), some in _runs(batch, 3):
                if at != (node, cell):
                    at, vecs, ids, x = (node, cell), [], [], None
                if kind == 0:
                    vecs += some.column(3).to_pylist()
                    ids += some.column(4).to_pylist()
                elif vecs:
                    if x is None:
                        x = np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1)
                        size = (x * x).sum(axis=1)
                    yield from best(x, size, ids, some.column(3))

    return run


def _search(visits: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(vec, score, id): the k best ids of each query vector over the leaves (node, vec) it visits."""
    cells = leaves.groupBy("node").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    inside = leaves.join(cells, "node").select("node", F.pmod(F.xxhash64("vec"), F.col("cells")).cast("int").alias("cell"), F.lit(0).alias("kind"),
                                               "vec", "ids")
    asked = visits.join(cells, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(1).alias("kind"),
                                              "vec", F.lit(None).cast("array<long>").alias("ids"))
    schema = pa.schema([("vec", pa.binary()), ("score", pa.float64()), ("id", pa.int64())])
    found = (inside.unionByName(asked).repartition("node", "cell").sortWithinPartitions("node", "cell", "kind")
             .mapInArrow(_best_in_cell(k, schema), "vec binary, score double, id long"))
    order = Window.partitionBy("vec").orderBy("score", "id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec): the original vector as doubles; unusable ones and zero vectors go."""
    for batch in batches:
        for rows, x in vectors_by_length(batch.column(1)):
            some = np.flatnonzero((x != 0).any(axis=1))
            data = [row.tobytes() for row in x[some] + 0.0]              # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), pa.array(data, pa.binary())], names=["id", "vec"])


def nearest_neighbours(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, leaf: int = LEAF,
                       recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``is_query`` (a Column over ``id``) marks.

    Nearness is the Euclidean distance of the original vectors in double
    precision, ties to the smaller id. Null, empty and zero vectors, vectors
    with null or non-finite components and rows with a null id take no part;
    vectors of different lengths are never compared. A repeated row counts
    once; rows that share the query's id are its own. Equal vectors are one
    indexed vector with its k + 1 smallest ids, which is all that any query
    can return of them, so a family of copies costs no more than one vector. A query
    whose visited leaves hold fewer than k rows is compared with all rows of
    its length, so it returns all candidates where there are fewer than k. An
    empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    units = staged(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull())
                   .mapInArrow(_unit_batches, "id long, vec binary").distinct(), "units")
    of_vector = Window.partitionBy("vec").orderBy("id")
    classes = (units.withColumn("r", F.row_number().over(of_vector)).where(F.col("r") <= k + 1)
               .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))             # k + 1 ids at most
    leaves, models = learned_index(classes, leaf, recall, sample)

    queries = units.where(is_query)
    wanted = staged(queries.select("vec").distinct(), "queries")
    none = F.lit(None).cast("array<long>").alias("ids")
    visits = wanted.select((F.octet_length("vec") / 8).cast("int").cast("string").alias("node"), "vec", none)
    for level in models:
        nodes = level.select("node")
        visits = staged(visits.join(nodes, "node", "left_anti").unionByName(_route(visits.join(nodes, "node"), level, True)), "visits")
    found = staged(_search(visits, leaves, k + 1), "found")

    counts = found.groupBy("vec").agg(F.count("*").alias("n"))
    short = staged(wanted.join(counts, "vec", "left").where(F.coalesce("n", F.lit(0)) <= k).select("vec"), "short")
    if not short.isEmpty():
        length = F.octet_length("vec").alias("length")
        all_nodes = leaves.select("node", length).distinct()
        everywhere = short.withColumn("length", length).join(all_nodes, "length").select("node", "vec", none)
        found = found.join(short, "vec", "left_anti").unionByName(_search(everywhere, leaves, k + 1))
    own = Window.partitionBy("query_id", "vec").orderBy("score", "id")
    return (queries.withColumnRenamed("id", "query_id").join(found, "vec").where(F.col("id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
