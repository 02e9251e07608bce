"""Sharding by histogram sort. DataFrame functions only.

Rows are ordered by (hash of the text, hash of text and id); a shard is a range of
that order. Where rows repeat in both, a number dealt to each row joins the second key,
and is written with it, so that any number of such rows can be divided. The boundaries between shards are found without sorting: each
round counts the exact bytes below candidate boundaries, ``DIGIT_BITS`` more
bits of the key at a time and only inside the candidates' intervals that
still straddle a boundary, until every boundary meets the tolerance. Then the
rows move once, to (shard, cell), where they also get their slot.

Equal texts share their first key, so they stay in one shard unless keeping
them together would miss the group tolerance; only such a hot text is divided,
by the second key. A round returns at most ``(shards - 1) * 2**DIGIT_BITS``
sums to the driver, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

KEY_BITS = 63
DIGIT_BITS = 12
TOLERANCE = 0.001
GROUP_TOLERANCE = 0.05
ROWS_A_CELL = 8192


def _keyed(df: DataFrame, id_col: str, text_col: str, *dealt: Column) -> DataFrame:
    text = text_or_empty(text_col)
    k1 = F.xxhash64(text)
    return df.select(F.struct("*").alias("row"), F.shiftrightunsigned(k1, 1).alias("k1"),
                     F.shiftrightunsigned(F.xxhash64(k1, F.col(id_col), *dealt), 1).alias("k2"),
                     (F.octet_length(text) + 1).cast("long").alias("size"))


def _digits(keys: DataFrame, col: str, within: dict[int, int], shift: int, bits: int) -> dict[int, list[tuple[int, int]]]:
    """Bytes per next digit of ``col``, for the prefixes in ``within`` (prefix -> shift of the prefix)."""
    prefix = F.shiftright(col, shift + bits) if shift + bits < KEY_BITS else F.lit(0).cast("long")
    rows = (keys.select(prefix.alias("p"), F.shiftright(col, shift).bitwiseAND((1 << bits) - 1).alias("d"), "size")
            .where(F.col("p").isin(list(within))).groupBy("p", "d").agg(F.sum("size").alias("b")).collect())
    out: dict[int, list[tuple[int, int]]] = {p: [] for p in within}
    for r in rows:
        out[r["p"]].append((r["d"], r["b"]))
    return {p: sorted(v) for p, v in out.items()}


def _search(keys: DataFrame, col: str, wanted: dict[int, tuple[int, int]], tolerance: float) -> dict[int, tuple[int, int, int, bool]]:
    """For each wanted boundary j -> (bytes to find, bytes below this key range): the key it falls on.

    Returns j -> (key, bytes below it, bytes of that key, close): with
    ``close`` the boundary lies just before ``key`` and meets the tolerance;
    otherwise it falls inside the rows of ``key``.
    """
    state = {j: (0, below) for j, (_, below) in wanted.items()}          # prefix, bytes below it
    found: dict[int, tuple[int, int, int, bool]] = {}
    shift = KEY_BITS
    while state:
        bits = min(DIGIT_BITS, shift)
        shift -= bits
        table = _digits(keys, col, {p: shift for p, _ in state.values()}, shift, bits)
        for j, (prefix, below) in list(state.items()):
            goal = wanted[j][0]
            at, size, last = below, 0, 0
            for last, size in table[prefix]:
                if at + size > goal:
                    break
                at += size
            else:                                                        # everything here lies below the goal
                at, size = at - size, size
            key = (prefix << bits) | last
            if goal - at <= tolerance or at + size - goal <= tolerance:
                up = at + size - goal < goal - at
                found[j] = ((key + up) << shift, at + size * up, 0, True)
            elif shift == 0:
                found[j] = (key, at, size, False)
            else:
                state[j] = (key, at)
                continue
            del state[j]
    return found


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE,
              group_tolerance: float = GROUP_TOLERANCE) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries (k1, k2): a row is right of one if its key pair is not below it."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    ideal = total / shards
    goals = {j: (round(j * ideal), 0) for j in range(1, shards)}
    first = _search(keys, "k1", goals, tolerance * ideal)
    out = {}
    for j, (key, below, size, close) in first.items():
        goal = goals[j][0]
        if close:
            out[j] = (key, 0)
        elif min(goal - below, below + size - goal) <= group_tolerance * ideal:
            out[j] = (key + 1, 0) if below + size - goal < goal - below else (key, 0)
    for key in {first[j][0] for j in first if j not in out}:             # hot texts, cut by the second key
        inner = {j: (goals[j][0], first[j][1]) for j in first if j not in out and first[j][0] == key}
        cuts = _search(keys.where(F.col("k1") == key), "k2", inner, tolerance * ideal)
        for j, (k2, below, size, _) in cuts.items():
            up = size and below + size - goals[j][0] < goals[j][0] - below
            out[j] = (key, k2 + 1 if up else k2)
    return [out[j] for j in sorted(out)]


def _shard(cuts: list[tuple[int, int]]) -> Column:
    right = F.lit(0)
    for a, b in cuts:
        right = right + ((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int")
    return right.cast("int")


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> DataFrame:
    """(row, shard, slot, size): every row of ``df`` whole, as a struct, with its shard and its place in it.

    Shards hold nearly equal bytes (UTF-8 text plus one a row; null counts as
    empty). Slots are gapless from 0 in each shard, in order of the id's
    hash, so a cell of a shard is numbered by one task and only the counts of
    cells are summed up. An empty table gives no rows; a null id is an id of
    its own; rows repeating an id and text, in any number, get one slot each
    and may lie in several shards. A text of any length is one row.
    """
    keyed = _keyed(df, id_col, text_col)
    keys = staged(keyed.select("k1", "k2", "size"), "keys")
    if not keys.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        keyed = staged(_keyed(df, id_col, text_col, F.monotonically_increasing_id()), "rows")
        keys = keyed.select("k1", "k2", "size")
    cuts = splitters(keys, shards, tolerance, group_tolerance)
    bits = max(0, (max(1, keys.count() // ROWS_A_CELL)).bit_length() - 1)
    cell = F.shiftright("k2", KEY_BITS - bits) if bits else F.lit(0).cast("long")
    placed = keyed.withColumn("shard", _shard(cuts)).withColumn("cell", cell)
    counts = keys.groupBy(_shard(cuts).alias("shard"), cell.alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k2", "k1"))
    return (placed.withColumn("n", number).join(starts, ["shard", "cell"])
            .select("row", "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), "size"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The shards as Parquet folders ``shard=0`` ..., each row whole with its slot."""
    sharded.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)
