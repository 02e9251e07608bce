"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation's rows are edited at the least cost so that the initials of
its roles read ``(s?(ua)+)?``. The search has four states (nothing yet, after
a system, user or assistant row); a step is one row with the inserts before
it, and ends in the row's own edit, so of two different paths over the same
rows neither is the beginning of the other. Ties go to the ASCII-least edits.

Survivors (the best path into each state) share a backpointer tree whose
nodes are counted by their references. A survivor that no path can need is
dropped, unreferenced nodes are freed, and once all survivors descend from
one child of the root, its edits go out and the child becomes the root; only
the unresolved suffixes are held. Tied suffixes are compared whole: the
survivors' order is carried from row to row, because the order of two longer
suffixes is the order of their survivors, or of the two steps where they
share one.

Rows are dealt to tasks by ranges of (conversation, turn, role, text digest),
so a conversation of any size is spread. One that reaches over several blocks
is first summed up block by block: least costs and order of the exits for
each entry state. A fold over these few numbers gives each block's entry and
exit, between which the block is then edited like a conversation of its own.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5         # costs
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTS_USER = (START, SYSTEM, ASSISTANT)
ROWS_A_BATCH = 4096
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}      # inserts that end a conversation from each state
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
#: What leaving state y for state x can cost at most: the best future of y is at most that of x plus this.
DETOUR = {START: {SYSTEM: 0, USER: 5, ASSISTANT: 0}, SYSTEM: {START: 10, USER: 5, ASSISTANT: 10},
          USER: {START: 7, SYSTEM: 5, ASSISTANT: 5}, ASSISTANT: {START: 2, SYSTEM: 0, USER: 5}}


def _emitted(state: int, initial: str) -> int | None:
    """The state after a row of this initial, or None where it may not come."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state in EXPECTS_USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _steps(initial: str | None, truncated: bool) -> list[list[tuple[int, str] | None]]:
    """[entry][exit] -> (cost, edits) of one row with the inserts before it; ``initial`` None: the row must go."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for entry in range(4):
        state = entry
        for inserts in range(4):
            moves = [(state, DELETE, "D")]
            if initial is not None:
                extra = TRUNCATED if truncated else 0
                moves += [(_emitted(state, initial), KEEP + extra, "K"), (USER if state in EXPECTS_USER else ASSISTANT, REROLE + extra, "R")]
            for after, cost, edit in moves:
                if after is not None:
                    choice = (cost + INSERT * inserts, "I" * inserts + edit)
                    table[entry][after] = min(table[entry][after] or choice, choice)
            state = USER if state in EXPECTS_USER else ASSISTANT
    return table


#: Row classes: 0 must go; then system, user, assistant and other initials, each whole or truncated.
STEPS = [_steps(None, False)] + [_steps(i, t) for i in "sua?" for t in (False, True)]


class Survivors:
    """The automaton of the search: costs relative to the least, and the order of the survivors' edits."""

    def __init__(self):
        self.known: dict = {}

    @staticmethod
    def at(entry: int) -> tuple:
        return tuple((0, 0) if s == entry else None for s in range(4))

    def advance(self, state: tuple, kind: int) -> tuple:
        """(next state, cost added to all, for each exit its (entry, edits) or None)."""
        key = (state, kind)
        if key not in self.known:
            self.known[key] = self._advance(state, STEPS[kind])
        return self.known[key]

    @staticmethod
    def _advance(state: tuple, steps) -> tuple:
        best: list = [None] * 4
        for entry, held in enumerate(state):
            if held is not None:
                for after, step in enumerate(steps[entry]):
                    if step is not None:
                        choice = (held[0] + step[0], held[1], step[1], entry)
                        best[after] = min(best[after] or choice, choice)
        live = [x for x in range(4) if best[x] is not None]
        rank = {x: r for r, x in enumerate(sorted(live, key=lambda x: best[x][1:3]))}

        def needless(x):
            return any(best[y][0] + DETOUR[y][x] < best[x][0] or (DETOUR[y][x] == 0 and best[y][0] == best[x][0] and rank[y] < rank[x])
                       for y in live if y != x)

        kept = [x for x in live if not needless(x)]
        least = min(best[x][0] for x in kept)
        order = {x: r for r, x in enumerate(sorted(kept, key=rank.get))}
        after = tuple((best[x][0] - least, order[x]) if x in order else None for x in range(4))
        return after, least, tuple((best[x][3], best[x][2]) if x in order else None for x in range(4))


class BackpointerTree:
    """Paths of the survivors; nodes live while a survivor or a child refers to them."""

    def __init__(self, entry: int):
        self.parent, self.edits, self.refs, self.children, self.free = [-1], [""], [1], [0], []
        self.root, self.tips = 0, [0 if s == entry else None for s in range(4)]

    def _node(self, parent: int, edits: str) -> int:
        if self.free:
            i = self.free.pop()
            self.parent[i], self.edits[i], self.refs[i], self.children[i] = parent, edits, 1, 0
        else:
            i = len(self.parent)
            self.parent.append(parent)
            self.edits.append(edits)
            self.refs.append(1)
            self.children.append(0)
        self.refs[parent] += 1
        self.children[parent] += i                                       # the only child's number, while there is one
        return i

    def _release(self, i: int) -> None:
        self.refs[i] -= 1
        while self.refs[i] == 0 and i != self.root:
            up = self.parent[i]
            self.free.append(i)
            self.refs[up] -= 1
            self.children[up] -= i
            i = up

    def step(self, moves: tuple) -> list[str]:
        """Extends the survivors by a row; gives the edits of the rows that are settled now."""
        before = self.tips
        self.tips = [None if m is None else self._node(before[m[0]], m[1]) for m in moves]
        for i in before:
            if i is not None:
                self._release(i)
        out = []
        while self.refs[self.root] == 1 and self.root not in self.tips:
            child = self.children[self.root]
            out.append(self.edits[child])
            self.free.append(self.root)
            self.root = child
        return out

    def rest(self, state: int) -> list[str]:
        """The edits of the unresolved rows of one survivor."""
        out, i = [], self.tips[state]
        while i != self.root:
            out.append(self.edits[i])
            i = self.parent[i]
        return out[::-1]

    def held(self) -> int:
        return len(self.parent) - len(self.free)


def _ending(costs: list) -> int:
    """The state to end in, from (cost, order) of each state."""
    return min((c[0] + INSERT * len(TAIL[s]), c[1], s) for s, c in enumerate(costs) if c is not None)[2]


# ---------------------------------------------------------------- blocks of rows

def _transfers(schema: pa.Schema):
    """Over (conv, block, seq, kind, copies) in order: each block's least cost and order of the exits, for every entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, at, states, costs = Survivors(), None, [], []

        def row():
            flat = [None if s[x] is None else (c + s[x][0], s[x][1]) for s, c in zip(states, costs) for x in range(4)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], schema.field(0).type), pa.array([at[1]], pa.int32()),
                                               pa.array([[f and f[0] for f in flat]], pa.list_(pa.int64())),
                                               pa.array([[f and f[1] for f in flat]], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            for conv, block, _, kind, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (conv, block) != at:
                    if at is not None:
                        yield row()
                    at, states, costs = (conv, block), [Survivors.at(e) for e in range(4)], [0] * 4
                for k in range(copies):
                    for e in range(4):
                        states[e], more, _ = automaton.advance(states[e], kind if k == 0 else 0)
                        costs[e] += more
        if at is not None:
            yield row()

    return run


def _route_blocks(schema: pa.Schema):
    """For one conversation's blocks (conv, block, costs, orders): the entry and the exit of each on the best path."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        held, origin = {START: (0, 0)}, []
        for r in rows:
            choice = {}
            for entry, (cost, order) in held.items():
                for x in range(4):
                    more = r["costs"][entry * 4 + x]
                    if more is not None:
                        new = (cost + more, order, r["orders"][entry * 4 + x], entry)
                        choice[x] = min(choice.get(x, new), new)
            ranks = {x: i for i, x in enumerate(sorted(choice, key=lambda x: choice[x][1:3]))}
            origin.append({x: c[3] for x, c in choice.items()})
            held = {x: (c[0], ranks[x]) for x, c in choice.items()}
        state = _ending([held.get(x) for x in range(4)])
        entries, exits = [], []
        for back in reversed(origin):
            exits.append(state)
            state = back[state]
            entries.append(state)
        last = [False] * (len(rows) - 1) + [True]
        return pa.Table.from_arrays([pa.array([rows[0]["conv"]] * len(rows), schema.field(0).type), pa.array([r["block"] for r in rows], pa.int32()),
                                     pa.array(entries[::-1], pa.int32()), pa.array(exits[::-1], pa.int32()), pa.array(last)], schema=schema)

    return run


def _edited(schema: pa.Schema):
    """Over (conv, block, seq, kind, copies, turn, role, sha, fault, entry, exit, last) in order: (edits, state before) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, at = Survivors(), None
        state = tree = leave = last = inside = None
        waiting: deque = deque()                                         # [row, copies still unsettled, edits so far]
        settled: list = []                                               # the last one may still get inserts behind it
        done: list = []

        def settle(edits):
            for e in edits:
                head = waiting[0]
                head[2].append(e)
                head[1] -= 1
                if not head[1]:
                    settled.append(waiting.popleft())

        def write(all_of_them):
            nonlocal inside
            stay = 0 if all_of_them else 1
            for r, _, edits in settled[:len(settled) - stay]:
                text = "".join(edits)
                done.append((r[0], r[2], *r[5:9], text, inside))
                inside = _after(inside, text, r[6])
            del settled[:len(settled) - stay]

        def finish():
            end = leave if leave is not None else _ending(state)
            settle(tree.rest(end))
            if last:
                settled[-1][2].append(TAIL[end])
            write(True)

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(12))):
                if r[:2] != at:
                    if tree is not None:
                        finish()
                    at, entry, leave, last = r[:2], *r[9:]
                    state, tree, inside = Survivors.at(entry), BackpointerTree(entry), entry
                waiting.append([r, r[4], []])
                for k in range(r[4]):
                    state, _, moves = automaton.advance(state, r[3] if k == 0 else 0)
                    settle(tree.step(moves))
                if len(settled) > 1:
                    write(False)
                if len(done) >= ROWS_A_BATCH:
                    yield batch_of()
                    done.clear()
        if tree is not None:
            finish()
        if done:
            yield batch_of()

    return run


def _after(state: int, edits: str, role: str) -> int:
    """The state after a row's edits."""
    for e in edits:
        if e == "K":
            state = _emitted(state, role[:1])
        elif e != "D":
            state = USER if state in EXPECTS_USER else ASSISTANT
    return state


def _applied(schema: pa.Schema):
    """Over (conv, turn, role, sha, part, seq, edits, before, fault, text) by key, edits first: one row for each edit, texts where a row stays."""
    def rows(told, text):
        conv, turn, role, _, _, seq, edits, state, fault, _ = told
        first = True
        for n, e in enumerate(edits):
            expected = "user" if state in EXPECTS_USER else "assistant"
            if e == "I":
                yield (conv, seq, n, e, None, None, None, expected, "")
            else:
                why, first = fault if first or fault == BLANK else DUPLICATE, False
                new = None if e == "D" else role if e == "K" else expected
                yield (conv, seq, n, e, turn, role, why, new, None if e == "D" else text)
            state = _after(state, e, role)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, found = None, []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(10))):
                if r[4] == 1:
                    if told is not None and r[:4] == told[:4]:
                        found += rows(told, r[9])
                        told = None
                elif "K" in r[6] or "R" in r[6]:
                    told = r                                             # its text comes next
                else:
                    found += rows(r, None)
                if len(found) >= ROWS_A_BATCH:
                    yield batch_of()
                    found = []
        if found:
            yield batch_of()

    return run


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           blocks: int | None = None) -> DataFrame:
    """One row per edit, to be read in the order (conv, seq, part): (conv, seq, part, edit, turn, role, fault, new_role, new_text).

    ``edit`` is K (keep), R (rerole), D (delete) or I (insert); ``role`` and
    ``fault`` are the row's own (null for an insert; only the first fault of
    blank, duplicate, truncated is named), ``new_role`` and ``new_text`` those
    of the repaired row (null for a deletion). Rows are taken by turn, nulls
    first; rows of one turn by role and then by the SHA-256 of their text, so
    the order never depends on the files. Null roles and texts count as one
    space; a null conversation id is a conversation of its own. Repeated rows
    are counted, not dealt one by one. Texts may have any length: the search
    only sees their digests, and a text moves once, to the row that keeps it.
    An empty table gives no rows; other columns are not read. ``blocks`` sets
    the number of ranges, else Spark's settings do.
    """
    kind = df.schema[conv_col].dataType
    turns = df.schema[turn_col].dataType
    conv_t, turn_t = kind.simpleString(), turns.simpleString()
    space = F.lit(" ")
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), space).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    units = (rows.select("conv", "turn", "role", "sha", blank.alias("blank"), cut.alias("cut"))
             .groupBy("conv", "turn", "role", "sha").agg(F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.count("*").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))
    first = units.groupBy("conv", "role", "sha").agg(F.min(place).alias("first")).select(
        F.col("conv").alias("c"), F.col("role").alias("o"), F.col("sha").alias("s"), "first")
    same = units["conv"].eqNullSafe(first["c"]) & (units["role"] == first["o"]) & (units["sha"] == first["s"])
    again = ~place.eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), CUT)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 1).when(initial == "u", 3).when(initial == "a", 5).otherwise(7) + F.col("cut").cast("int")
    order = ["conv", "turn", "role", "sha"]
    known = (units.join(first, same).select(*order, "copies", fault.alias("fault"),
                                            F.when(F.col("blank") | again, 0).otherwise(number).cast("int").alias("kind")))
    ranged = known.repartitionByRange(blocks, *order) if blocks else known.repartitionByRange(*order)
    ordered = staged(ranged.sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("block"),
                                                                F.monotonically_increasing_id().alias("seq")), "ordered")

    crossing = (ordered.groupBy("conv").agg(F.min("block").alias("low"), F.max("block").alias("high"))
                .where(F.col("low") < F.col("high")).select(F.col("conv").alias("c")))            # fewer than there are blocks
    conv_a = to_arrow_type(kind)
    table = pa.schema([("conv", conv_a), ("block", pa.int32()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64()))])
    sums = (ordered.join(crossing, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select("conv", "block", "seq", "kind", "copies")
            .repartition("conv", "block").sortWithinPartitions("conv", "block", "seq")
            .mapInArrow(_transfers(table), f"conv {conv_t}, block int, costs array<long>, orders array<long>"))
    ends = pa.schema([("conv", conv_a), ("block", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])
    routes = staged(sums.groupBy("conv").applyInArrow(_route_blocks(ends), f"conv {conv_t}, block int, entry int, leave int, last boolean"), "routes")
    r = routes.select(F.col("conv").alias("c"), F.col("block").alias("b"), "entry", "leave", "last")
    edits_schema = pa.schema([("conv", conv_a), ("seq", pa.int64()), ("turn", to_arrow_type(turns)), ("role", pa.string()), ("sha", pa.binary()),
                              ("fault", pa.string()), ("edits", pa.string()), ("before", pa.int32())])
    edits = (ordered.join(r, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
             .select("conv", "block", "seq", "kind", "copies", "turn", "role", "sha", "fault", F.coalesce("entry", F.lit(START)).alias("entry"), "leave",
                     F.coalesce("last", F.lit(True)).alias("last"))
             .repartition("conv", "block").sortWithinPartitions("conv", "block", "seq")
             .mapInArrow(_edited(edits_schema), f"conv {conv_t}, seq long, turn {turn_t}, role string, sha binary, fault string, edits string, before int"))

    told = edits.select(*order, F.lit(0).alias("part"), "seq", "edits", "before", "fault", F.lit(None).cast("string").alias("text"))
    bodies = rows.where(~blank).select(*order, F.lit(1).alias("part"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("edits"),
                                       F.lit(None).cast("int").alias("before"), F.lit(None).cast("string").alias("fault"), "text")
    both = told.unionByName(bodies).repartition(*order).sortWithinPartitions(*order, "part")
    result = pa.schema([("conv", conv_a), ("seq", pa.int64()), ("part", pa.int32()), ("edit", pa.string()), ("turn", to_arrow_type(turns)),
                        ("role", pa.string()), ("fault", pa.string()), ("new_role", pa.string()), ("new_text", pa.string())])
    return both.mapInArrow(
        _applied(result), f"conv {conv_t}, seq long, part int, edit string, turn {turn_t}, role string, fault string, new_role string, new_text string")


# ---------------------------------------------------------------- the registered query

def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows as the contract damages them, by crc32 of ``conv_id:turn``; nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("c"))
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("c") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(F.col("c") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _summaries(schema: pa.Schema):
    """Over the edits in order: the counts, costs, edits and digest of each conversation, in memory that does not grow but for the edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_, found = None, False, []
        count, audit, sha, turns, before, written = {}, [], None, None, None, False

        def row():
            gaps = 0 if turns is None else int(turns[1] - turns[0] + 1 - turns[2])
            return (at, gaps, *(count[c] for c in SUMMARY[1:]), "".join(audit), sha.hexdigest())

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            for conv, edit, turn, role, fault, new_role, new_text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7, 8))):
                if not open_ or conv != at:
                    if open_:
                        found.append(row())
                        if len(found) >= ROWS_A_BATCH:
                            yield batch_of()
                            found = []
                    at, open_ = conv, True
                    count, audit, sha, turns, before, written = dict.fromkeys(SUMMARY, 0), [], hashlib.sha256(), None, None, False
                audit.append(edit)
                count["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == CUT and edit in "KR" else 0)
                if edit != "I":
                    if fault:
                        count[fault] += 1
                    if before is not None and before + role[:1] not in ("su", "ua", "au"):
                        count["illegal"] += 1
                    before = role[:1]
                    if turn is not None:
                        turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
                if new_role is not None:
                    sha.update((("\n" if written else "") + new_role + ":" + new_text).encode("utf-8", "surrogatepass"))
                    written = True
        if open_:
            found.append(row())
        if found:
            yield batch_of()

    return run


def repair_report(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per original conv_id (null included) of (conv_id, turn, role, text): what the damage did and how it is repaired.

    A digest of one conversation's repaired text is taken in its order, so
    this last step streams each conversation through one task, in memory that
    holds its edits only.
    """
    edits = repair(damaged(df), "conv_id", "turn", "role", "text", blocks)
    kind = df.schema["conv_id"].dataType
    names = ", ".join(f"{c} long" for c in SUMMARY)
    schema = pa.schema([("c", to_arrow_type(kind)), *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string()), ("sha", pa.string())])
    told = (edits.repartition("conv").sortWithinPartitions("conv", "seq", "part")
            .mapInArrow(_summaries(schema), f"c {kind.simpleString()}, {names}, audit string, sha string"))
    every = df.select("conv_id").distinct()
    return every.join(told, every["conv_id"].eqNullSafe(told["c"]), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMMARY), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
