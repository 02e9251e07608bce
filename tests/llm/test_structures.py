"""Neighbour search, conversation repair and whitening against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import conversations, neighbours, whitening

VECTORS = "vec_id long, embedding array<float>, label int, node string, n long"


# ---------------------------------------------------------------- vectors

def clouds(n, dims, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def vector_table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", 2)
                                  for i, v in zip(ids, vectors)], VECTORS).repartition(4)


def plain_neighbours(ids, vectors, query_ids, k):
    out = {}
    x = np.array(vectors, np.float64)
    for q in query_ids:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((s, i) for s, i in zip(d.tolist(), ids) if i != q)[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    x = clouds(3000, 24, 1)
    ids = list(range(3000))
    got = neighbours.nearest_neighbours(vector_table(spark, x), F.col("id") % 100 == 0, leaf=400).collect()
    want = plain_neighbours(ids, x, range(0, 3000, 100), 10)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hits = 0
    for q, near in want.items():
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(s, i) for _, s, i in rows] == sorted((s, i) for _, s, i in rows)
        for _, s, i in rows:
            assert s == pytest.approx(float(np.linalg.norm(x[i].astype(float) - x[q].astype(float))), abs=1e-12)
        hits += len({i for _, _, i in rows} & {i for _, i in near})
    assert hits / (len(want) * 10) >= 0.9


def test_neighbours_tree_of_several_levels(spark):
    x = clouds(4000, 16, 2)
    units = spark.createDataFrame([(v.astype(float).tobytes(), [i]) for i, v in enumerate(x)], "vec binary, ids array<long>")
    leaves, models = neighbours.learned_index(units, leaf=20, sample=800)
    assert len(models) >= 2
    assert sorted(i for r in leaves.collect() for i in r["ids"]) == list(range(4000))
    got = neighbours.nearest_neighbours(vector_table(spark, x), F.col("id") % 100 == 0, leaf=20, sample=800).collect()
    want = plain_neighbours(list(range(4000)), x, range(0, 4000, 100), 10)
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for _, i in near}) for q, near in want.items())
    assert hits / (len(want) * 10) >= 0.9


def test_neighbours_copies_ties_and_unusable_rows(spark):
    x = [list(v) for v in clouds(300, 8, 3)]
    x[7] = list(x[0])
    hot = [1.0] * 8
    vectors = x + [hot] * 200 + [None, [0.0] * 8, [None] + [1.0] * 7, [math.nan] * 8, [math.inf] + [0.0] * 7, [], [1.0, 2.0], [1.0, 2.0], x[5], x[1]]
    ids = list(range(500)) + [500, 600, 601, 602, 603, 604, 700, 701, None, 1]
    got = neighbours.nearest_neighbours(vector_table(spark, vectors, ids), F.col("id") % 100 == 0).collect()
    rows = {}
    for r in got:
        rows.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(rows) == {0, 100, 200, 300, 400, 700}
    assert sorted(rows[300]) == [(i + 1, 301 + i, 0.0) for i in range(10)]           # copies: distance 0, smaller ids first
    assert sorted(rows[400]) == [(i + 1, 300 + i, 0.0) for i in range(10)]
    assert sorted(rows[0])[0] == (1, 7, 0.0)
    assert rows[700] == [(1, 701, 0.0)]                                  # all candidates of its length
    assert all(i not in (500, 600, 601, 602, 603, 604, None) for r in rows.values() for _, i, _ in r)
    assert neighbours.nearest_neighbours(vector_table(spark, vectors, ids).limit(0), F.col("id") % 100 == 0).collect() == []
    few = neighbours.nearest_neighbours(vector_table(spark, x[:6]), F.col("id") % 100 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4, 5]


def test_balanced_parts_are_balanced_and_cut_less_than_chance():
    x = clouds(1000, 6, 4, 0.3).astype(float)
    near = neighbours._nearest(x, x, 10, True)
    label = neighbours.balanced_parts(near, 7)
    sizes = np.bincount(label, minlength=7)
    assert sizes.max() - sizes.min() <= 3
    assert (label[near] == label[:, None]).mean() > 0.6                  # chance: 1/7


def plain_whitening(vectors):
    y = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in y.tolist()}), object)
    n, total = len(fit), fit.sum(axis=0)
    centred = (fit * n - total).astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, total))) for r in y]
    z = ((y * n - total).astype(float) / n) @ u[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300))
    return n, deviation, z, e[::-1] / np.trace(v)


@pytest.mark.parametrize("dims,rows", [(40, 900), (64, 500), (5, 60)])
def test_whitening_against_dense_eigenvectors(spark, dims, rows):
    x = clouds(rows, dims, dims)
    x[3] = x[9]
    n, deviation, z, share = plain_whitening(x)
    assert n == rows - 1
    got = whitening.whiten(vector_table(spark, x)).collect()
    k = min(16, dims)
    assert len(got) == rows * k
    sign = {}
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert r["explained"] == pytest.approx(share[c], rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(z[i, c]) > 1e-3:
            s = sign.setdefault(c, math.copysign(1, r["whitened"] * z[i, c]))
            assert r["whitened"] * s == pytest.approx(z[i, c], rel=1e-6, abs=1e-9)


def test_whitening_edge_cases(spark):
    x = [list(v) for v in clouds(40, 6, 6)]
    vectors = x + [x[0], None, [math.nan] * 6, [None] * 6, [], x[1], [1.0, 2.0], [3.0, 5.0], [4.0, 4.0]]
    ids = list(range(40)) + [0, 90, 91, 92, 93, None, 100, 101, 102]
    got = whitening.whiten(vector_table(spark, vectors, ids)).collect()
    assert {r["n"] for r in got if r["vec_id"] is None or r["vec_id"] < 100} == {40}
    assert sum(r["vec_id"] == 0 for r in got) == 12 and sum(r["vec_id"] is None for r in got) == 6
    assert not any(r["vec_id"] in (90, 91, 92, 93) for r in got)
    assert sorted({r["component"] for r in got if r["vec_id"] == 100}) == [1, 2]
    assert whitening.whiten(vector_table(spark, [x[0]] * 5)).collect() == []          # no variance, no component
    assert whitening.whiten(vector_table(spark, x).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                                                         "identity_error"]
    flat = whitening.whiten(vector_table(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1}                         # rank one
    big = whitening.whiten(vector_table(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]])).collect()
    assert {r["vec_id"] for r in big} == {0, 1, 2} and all(math.isfinite(r["whitened"]) for r in big)


# ---------------------------------------------------------------- conversations

WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out += [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Best (cost, edits, repaired rows): every state with whole strings, inserts closed after each row and before the first."""
    def role_after(state):
        return ("user", 2) if state != 2 else ("assistant", 3)

    def close(best):
        todo = list(best)
        while todo:
            s = todo.pop()
            cost, audit, made = best[s]
            role, t = role_after(s)
            new = (cost + 5, audit + "I", made + ((role, ""),))
            if t not in best or new[:2] < best[t][:2]:
                best[t] = new
                todo.append(t)
        return best

    best = close({0: (0, "", ())})
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, cost, audit, made):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, made)

        for s, (cost, audit, made) in best.items():
            offer(s, cost + 2, audit + "D", made)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            keep = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
            if keep:
                offer(keep, cost + extra, audit + "K", made + ((role, text),))
            new, t = role_after(s)
            offer(t, cost + 1 + extra, audit + "R", made + ((new, text),))
        best = close(after)
    return min(best[s] for s in (0, 3) if s in best)


def plain_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        some = [r for r in plain_damage(rows) if r[0] == conv]
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        faults = plain_faults(some)
        cost, audit, made = plain_repair(some, faults)
        turns = {r[1] for r in some if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(some, some[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def talk(rnd, conv, n, shape="mixed"):
    roles = {"mixed": ["system", "user", "assistant", "user", "assistant", "tool", None, ""], "users": ["user"], "pairs": ["user", "assistant"],
             "systems": ["system", "system", "user", "assistant"], "backwards": ["assistant", "user"]}[shape]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "Same.", None, "Long one. " * 9 + "end", "é。", "x.\x85"]
    return [(conv, rnd.choice([i, i, i, i + 1, None if rnd.random() < 0.05 else i]), rnd.choice(roles) if shape != "pairs" else roles[i % 2],
             rnd.choice(texts) if rnd.random() < 0.5 else f"Line {i} of it.") for i in range(n)]


TALKS = "conv_id long, turn long, role string, text string, seq int, sha string, edits string, c long"


def talk_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "e", 5) for r in rows], TALKS).repartition(3)


def reported(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
            for r in df.collect()}


def test_repair_report_against_plain_version(spark):
    rnd = random.Random(5)
    shapes = ["mixed", "users", "pairs", "systems", "backwards"]
    rows = [r for c in range(150) for r in talk(rnd, c, rnd.randint(1, 12), shapes[c % 5])]
    rows += talk(rnd, None, 9) + [rows[10], rows[10], rows[11]]
    assert reported(conversations.repair_report(talk_table(spark, rows))) == plain_report(rows)


@pytest.mark.parametrize("shape", ["users", "mixed", "pairs", "backwards"])
def test_long_conversation_over_many_blocks(spark, shape):
    rnd = random.Random(11)
    rows = talk(rnd, 1, 700, shape) + talk(rnd, 2, 5) + talk(rnd, None, 120, "backwards")
    assert reported(conversations.repair_report(talk_table(spark, rows), blocks=9)) == plain_report(rows)


def test_whole_conversation_lost_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hello."), (5000, None, None, None)]
    out = reported(conversations.repair_report(talk_table(spark, rows)))
    assert out[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == plain_report(rows)
    assert conversations.repair_report(talk_table(spark, rows).limit(0)).collect() == []


def test_repeated_rows_in_bulk_and_long_texts(spark):
    rows = [(1, 3, "user", "Again.")] * 400 + [(1, 4, "assistant", "word " * 40000 + "end."), (1, 5, "user", "!" * 60000)]
    assert reported(conversations.repair_report(talk_table(spark, rows), blocks=3)) == plain_report(rows)


def test_repair_gives_the_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "tool", "Out."), (1, 3, "assistant", "Bye.")]
    got = sorted(conversations.repair(talk_table(spark, rows)).collect(), key=lambda r: (r["seq"], r["part"]))
    assert "".join(r["edit"] for r in got) == plain_repair(rows, [None] * 4)[1]
    assert [(r["new_role"], r["new_text"]) for r in got if r["new_role"]] == list(plain_repair(rows, [None] * 4)[2])


def test_every_edit_sequence_of_short_conversations():
    """The automaton and tree against all sequences of inserts and row edits."""
    def all_ways(kinds):
        best = None
        for ways in itertools.product(*([f"{'I' * k}{e}" for k in range(3) for e in "KRD"] for _ in kinds)):
            for tail in ("", "I", "II"):
                state, cost = 0, 0
                for kind, way in zip(kinds, ways):
                    for e in way:
                        initial, cut = (None, 0) if kind == 0 else ("sua?"[(kind - 1) // 2], (kind - 1) % 2)
                        if e == "D":
                            cost += 2
                        elif e == "I":
                            cost, state = cost + 5, 3 if state == 2 else 2
                        elif initial is None:
                            state = None
                        else:
                            cost += 5 * cut + (e == "R")
                            state = (3 if state == 2 else 2) if e == "R" else {"s": 1 if state == 0 else None, "u": None if state == 2 else 2,
                                                                               "a": 3 if state == 2 else None}.get(initial)
                        if state is None:
                            break
                    if state is None:
                        break
                else:
                    for _ in tail:
                        cost, state = cost + 5, 3 if state == 2 else 2
                    if state in (0, 3):
                        new = (cost, "".join(ways) + tail)
                        best = min(best or new, new)
        return best

    automaton = conversations.Survivors()
    for n in (1, 2, 3):
        for kinds in itertools.product(range(9), repeat=n):
            if n == 3 and hash(kinds) % 4:
                continue
            state, tree, cost, out = automaton.at(0), conversations.BackpointerTree(0), 0, []
            for kind in kinds:
                state, more, moves = automaton.advance(state, kind)
                cost += more
                out += tree.step(moves)
            end = conversations._ending(state)
            edits = "".join(out + tree.rest(end)) + conversations.TAIL[end]
            assert (cost + state[end][0] + 5 * len(conversations.TAIL[end]), edits) == all_ways(kinds)


def test_tree_holds_only_unresolved_rows():
    automaton, tree = conversations.Survivors(), conversations.BackpointerTree(0)
    state, most, settled = automaton.at(0), 0, 0
    for i in range(20000):
        state, _, moves = automaton.advance(state, 3 if i % 2 == 0 else 5)
        settled += len(tree.step(moves))
        most = max(most, tree.held())
    assert most < 40 and settled > 19900
