"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every source gets a target number of words; each of its documents is then
wanted ``target / source_size`` times. The whole part is certain; the
fraction is rounded by the weighted pivotal method: two fractional documents
meet, words move at random from one to the other, in odds that keep each
one's expectation, until one of them is at none or at a full copy. The other
carries on. The total number of words is kept exactly by every such meeting.

The meetings form a reduction tree: documents of a source meet in groups of
about ``FAN``, each group hands one undecided document to the next level, and
so on until one is left for the source; only that one is drawn alone. So no
task ever holds more than a group, however large the source is, and a
source's total misses its target by less than one document. Groups fold from
the largest document to the smallest, which leaves a small one over.

All draws are hashes of the seed and ids, so reruns agree at any
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged, text_or_empty

FAN = 64
MAX_COPIES = 3
SOURCE_WEIGHTS = (1, 2, 3)
SEED = 42


def word_count(text_col: str) -> Column:
    """Number of words of the text (null: 0): each word becomes one dot, white space goes."""
    dots = F.regexp_replace(text_or_empty(text_col), WORD_PATTERN, ".")
    return F.length(F.regexp_replace(dots, r"[\x20\x09-\x0D]+", "")).cast("long")


def _source_key(source_col: str) -> Column:
    """Orders sources by code point, null last, and joins nulls."""
    s = F.col(source_col).cast("string")
    return F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s))


def source_targets(sizes: DataFrame, key: str = "k", size: str = "size",
                   weights: tuple = SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, source_size, target) per source: shares by weight, capped at ``max_copies`` times the source.

    The excess of capped sources goes to the others by weight until none is
    above its cap. In order of cap / weight the capped sources come first, so
    one running sum finds them. The table has one row a source.
    """
    per = sizes.groupBy(key).agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(key)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    order = Window.orderBy(F.col("cap") / F.col("w"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct("place", "level"))
    per = per.withColumn("share", F.min(free).over(Window.partitionBy()))
    target = F.when(F.col("place") < F.col("share.place"), F.col("cap")).otherwise(F.col("share.level") * F.col("w"))
    return per.select(key, "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _draw(*cols: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) / F.lit(float(1 << 53))


def _fold(items: Column, kind: str) -> Column:
    """Let the documents of a group meet in order; returns struct(rest, done)."""
    def step(acc, e):
        r = acc["rest"]
        room_e, room_r = e["u"] - e["mass"], r["u"] - r["mass"]
        to_e, to_r = F.least(r["mass"], room_e), F.least(e["mass"], room_r)
        gives = _draw(r["id"], e["id"]) * (to_e + to_r) < to_r
        r_down, e_up = gives & (r["mass"] <= room_e), gives & (r["mass"] > room_e)
        e_down = ~gives & (e["mass"] <= room_r)

        def unit(x, mass):
            return F.struct(x["u"].alias("u"), x["id"].alias("id"), x["size"].alias("size"), mass.alias("mass"))

        rest = (F.when(r_down, unit(e, e["mass"] + to_e)).when(e_up, unit(r, r["mass"] - to_e))
                .when(e_down, unit(r, r["mass"] + to_r)).otherwise(unit(e, e["mass"] - to_r)))
        settled = F.when(r_down | (~gives & ~e_down), r).otherwise(e)
        up = e_up | (~gives & ~e_down)
        done = F.struct(settled["id"].alias("id"), settled["size"].alias("size"), up.alias("up"))
        return F.struct(rest.alias("rest"), F.concat(acc["done"], F.array(done)).alias("done"))

    first = F.struct(items[0].alias("rest"), F.expr(f"cast(array() as array<{kind}>)").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)


def _rounded_up(units: DataFrame) -> DataFrame:
    """(k, id, size, up) for each unit (k, id, size, u, mass) with a fractional mass."""
    id_type = dict(units.dtypes)["id"]
    counts = units.groupBy("k").agg(F.count("*").alias("n"))
    level = units.join(counts, "k").withColumn("g", F.pmod(F.xxhash64("id", "size"), F.ceil(F.col("n") / FAN))).drop("n")
    groups = counts.agg(F.max(F.ceil(F.col("n") / FAN))).first()[0] or 0
    settled = []
    while groups:
        items = F.array_sort(F.collect_list(F.struct(
            (-F.col("u")).alias("o"), F.xxhash64("id", "size").alias("h"), "u", "id", "size", "mass")))
        plain = F.transform(items, lambda x: F.struct(*[x[c].alias(c) for c in ("u", "id", "size", "mass")]))
        folded = staged(level.repartition("k", "g").groupBy("k", "g").agg(plain.alias("items")).select(
            "k", "g", _fold(F.col("items"), f"struct<id:{id_type},size:bigint,up:boolean>").alias("f"))
            .select("k", "g", "f.rest", "f.done"), "pivotal")
        settled.append(folded.select("k", F.explode("done").alias("d")).select("k", "d.*"))
        level = folded.select("k", F.floor(F.col("g") / FAN).alias("g"), "rest.*")
        if groups == 1:
            last = level.select("k", "id", "size", (_draw(F.col("id")) * F.col("u") < F.col("mass")).alias("up"))
            settled.append(last)
        groups = 0 if groups == 1 else -(-groups // FAN)
    out = units.select("k", "id", "size").where(F.lit(False)).withColumn("up", F.lit(False))
    for s in settled:
        out = out.unionByName(s)
    return out


def mix_decisions(sizes: DataFrame, weights: tuple = SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(k, id, size, part, source_size, target, first, rows, copies) for each distinct (k, id, size, part) of ``sizes``.

    Rows that agree in source, id and size are one unit: it wants ``rows``
    times as many copies as one row, and only the fraction of the sum is
    rounded, so a unit of any number of rows misses what it wants by less than
    one row. ``copies`` are those of the whole unit; ``first`` counts its rows
    in earlier parts, from which the rows are numbered. Documents without
    words take part in no draw and get no copy.
    """
    key = ["k", "id", "size"]
    parts = staged(sizes.groupBy(*key, "part").agg(F.count("*").alias("n")), "parts")
    targets = source_targets(parts.select("k", (F.col("size") * F.col("n")).alias("size")), weights=weights, max_copies=max_copies)
    want = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    units = (parts.groupBy(*key).agg(F.sum("n").alias("rows")).join(targets, "k").withColumn("want", want * F.col("rows"))
             .withColumn("base", F.floor("want")).withColumn("u", F.col("size").cast("double")))
    units = staged(units.withColumn("mass", (F.col("want") - F.col("base")) * F.col("u")), "units")
    up = _rounded_up(units.where("mass > 0").select(*key, "u", "mass"))
    a, b = units.alias("a"), up.alias("b")
    extra = F.coalesce(F.col("b.up"), F.lit(False)).cast("long")
    copies = F.when(F.col("a.size") > 0, F.col("a.base") + extra).otherwise(F.lit(0).cast("long"))
    decided = a.join(b, _same("a", "b"), "left").select("a.k", "a.id", "a.size", "a.rows", "a.source_size", "a.target", copies.alias("copies"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # a row for each input partition at most
    p, d = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("p"), decided.alias("d")
    return p.join(d, _same("p", "d")).select("p.k", "p.id", "p.size", "p.part", "p.first", "d.rows", "d.source_size", "d.target", "d.copies")


def _same(a: str, b: str) -> Column:
    return (F.col(f"{a}.k") == F.col(f"{b}.k")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))


def _copied(rows: DataFrame, weights: tuple, max_copies: int) -> DataFrame:
    """``rows`` (k, id, size, part, ...) with ``source_size``, ``target`` and each row's own number of ``copies``.

    A unit's copies are spread evenly over its rows; the first ones get one more.
    """
    d = mix_decisions(rows.select("k", "id", "size", "part"), weights, max_copies).alias("d")
    s = rows.withColumn("n", F.row_number().over(Window.partitionBy("k", "id", "size", "part").orderBy(F.lit(0)))).alias("s")
    whole = F.floor(F.col("d.copies") / F.col("d.rows"))
    more = (F.col("d.first") + F.col("s.n") <= F.col("d.copies") - whole * F.col("d.rows")).cast("long")
    return (s.join(d, _same("s", "d") & (F.col("s.part") == F.col("d.part")))
            .select("s.*", "d.source_size", "d.target", (whole + more).alias("copies")))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per input row: (id_col, size, source_size, target, taken); ``taken`` counts the words the mix takes.

    Size is the number of words, 0 for null. Sources in code point order,
    null last, weigh ``weights`` in turn. Null ids and repeated rows are rows
    like others. Texts may have any length; only their word counts are kept.
    An empty table gives no rows; other columns are not read.
    """
    sizes = staged(df.select(F.col(id_col).alias("id"), _source_key(source_col).alias("k"), word_count(text_col).alias("size"),
                             F.spark_partition_id().alias("part")), "sizes")
    return _copied(sizes, weights, max_copies).select(F.col("id").alias(id_col), "size", "source_size", "target",
                                                      (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple = SOURCE_WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with the columns of ``df``."""
    keyed = staged(df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _source_key(source_col).alias("k"),
                             word_count(text_col).alias("size"), F.spark_partition_id().alias("part")), "keyed")
    taken = _copied(keyed, weights, max_copies).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")
