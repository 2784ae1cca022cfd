"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of the corpus; every document of the source wants
the same number of copies, target / source size, which is rarely whole.  The
whole part is taken outright.  The fractional parts are rounded dependently:
two documents' copy probabilities are paired and words move from one to the
other, in the direction that a hashed coin picks with the odds that keep both
expectations, until one of the two is integral; the other goes on to the next
pair.  As each transfer keeps the pair's expected words, a source's taken words
miss its target by no more than the last document left over.

The pairing runs as a reduction tree of DataFrame operations: bounded chunks of
a source are folded with a higher-order function, one residual a chunk goes up
a level, and each level is written before it is used twice.  A source of any
size is dealt over its chunks, so a hot source is no hot task.  All coins are
hashes of the documents met, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Workspace, fresh, merging, prepare

WEIGHTS = (5, 2, 1)  #: repeated over the sources in code point order, null last
MOST_COPIES = 3
FAN_IN = 64  #: documents of a chunk, about
SEED = 20240611
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target) by water-filling: weights share all sizes, capped at ``most`` times a source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest_size = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the water level if all sources that fill up earlier are full: its maximum is where it settles
    water = ranked.withColumn("water", rest_size / rest_weight).withColumn("water", F.max("water").over(everything))
    return water.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(a, b):
    """Both documents after a transfer: struct(done, left); ``done`` has a whole number of extra copies."""

    def rooms():
        mass_a, mass_b = a["p"] * a["size"], b["p"] * b["size"]
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
        up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)  # words that a can gain, can give
        coin = F.pmod(F.xxhash64(F.lit(SEED), a["doc_id"], a["rep"], b["doc_id"], b["rep"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
        gains = coin * (up + down) < down
        first = F.when(gains, room_a <= mass_b).otherwise(mass_a <= room_b)
        return F.struct(gains.alias("gains"), first.alias("first"), F.when(gains, up).otherwise(-down).alias("moved"))

    def at(x, p):
        return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["rep"].alias("rep"), p.alias("p"))

    def between(p):
        return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))

    def settle(t):
        whole_a, whole_b = F.when(t["gains"], 1.0).otherwise(0.0), F.when(t["gains"], 0.0).otherwise(1.0)
        a_done = F.struct(at(a, whole_a).alias("done"), at(b, between(b["p"] - t["moved"] / b["size"])).alias("left"))
        b_done = F.struct(at(b, whole_b).alias("done"), at(a, between(a["p"] + t["moved"] / a["size"])).alias("left"))
        return F.when(t["first"], a_done).otherwise(b_done)

    return _let(rooms(), settle)


def _fold(items: str):
    """struct(done array, left) of an array of documents, largest first."""
    ordered = F.reverse(F.array_sort(F.col(items)))
    empty = F.slice(ordered, 1, 0)
    start = F.struct(empty.alias("done"), F.element_at(ordered, 1).alias("left"))

    def step(acc, x):
        return _let(_pair(acc["left"], x), lambda pair: F.struct(F.concat(acc["done"], F.array(pair["done"])).alias("done"), pair["left"].alias("left")))

    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.aggregate(rest, start, step)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, name: str = "mix", ws: Workspace | None = None) -> DataFrame:
    """(doc_id, source, rep, size, source_size, target, copies, taken) for each row of ``docs`` (doc_id, text, source, ...).

    ``size`` counts words ``[^\\x20\\x09-\\x0D]+``; ``taken`` is size times copies.
    Defined cases: null and empty texts have size 0 and take 0 words (copies as
    the whole part of their source's rate); a null source is a source, last in
    order; rows that repeat a doc_id are told apart by ``rep``; sources without
    words have target 0; an empty table gives no rows.  Equal sizes are ordered
    by doc_id.  Further columns are ignored.  Tables go to ``ws`` if it is given.
    """
    prepare(spark)
    ws = ws or Workspace(spark, name)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))
    # repeated rows: counted first, then told apart, so that they never meet in one task
    sized = plain.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    sized = ws.save(sized.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("rep")), "sized")
    wanted = ws.save(targets(sized, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = wanted.select(F.col("source").alias("s"), "source_size", "target", "n", F.floor(rate + 1e-9).alias("whole"), F.greatest(rate - F.floor(rate + 1e-9), F.lit(0.0)).alias("p"))
    rows = sized.join(rated, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    base = ["source", "source_size", "target", "whole"]
    idle = (F.col("size") == 0) | (F.col("p") < 1e-9)
    results = [rows.where(idle).select("doc_id", "rep", "size", *base, F.lit(0.0).alias("extra"))]

    largest = wanted.agg(F.max("n").alias("n")).collect()[0]["n"] or 0
    item = F.struct(F.col("size").cast("double").alias("size"), "doc_id", "rep", "p")
    level = rows.where(~idle).select(*base, F.col("n").alias("count"), item.alias("item"))
    depth = 0
    while largest > 0:
        groups = F.ceil(F.col("count") / FAN_IN).cast("long")
        chunk = F.pmod(F.xxhash64("item.doc_id", "item.rep", F.lit(depth)), groups)
        folded = level.groupBy(*base, groups.alias("count"), chunk.alias("chunk")).agg(F.collect_list("item").alias("items"))
        folded = folded.select(*base, "count", "chunk", F.transform("items", lambda x: F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["rep"].alias("rep"), x["p"].alias("p"))).alias("items"))
        folded = ws.save(folded.select(*base, "count", _fold("items").alias("f")), f"level{depth}")
        done = folded.select(*base, F.explode("f.done").alias("d"))
        results.append(done.select("d.doc_id", "d.rep", F.col("d.size").cast("long").alias("size"), *base, F.col("d.p").alias("extra")))
        level = folded.select(*base, "count", F.struct("f.left.size", "f.left.doc_id", "f.left.rep", "f.left.p").alias("item"))
        largest = -(-largest // FAN_IN)
        depth += 1
        if largest == 1:
            # one document a source is left: the nearer of both whole numbers
            results.append(level.select("item.doc_id", "item.rep", F.col("item.size").cast("long").alias("size"), *base, F.round("item.p").alias("extra")))
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "rep", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, name: str = "mix") -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it (not at all for 0 copies).

    Defined cases: as for ``mix``; rows that share doc_id, source and size are
    told apart in the order of their texts, equal ones at will; further columns,
    of whatever name, pass through; an empty table stays empty.
    """
    ws = Workspace(spark, f"{name}-take")
    mixed = ws.save(mix(spark, docs, weights, most, ws=ws).select("doc_id", "source", "size", "rep", "copies"), "copies")
    ws.clear(mixed)
    counts = mixed.groupBy("doc_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).collect()[0]
    names = docs.columns
    ident, copies, size, rep, source, size_, copy = (fresh(x, names) for x in ("id", "copies", "size", "rep", "source_of", "size_of", "copy"))
    rep_ = fresh("rep_of", names)
    chosen = mixed.where("copies > 0").select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("size").alias(size_), F.col("rep").alias(rep_), F.col("copies").alias(copies))
    if counts["most"] <= 1 and not counts["nulls"]:
        joined = docs.join(merging(chosen.select(ident, copies)), F.col("doc_id").cast("long") == F.col(ident))
    else:
        words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
        own = docs.withColumn(size, words).withColumn(rep, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy("text")))
        joined = own.join(merging(chosen), F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(size) == F.col(size_)) & (F.col(rep) == F.col(rep_)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in names])
