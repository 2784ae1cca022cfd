"""A trie of conversation prefixes, from rolling fingerprints that are then verified.

Plan
1. A turn is known by a 64-bit hash of role and text.  One grouping over the
   texts themselves shows that no two texts share a hash; those that do are
   numbered, so that (hash, number) stands for the text exactly.  No text goes
   further than this.
2. Turns are dealt in ranges of (conv_id, turn) and scanned in numpy: place and
   polynomial fingerprint of the prefix, ``f = f * base + turn`` over two primes
   of 31 bits.  A conversation cut by ranges is put together from the ends of
   its pieces, at most two rows a range, since fingerprints of neighbouring
   pieces combine.
3. A conversation that is rebuilt, the first turns of another before the rest
   of its own, gets its fingerprints by arithmetic from those of both.
4. (depth, fingerprint) proposes nodes.  A node's members are verified against
   its representative, the smallest conv_id, turn by turn: each must have the
   same last turn and the same group one turn above, which then holds for every
   turn of the prefix.  Groups that fail are split into labels, level by level,
   until each label has one turn and one label above.
5. Parent, children and sums over subtrees are joins over one row a node; sums
   go up by pointer doubling over nodes of several members, so that the number
   of rounds is the logarithm of the depth.  Nodes of one member are chains with
   one leaf and save nothing.
6. Ids of the conversations that end in a node are sorted by range and packed
   into strings of some 64 kB; one task reads a node's strings in order and
   hashes them as they come.

Cases: rows without a conv_id belong to no conversation; a null turn comes
first; turns of equal number follow in the order of the hash of role and text,
and repeated rows are repeated turns; null role or text is empty; an empty table
has no root and gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import Workspace, merging, prepare

WORDS = r"[^\x20\x09-\x0D]+"
SHARE, DRAW = 20, 4  #: conversations of a family, and choices of how many turns they share
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
PACK = 1 << 16  #: bytes of a string of packed ids
_EMPTY = hashlib.sha256(b"").hexdigest()


class Lanes:
    """Polynomials over two primes, packed into one non-negative long."""

    def __init__(self, primes: tuple[int, int] = PRIMES) -> None:
        self.primes = [np.uint64(p) for p in primes]
        self.bases = [np.uint64(b % p or 1) for b, p in zip(BASES, primes, strict=True)]
        self.inverse = [np.uint64(pow(int(b), -1, p)) for b, p in zip(self.bases, primes, strict=True)]

    def unpack(self, f: np.ndarray) -> list[np.ndarray]:
        f = f.astype(np.uint64)
        return [f >> np.uint64(31), f & np.uint64((1 << 31) - 1)]

    def pack(self, lanes: list[np.ndarray]) -> np.ndarray:
        return (lanes[0] << np.uint64(31) | lanes[1]).astype(np.int64)

    def turns(self, t: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """Residues of turns (hash, number)."""
        return [(t.view(np.uint64) % p + v.astype(np.uint64) % p * np.uint64(1000003)) % p for p in self.primes]

    def powers(self, k: np.ndarray) -> list[np.ndarray]:
        out = []
        for base, p in zip(self.bases, self.primes, strict=True):
            power, value, rest = np.full(len(k), base), np.ones(len(k), np.uint64), k.astype(np.uint64)
            while rest.any():
                value = np.where(rest & np.uint64(1), value * power % p, value)
                power, rest = power * power % p, rest >> np.uint64(1)
            out.append(value % p)
        return out

    def moved(self, f: np.ndarray, old: np.ndarray, new: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """Fingerprints whose first part ``old``, k turns before the end, is exchanged for ``new``."""
        parts = zip(self.unpack(f), self.unpack(old), self.unpack(new), self.powers(k), self.primes, strict=True)
        return [(a + (y + p - x) % p * power) % p for a, x, y, power, p in parts]

    def before(self, lanes: list[np.ndarray], turn: list[np.ndarray]) -> list[np.ndarray]:
        """The fingerprints a turn earlier."""
        return [(a + p - t) % p * i % p for a, t, i, p in zip(lanes, turn, self.inverse, self.primes, strict=True)]

    def scan(self, turn: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        """Prefix fingerprints of segments; ``at`` is the place in the segment from 0."""
        longest, out = int(at.max(initial=0)) + 1, []
        for values, base, p in zip(turn, self.bases, self.primes, strict=True):
            f, power, step = values.copy(), base, 1
            while step < longest:
                far = np.flatnonzero(at >= step)
                f[far] = (f[far] + f[far - step] * power % p) % p
                power, step = power * power % p, step * 2
            out.append(f)
        return out


_TURNS = "part long, conv_id long, pos long, f long, t long, v long, words long"


def _scan(primes: tuple[int, int]):
    """Number and fingerprint the sorted turns of one range; a conversation's state goes from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, part = Lanes(primes), TaskContext.get().partitionId()
        last, placed, carried = None, 0, np.zeros(1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, t, v = (batch.column(i).to_numpy() for i in (0, 2, 3))
            rows = np.arange(len(conv))
            starts = np.maximum.accumulate(np.where(np.r_[True, conv[1:] != conv[:-1]], rows, 0))
            at = rows - starts
            f = lanes.pack(lanes.scan(lanes.turns(t, v), at))
            pos = at + 1
            if conv[0] == last:
                first = starts == 0
                nothing = np.zeros(int(first.sum()), np.int64)
                f[first] = lanes.pack(lanes.moved(f[first], nothing, nothing + carried, pos[first]))
                pos[first] += placed
            last, placed, carried = conv[-1], pos[-1], f[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), batch.column(0), pa.array(pos), pa.array(f), batch.column(2), batch.column(3), batch.column(4)], names=["part", "conv_id", "pos", "f", "t", "v", "words"])

    return run


def _rebuilt(primes: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = Lanes(primes)
        for batch in batches:
            f, old, new, k, t, v = (batch.column(name).to_numpy() for name in ("f", "old", "new", "k", "t", "v"))
            now = lanes.moved(f, old, new, k)
            above = lanes.before(now, lanes.turns(t, v))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(lanes.pack(now)), pa.array(lanes.pack(above)), batch.column("t"), batch.column("v"), batch.column("words"), batch.column("ends")], names=["conv_id", "depth", "f", "g", "t", "v", "words", "ends"])

    return run


def turn_hash(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text)


def _known_turns(ws: Workspace, turns: DataFrame, digest: Callable[[Column, Column], Column]) -> DataFrame:
    """conv_id, turn, t, v, words: turns by hash and number; equal (t, v) are equal role and text, byte for byte."""
    turns = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("t", digest(F.col("role"), F.col("text")).cast("long"))
    forms = turns.groupBy("t", "role", "text").agg(F.count("*").alias("n"))
    shared = ws.save(forms.groupBy("t").agg(F.count("*").alias("forms")).where("forms > 1"), "collisions")
    number = F.lit(0).cast("long")
    if not shared.isEmpty():
        one = forms.join(merging(shared.select("t")), "t", "left_semi")
        numbered = one.select("t", "role", "text", (F.row_number().over(Window.partitionBy("t").orderBy("role", "text")) - 1).cast("long").alias("number"))
        turns = turns.join(merging(numbered), ["t", "role", "text"], "left")
        number = F.coalesce("number", F.lit(0).cast("long"))
    return turns.select("conv_id", "turn", "t", number.alias("v"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))


def _placed(ws: Workspace, known: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """conv_id, pos (from 1), f, t, v, words of every turn, whatever ranges its conversation is cut into."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t"), F.col("v")]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = ws.save(dealt.select("conv_id", "turn", "t", "v", "words").mapInArrow(_scan(primes), _TURNS), "turns")
    pieces = turns.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by("f", "pos").alias("f"))
    cut = pieces.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1")
    # a border of ranges cuts one conversation: at most two rows a range
    rows = sorted((r["conv_id"], r["part"], r["n"], r["f"]) for r in cut.collect())
    if not rows:
        return turns.drop("part")
    lanes, earlier, state, place = Lanes(primes), [], np.zeros(1, np.int64), 0
    for k, (conv, part, n, f) in enumerate(rows):
        if k == 0 or rows[k - 1][0] != conv:
            state, place = np.zeros(1, np.int64), 0
        earlier.append((part, conv, place, int(state[0])))
        state = lanes.pack(lanes.moved(np.array([f]), np.zeros(1, np.int64), state, np.array([n])))
        place += n
    spans = ws.spark.createDataFrame(earlier, "part long, conv_id long, place long, state long")

    @F.pandas_udf("long")
    def behind(f: pd.Series, state: pd.Series, k: pd.Series) -> pd.Series:
        lanes = Lanes(primes)
        return pd.Series(lanes.pack(lanes.moved(f.to_numpy(), np.zeros(len(f), np.int64), state.to_numpy(), k.to_numpy())))

    joined = turns.join(F.broadcast(spans), ["part", "conv_id"], "left")
    nothing = F.lit(0).cast("long")
    place, state = F.coalesce("place", nothing), F.coalesce("state", nothing)
    return ws.save(joined.select("conv_id", (F.col("pos") + place).alias("pos"), behind("f", state, "pos").alias("f"), "t", "v", "words"), "placed")


def _sequences(ws: Workspace, placed: DataFrame, primes: tuple[int, int], share: int, draw: int) -> tuple[DataFrame, DataFrame]:
    """One row a turn of each rebuilt conversation (conv_id, depth, f, g of the prefix above, t, v, words, ends), and each conversation's depth."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % draw).cast("long")
    firsts = range(1, draw)
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("pos") == k, F.col("f"))).alias(f"p{k}") for k in firsts])
    convs = ws.save(convs.select("*", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base")), "conversations")
    donors = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("donor_n"), *[F.col(f"p{k}").alias(f"d{k}") for k in firsts])
    nothing = F.lit(0).cast("long")

    def at(prefix: str, place: Column) -> Column:
        return F.coalesce(*[F.when(place == k, F.col(f"{prefix}{k}")) for k in firsts], nothing)

    got = F.least("h", F.coalesce("donor_n", nothing))
    about = convs.join(merging(donors), "base", "left").withColumn("got", got)
    depth = F.col("got") + F.greatest(F.col("n") - F.col("h"), nothing)
    about = ws.save(about.select("conv_id", "base", "h", "got", depth.alias("whole"), at("p", F.col("h")).alias("old"), at("d", F.col("got")).alias("new")), "about")

    rest = placed.where(F.col("pos") > taken).join(merging(about), "conv_id")
    k = F.col("pos") - F.col("h")
    rest = rest.select("conv_id", (F.col("got") + k).alias("depth"), "f", "old", "new", k.alias("k"), "t", "v", "words", (F.col("got") + k == F.col("whole")).alias("ends"))
    heads = placed.where((F.col("pos") < draw) & (F.col("conv_id") % share == 0)).withColumnRenamed("conv_id", "base")
    lent = about.where("got > 0").select("conv_id", "base", "got", "whole").join(merging(heads), "base").where("pos <= got")
    lent = lent.select("conv_id", F.col("pos").alias("depth"), "f", nothing.alias("old"), nothing.alias("new"), nothing.alias("k"), "t", "v", "words", (F.col("pos") == F.col("whole")).alias("ends"))
    rows = rest.unionByName(lent).mapInArrow(_rebuilt(primes), "conv_id long, depth long, f long, g long, t long, v long, words long, ends boolean")
    return ws.save(rows, "rebuilt"), about.select("conv_id", "whole")


def _proposed(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Candidate nodes with what verification needs: the least and greatest turn and prefix above of their members."""
    spans = [f(c).alias(f"{name}_{c}") for c in ("g", "t", "v") for name, f in (("least", F.min), ("most", F.max))]
    return ws.save(rows.groupBy("depth", "f").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("words").alias("words"), *spans), "nodes")


def _split(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Rows whose f and g are labels: the smallest conv_id of those that share turn and label above, at every level."""

    def labelled(rows: DataFrame, *by: str) -> DataFrame:
        least = rows.groupBy("depth", *by).agg(F.min("conv_id").alias("label"))
        return rows.join(merging(least), ["depth", *by])

    rows = labelled(rows, "f", "g", "t", "v").drop("f", "g").withColumnRenamed("label", "f")
    while True:
        above = F.coalesce(F.lag("f").over(Window.partitionBy("conv_id").orderBy("depth")), F.lit(0).cast("long"))
        rows = ws.save(rows.withColumn("g", above), "labels")
        if rows.groupBy("depth", "f").agg(F.min("g").alias("least"), F.max("g").alias("most")).where("least <> most").isEmpty():
            return rows
        rows = labelled(rows, "f", "g").drop("f", "g").withColumnRenamed("label", "f")


def _subtrees(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """depth, f, leaves, saved of nodes of several members, summed over their subtrees by pointer doubling."""
    sums = ws.save(nodes.where("n > 1").select("depth", "f", F.when(F.col("depth") > 1, F.col("g")).alias("up"), F.when(F.col("n_children") == 0, 1).otherwise(F.col("single")).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")), "sums")
    step = 1
    while not sums.where("up is not null").isEmpty():
        gains = sums.where("up is not null").groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("f")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = sums.where("up is not null").select((F.col("depth") + step).alias("depth"), F.col("f").alias("up"), F.col("up").alias("next"))
        nothing = F.lit(0).cast("long")
        joined = sums.join(merging(gains), ["depth", "f"], "left").join(merging(further), ["depth", "up"], "left")
        grown = ws.save(joined.select("depth", "f", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", nothing)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", nothing)).alias("saved")), "sums")
        ws.drop(sums)
        sums, step = grown, step * 2
    return sums


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, f, conv_id) rows into strings of ids of one node."""
    node, ids, size = None, [], 0

    def flush(out: list[tuple]) -> None:
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "f", "first", "ids"])

    for batch in batches:
        out: list[tuple] = []
        for depth, f, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if node != (depth, f) or size > PACK:
                flush(out)
                node, ids, size = (depth, f), [], 0
            ids.append(conv)
            size += 20
        yield batch_of(out)
    out = []
    flush(out)
    yield batch_of(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted packs of each node into the SHA-256 of all of them, comma-joined."""
    node, state = None, None
    for batch in batches:
        out = []
        for depth, f, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if node != (depth, f):
                if state is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, f), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield _digests(out)
    yield _digests([] if state is None else [(*node, state.hexdigest())])


def _digests(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "f", "ends_sha256"])


def _ends(rows: DataFrame, about: DataFrame) -> DataFrame:
    root = about.where("whole = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f"), "conv_id")
    ends = rows.where("ends").select("depth", "f", "conv_id").unionByName(root)
    packs = ends.repartitionByRange("depth", "f", "conv_id").sortWithinPartitions("depth", "f", "conv_id").mapInArrow(_packed, "depth long, f long, first long, ids string")
    return packs.repartition("depth", "f").sortWithinPartitions("depth", "f", "first").mapInArrow(_hashed, "depth long, f long, ends_sha256 string")


def trie(spark: SparkSession, turns: DataFrame, *, name: str = "trie", share: int = SHARE, draw: int = DRAW, digest: Callable[[Column, Column], Column] = turn_hash, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row a node of the prefix trie of ``turns`` (conv_id, turn, role, text).

    Conversation c begins with the first crc32(c) % ``draw`` turns of c - c % ``share``
    in place of its own; ``draw`` = 1 leaves conversations as they are.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prepare(spark, 8192)
    ws = Workspace(spark, name)
    placed = _placed(ws, _known_turns(ws, turns, digest), primes)
    rows, about = _sequences(ws, placed, primes, share, draw)
    nodes = _proposed(ws, rows)
    if not nodes.where("least_g <> most_g or least_t <> most_t or least_v <> most_v").isEmpty():
        rows = _split(ws, rows)
        nodes = _proposed(ws, rows)
    nodes = nodes.select("depth", "f", F.col("least_g").alias("g"), "rep", "n", "words")

    nothing = F.lit(0).cast("long")
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("g").alias("f")).agg(F.count("*").alias("n_children"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    nodes = nodes.join(merging(children), ["depth", "f"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("n_children", "single")})
    nodes = ws.save(nodes, "counted")
    sums = _subtrees(ws, nodes)

    root = about.agg(F.min("conv_id").alias("root"), F.count("*").alias("n_convs"))
    top = nodes.agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), F.sum((F.col("n") - 1) * F.col("words")).alias("saved"))
    first = {**root.first().asDict(), **top.first().asDict()}  # scalars of the root
    ends = ws.save(_ends(rows, about), "ends")
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f").alias("g"), F.col("rep").alias("parent"))
    out = nodes.join(merging(sums.drop("up")), ["depth", "f"], "left").join(merging(ends), ["depth", "f"], "left").join(merging(above), ["depth", "g"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(first["root"]).cast("long")).otherwise(F.col("parent"))
    out = out.select(F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", nothing).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    if first["root"] is None:
        return out
    whole = spark.createDataFrame([(first["root"], 0, None, first["n_convs"], first["n_children"] or 0, first["leaves"] or 1, first["saved"] or 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    turnless = ends.where("depth = 0").select("depth", "ends_sha256")
    whole = whole.join(turnless, "depth", "left").select(*out.columns[:-1], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    return out.unionByName(whole)
