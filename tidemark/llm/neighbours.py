"""Embedding near-duplicates by collision counting on sorted projections.

Vectors are scaled to unit length and projected on many random directions.  Two
vectors at cosine c differ on a Gaussian direction by a normal variate of
standard deviation sqrt(2 - 2c), so a window around a query's projection holds
a near vector with a known probability; the number of projections on which a
pair collides is binomial, and the count that a pair must reach is calibrated
so that a pair at the threshold passes with probability RECALL.  Pairs that
pass are verified in double precision.

A label's vectors are sorted along their first projection and cut into tiles;
two tiles meet only where their ranges, widened by the reach of a true pair on
that projection, overlap.  In a meeting one tile is sorted along every
projection.  The vectors below each rank of a projection are kept as a bitset,
so that a query's window is the difference of two of them, and the windows of
all projections are summed by bit-sliced counters: 64 pairs at a time, without
touching a pair by itself before its count is known.  Links and a spanning
forest of them leave a meeting; a label or a group of copies of any size is
dealt over many bounded tasks.  Equal vectors of a label are one vector with a
multiplicity.  Labels of every size go the same way; the number of meetings
grows with the square of a label.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.store import Workspace, prepare

PROJECTIONS = 32
WINDOW = 2.4  #: half-width of a window in standard deviations of a pair at the threshold
REACH = 5.0  #: standard deviations that the first projection's tiles are widened by
RECALL = 0.999999
TILE = 2048  #: vectors of a tile
QUERIES = 512  #: windows that are counted at once
CELL = 4 * TILE  #: vectors that a task sorts into tiles, about


def calibrate(cosine: float, projections: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int]:
    """(window half-width, collisions that a pair must reach)."""
    sigma = math.sqrt(2 - 2 * cosine)
    p = 2 * NormalDist().cdf(WINDOW) - 1
    lost, count = 0.0, 0
    for k in range(projections + 1):
        lost += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if lost > 1 - recall:
            break
        count = k + 1
    return WINDOW * sigma, count


@lru_cache(8)
def directions(width: int, count: int, seed: int = 20240613) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, count))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length, in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _matrix(raw: bytes, kind: str, rows: int) -> np.ndarray:
    return _unit(np.frombuffer(raw, kind).reshape(rows, -1))


def _prepared(kind: str):
    """Each row with its vector as bytes (null if unusable) and its first projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, lists, label = batch.column(0), batch.column(1), batch.column(2)
            usable = (pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) > 0) & label.is_valid().to_numpy(zero_copy_only=False) & ident.is_valid().to_numpy(zero_copy_only=False)
            vectors: list[bytes | None] = [None] * len(usable)
            first = np.full(len(usable), np.nan)
            rows = np.flatnonzero(usable)
            picked = lists.take(pa.array(rows))
            sizes = pc.list_value_length(picked).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            values = picked.flatten().to_numpy(zero_copy_only=False).astype(kind)  # a null component becomes NaN
            for width in np.unique(sizes):
                own = np.flatnonzero(sizes == width)
                v = values[(ends[own] - width)[:, None] + np.arange(width)] + 0  # + 0: a negative zero equals zero
                good = np.isfinite(v).all(1) & v.any(1)
                own, v = own[good], np.ascontiguousarray(v[good])
                if len(own):
                    first[rows[own]] = _unit(v) @ directions(int(width), 1, 11)[:, 0]
                    for at, row in zip(rows[own].tolist(), v, strict=True):
                        vectors[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([ident, label, pa.array(first, mask=np.isnan(first)), pa.array(vectors, pa.binary())], names=["vec_id", "label", "first", "vector"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to TILE sorted rows of one label and width, packed."""

    def pack(rows: pa.Table) -> dict:
        first = rows.column("first")
        return {
            "label": rows.column("label")[0].as_py(), "tile": rows.column("node")[0].as_py(), "width": len(rows.column("vector")[0].as_py()),
            "lo": first[0].as_py(), "hi": first[len(rows) - 1].as_py(), "n": len(rows),
            "nodes": rows.column("node").to_numpy().astype(np.int64).tobytes(), "copies": rows.column("copies").to_numpy().astype(np.int64).tobytes(),
            "vectors": b"".join(rows.column("vector").to_pylist()),
        }

    schema = pa.schema([("label", pa.string()), ("tile", pa.int64()), ("width", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("nodes", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
    held: pa.Table | None = None
    for batch in chain(batches, (None,)):
        if batch is not None:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if len(held) < TILE:
                continue
        if held is None or not len(held):
            continue
        held = held.combine_chunks()
        label, width = held.column("label"), pc.binary_length(held.column("vector"))
        breaks = pc.or_(pc.not_equal(label[1:], label[:-1]), pc.not_equal(width[1:], width[:-1])).to_numpy()
        edges = [0, *(np.flatnonzero(breaks) + 1).tolist(), len(held)]
        done, begin = [], 0
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            for begin in range(low, high, TILE):
                if high - begin >= TILE or high < len(held) or batch is None:
                    done.append(pack(held.slice(begin, min(TILE, high - begin))))
                    begin = min(begin + TILE, high)
        held = held.slice(begin)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted values, bitset of the positions below each rank) of one projection."""
    order = np.argsort(values, kind="stable")
    bits = np.zeros((len(order) + 1, -(-len(order) // 64)), np.uint64)
    bits[np.arange(1, len(order) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    return values[order], np.bitwise_or.accumulate(bits, axis=0, out=bits)


def _added(bitsets: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Bit planes, lowest first, of how many of the bitsets hold each position (carry-save addition)."""
    held: list[list[np.ndarray]] = [[]]
    for x in bitsets:
        place = 0
        while True:
            held[place].append(x)
            if len(held[place]) < 3:
                break
            a, b, c = held[place]
            odd = a ^ b
            x, held[place] = (a & b) | (odd & c), [odd ^ c]
            place += 1
            if place == len(held):
                held.append([])
    planes = []
    for place, row in enumerate(held):  # grows while it runs
        while len(row) > 1:
            a, b = row.pop(), row.pop()
            row.append(a ^ b)
            if place + 1 == len(held):
                held.append([])
            held[place + 1].append(a & b)
        planes.append(row[0] if row else np.zeros_like(planes[0]))
    return planes


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bitset of the positions whose count is ``least`` or more."""
    if least >= 1 << len(planes):
        return np.zeros_like(planes[0])
    more, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for place in reversed(range(len(planes))):
        if least >> place & 1:
            equal &= planes[place]
        else:
            more |= equal & planes[place]
            equal &= ~planes[place]
    return more | equal


def _places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the bits that are set."""
    row, word = np.nonzero(bits)
    at, bit = np.nonzero(np.unpackbits(bits[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[at], word[at] * 64 + bit


def colliding(queries: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], half: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that collide on ``needed`` projections or more; ``queries`` are projections, ``windows`` those of ``_prefixes``."""
    out = []
    for begin in range(0, len(queries), QUERIES):
        part = queries[begin : begin + QUERIES]

        def sets(part=part) -> Iterator[np.ndarray]:
            for k, (values, below) in enumerate(windows):
                yield below[np.searchsorted(values, part[:, k] + half, "right")] ^ below[np.searchsorted(values, part[:, k] - half, "left")]

        i, j = _places(_at_least(_added(sets()), needed))
        if len(windows[0][0]):
            out.append((i + begin, j))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _forest(rows: np.ndarray, columns: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of links between positions 0..size, each tree hung below its least position."""
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(rows.tolist(), columns.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in range(size) if find(x) != x]


def _meet(cosine: float, kind: str):
    """Links inside one tile, or between two: rows (node, links, root)."""
    half, needed = calibrate(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None, None)  # the second tile of the last meeting, its vectors and its windows

        def links(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
            nonlocal known
            same = row["tile"] == row["tile_b"]
            ia, ib = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["nodes_b"], np.int64)
            key = (row["label"], row["width"], row["tile_b"])
            if known[0] != key:
                vb = _matrix(row["vectors_b"], kind, len(ib))
                pb = vb @ directions(vb.shape[1], PROJECTIONS)
                known = (key, vb, [_prefixes(pb[:, k]) for k in range(PROJECTIONS)])
            vb = known[1]
            va = vb if same else _matrix(row["vectors"], kind, len(ia))
            i, j = colliding(va @ directions(va.shape[1], PROJECTIONS), known[2], half, needed)
            keep = (i < j) if same else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            if not len(i):
                return None
            near = np.concatenate([np.einsum("ij,ij->i", va[i[s : s + 16384]], vb[j[s : s + 16384]]) >= cosine for s in range(0, len(i), 16384)])
            i, j = i[near], j[near]
            if not len(i):
                return None
            ma, mb = np.frombuffer(row["copies"], np.int64), np.frombuffer(row["copies_b"], np.int64)
            shift = 0 if same else len(ia)
            ids = ia if same else np.concatenate([ia, ib])
            order = np.argsort(ids, kind="stable")  # so that each tree hangs below its least id
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            count = np.bincount(i, mb[j], len(ids)) + np.bincount(j + shift, ma[i], len(ids))
            root = np.arange(len(ids))
            for x, r in _forest(rank[i], rank[j + shift], len(ids)):
                root[order[x]] = order[r]
            at = np.flatnonzero(count)
            return ids[at], count[at].astype(np.int64), ids[root[at]]

        for batch in batches:
            for n in range(len(batch)):
                found = links(batch.slice(n, 1).to_pylist()[0])
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "links", "root"])

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.93, name: str = "neighbours") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label, ...).

    Two vectors of equal, non-null label are linked when their cosine in double
    precision reaches ``cosine``.  Defined cases: vectors that are null, empty,
    zero or hold null or non-finite components, and those of a null label, have
    no links; vectors of different width never link; repeated rows are vectors
    of their own and link with each other, also where different vectors bear one
    vec_id; a null vec_id links with nothing, has component null and is kept; an empty
    table gives no rows; further columns are ignored.
    """
    prepare(spark)
    ws = Workspace(spark, name)
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    kind, element = ("<f8", "double") if double else ("<f4", "float")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ready = ws.save(source.mapInArrow(_prepared(kind), "vec_id long, label string, first double, vector binary"), "vectors")
    usable = ready.where("vector is not null")
    distinct = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("first").alias("first"))
    # each distinct vector has a number of its own, whatever vec_ids its rows bear
    distinct = ws.save(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")

    parts = max(1, -(-distinct.count() // CELL))
    order = ("label", F.length("vector"), "first", "node")
    placed = distinct.select("label", "node", "copies", "first", "vector").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "label string, tile long, width int, lo double, hi double, n int, nodes binary, copies binary, vectors binary"
    tiles = ws.save(placed.mapInArrow(_tiles, schema), "tiles")

    reach = REACH * math.sqrt(2 - 2 * cosine)
    key = ["label", "width"]
    a = tiles.select(*key, "tile", "lo", "hi")
    b = tiles.select(*key, F.col("tile").alias("tile_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    meetings = a.join(b, key).where(f"(lo, tile) <= (lo_b, tile_b) and lo_b - hi <= {reach}").select(*key, "tile", "tile_b")
    other = tiles.select(*key, F.col("tile").alias("tile_b"), *[F.col(c).alias(f"{c}_b") for c in ("nodes", "copies", "vectors")])
    meetings = ws.save(meetings, "meetings")
    spread = max(1, -(-distinct.count() // TILE), -(-meetings.count() // 8))  # bounded tasks however many tiles a label has
    loaded = meetings.join(tiles.drop("lo", "hi", "n"), [*key, "tile"]).join(other, [*key, "tile_b"])
    prepare(spark, 8)
    found = ws.save(loaded.repartition(spread).sortWithinPartitions(*key, "tile_b").mapInArrow(_meet(cosine, kind), "node long, links long, root long"), "found")
    prepare(spark)

    component = connected_components(ws, found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    rooted = distinct.select("node", "least").join(component, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    rooted = ws.save(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = rooted.join(named, "root").join(links, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    known = ws.save(known.join(distinct.select("node", "label", "vector", "copies"), "node"), "known")
    linked = usable.select("vec_id", "label", "vector").join(known, ["label", "vector"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = ready.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
