"""MinHash near-duplicate detection with tensored banding.

Two small collections of band hashes, A and B, are computed for each text; a
table key is a pair (A_i, B_j), so a * b tables need only a + b bands of
MinHash values: about the square root of what independent tables would take.
A pair of texts at similarity s meets in some table with probability
``(1 - (1 - s**rows)**a) * (1 - (1 - s**rows)**b)``: at s = 0.8 and the default
4 rows and 12 + 12 bands that is 0.996, at 0.85 it is 0.9998.

Plan
1. One pass over the texts (Arrow, numpy): hash of the word sequence, size of
   the shingle set, 24 band hashes.  Texts do not leave the pass.
2. Equal word sequences collapse to their least document by a partially
   aggregated minimum over scalars, however large the group of copies is.
3. Bands that only one text has are dropped; what is left forms table keys.
4. Pairs are proposed in rounds and confirmed on full shingle sets: first each
   text against one hub, then, only in buckets whose members are not yet one
   component, those outside the largest against a few hubs of it, then whatever
   pairs of different components are left, in bounded tiles.  Buckets are never expanded into all pairs of
   members that are already connected, and no pair that could still join two
   components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytescan
from tidemark.llm.components import connected_components
from tidemark.llm.store import Workspace, merging, prepare

BANDS = 12  #: bands of each of the two collections
ROWS = 4  #: MinHash values of a band
HUBS = 6  #: hubs of each bucket in the second round
TILE_OUT, TILE_ALL = 256, 1024  #: texts of a tile's two sides in the last round


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    multiply = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return multiply, rng.integers(0, 1 << 32, count, dtype=np.uint32)


def band_hashes(values: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """uint64 [documents, 2 * bands]; documents without values keep zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * bands), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    at = offsets[:-1][full]
    multiply, add = _family(2 * bands * rows)
    low = (values >> np.uint64(32)).astype(np.uint32)
    for band in range(2 * bands):
        h = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            x = low * multiply[k]
            x ^= add[k]
            x *= np.uint32(0x85EBCA6B)
            h = bytescan.mix(h ^ np.minimum.reduceat(x, at).astype(np.uint64))
        out[full, band] = h
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, bounds in bytescan.chunks(batch.column(1)):
                w = bytescan.words(part, bounds)
                h1, h2 = bytescan.sequence_hashes(w)
                values, offsets = bytescan.distinct(*bytescan.shingles(w, k))
                bands = band_hashes(values, offsets)
                flat = pa.array(bands.view(np.int64).reshape(-1))
                rows = pa.array(np.arange(0, (j - i) * bands.shape[1] + 1, bands.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(rows, flat)],
                    names=["doc_id", "h1", "h2", "n_shingles", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, bounds in bytescan.chunks(batch.column(1)):
                values, offsets = bytescan.distinct(*bytescan.shingles(bytescan.words(part, bounds), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=["node", "shingles"],
                )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity, in integer arithmetic."""
    x = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    y = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    # first the side with many different partners each, so that the larger side travels once
    return (
        pairs.join(merging(y), "v")
        .join(merging(x), "u")
        .withColumn("common", F.size(F.array_intersect("su", "sv")).cast("long"))
        .where(F.expr(f"100 * common >= {percent} * (size(su) + size(sv) - common)"))
        .select("u", "v")
    )


def _tile_links(percent: int):
    """Links of one tile: outside texts against all, at most one for each component that a text reaches."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks().sort_by([("node", "ascending")])
        outside = tile.column("outside").to_numpy()
        out, rest = tile.filter(pa.array(outside)), tile.filter(pa.array(~outside))
        u, v = [], []
        if len(out) and len(rest):
            sizes, values = _flat(rest.column("shingles"))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vocabulary, place = np.unique(values, return_inverse=True)
            mark = np.zeros(len(vocabulary) + 1, np.int32)
            nodes, components = rest.column("node").to_numpy(), rest.column("c").to_numpy()
            own_sizes, own_values = _flat(out.column("shingles"))
            ends = np.cumsum(own_sizes)
            for node, c, end, size in zip(out.column("node").to_pylist(), out.column("c").to_pylist(), ends.tolist(), own_sizes.tolist(), strict=True):
                own = own_values[end - size : end]
                at = np.searchsorted(vocabulary, own)
                at = np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == own, at, len(vocabulary))
                mark[at] = 1
                mark[-1] = 0
                common = np.add.reduceat(mark[place], starts)
                mark[at] = 0
                near = (100 * common >= percent * (size + sizes - common)) & (components != c)
                if near.any():
                    _, first = np.unique(components[near], return_index=True)
                    v.extend(nodes[near][first].tolist())
                    u.extend([node] * len(first))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values end to end) of a column of lists; none is null or empty here."""
    whole = lists.combine_chunks()
    return np.diff(whole.offsets.to_numpy()).astype(np.int64), whole.flatten().to_numpy(zero_copy_only=False)


def _tiled(ws: Workspace, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v) between different components of each block.

    ``placed`` (block, node, c): a block is a component with all texts that
    share a bucket with it.  Texts outside the component meet all of the block's
    texts in tiles of bounded size; only links leave a tile.
    """
    rows = ws.save(placed.distinct(), "block")
    counts = rows.groupBy("block").agg(F.ceil(F.count(F.when(F.col("c") != F.col("block"), 1)) / TILE_OUT).cast("int").alias("outs"), F.ceil(F.count("*") / TILE_ALL).cast("int").alias("alls"))
    rows = rows.join(ws.save(counts, "counts"), "block")
    i = F.pmod(F.xxhash64("node", F.lit(1)), F.col("outs")).cast("int")
    j = F.pmod(F.xxhash64("node", F.lit(2)), F.col("alls")).cast("int")
    out = rows.where("c <> block").select("block", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), F.lit(True).alias("outside"), "node", "c")
    rest = rows.select("block", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("outside"), "node", "c")
    return out.unionByName(rest).join(merging(sets), "node").groupBy("block", "i", "j").applyInArrow(_tile_links(percent), "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, name: str = "minhash", ws: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...).

    Words are runs of other than the six ASCII white-space characters, A-Z
    lower-cased; a document's set holds its distinct ``k``-word shingles, or its
    whole sequence where it has fewer words.  Documents whose sets reach
    ``percent`` per cent Jaccard similarity are linked; ``component_id`` is the
    least doc_id reachable, ``kept`` whether that is the document itself.

    Defined cases: a null, empty or blank text has no set, n_shingles 0 and is
    linked with nothing.  Rows that repeat a doc_id count as one node.  A null
    doc_id is linked with nothing: component_id null, kept true.  An empty table
    gives no rows.  Further columns are ignored, whatever their names.  Tables
    go to ``ws`` if it is given, for its owner to clear, else to one of their own.
    """
    prepare(spark)
    ws = ws or Workspace(spark, name)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = ws.save(docs.mapInArrow(_signatures(k), "doc_id long, h1 long, h2 long, n_shingles long, bands array<long>"), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    copies = ws.save(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    firsts = ws.save(real.join(merging(copies), ["h1", "h2"], "left").where("node is null or node = doc_id").select(F.col("doc_id").alias("node"), "bands"), "firsts")

    keys = firsts.select("node", F.posexplode("bands").alias("band", "h"))
    shared = ws.save(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    held = keys.join(merging(shared), "h", "left_semi").groupBy("node").agg(
        F.collect_set(F.when(F.col("band") < BANDS, F.col("h"))).alias("a"), F.collect_set(F.when(F.col("band") >= BANDS, F.col("h"))).alias("b")
    )
    table = ws.save(held.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "node"), "tables")
    buckets = ws.save(table.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub"), "buckets")
    members = ws.save(table.join(merging(buckets), "key"), "members")
    ws.drop(table, buckets, shared, firsts)

    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = ws.save(docs.join(merging(wanted), "doc_id", "left_semi").mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")

    # round one: the least hub that a text meets in any table
    pairs = members.where("hub < node").groupBy("node").agg(F.min("hub").alias("v")).select(F.col("node").alias("u"), "v")
    links = ws.save(_confirmed(pairs, sets, percent), "links")
    component = connected_components(ws, links)

    for last in (False, True):
        # larger components first: what a bucket's first component lacks are few members
        sizes = component.groupBy("component").agg((-F.count("*")).alias("size"))
        ranked = component.join(sizes, "component").select("node", F.struct("size", "component").alias("c"))
        alone = F.struct(F.lit(-1).cast("long").alias("size"), F.col("node").alias("component"))
        placed = ws.save(members.select("key", "node").join(merging(ranked), "node", "left").select("key", "node", F.coalesce("c", alone).alias("c")), "placed")
        picks = [] if last else [F.min_by("node", F.struct("c", F.xxhash64("node", F.lit(s)))).alias(f"p{s}") for s in range(HUBS)]
        open_buckets = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *picks).where("lo < hi")
        open_buckets = ws.save(open_buckets.drop("hi"), "open")
        if open_buckets.isEmpty():
            break
        if last:
            found = ws.save(_tiled(ws, placed.join(merging(open_buckets), "key").select(F.col("lo.component").alias("block"), "node", F.col("c.component").alias("c")), sets, percent), "links")
        else:
            outside = placed.join(merging(open_buckets), "key").where("c <> lo").select("node", F.explode(F.array_distinct(F.array(*[f"p{s}" for s in range(HUBS)]))).alias("hub"))
            pairs = outside.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
            found = ws.save(_confirmed(pairs, sets, percent), "links")
        ws.drop(placed, open_buckets)
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        component = connected_components(ws, links)

    ws.drop(sets, members)
    own = signed.select("doc_id", "h1", "h2", "n_shingles")
    named = own.join(merging(copies), ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
    return named.join(merging(component), "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "node"), F.lit(True)).alias("kept")
    )
