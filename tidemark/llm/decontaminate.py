"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions of a window that count; the others are
ignored, so a window survives substitutions there.  Windows of the benchmark
items under each mask are hashed into a sorted table, windows of the documents
are looked up in it (a bit table first, then the exact keys), and each hit's
diagonal is verified: document and item are laid side by side and some run of
positions must hold enough words, nearly all of them equal.  The best scoring
run is taken if it does, or else the passing run with the most equal words.

The benchmark is broadcast in blocks of bounded size, one block at a time; a
benchmark of any size is handled by as many passes over the documents as it has
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytescan
from tidemark.llm.store import Workspace, prepare

MASKS = ("1011111", "101110011", "1111001001", "1100001111")  #: six counted positions each; together they hit 82 % of ten-word runs with two inner substitutions, and all with one
LEAST_ITEM = 3  #: items of fewer words are no passage and match nothing
MIN_WORDS = 10  #: a verified overlap has at least this many words, or the whole of a shorter item
IDENTITY = 0.8  #: share of its words that are equal
MISMATCH = -2.5  #: score of a differing word against 1 for an equal one
BLOCK_BYTES = 4 << 20  #: benchmark text broadcast at once
_BITS = 22
_EXPAND = 1 << 20  #: pairs of windows that are expanded at once


@dataclass
class SeedIndex:
    """Windows of one block of benchmark items."""

    item_ids: pa.Array  #: may hold nulls
    starts: np.ndarray  #: offsets into ``words`` by item
    words: np.ndarray
    tables: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  #: offsets, keys, item, position, bit table

    @classmethod
    def build(cls, item_ids: list[int | None], texts: list[bytes]) -> SeedIndex:
        part = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        w = bytescan.words(part, bounds, marks_too=True)
        lengths = np.diff(w.offsets)
        tables = []
        shortest = min(len(m) for m in MASKS)
        short = ["1" * int(n) for n in np.unique(lengths[(lengths >= LEAST_ITEM) & (lengths < shortest)])]
        for mask in (*MASKS, *short):
            at = tuple(i for i, c in enumerate(mask) if c == "1")
            own = lengths == len(mask) if len(mask) < shortest else lengths >= len(mask)
            keys, items, positions = [], [], []
            h = _windows(w.hashes, at)
            for item in np.flatnonzero(own):
                n = int(lengths[item]) - len(mask) + 1
                keys.append(h[w.offsets[item] : w.offsets[item] + n])
                items.append(np.full(n, item))
                positions.append(np.arange(n))
            if not keys:
                continue
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key = key[order]
            bits = np.zeros(1 << _BITS, bool)
            bits[(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            tables.append((at, key, np.concatenate(items)[order], np.concatenate(positions)[order], bits))
        return cls(pa.array(item_ids, pa.int64()), w.offsets, w.hashes, tables)

    def overlaps(self, own: np.ndarray, hits: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """item: (words of the overlap, equal ones, first word in the document) from (item, diagonal) hits."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in hits:
            theirs = self.words[self.starts[item] : self.starts[item + 1]]
            lo, hi = max(0, -diagonal), min(len(theirs), len(own) - diagonal)
            equal = own[lo + diagonal : hi + diagonal] == theirs[lo:hi]
            total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, MISMATCH))])
            floor = np.minimum.accumulate(total)
            end = int(np.argmax(total - floor))
            begin = int(np.argmin(total[: end + 1]))
            size, same = end - begin, int(equal[begin:end].sum())
            least = min(MIN_WORDS, len(theirs))
            if size < least or same < IDENTITY * size:
                run = _passing_run(equal, least)
                if run is None:
                    continue
                begin, size, same = run
            if same > best.get(item, (0, 0, 0))[1]:
                best[item] = (size, same, lo + diagonal + begin)
        return best

    def search(self, part: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, words, equal words, first word) of the verified overlaps of a chunk."""
        w = bytescan.words(part, bounds, marks_too=True)
        if not len(w.hashes) or not self.tables:
            return []
        found: set[tuple[int, int, int]] = set()
        for at, keys, items, positions, bits in self.tables:
            h = _windows(w.hashes, at)
            likely = np.flatnonzero(bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(likely):
                continue
            lo = np.searchsorted(keys, h[likely], "left")
            hi = np.searchsorted(keys, h[likely], "right")
            doc = np.searchsorted(w.offsets, likely, "right") - 1
            inside = (hi > lo) & (likely + at[-1] < w.offsets[doc + 1])
            at_doc, lo, hi = doc[inside], lo[inside], hi[inside]
            first = likely[inside] - w.offsets[at_doc]
            ends = np.cumsum(hi - lo)
            # windows that recur in a text and in an item are a product: in bounded pieces, of which only distinct diagonals stay
            begin = 0
            while begin < len(ends):
                stop = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _EXPAND, "right")), begin + 1)
                n = hi[begin:stop] - lo[begin:stop]
                x = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:stop], n)
                triples = np.stack([np.repeat(at_doc[begin:stop], n), items[x], np.repeat(first[begin:stop], n) - positions[x]], 1)
                found.update(map(tuple, np.unique(triples, axis=0).tolist()))
                begin = stop
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for d, item, diagonal in sorted(found):
            by_doc.setdefault(d, []).append((item, diagonal))
        return [(d, item, *v) for d, hits in by_doc.items() for item, v in sorted(self.overlaps(w.hashes[w.offsets[d] : w.offsets[d + 1]], hits).items())]


def _passing_run(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(begin, words, equal words) of the run with the most equal words among all that begin and end with one, have ``least`` words and pass IDENTITY."""
    at = np.flatnonzero(equal)
    if len(at) < IDENTITY * least:
        return None
    # the n-th equal word at p: a run from a to b passes if (1 - IDENTITY) * equal - IDENTITY * differing >= 0
    n = np.arange(len(at))
    level = n - IDENTITY * at
    # for each end, the first begin that passes gives the longest run
    first = np.searchsorted(-np.minimum.accumulate(level), -(level + 1 - IDENTITY + 1e-9), "left")
    size = at - at[first] + 1
    same = np.where(size >= least, n - first + 1, 0)
    end = int(np.argmax(same))
    return (int(at[first[end]]), int(size[end]), int(same[end])) if same[end] else None


def _windows(hashes: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    """Hash of the counted positions of the window that begins at each word (wraps past the end)."""
    padded = np.concatenate([hashes, np.zeros(at[-1] + 1, np.uint64)])
    h = np.zeros(len(hashes), np.uint64)
    for n, offset in enumerate(at):
        h += padded[offset : offset + len(hashes)] * np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) & ((1 << 64) - 1) | 1)
    return bytescan.mix(h + np.uint64(len(at)))


def _blocks(spark: SparkSession, benchmark: DataFrame) -> tuple[int, Iterator]:
    """How many blocks of about BLOCK_BYTES of benchmark text there are, and their seed indexes, broadcast one at a time."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    count = max(1, -(-size // BLOCK_BYTES))

    def each() -> Iterator:
        for block in range(count):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).toArrow().to_pylist()
            rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
            if rows:
                yield spark.sparkContext.broadcast(SeedIndex.build([r["item_id"] for r in rows], [r["text"] for r in rows]))

    return count, each()


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap_words, equal_words, first_word): verified overlaps of documents with items.

    Words are runs of letters and digits (any byte above ASCII counts as one),
    A-Z lower-cased; ``first_word`` counts them from 0 in the document.  One row
    per document row and item, for its best overlap.

    Defined cases: null or empty texts overlap with nothing; items shorter than
    a mask must occur whole, those of fewer than LEAST_ITEM words match nothing;
    of equally good overlaps the first diagonal wins;
    repeated documents or items each give their rows; an item
    of null item_id counts as any other and is reported with a null; an empty table gives none.
    """
    prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, overlap_words long, equal_words long, first_word long"
    out = None
    count, blocks = _blocks(spark, benchmark)
    ws = Workspace(spark, "overlaps")
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], index=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, part, bounds in bytescan.chunks(batch.column(1)):
                    found = index.value.search(part, bounds)
                    if found:
                        d, item, *rest = (np.array(x, np.int64) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(d)), index.value.item_ids.take(pa.array(item)), *(pa.array(x) for x in rest)], names=["doc_id", "item_id", "overlap_words", "equal_words", "first_word"])

        part_rows = source.mapInArrow(run, schema)
        if count > 1:  # written, so that a block's index can go before the next one comes
            part_rows = ws.save(part_rows, "block")
            block.destroy()
        out = part_rows if out is None else out.unionByName(part_rows)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the documents that overlap with a benchmark item.

    Defined cases: as for ``overlaps``; null and empty texts stay; repeated rows
    stay or go together; an empty benchmark takes nothing away; further columns,
    of whatever name, pass through.
    """
    prepare(spark)
    column = docs.columns.index("text")
    out = docs
    count, blocks = _blocks(spark, benchmark)
    ws = Workspace(spark, "clean")
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], index=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, part, bounds in bytescan.chunks(batch.column(column)):
                    keep = np.ones(j - i, bool)
                    keep[[x[0] for x in index.value.search(part, bounds)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(keep))

        before, out = out, out.mapInArrow(run, docs.schema)
        if count > 1:
            out = ws.save(out, "block")
            if before is not docs:
                ws.drop(before)
            block.destroy()
    return out
