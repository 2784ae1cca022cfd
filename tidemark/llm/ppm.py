"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (orders 0 to ORDER) holds
symbol counts from a bounded training sample.  A byte's code length follows PPM
with escape method C: in a context seen n times with d distinct successors a
known byte costs -log(c / (n + d)), otherwise the escape -log(d / (n + d)) is
paid and the next shorter context is asked; below order 0 all 256 bytes are
equal.  Statistics are frozen after training, so a text's code length is a plain
sum and exact: the trees of all languages share one node table (hash addressed)
whose rows hold, for every language, the full cost of reaching the node's last
byte from its prefix, escapes included, and the cost of leaving the node.
Scoring is a few vectorised look-ups a byte, whatever the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bytescan
from tidemark.llm.store import prepare

ORDER = 4  #: longest context in bytes
SAMPLE_ROWS = 160  #: documents learned from per language, at most, chosen by hash of doc_id
SAMPLE_BYTES = 1 << 20  #: whole texts are taken in that order until a language has this many bytes
UNKNOWN = "und"
REJECT_BELOW = 0.5  #: the pipeline drops a document whose best language has no majority

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Frozen statistics; ``languages`` is sorted."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER) -> None:
        self.order, self.languages = order, sorted(texts)
        size = len(self.languages)
        seen = []
        for n, language in enumerate(self.languages):
            joined = b"".join(t + bytes(order) for t in texts[language] if t)
            raw = np.frombuffer(bytes(order) + joined, np.uint8).astype(np.uint64)
            body = np.ones(len(raw), bool)
            # the zero bytes after a text are only context for the next
            at = order
            for t in texts[language]:
                if t:
                    body[at - order : at] = False
                    at += len(t) + order
            body[at - order :] = False
            where = np.flatnonzero(body)
            node = np.ones(len(where), np.uint64)
            levels = []
            for k in range(order + 1):
                low = np.zeros(len(where), np.uint64)
                for j in range(k, -1, -1):
                    low = (low << np.uint64(8)) | raw[where - j]
                node = (np.uint64(1) << np.uint64(8 * (k + 1))) | low
                levels.append(np.unique(node, return_counts=True))
            seen.append(levels)
        self.base = np.full(size, np.log(256.0), np.float32)
        ids: list[np.ndarray] = []
        cost: list[np.ndarray] = []
        leave: list[np.ndarray] = []
        roots_leave = np.zeros((1, size), np.float32)
        previous_ids, previous_cost, previous_leave = np.array([1], np.uint64), None, None
        # contexts are nodes too, even those that hold the zero bytes before a text
        nodes: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 2)
        for k in range(order, -1, -1):
            nodes[k] = np.unique(np.concatenate([*(s[k][0] for s in seen), nodes[k + 1] >> np.uint64(8)]))
        for k in range(order + 1):
            own = nodes[k]
            parents = own >> np.uint64(8)
            parent_at = np.searchsorted(previous_ids, parents)
            count = np.zeros((len(own), size))
            total = np.zeros((len(previous_ids), size))
            kinds = np.zeros((len(previous_ids), size))
            for n, s in enumerate(seen):
                at = np.searchsorted(own, s[k][0])
                count[at, n] = s[k][1]
                np.add.at(total[:, n], parent_at[at], s[k][1])
                np.add.at(kinds[:, n], parent_at[at], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log(kinds / (total + kinds)), 0.0).astype(np.float32)
                known = -np.log(count / (total + kinds)[parent_at])
            if k == 0:
                lower = np.broadcast_to(self.base, (len(own), size))
                roots_leave = escape
            else:
                # the same byte after the context without its first byte: drop the leading byte of the id
                width = np.uint64(8 * k)
                suffix = (own & ((np.uint64(1) << width) - np.uint64(1))) | (np.uint64(1) << width)
                lower = previous_cost[np.minimum(np.searchsorted(previous_ids, suffix), len(previous_ids) - 1)]
                leave.append(escape)
            row = np.where(count > 0, known, escape[parent_at] + lower).astype(np.float32)
            ids.append(own)
            cost.append(row)
            previous_ids, previous_cost = own, row
        leave.append(np.zeros((len(previous_ids), size), np.float32))
        self.root_leave = roots_leave[0] if len(roots_leave) else np.zeros(size, np.float32)
        self._index(np.concatenate(ids))
        # one contiguous column a language; the extra last row serves ids that no tree has
        pad = np.zeros((1, size), np.float32)
        self.cost = np.ascontiguousarray(np.concatenate([*cost, pad]).T)
        self.leave = np.ascontiguousarray(np.concatenate([*leave, pad]).T)

    def _index(self, ids: np.ndarray) -> None:
        bits = max(10, int(np.ceil(np.log2(max(len(ids), 1) * 4))))
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros(1 << bits, np.int32)
        self.missing = len(ids)
        mask = (1 << bits) - 1
        pending = np.arange(len(ids))
        slot = ((ids * _MULT) >> self.shift).astype(np.int64)
        while len(pending):
            free = self.slots[slot[pending]] == 0
            candidates = pending[free]
            _, first = np.unique(slot[candidates], return_index=True)
            winners = candidates[first]
            self.slots[slot[winners]] = ids[winners]
            self.rows[slot[winners]] = winners
            pending = np.setdiff1d(pending, winners, assume_unique=True)
            slot[pending] = (slot[pending] + 1) & mask
        self.mask = mask

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Row of each node id; ``missing`` where there is none."""
        slot = ((ids * _MULT) >> self.shift).astype(np.int64)
        held = self.slots[slot]
        out = self.rows[slot]
        wrong = np.flatnonzero(held != ids)
        if len(wrong):
            at, want = slot[wrong], ids[wrong]
            while len(wrong):
                empty = self.slots[at] == 0
                out[wrong[empty]] = self.missing
                wrong, at, want = wrong[~empty], (at[~empty] + 1) & self.mask, want[~empty]
                hit = self.slots[at] == want
                out[wrong[hit]] = self.rows[at[hit]]
                wrong, at, want = wrong[~hit], at[~hit], want[~hit]
        return out

    def code_lengths(self, part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """[documents, languages] code length in nats of whole texts laid end to end."""
        size, n = len(self.languages), len(part)
        out = np.zeros((len(bounds) - 1, size))
        if not n or not size:
            return out
        # suffix ids: the last k + 1 bytes at each position, zero bytes before a text
        shifted = [part.astype(np.uint64)]
        starts = bounds[:-1][np.diff(bounds) > 0]
        for j in range(1, self.order + 1):
            s = np.zeros(n, np.uint64)
            s[j:] = shifted[0][:-j] if j < n else 0
            for i in range(j):
                at = starts + i
                s[at[at < n]] = 0
            shifted.append(s)
        # texts shorter than the order: positions past a text's end belong to the next, whose own zeros are set above
        low = [shifted[0]]
        for j in range(1, self.order + 1):
            low.append(low[-1] | (shifted[j] << np.uint64(8 * j)))
        one = np.uint64(1)
        row = self.find(low[self.order] | (one << np.uint64(8 * (self.order + 1))))
        extra: list[tuple[np.ndarray, np.ndarray]] = []
        open_ = np.flatnonzero(row == self.missing)
        bottom = np.zeros(0, np.int64)
        for k in range(self.order, 0, -1):
            if not len(open_):
                break
            context = (low[k][open_] >> np.uint64(8)) | (one << np.uint64(8 * k))
            extra.append((open_, self.find(context)))
            found = self.find(low[k - 1][open_] | (one << np.uint64(8 * k)))
            row[open_] = found
            open_ = open_[found == self.missing]
            bottom = open_ if k == 1 else bottom
        full = np.flatnonzero(np.diff(bounds) > 0)
        for language in range(size):
            value = self.cost[language][row].astype(np.float64)
            for at, context in extra:
                value[at] += self.leave[language][context]
            value[bottom] += self.root_leave[language] + self.base[language]
            out[full, language] = np.add.reduceat(value, bounds[:-1][full])
        return out


def _held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """A model from the distinct texts of documents that are not held out.

    The sample is bounded by SAMPLE_ROWS and SAMPLE_BYTES a language, before it
    leaves the executors; the counts by language are one row for each of the
    languages, which are taken to be few.  Rates come from (approximate) numbers
    of distinct texts, so that copies neither swell nor starve a language.  Of a
    text longer than SAMPLE_BYTES that many bytes are learned from.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~_held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("text").alias("n")).collect()}
    if not counts:
        return Model({})
    span = 1 << 30
    rank = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(span))  # copies are one candidate
    limits = [F.when((F.col("lang") == lang) & (rank < int(min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1)) * span)), True) for lang, n in counts.items()]
    chosen = usable.where(F.coalesce(*limits, F.lit(False))).select("lang", rank.alias("rank"), F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES).alias("text")).distinct()
    # a bounded number of rows a language: their bytes are added up in the order in which they are taken
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank", "text").rowsBetween(Window.unboundedPreceding, -1))
    sample = chosen.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_BYTES).drop("before").toArrow().to_pylist()
    texts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    size = dict.fromkeys(counts, 0)
    for row in sorted(sample, key=lambda r: (r["rank"], r["lang"], r["text"])):
        own = texts[row["lang"]]
        if len(own) < SAMPLE_ROWS and (size[row["lang"]] < SAMPLE_BYTES or not own):
            own.append(row["text"])
            size[row["lang"]] += len(row["text"])
    return Model({lang: own for lang, own in texts.items() if own})


def predict_chunk(model: Model, part: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a chunk."""
    n = len(bounds) - 1
    letter = ((part | 32) >= 97) & ((part | 32) <= 122) & (part < 128)
    counted = np.concatenate([[0], np.cumsum(letter)])
    has = counted[bounds[1:]] > counted[bounds[:-1]]
    for d in np.flatnonzero(~has & (np.diff(bounds) > 0)):
        own = part[bounds[d] : bounds[d + 1]]
        if (own >= 128).any():
            has[d] = any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    lengths = model.code_lengths(part, bounds)
    best = lengths.argmin(1)
    likely = 1.0 / np.exp(-(lengths - lengths.min(1, keepdims=True))).sum(1)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, likely, 0.0)


def predict(spark: SparkSession, docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang, ...).

    ``score`` is the posterior of the predicted language under equal priors.
    Defined cases: a null text, or one without any letter, is ``und`` with score
    0; without any training row every text is ``und``.  Ties go to the language
    that sorts first.  Texts of one or more bytes are scored whole.  Repeated
    rows are predicted alike; further columns are ignored.
    """
    prepare(spark)
    model = spark.sparkContext.broadcast(train(spark, docs if training is None else training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, bounds in bytescan.chunks(batch.column(2)):
                language, score = predict_chunk(model.value, part, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(language, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows whose language is rejected (und, or a score under REJECT_BELOW).

    Defined cases: null, empty and letterless texts are rejected; without any
    training row every row is; repeated rows stay or go together; ties go to the
    language that sorts first; an empty table stays empty; further columns, of
    whatever name, pass through.
    """
    prepare(spark)
    model = spark.sparkContext.broadcast(train(spark, docs))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, part, bounds in bytescan.chunks(batch.column(column)):
                language, score = predict_chunk(model.value, part, bounds)
                keep = (np.array(language, dtype=object) != UNKNOWN) & (score >= REJECT_BELOW)
                yield batch.slice(i, j - i).filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
