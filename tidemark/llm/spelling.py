"""Spelling variants grouped over wildcard keys, without pairs of words.

Plan
1. Letter runs of whole texts are counted in the JVM; every word is one row of
   the vocabulary, numbered in code-point order once it is written.
2. Each word sends one narrow row a position to the group of its wildcard key,
   (position, prefix, suffix): its members differ from one another at that
   position alone.  A group keeps its size and its two leading words; from these
   every member has its number of replacements and the best of them.
3. Each word also sends a row to its own spelling and one to every spelling that
   a deletion leaves.  Where the own spelling's row (the owner) meets deletions,
   owner and deletions are an insertion apart: the owner takes count and best of
   the deletions, each deletion takes the owner.
4. A word adds its counts and takes the best over its groups.  No pair of words
   is made: a word of length L causes 2 L + 1 rows and gets back as many.
5. Roots follow forms by pointer doubling: a form is at least five times as
   frequent, so chains are short.

Bounds: a wildcard group has at most as many members as there are letters (90),
a spelling of length L at most 90 (L + 1) deletions, so no group grows with the
corpus.  Keys of words up to ``EXACT`` letters are the strings themselves; of
longer words, whose L keys of length L would take the square of it, they are
124-bit polynomial fingerprints of prefix and suffix with their lengths, for
which a collision is less likely than 1e-13 at a million letters.

Cases: null and empty texts hold no words; a null doc_id reads as an empty one
when slips are drawn; rows that repeat a doc_id count each; ties go to the
smallest word in code-point order; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import Workspace, merging, prepare

RUNS = "[A-Za-zÀ-ÿ]+"
SLIP = 199  #: one run in so many loses a letter
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
EXACT = 64  #: letters up to which keys are strings
BATCH_KEYS = 1 << 16  #: keys of an output batch, about

_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = np.array([911382323, 972663749, 536870923, 1190494759], np.uint64)


def _running(codes: np.ndarray) -> np.ndarray:
    """Fingerprints of all prefixes of a word, [length + 1, 4]: a scan by doubling."""
    out = np.zeros((len(codes) + 1, len(_PRIMES)), np.uint64)
    out[1:] = codes[:, None] + np.uint64(1)
    power, step = _BASES.copy(), 1
    while step < len(out):
        moved = np.zeros_like(out)
        moved[step:] = out[:-step] * power % _PRIMES
        out = (out + moved) % _PRIMES
        power, step = power * power % _PRIMES, step * 2
    return out


def word_keys(word: str, exact: int = EXACT) -> tuple[list[bytes], list[bytes]]:
    """Wildcard keys of all positions, and the spelling with those that a deletion leaves, each once."""
    distinct = [i for i, c in enumerate(word) if i == 0 or word[i - 1] != c]
    if len(word) <= exact:
        wild = [(word[:i] + "*" + word[i + 1 :]).encode() for i in range(len(word))]
        # a spelling one letter longer than ``exact`` has its deletions as fingerprints, so this one needs both kinds
        plain = [word, *[word[:i] + word[i + 1 :] for i in distinct]]
        keys = [s.encode() for s in plain]
        return wild, keys + [_long_plain(word)] if len(word) == exact else keys
    codes = np.array([ord(c) for c in word], np.uint64)
    front, back = _running(codes), _running(codes[::-1])[::-1]
    n = len(word)
    sides = np.concatenate([front[:-1], back[1:]], axis=1).astype("<u4")
    at = np.arange(n, dtype="<u4")[:, None]
    raw = np.concatenate([np.full((n, 1), n, "<u4"), at, sides], axis=1).tobytes()
    width = len(raw) // n
    wild = [b"*" + raw[i * width : (i + 1) * width] for i in range(n)]
    powers = _powers(n)
    left = (front[distinct] * powers[n - 1 - np.array(distinct)] % _PRIMES + _forward(codes, front, powers)[distinct]) % _PRIMES
    plain = [b"+" + int(n - 1).to_bytes(4, "little") + row.tobytes() for row in left.astype("<u4")]
    return wild, [_long_plain(word, front), *plain]


def _powers(n: int) -> np.ndarray:
    """Powers of the bases up to n, by doubling."""
    out = np.ones((n + 1, len(_PRIMES)), np.uint64)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = out[:more] * (out[done - 1] * _BASES % _PRIMES) % _PRIMES
        done += more
    return out


def _forward(codes: np.ndarray, front: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Fingerprint of what follows each position, read forwards: whole minus prefix."""
    n = len(codes)
    return (front[n] + _PRIMES - front[1:] * powers[n - 1 - np.arange(n)] % _PRIMES) % _PRIMES


def _long_plain(word: str, front: np.ndarray | None = None) -> bytes:
    if front is None:
        front = _running(np.array([ord(c) for c in word], np.uint64))
    return b"+" + len(word).to_bytes(4, "little") + front[len(word)].astype("<u4").tobytes()


_ROWS = "key binary, kind int, id long, n long"  #: kind: 0 member of a wildcard group, 1 owner of a spelling, 2 deletion


def _emit(exact: int):
    def batches_of(keys: list, kinds: list, ids: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kinds, pa.int32()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["key", "kind", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for word, id_, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wild, plain = word_keys(word, exact)
                own = 2 if len(word) == exact else 1  # the exact spelling, and its fingerprint at the border
                kinds = [0] * len(wild) + [1] + [2] * (len(plain) - 1)
                if own == 2:
                    kinds[-1] = 1
                for start in range(0, len(kinds), BATCH_KEYS):  # a very long word's keys leave in pieces
                    part = (wild + plain)[start : start + BATCH_KEYS]
                    held[0].extend(part)
                    held[1].extend(kinds[start : start + BATCH_KEYS])
                    held[2].extend([id_] * len(part))
                    held[3].extend([n] * len(part))
                    if len(held[0]) >= BATCH_KEYS:
                        yield batches_of(*held)
                        held = ([], [], [], [])
        yield batches_of(*held)

    return run


def runs(docs: DataFrame) -> DataFrame:
    """One row a run of letters: its lower-cased form, a letter short where the draw says so (column word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("run"))
    found = found.select("doc", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    # a run of fewer letters cannot become a word, drawn or not
    found = found.where(F.char_length("run") >= LEAST_LENGTH)
    found = found.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = F.col("h") % F.char_length("run")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at.cast("int")), F.substring(F.col("run"), (at + 2).cast("int"), F.char_length("run")))
    return found.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(ws: Workspace, docs: DataFrame) -> DataFrame:
    """word, id, n: distinct words with their occurrences; ids ascend with words."""
    counted = runs(docs).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))
    counted = ws.save(counted, "counted")
    return ws.save(counted.orderBy("word").select("word", F.monotonically_increasing_id().alias("id"), "n"), "vocabulary")


def _near(rows: DataFrame) -> DataFrame:
    """id, near, best: what each row's group gives its word; best is a struct (negated n, id), so the least leads."""
    ranked = Window.partitionBy("key").orderBy(F.col("n").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("neg"), "id")
    # leaders of what is no owner: members of wildcard groups, or deletions
    rows = rows.withColumn("me", me)
    rows = rows.select(
        "kind", "id", "me",
        F.sum(F.when(F.col("kind") != 1, 1).otherwise(0)).over(ranked).alias("size"),
        F.min(F.when(F.col("kind") != 1, F.col("me"))).over(ranked).alias("first"),
        F.nth_value("me", 2).over(ranked).alias("second"),
        F.min(F.when(F.col("kind") == 1, F.col("me"))).over(ranked).alias("owner"),
    )
    near = F.when(F.col("kind") == 0, F.col("size") - 1).when(F.col("kind") == 1, F.col("size")).otherwise(F.when(F.col("owner").isNotNull(), 1).otherwise(0))
    best = F.when(F.col("kind") == 0, F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first"))).when(F.col("kind") == 1, F.col("first")).otherwise(F.col("owner"))
    return rows.select("id", near.alias("near"), best.alias("best")).where("near > 0")


def variants(spark: SparkSession, docs: DataFrame, *, name: str = "spelling", exact: int = EXACT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    prepare(spark)
    ws = Workspace(spark, name)
    words = vocabulary(ws, docs)
    sent = words.select("word", "id", "n").mapInArrow(_emit(exact), _ROWS)
    found = _near(sent).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    graded = words.select("id", "n").join(merging(found), "id", "left")
    most = -F.col("best.neg")
    takes: Column = most >= RATIO * F.col("n")
    graded = ws.save(graded.select("id", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.id")).alias("form"), F.when(takes, most).alias("form_n")), "graded")

    at = ws.save(graded.where("form is not null").select("id", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = ws.save(at.join(merging(further), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ws.drop(at)
        at = moved
        if at.where("moved").isEmpty():
            break
    named = words.select("id", "word")
    forms = graded.where("form is not null").select("id", "form").join(at.select("id", "root"), "id")
    spelt = forms.join(merging(named.select(F.col("id").alias("form"), F.col("word").alias("form_word"))), "form").join(merging(named.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root")
    out = words.join(merging(graded.select("id", "n_near", "form_n")), "id").join(merging(spelt.select("id", "form_word", "root_word")), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
