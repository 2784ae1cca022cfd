"""Token ids in flat binary files.

Format.  A run writes shards.  Shard s has ``s.ids``, the ids of its documents
laid end to end as little-endian unsigned integers (16 bits where the vocabulary
allows, else 32), and ``s.off``, unsigned 64-bit offsets: document d of the
shard owns ids off[d] to off[d + 1].  ``s.doc`` holds the documents' integer
ids.  Shards cover ascending ranges of doc_id in the order of their names and
documents ascend within a shard, so the shards read in order are the whole
corpus in ascending doc_id order.  ``manifest`` is a Parquet table of one row a
shard: its name, documents, ids, width in bytes and base, the ids of all shards
before it, which is a prefix sum of the shards' sizes.  Readers memory-map the
files; ``TokenFiles`` does so without Spark.

A task writes its shard under a name of its own and renames it at the end, so a
task that is lost or runs twice leaves whole files only.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Workspace, local_path, prepare

END_ID = 1  #: appended to each document
CACHE_WORDS = 1_200_000  #: words whose ids a worker remembers, about 200 bytes each
SHARD_ROWS = 8192  #: documents of a shard, about
_SPACE = " \t\n\r"


class WordEncoder:
    """Ids of whole texts, exactly as the tokenizer gives them.

    The vocabulary's pre-tokenizer never crosses white space, which it drops, so
    a text's ids are those of its white-space separated words in turn, and words
    repeat: their ids are remembered.  Words that are not remembered are encoded
    together, plain words in one call: the last id of each carries the mark of a
    word's end.  A tokenizer without such marks is asked for whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max([*vocabulary.values(), END_ID]) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.ends[at] = token.endswith("</w>")
        self.by_word = bool(self.ends.any())
        self.known: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        if plain:
            ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                raw, begin = ids.tobytes(), 0
                for word, end in zip(plain, (cuts * self.dtype.itemsize).tolist(), strict=True):
                    self.known[word] = raw[begin:end]
                    begin = end
            else:
                for word in plain:
                    self.known[word] = self._raw(word)
        rest = [w for w in words if not w.isalpha()]
        if rest:
            for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.known[word] = np.array(found.ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian bytes, without the end id."""
        if not self.by_word:
            return self._raw(text)
        for c in _SPACE[1:]:
            if c in text:
                text = text.replace(c, " ")
        words = text.split(" ")
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        known[""] = b""
        missing = set(words).difference(known)
        if missing:
            self._learn(list(missing))
        return b"".join(map(known.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, rows_per_shard: int = SHARD_ROWS) -> DataFrame:
    """Write ``docs`` (doc_id, text) and their manifest below ``folder``; the manifest's rows: name, documents, nulls (the first of them, which have no doc_id), ids, width, base.

    Tasks take ranges of (doc_id, hash of the text), so one repeated doc_id is
    dealt over several; each cuts its range into shards of ``rows_per_shard``.
    """
    prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, -(-source.count() // rows_per_shard))
    target = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(target, exist_ok=True)
        encoder = _encoder(tokenizer)
        end = np.array([END_ID], encoder.dtype).tobytes()
        task, number, ids, tmp = TaskContext.get().partitionId(), 0, None, ""
        offsets, documents, nulls = [0], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, number, offsets, documents, nulls
            ids.close()
            name = f"{task:08d}-{number:06d}"
            np.array(offsets, "<u8").tofile(f"{tmp}.off")
            np.array(documents, "<i8").tofile(f"{tmp}.doc")
            for kind in ("off", "doc", "ids"):
                os.replace(f"{tmp}.{kind}", f"{target}/{name}.{kind}")
            row = pa.RecordBatch.from_arrays([pa.array(x) for x in ([name], [len(documents)], [nulls], [offsets[-1]], [encoder.dtype.itemsize])], names=["name", "documents", "nulls", "ids", "width"])
            ids, number, offsets, documents, nulls = None, number + 1, [0], [], 0
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if ids is None:
                    tmp = f"{target}/.{uuid.uuid4().hex}"
                    ids = open(f"{tmp}.ids", "wb")  # noqa: SIM115
                raw = encoder.encode(text.as_py()) + end
                ids.write(raw)
                offsets.append(offsets[-1] + len(raw) // encoder.dtype.itemsize)
                documents.append(0 if doc is None else doc)
                nulls += doc is None  # they come first, so their number tells which they are
                if len(documents) == rows_per_shard:
                    yield close()
        if ids is not None:
            yield close()

    order = F.col("doc_id").asc_nulls_first()
    placed = source.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, order, "h").sortWithinPartitions(order, "h", "text")
    sizes = f"{folder}/sizes"
    placed.select("doc_id", "text").mapInArrow(run, "name string, documents long, nulls long, ids long, width long").write.mode("overwrite").parquet(sizes)
    # one row a shard: names ascend as doc_ids do, and a base is the prefix sum of the sizes before
    before = F.sum("ids").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))
    manifest = spark.read.parquet(sizes).withColumn("base", F.coalesce(before, F.lit(0)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class TokenFiles:
    """Written token files, opened without a Spark session: ``documents`` and their ids by place in ascending doc_id order."""

    def __init__(self, folder: str) -> None:
        import pyarrow.parquet as pq

        self.folder = local_path(folder)
        self.shards = pq.read_table(f"{self.folder}/manifest").sort_by("name").to_pylist()
        self.firsts = np.cumsum([0] + [s["documents"] for s in self.shards])

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def __getitem__(self, at: int) -> tuple[int | None, int, np.ndarray]:
        """(doc_id, ids of all documents before it, its ids) of one document."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        n = int(np.searchsorted(self.firsts, at, "right")) - 1
        documents, offsets, ids = mapped(self.folder, self.shards[n])
        k = at - int(self.firsts[n])
        return None if k < self.shards[n]["nulls"] else int(documents[k]), self.shards[n]["base"] + int(offsets[k]), ids[int(offsets[k]) : int(offsets[k + 1])]


def mapped(folder: str, shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, offsets, ids) of one shard, mapped."""
    stem = f"{folder}/{shard['name']}"
    return np.memmap(f"{stem}.doc", "<i8", "r"), np.memmap(f"{stem}.off", "<u8", "r"), np.memmap(f"{stem}.ids", f"<u{shard['width']}", "r")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the memory-mapped files."""
    prepare(spark)
    target = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                documents, offsets, ids = mapped(target, row)
                documents, offsets = np.array(documents), offsets.astype(np.int64)
                crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, len(documents))
                yield pa.RecordBatch.from_arrays([pa.array(documents, mask=np.arange(len(documents)) < row["nulls"]), pa.array(row["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a shard: dealt out, so that each task maps a few
    spread = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    return shards.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, name: str = "tokens") -> DataFrame:
    """Write ``docs`` as token ids and return what the files say of each document.

    Defined cases: null and empty texts hold the end id alone; a null doc_id
    sorts first; rows that repeat a doc_id follow each other, ordered by the hash
    of their text;
    an empty table gives no files and no rows; further columns are ignored.
    """
    ws = Workspace(spark, name)
    folder = ws.path("ids")
    return read(spark, folder, write(spark, docs, folder, tokenizer or tokenizer_path()))
