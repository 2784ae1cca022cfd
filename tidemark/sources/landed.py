"""Fetched payloads that were landed in a shared folder, as a data source of their own.

``land`` writes one file a payload, in shard folders; ``LandedPayloads`` reads
them back, a partition a shard, with what became of each fetch as a row; what was
wanted and never landed is a row as well.  The folder is a mount that every
executor has.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, status string, body string, error string"
_BODY, _ERROR = ".body", ".error"
_NAMELESS = "%"  #: the file of the empty key, which no quoted key is called


class Shard(InputPartition):
    def __init__(self, folder: str) -> None:
        super().__init__(folder)
        self.folder = folder


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Shard]:
        return [Shard(e.path) for e in sorted(os.scandir(self.path), key=lambda e: e.name) if e.is_dir()]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if getattr(partition, "folder", None) is None:  # a folder without shards
            return
        for entry in sorted(os.scandir(partition.folder), key=lambda e: e.name):
            name, kind = os.path.splitext(entry.name)
            if kind not in (_BODY, _ERROR):
                continue
            key = "" if name == _NAMELESS else unquote(name)
            with open(entry.path, "rb") as f:
                raw = f.read()
            if kind == _ERROR:
                yield key, "failed", None, raw.decode("utf-8", "replace")
                continue
            try:
                body = raw.decode("utf-8")
            except UnicodeDecodeError as problem:
                yield key, "failed", None, f"not UTF-8: {problem.reason}"
                continue
            yield key, "ok" if body else "empty", body or None, None


class LandedPayloads(DataSource):
    """``spark.read.format("landed_payloads").load(folder)``; a partition a shard."""

    @classmethod
    def name(cls) -> str:
        return "landed_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].removeprefix("file://"))


def land(fetched: DataFrame, folder: str, shards: int = 64) -> None:
    """Write ``fetched`` (key, body, error), one file a key; a key landed again replaces its file, and an error its body."""
    target = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for batch in batches:
            for key, body, error, shard in zip(batch["key"], batch["body"], batch["error"], batch["shard"], strict=True):
                place = os.path.join(target, f"{shard:05d}")
                os.makedirs(place, exist_ok=True)
                kind, other, text = (_BODY, _ERROR, body or "") if error is None else (_ERROR, _BODY, error)
                path = os.path.join(place, quote(key, safe="") or _NAMELESS)
                with open(f"{path}.part{os.getpid()}", "wb") as f:
                    f.write(text.encode())
                os.replace(f"{path}.part{os.getpid()}", path + kind)  # whole or not at all, however often a task runs
                if os.path.exists(path + other):
                    os.remove(path + other)
                n += 1
        yield pd.DataFrame({"n": [n]})

    text = lambda c: F.col(c).cast("string").alias(c)
    os.makedirs(target, exist_ok=True)
    rows = fetched.where("key is not null").select(text("key"), text("body"), text("error"), F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(shards)).cast("int").alias("shard"))
    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def landed(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(key, status, body, error) of every wanted key: ok, empty, failed, or absent."""
    spark.dataSource.register(LandedPayloads)
    found = spark.read.format("landed_payloads").load(folder)
    keys = wanted.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    out = keys.join(found, "key", "left")
    return out.select("key", F.coalesce("status", F.lit("absent")).alias("status"), "body", "error")


def verdict(rows: DataFrame) -> DataFrame:
    """(verdict, wanted, ok, empty, failed, absent): unreachable if a fetch failed or nothing live came back, incomplete if some came back empty, else complete; absent keys are counted beside it."""
    n = rows.groupBy().agg(F.count("*").alias("wanted"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("ok", "empty", "failed", "absent")])
    said = F.when((F.col("failed") > 0) | ((F.col("empty") > 0) & (F.col("ok") == 0)), "unreachable").when(F.col("empty") > 0, "incomplete").otherwise("complete")
    return n.select(said.alias("verdict"), "*")


def first_links(body: Column, pattern: str, most: int) -> Column:
    """The first ``most`` different targets of a page's links, in order: repeats go before the limit counts."""
    return F.slice(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1))), 1, most)


def document_pages(rows: DataFrame, strip) -> DataFrame:
    """(key, page, page_text) of documents (key, body): pages cut by form feeds, or a page of markup as one, stripped by ``strip``."""
    paged = F.contains("body", F.lit("\f"))
    texts = F.when(paged, F.split("body", "\f")).otherwise(F.array(F.when(F.col("body").rlike(r"<[A-Za-z!/][^>]*>"), strip(F.col("body"))).otherwise(F.col("body"))))
    return rows.where("body is not null").select("key", F.posexplode(texts).alias("page", "page_text")).withColumn("page", F.col("page") + 1)
