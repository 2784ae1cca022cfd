"""A training-data pipeline: language, near-duplicates, benchmark leaks, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, ppm, tokens
from tidemark.llm.store import Workspace, fresh, merging


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or without a clear language go.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    return ppm.keep_identified(spark, docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one of least doc_id.

    Documents without words, which are near no other, stay, as do rows without a
    doc_id.  Rows that share a doc_id are one document: it stays or goes whole,
    and of its rows of equal text one stays, the least by the other columns.
    Columns of whatever name pass through; an empty table stays empty.
    """
    ws = Workspace(spark, "deduplicate")
    found = minhash.near_duplicates(spark, docs, k=5, percent=80, ws=ws)
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = ws.save(kept, "kept")
    ws.clear(kept)
    name = fresh("kept", docs.columns)
    out = docs.join(merging(kept.select(F.col("doc_id").alias(name))), F.col("doc_id").cast("long") == F.col(name), "left_semi")
    if not kept.where("n > 1").isEmpty():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        row = fresh("row", docs.columns)
        # a partially aggregated minimum, however many the repeats are
        least = out.groupBy("doc_id", "text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)])).alias(row))
        out = least.select(*[F.col(c) if c in ("doc_id", "text") else F.col(row).getField(c).alias(c) for c in docs.columns])
    nameless = docs.where(F.col("doc_id").isNull())
    return out.unionByName(nameless)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark or table takes and gives nothing.
    """
    return decontaminate.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them.

    A null source is one, last in order; null and empty texts count no words; an empty table stays empty.
    """
    return mixing.take(spark, docs, name="pipeline7")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files say of each document.

    Null and empty texts hold the end id alone; a null doc_id sorts first; copies follow each other; an empty table gives no rows.
    """
    return tokens.round_trip(spark, docs, name="pipeline4")


STAGES = [
    ("language", language),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", tokenised),
]

#: No stage can be stated in SQL: each holds a trained model, hashing or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read, docs = docs, ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
