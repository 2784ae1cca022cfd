"""The thin queries that apply the operators to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, extract, licenses, minhash, mixing, neighbours, pii, ppm, prefixes, spelling, sql, tokens, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(spark, _table(spark, folder, "pages"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(spark, _table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.predict(spark, _table(spark, folder, "documents"))


def op4_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(spark, _table(spark, folder, "documents"), name="op4")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_vectors(spark, _table(spark, folder, "embeddings"), cosine=0.93, name="op6")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(spark, _table(spark, folder, "documents"), name="op7")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, folder, "documents"), k=2, percent=80, name="op9")


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(spark, _table(spark, folder, "documents"), name="op10")
    return found.select("doc_id", "license_id", "containment")  # what does not hang on how windows are cut


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spark, _table(spark, folder, "documents"), name="op11")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(spark, _table(spark, folder, "conversations"), name="op12")


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, folder, "pages"), name="op13")


def queries() -> dict[str, Query]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_pii": op2_pii,
        "op3_language_id": op3_language_id,
        "op4_token_ids": op4_token_ids,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_mixing": op7_mixing,
        "op8_decontamination": op8_decontamination,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_license_scan": op10_license_scan,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_html_extraction": sql.EXTRACTION,
        "op6_embedding_dedup": sql.NEIGHBOURS,
        "op9_minhash_dedup": sql.NEAR_DUPLICATES,
        "op10_license_scan": sql.LICENCES,
        "op11_spelling_variants": sql.SPELLING,
        "op12_prefix_trie": sql.PREFIXES,
        "op13_warc": sql.ARCHIVE,
    }
