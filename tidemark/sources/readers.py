"""Scans: declared schemas, vintages, absent reports, curated files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class MissingColumns(ValueError):
    """A file lacks required columns."""


class SourceUnreachable(RuntimeError):
    """No fetch of a batch returned anything."""


def csv_strings(spark: SparkSession, path: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with every cell as text: a blank stays an empty string, nothing is inferred.

    Columns come from the header; required ones that it lacks refuse the scan,
    and optional ones that it lacks are added as empty strings.
    """
    header = spark.read.csv(path, header=True, inferSchema=False).columns
    lacking = [c for c in required if c not in header]
    if lacking:
        raise MissingColumns(f"{path} lacks {', '.join(lacking)}")
    schema = StructType([StructField(c, StringType()) for c in header])
    rows = spark.read.csv(path, header=True, schema=schema, nullValue="\u0000", emptyValue="", enforceSchema=False)
    rows = rows.na.fill("")
    for c in optional:
        if c not in header:
            rows = rows.withColumn(c, F.lit(""))
    return rows


class VintageCutOff(ValueError):
    """A vintage's rows are not those that its writer committed."""


def vintage(spark: SparkSession, path: str, stamp: str, wanted: DataFrame, key: str = "source_ticker") -> tuple[DataFrame, DataFrame]:
    """(rows of the vintage for the wanted keys, keys of which there are none); the vintage is a partition, so others are not read.

    Refused if the vintage has no commit marker or not as many rows as it says.
    """
    rows = spark.read.parquet(path).where(F.col("vintage") == stamp)
    try:
        told = spark.read.schema("vintage string, rows long").json(f"{path}/_committed/{stamp}").collect()
    except AnalysisException:
        told = []
    if not told or told[0]["rows"] != rows.count():  # counted from file footers
        raise VintageCutOff(f"{path}: vintage {stamp} was not committed whole")
    rows = rows.join(wanted.select(key).distinct(), key, "left_semi")
    return rows, wanted.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti")


def batch_verdict(fetches: DataFrame) -> str:
    """'unreachable' if every live fetch (ticker, rows, error) failed or is empty, 'complete' if none is empty; otherwise refuses."""
    a = fetches.agg(F.count("*").alias("n"), F.count(F.when(F.col("error").isNotNull() | (F.coalesce("rows", F.lit(0)) == 0), 1)).alias("bad"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("errors")).collect()[0]
    if a["n"] and (a["errors"] or a["bad"] == a["n"]):
        raise SourceUnreachable("the source gave nothing")
    if a["bad"]:
        names = [r["ticker"] for r in fetches.where("rows = 0").orderBy("ticker").limit(20).collect()]
        raise ValueError(f"no rows for {', '.join(names)}")
    return "complete"


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, page_text) of a folder of cached texts whose pages are cut by form feeds."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\f")).alias("page", "page_text")).withColumn("page", F.col("page") + 1)


def yaml_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list under ``key`` of a small YAML file as rows of a declared schema; unknown keys refuse."""
    import yaml

    with open(path, encoding="utf-8") as f:
        items = (yaml.safe_load(f) or {}).get(key) or []
    frame = spark.createDataFrame([], schema)
    strange = {k for item in items for k in item} - set(frame.columns)
    if strange:
        raise ValueError(f"unknown keys in {path}: {', '.join(sorted(strange))}")
    return spark.createDataFrame([tuple(item.get(c) for c in frame.columns) for item in items], schema)
