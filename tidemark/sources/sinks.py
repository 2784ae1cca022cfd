"""Sinks: vintages, single files, templates, Markdown."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_vintage(rows: DataFrame, path: str) -> None:
    """Parquet partitioned by the rows' vintage; vintages that the rows hold are replaced whole, others are not touched.

    A marker with each vintage's rows is written last, under ``_committed``; a
    vintage whose rows do not match its marker was cut off and is refused when
    read (``readers.vintage``).  Rows without a vintage are refused.
    """
    counts = rows.groupBy(F.col("vintage").cast("string").alias("vintage")).agg(F.count("*").alias("rows")).collect()  # one row a vintage
    if any(r["vintage"] is None for r in counts):
        raise ValueError("rows without a vintage")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vintage").parquet(path)
    for r in counts:
        rows.sparkSession.createDataFrame([(r["vintage"], r["rows"])], "vintage string, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/_committed/{r['vintage']}")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_scalars(rows: DataFrame, path: str) -> None:
    """The scalar fields of a one-row result as JSON."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a scalar result has one row")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: v for k, v in found[0].asDict().items() if isinstance(v, (int, float, str, bool))}, f, indent=1, sort_keys=True)


def write_template(path: str, columns: tuple[str, ...], overwrite: bool = False) -> None:
    """A CSV with a header only; an existing file is not touched unless told so."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(columns) + "\n")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A Markdown table of the first rows of a report: four decimals, a dash for missing, a note if empty, and how many rows were left out."""
    found = rows.limit(most + 1).collect()
    if not found:
        return "_(no rows)_"

    def cell(v) -> str:
        if v is None or (isinstance(v, float) and v != v):
            return "—"
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in found[:most]]
    if len(found) > most:
        lines += ["", f"_({rows.count() - most} more rows)_"]
    return "\n".join(lines)


def ensure_folders(*paths: str) -> None:
    """Folders that reports and tables are written to, made where they are missing."""
    for path in paths:
        os.makedirs(path, exist_ok=True)
