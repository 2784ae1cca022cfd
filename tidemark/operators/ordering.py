"""Numbers in an order, and counts over two orders, for groups of any size.

A window over a group puts the whole group into one task.  Here rows are dealt
in ranges; each range numbers its own rows, and what came before is a sum over
ranges, one row a range and group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.settle import settled

BLOCK = 1024  #: points of one block of an order


def running(rows: DataFrame, by: list[str], order: list[Column | str], weight: str, into: str = "running") -> DataFrame:
    """``rows`` with the sum of ``weight`` (whole numbers) over the rows up to each in ``order`` within ``by``, itself included.

    ``order`` must leave no ties that matter; an empty table stays empty.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id())
    return _carried(settled(dealt), by, ["_part"], Window.partitionBy("_part", *by).orderBy(*order), weight, into).drop("_part")


def _carried(rows: DataFrame, by: list[str], part: list[str], inside: Window, weight: str, into: str) -> DataFrame:
    own = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*part, *by).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*part, *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return rows.withColumn("_own", own).join(before, [*part, *by]).withColumn(into, F.col("_own") + F.col("_before")).drop("_own", "_before")


def following(rows: DataFrame, by: list[str], order: list[str], column: str, into: str) -> DataFrame:
    """``rows`` with the ``column`` of the next row in ``order`` (columns) within ``by``; null at a group's end."""
    dealt = settled(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = F.lead(column).over(Window.partitionBy("_part", *by).orderBy(*order))
    firsts = dealt.groupBy("_part", *by).agg(F.min(F.struct(*order, F.col(column).alias("_first"))).getField("_first").alias("_first"))
    after = firsts.select("_part", *by, F.lead("_first").over(Window.partitionBy(*by).orderBy("_part")).alias("_after"))
    last = F.lead(F.lit(1)).over(Window.partitionBy("_part", *by).orderBy(*order)).isNull()
    out = dealt.withColumns({"_next": inside, "_last": last}).join(after, ["_part", *by], "left")
    return out.withColumn(into, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))).drop("_part", "_next", "_last", "_after")


def file_positions(scan: DataFrame, into: str = "position") -> DataFrame:
    """A file scan's rows with their place in their file, from 0, in whatever splits it is read.

    Rows of one split are numbered where they are read; a split's start is a sum
    over the splits before it.  ``scan`` is read straight from a file source.
    """
    placed = scan.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id(), "_one": F.lit(1)})
    placed = settled(placed)
    out = _carried(placed, ["_file"], ["_start"], Window.partitionBy("_file", "_start").orderBy("_id"), "_one", into)
    return out.withColumn(into, F.col(into) - 1).drop("_file", "_start", "_id", "_one")


def _inside(x: np.ndarray, y: np.ndarray, upto_x: np.ndarray, upto_y: np.ndarray) -> np.ndarray:
    """How many points (x, y) are at most each (upto_x, upto_y)."""
    out = np.empty(len(upto_x), np.int64)
    for k in range(0, len(out), 2048):
        rows = slice(k, k + 2048)
        out[rows] = ((x[None, :] <= upto_x[rows, None]) & (y[None, :] <= upto_y[rows, None])).sum(1)
    return out


def dominated(points: DataFrame, queries: DataFrame, by: list[str], key: list[str], block: int = BLOCK) -> DataFrame:
    """(*by, *key, dominated): for each of ``queries`` (*by, *key, r, t) the ``points`` (*by, p, s) with p <= r and s <= t.

    p and s number a group's points from 1.  Both orders are cut into blocks:
    whole blocks are counted over a grid of (block, block) totals, and what is
    left of a query is one block of either order, where points and queries of
    that block meet.  Blocks that many queries end in are dealt over several
    tasks.  The cost is a block a query, not a group.
    """
    points = points.select(*by, "p", "s", F.floor((F.col("p") - 1) / block).alias("pb"), F.floor((F.col("s") - 1) / block).alias("sb"))
    # both sides may come from one table, so one of them gets columns of its own
    queries = queries.select(*[F.col(c).alias(c) for c in (*by, *key)], "r", "t", F.floor(F.col("r") / block).alias("rb"), F.floor(F.col("t") / block).alias("tb"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*by).schema)

    def grid(cells: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame([], columns=[*by, "rb", "tb", "n"])
        total = np.zeros((int(max(cells["pb"].max() if len(cells) else 0, wanted["rb"].max())) + 2, int(max(cells["sb"].max() if len(cells) else 0, wanted["tb"].max())) + 2), np.int64)
        total[cells["pb"].to_numpy(int) + 1, cells["sb"].to_numpy(int) + 1] = cells["n"]
        total = total.cumsum(0).cumsum(1)
        return wanted.assign(n=total[wanted["rb"].to_numpy(int), wanted["tb"].to_numpy(int)])[[*by, "rb", "tb", "n"]]

    cells = points.groupBy(*by, "pb", "sb").agg(F.count("*").alias("n"))
    whole = queries.select(*by, "rb", "tb").distinct()
    whole = cells.groupBy(*by).cogroup(whole.groupBy(*by)).applyInPandas(grid, f"{names}, rb long, tb long, n long")
    found = queries.join(whole, [*by, "rb", "tb"]).select(*by, *key, "n")

    # the two strips that the grid leaves: the query's last block of s below its blocks of p, and its last block of p
    ends = queries.select(*by, *key, F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col("tb").alias("at"), F.col("t").alias("x"), (F.col("rb") - 1).alias("y")),
        F.struct(F.lit("p").alias("side"), F.col("rb").alias("at"), F.col("r").alias("x"), F.col("t").alias("y")),
    )).alias("e")).select(*by, *key, "e.*")
    parts = points.select(*by, F.explode(F.array(
        F.struct(F.lit("s").alias("side"), F.col("sb").alias("at"), F.col("s").alias("x"), F.col("pb").alias("y")),
        F.struct(F.lit("p").alias("side"), F.col("pb").alias("at"), F.col("p").alias("x"), F.col("s").alias("y")),
    )).alias("e")).select(*by, "e.*")
    shares = ends.groupBy(*by, "side", "at").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("shares"))
    ends = ends.join(shares, [*by, "side", "at"]).withColumn("share", F.pmod(F.xxhash64(*key), F.col("shares")).cast("int")).drop("shares")
    parts = parts.join(shares, [*by, "side", "at"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def strip(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if queries.empty:
            return pd.DataFrame([], columns=[*by, *key, "n"])
        n = _inside(*(points[c].to_numpy(np.int64) for c in "xy"), *(queries[c].to_numpy(np.int64) for c in "xy"))
        return queries.assign(n=n)[[*by, *key, "n"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*by, *key).schema) + ", n long"
    sides = [*by, "side", "at", "share"]
    strips = parts.groupBy(*sides).cogroup(ends.groupBy(*sides)).applyInPandas(strip, schema)
    return found.unionByName(strips).groupBy(*by, *key).agg(F.sum("n").alias("dominated"))
