"""Dose-response: do effects grow with exposure, within events?

The fixed-effects estimate needs no design matrix: demeaning within events
leaves a small Gram matrix of sums (Frisch-Waugh-Lovell), which one grouped
aggregate gives at any size.  Controls, clusters by group and resampling are in
``regression`` and ``resampling``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import inverse_normal


class NotIdentified(ValueError):
    """The exposure does not vary within any event."""


def demean(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Columns less their mean within the group, as ``<name>_d``."""
    means = rows.groupBy(by).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    out = rows.join(means, by)
    return out.withColumns({f"{c}_d": F.col(c) - F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def complete_cases(rows: DataFrame, *required: str) -> DataFrame:
    """Rows that have all of the required figures; NaN counts as missing."""
    return rows.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in required}).na.drop(subset=list(required))


def check_identified(rows: DataFrame, exposure: str = "exposure") -> None:
    """Refuse if the exposure's largest deviation within an event is not positive."""
    spread = rows.groupBy("event_id").agg(F.coalesce(F.stddev_samp(exposure), F.lit(0.0)).alias("s")).agg(F.max("s").alias("s")).collect()[0]["s"]
    if not spread or spread <= 0:
        raise NotIdentified(f"{exposure} does not vary within any event")


def slope(rows: DataFrame, exposure: str = "exposure", *by: str) -> DataFrame:
    """(by..., n, beta): fixed-effects slope of car on one exposure."""
    d = demean(rows, "event_id", "car", exposure)
    x, y = F.col(f"{exposure}_d"), F.col("car_d")
    return d.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("beta"))


def cluster_scores(rows: DataFrame, beta: DataFrame, exposure: str = "exposure") -> DataFrame:
    """(event_id, score): the sum over each event of demeaned exposure times residual."""
    d = demean(rows, "event_id", "car", exposure).crossJoin(beta.select("beta"))
    x = F.col(f"{exposure}_d")
    return d.groupBy("event_id").agg(F.sum(x * (F.col("car_d") - F.col("beta") * x)).alias("score"), F.sum(x * x).alias("sxx"), F.count("*").alias("n"))


def cluster_error(rows: DataFrame, exposure: str = "exposure") -> DataFrame:
    """(n, clusters, beta, se, t): slope with its cluster-robust error; parameters count the event dummies."""
    beta = slope(rows, exposure)
    s = cluster_scores(rows, beta, exposure).agg(F.sum(F.col("score") * F.col("score")).alias("meat"), F.sum("sxx").alias("sxx"), F.count("*").alias("g"), F.sum("n").alias("n"))
    k = F.col("g") + 1
    factor = F.col("g") / F.greatest(F.col("g") - 1, F.lit(1)) * (F.col("n") - 1) / F.greatest(F.col("n") - k, F.lit(1))
    se = F.sqrt(factor * F.col("meat")) / F.nullif("sxx", F.lit(0.0))
    out = s.crossJoin(beta.select("beta")).select("n", F.col("g").alias("clusters"), "beta", se.alias("se"))
    return out.withColumn("t", F.col("beta") / F.nullif("se", F.lit(0.0)))


def row_weights(rows: DataFrame, exposure: str = "exposure") -> DataFrame:
    """(event_id, unit_id, weight): each row's share in the demeaned exposure's squares, what identifies the slope."""
    d = demean(rows, "event_id", exposure)
    total = d.agg(F.sum(F.col(f"{exposure}_d") * F.col(f"{exposure}_d")).alias("_t"))
    return d.crossJoin(total).select("event_id", "unit_id", (F.col(f"{exposure}_d") * F.col(f"{exposure}_d") / F.nullif("_t", F.lit(0.0))).alias("weight"))


def effective_rows(weights: DataFrame, *by: str) -> DataFrame:
    """(by..., rows, effective): inverse Herfindahl of the weights."""
    w = weights.groupBy(*by, "event_id", "unit_id").agg(F.sum("weight").alias("w"))
    return w.groupBy(*by).agg(F.count("*").alias("rows"), (F.sum("w") * F.sum("w") / F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("effective"))


def p_floor(clusters: int, draws: int, points: int = 2) -> float:
    """Least p that a wild bootstrap can give: enumeration 2 / points**clusters, or 1 / (draws + 1)."""
    return max(min(math.exp(max(math.log(2) - clusters * math.log(points), -745.0)), 1.0), 1.0 / (draws + 1))


#: Two-point and six-point resampling weights.
WEIGHTS = {"rademacher": (-1.0, 1.0), "webb": (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))}


def minimum_detectable(error: DataFrame, alpha: float = 0.05, power: float = 0.8, inflation: float = 1.0) -> DataFrame:
    """(se, mde): the slope that is found with the given power, from the cluster-robust error."""
    z = inverse_normal(1 - alpha / 2) + inverse_normal(power)
    return error.select("se", (F.col("se") * z * inflation).alias("mde"))
