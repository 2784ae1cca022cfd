"""Resampled inference of a dose-response slope, from sums by cluster and by event.

A draw of the wild cluster bootstrap multiplies each cluster's restricted
residuals by one weight, so its slope and its error hang only on a few sums of
each cluster: draws never see a row.  A permutation within events leaves all
sums of squares as they are up to the controls' part, so an event gives a few
sums for each draw and draws are totals over events.  One event's units are one
group for each chunk of draws; nothing else is gathered.  Draws are a function of
seed, name and number, so that they repeat however they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import draws as U
from tidemark.functions.tails import t_two_sided
from tidemark.operators.dose import WEIGHTS, NotIdentified, complete_cases, p_floor
from tidemark.operators.regression import demeaned

CHUNK = 500  #: draws of one task
ROUNDING = 1e-9  #: a statistic this close to the observed one equals it


class _Fit:
    """Sums of a fit with ``size - 1`` controls: by cluster, and what follows for any weights."""

    def __init__(self, sums: pd.DataFrame, size: int, events: int) -> None:
        stack = lambda name: np.array(sums[name].tolist(), float)
        xx, xy = stack("xx").reshape(-1, size, size), stack("xy").reshape(-1, size)
        whole, self.n, self.events, self.size = xx.sum(0), int(sums["n"].sum()), events, size
        self.inverse = np.linalg.pinv(whole[1:, 1:], hermitian=True) if size > 1 else np.zeros((0, 0))
        gamma = self.inverse @ whole[1:, 0]  # of the exposure on the controls
        self.delta = self.inverse @ xy.sum(0)[1:]  # of the effect on the controls: no exposure, events removed
        # sums over each cluster of pure exposure p = x - C gamma and restricted residual r = y - C delta
        self.cr = xy[:, 1:] - xx[:, 1:, 1:] @ self.delta
        xr = xy[:, 0] - xx[:, 0, 1:] @ self.delta
        self.pr = xr - self.cr @ gamma
        self.pc = xx[:, 0, 1:] - np.einsum("gij,i->gj", xx[:, 1:, 1:], gamma)
        self.pp = xx[:, 0, 0] - 2 * xx[:, 0, 1:] @ gamma + np.einsum("gij,i,j->g", xx[:, 1:, 1:], gamma, gamma)
        self.total, self.gamma, self.scale = self.pp.sum(), gamma, whole[0, 0]

    def slopes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes and errors for weights [clusters, draws]."""
        beta = self.pr @ w / self.total
        controls = self.inverse @ (self.cr.T @ w)
        scores = self.pr[:, None] * w - self.pp[:, None] * beta - self.pc @ controls
        g = len(self.pr)
        factor = g / max(g - 1, 1) * (self.n - 1) / max(self.n - self.events - self.size, 1)
        return beta, np.sqrt(factor * (scores**2).sum(0)) / self.total


def wild_bootstrap(rows: DataFrame, weights: str, exposure: str = "exposure", controls: tuple[str, ...] = (), draws: int = 2000, seed: int = 20260815) -> DataFrame:
    """(beta, t, p_cluster, p_floor, p_wild, p_random, draws): cluster wild bootstrap under no effect, and permutation within events.

    ``weights`` (rademacher or webb) is never defaulted.  Clusters are
    ``cluster_id`` where the rows have it, else events.  p_wild is (1 + extreme)
    / (draws + 1); p_random the plain share, which may be 0; what equals the
    observed statistic up to rounding counts as extreme.  A cluster's weights
    are drawn from the stream of its name; a permutation orders an event's units
    by a draw from each one's stream, ties by unit.  Refused where the exposure does
    not vary within any event once the controls are taken out.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights are one of {sorted(WEIGHTS)}")
    spark, terms = rows.sparkSession, (exposure, *controls)
    size = len(terms)
    rows = rows if "cluster_id" in rows.columns else rows.withColumn("cluster_id", F.col("event_id"))
    d = demeaned(complete_cases(rows, "car", *terms), terms)
    x = [F.col("x")[i] for i in range(size)]
    sums = d.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array(*[F.sum(v * F.col("y")) for v in x]).alias("xy"), F.array(*[F.sum(u * v) for u in x for v in x]).alias("xx"))
    # one short row a cluster, of which there are no more than events
    table = sums.orderBy("cluster_id").toPandas()
    events = d.select("event_id").distinct().count()
    fit = _Fit(table, size, events) if len(table) else None
    if fit is None or not fit.total > 1e-10 * max(fit.scale, 1e-300):
        raise NotIdentified(f"{exposure} does not vary within any event")
    points = np.array(WEIGHTS[weights])
    beta, se = (float(v[0]) for v in fit.slopes(np.ones((len(table), 1))))
    t0 = beta / se if se > 0 else float("nan")

    streams, step = np.array([U.stream(seed, c) for c in table["cluster_id"]], np.uint64), CHUNK

    def wild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, count in zip(frame["chunk"], frame["size"], strict=True):
                w = points[U.below(U.hashes(streams[:, None], int(number) * step + np.arange(int(count))[None, :]), len(points))]
                b, s = fit.slopes(w)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = b / s
                finite = np.isfinite(t)
                yield pd.DataFrame({"finite": [int(finite.sum())], "wild": [int((np.abs(t[finite]) >= abs(t0) * (1 - ROUNDING)).sum())]})

    chunks = spark.createDataFrame([(n, min(step, draws - n * step)) for n in range(-(-draws // step))], "chunk int, size int")
    boot = chunks.mapInPandas(wild, "finite long, wild long").agg(F.sum("finite").alias("f"), F.sum("wild").alias("w"))

    def permuted(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values("unit_id", kind="stable")
        xs = np.array(task["x"].tolist(), float)
        r = task["y"].to_numpy() - xs[:, 1:] @ fit.delta
        event, first = task["event_id"].iloc[0], int(task["chunk"].iloc[0]) * step
        own = np.array([U.stream(seed, event, unit) for unit in task["unit_id"]], np.uint64)
        numbers = np.arange(first, min(first + step, draws))
        out = np.empty((len(numbers), size))
        few = max(2_000_000 // len(xs), 1)  # draws at a time
        for n in range(0, len(numbers), few):
            moved = xs[np.argsort(U.hashes(own[None, :], numbers[n : n + few, None]), axis=1, kind="stable"), 0]
            out[n : n + few, 0], out[n : n + few, 1:] = moved @ r, moved @ xs[:, 1:]
        return pd.DataFrame({"draw": numbers, "s": out.tolist()})

    dealt = d.select("event_id", "unit_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // step))).alias("chunk"))
    by_event = dealt.groupBy("event_id", "chunk").applyInPandas(permuted, "draw int, s array<double>")
    totals = by_event.groupBy("draw").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("s"))
    inverse, scale = fit.inverse.reshape(-1).tolist(), float(fit.scale)
    part = sum((F.col("s")[1 + i] * F.col("s")[1 + j] * inverse[i * (size - 1) + j] for i in range(size - 1) for j in range(size - 1)), F.lit(0.0))
    shuffled = totals.agg(F.count(F.when(F.abs(F.col("s")[0] / F.nullif(F.lit(scale) - part, F.lit(0.0))) >= abs(beta) * (1 - ROUNDING), 1)).alias("r"), F.count("*").alias("n"))
    constants = {"beta": beta, "t": t0, "p_cluster": t_two_sided(t0, max(len(table) - 1, 1)), "p_floor": p_floor(len(table), draws, len(points))}
    found = boot.crossJoin(shuffled)
    return found.select(*[F.lit(v).alias(k) for k, v in constants.items()], ((1 + F.col("w")) / (F.col("f") + 1)).alias("p_wild"), (F.col("r") / F.col("n")).alias("p_random"), F.col("n").alias("draws"))


def verdicts(result: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(..., headline_p, detectable, at_the_floor): the bootstrap's p is the headline, and means nothing where its floor is over alpha."""
    return result.select("*", F.col("p_wild").alias("headline_p"), (F.col("p_floor") <= alpha).alias("detectable"), (F.col("p_wild") <= F.col("p_floor") * 1.0001).alias("at_the_floor"))
