"""Small dense estimators that SQL cannot state, run as grouped Arrow functions keyed by task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import draws as U


def simplex_projection(v: np.ndarray) -> np.ndarray:
    """The nearest point whose parts are not negative and sum to 1."""
    u = np.sort(v)[::-1]
    total = np.cumsum(u) - 1
    k = np.flatnonzero(u - total / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - total[k] / (k + 1), 0.0)


def _active_set(gram: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The least of w'Gw / 2 - t'w on the simplex by adding the weight of steepest descent and dropping those that turn negative; None if it cycles."""
    n = len(target)
    scale = max(float(np.abs(gram).max()), float(np.abs(target).max()), 1e-300)
    first = int(np.argmin(np.diag(gram) / 2 - target))
    w = np.zeros(n)
    w[first] = 1.0
    inside = [first]
    for _ in range(20 * n + 20):
        g = gram @ w - target
        level = float(g[inside].mean())
        out = np.setdiff1d(np.arange(n), inside)
        if not len(out) or (g[out] - level).min() >= -1e-11 * scale:
            w[w < 0] = 0.0
            return w / w.sum()
        inside.append(int(out[np.argmin(g[out])]))
        while True:
            k = len(inside)
            system = np.ones((k + 1, k + 1))
            system[:k, :k], system[k, k] = gram[np.ix_(inside, inside)] / scale, 0.0
            right = np.append(target[inside] / scale, 1.0)
            try:
                z = np.linalg.solve(system, right)[:k]
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(system, right, rcond=None)[0][:k]
            if not np.isfinite(z).all():
                return None
            if (z > 0).all():
                w[:] = 0.0
                w[inside] = z
                break
            now = w[inside]
            bad = z <= 0
            step = float((now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min())
            w[inside] = now + step * (z - now)
            kept = [i for i in inside if w[i] > 1e-13]
            if len(kept) == len(inside) or not kept:
                return None
            w[[i for i in inside if i not in kept]] = 0.0
            inside = kept
    return None


def simplex_least_squares(y: np.ndarray, x: np.ndarray, penalty: float = 0.0, intercept: bool = False, steps: int = 4000) -> tuple[np.ndarray, float]:
    """Weights on the simplex that minimise |y - c - x w|^2 + penalty var(y) |w|^2, and c (0 without ``intercept``).

    By an active set, which ends after about as many small solves as weights are
    positive; where it does not settle, by accelerated projected gradient with
    restarts.  Rows are centred first where an intercept is free, which
    eliminates it.
    """
    if intercept:
        mx, my = x.mean(0), float(y.mean())
        w, _ = simplex_least_squares(y - my, x - mx, penalty * float(y.var()) / max(float((y - my).var()), 1e-300) if y.var() else penalty, False, steps)
        return w, my - float(mx @ w)
    ridge = penalty * float(y.var())
    return simplex_from_gram(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y, steps), 0.0


def simplex_from_gram(gram: np.ndarray, target: np.ndarray, steps: int = 4000) -> np.ndarray:
    """The least of w'Gw / 2 - t'w on the simplex."""
    if (w := _active_set(gram, target)) is not None:
        return w
    rate = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    w = momentum = np.full(len(target), 1 / len(target))
    t = 1.0
    for _ in range(steps):
        new = simplex_projection(momentum - rate * (gram @ momentum - target))
        if (momentum - new) @ (new - w) > 0:
            t, momentum = 1.0, w
            new = simplex_projection(w - rate * (gram @ w - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, t_new
        if moved < 1e-12:
            break
    w = np.where(w < 1e-10, 0.0, w)
    return w / w.sum()


def estimator_placebos(estimates: DataFrame) -> DataFrame:
    """(event_id, treated, tau, placebos, rank, p_tau, p_floor) of an estimator's effects of all units treated in turn: each against all others."""
    by = F.col("event_id")
    from pyspark.sql.window import Window

    whole, side = Window.partitionBy(by), Window.partitionBy(by).orderBy(F.abs("tau").desc())
    n, rank = F.count("*").over(whole), F.count("*").over(side.rangeBetween(Window.unboundedPreceding, 0))
    return estimates.select("event_id", "treated", "tau", (n - 1).alias("placebos"), rank.alias("rank"), (rank / n).alias("p_tau"), (F.lit(1.0) / n).alias("p_floor"))


def block_bootstrap(ar: DataFrame, gap: int, horizon: int, block: int = 5, draws: int = 2000, seed: int = 20260815) -> DataFrame:
    """(event_id, unit_id, tau, p, low, high): circular blocks of demeaned pre-event returns against the CAR; p may be 0.

    The start of block b of draw d is draw number d * blocks + b of the stream of
    the event and unit; the last block is cut to the steps after the event.
    """

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values("rel")
        pre = task.loc[task["rel"] < -gap, "ar"].to_numpy()
        post = task.loc[(task["rel"] >= 0) & (task["rel"] <= horizon), "ar"].to_numpy()
        if not len(pre) or not len(post) or np.isnan(pre).any() or np.isnan(post).any():
            return pd.DataFrame([], columns=["event_id", "unit_id", "tau", "p", "low", "high"])
        event, unit = task["event_id"].iloc[0], task["unit_id"].iloc[0]
        blocks = -(-len(post) // block)
        running = np.concatenate([[0.0], np.cumsum(np.resize(pre - pre.mean(), len(pre) + block))])
        starts = U.below(U.hashes(U.stream(seed, event, unit), np.arange(draws * blocks)), len(pre)).reshape(draws, blocks)
        lengths = np.full(blocks, block)
        lengths[-1] = len(post) - block * (blocks - 1)
        drawn = (running[starts + lengths] - running[starts]).sum(1)
        tau = float(post.sum())
        return pd.DataFrame({"event_id": [event], "unit_id": [unit], "tau": [tau], "p": [float((np.abs(drawn) >= abs(tau)).mean())], "low": [float(np.quantile(drawn, 0.025))], "high": [float(np.quantile(drawn, 0.975))]})

    return ar.groupBy("event_id", "unit_id").applyInPandas(run, "event_id string, unit_id string, tau double, p double, low double, high double")


def leverage(rows: DataFrame, exposure: str = "exposure") -> DataFrame:
    """(event_id, unit_id, hat, cook): leverage and Cook's distance with event effects.

    With one exposure and event dummies a row's hat value is 1 / event size +
    its share in the demeaned squares, so both are expressions over sums.
    """
    by = rows.groupBy("event_id").agg(F.avg(exposure).alias("_x"), F.avg("car").alias("_y"), F.count("*").alias("_n"))
    d = rows.join(by, "event_id").withColumn("x", F.col(exposure) - F.col("_x")).withColumn("y", F.col("car") - F.col("_y"))
    total = d.agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"), F.count_distinct("event_id").alias("g"))
    d = d.crossJoin(total)
    p = F.col("g") + 1
    hat = F.least(1 / F.col("_n") + F.col("x") * F.col("x") / F.nullif("xx", F.lit(0.0)), F.lit(1 - 1e-12))
    residual = F.col("y") - F.col("xy") / F.nullif("xx", F.lit(0.0)) * F.col("x")
    s2 = (F.col("yy") - F.col("xy") * F.col("xy") / F.nullif("xx", F.lit(0.0))) / F.greatest(F.col("n") - p, F.lit(1))
    return d.select("event_id", "unit_id", hat.alias("hat"), (residual * residual / F.nullif(p * s2, F.lit(0.0)) * hat / ((1 - hat) * (1 - hat))).alias("cook"))


def drop_path(rows: DataFrame, exposure: str = "exposure", ks: tuple[int, ...] = (0, 1, 2, 3, 5)) -> DataFrame:
    """(k, n, beta): the slope without the k units of largest absolute exposure (ties by unit); null where not identified."""
    top = rows.groupBy("unit_id").agg(F.max(F.abs(exposure)).alias("m")).orderBy(F.desc("m"), "unit_id").limit(max(ks))
    from pyspark.sql.window import Window

    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("m"), "unit_id"))).select("unit_id", "place")
    grid = rows.join(placed, "unit_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("place is null or place > k")
    means = grid.groupBy("k", "event_id").agg(F.avg(exposure).alias("_x"), F.avg("car").alias("_y"))
    d = grid.join(means, ["k", "event_id"])
    x, y = F.col(exposure) - F.col("_x"), F.col("car") - F.col("_y")
    return d.groupBy("k").agg(F.count("*").alias("n"), (F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("beta"))
