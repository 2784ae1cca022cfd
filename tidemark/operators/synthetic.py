"""Synthetic controls and synthetic differences in differences of every unit in turn.

Donor weights come from column generation: a problem (a unit treated, perhaps
without one donor) is solved over a few candidate donors, then priced against
all donors of its event in tiles of cross-products, block of problems by block
of donors; donors that would improve it join its candidates, and problems that
none improves are done.  The last pricing is the proof of optimality, and its
figures are a result of their own (``optimality``).  No task holds an event's
panel: a tile has at most about ``BLOCK`` series on a side, a solve the series of
its candidates.

Time weights come from one cross-product matrix an event, (steps + 2) squared,
summed over blocks of units; the problem of a treated unit is that matrix less
its own column's products.

Series are complete cumulative returns; an event's units share their steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.kernels import simplex_from_gram
from tidemark.operators.settle import settled

BLOCK = 512  #: series on a side of a tile
CANDIDATES = 48  #: donors that a problem starts with, and that join it in one round at most
TOLERANCE = 1e-10  #: of a problem's scale
PENALTY = 1e-6  #: ridge of the synthetic control, in variances of the treated series
WEIGHT_FLOOR = 1e-3  #: donors of less weight are not left out in turn

_KEYS = ["event_id", "problem"]


def series(rows: DataFrame, gap: int) -> DataFrame:
    """(event_id, unit_id, rel, y, n_pre, block, blocks) of ``rows`` (event_id, unit_id, rel, ret): one row a unit, cumulative from the window's start."""
    order = Window.partitionBy("event_id", "unit_id").orderBy("rel")
    path = rows.select("event_id", "unit_id", "rel", F.sum("ret").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    whole = path.groupBy("event_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("rel", "y"))).alias("p"))
    whole = whole.select("event_id", "unit_id", F.col("p.rel").alias("rel"), F.col("p.y").alias("y"), F.size(F.filter("p", lambda s: s["rel"] < -gap)).alias("n_pre"))
    count = whole.groupBy("event_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = whole.join(count, "event_id")
    return settled(placed.withColumn("block", F.pmod(F.xxhash64("unit_id"), F.col("blocks")).cast("int")))


def _prices(left: pd.DataFrame, right: pd.DataFrame, first: bool, most: int) -> pd.DataFrame:
    """Donors of a tile that improve its problems: (event_id, problem, unit_id, score, margin), the ``most`` best of each."""
    none = pd.DataFrame([], columns=["event_id", "problem", "unit_id", "score", "margin"])
    if left.empty or right.empty:
        return none
    right = right.sort_values("unit_id", kind="stable")
    units = right["unit_id"].to_numpy()
    at = {u: k for k, u in enumerate(units)}
    x = np.array(right["x"].tolist(), float)
    score = -np.array(left["r"].tolist(), float) @ x.T
    if first:
        score += (x * x).sum(1)[None, :] / 2
    held = [[at[u] for u in [*donors, treated, without] if u in at] for donors, treated, without in zip(left["donors"], left["treated"], left["without"], strict=True)]
    for k, columns in enumerate(held):
        score[k, columns] = np.inf
    margin = score - left["level"].to_numpy(float)[:, None]
    margin = margin / np.maximum(left["scale"].to_numpy(float), 1e-300)[:, None]
    if first or most == 1:
        wanted = np.isfinite(score)
    else:
        wanted = margin < -TOLERANCE
    score = np.where(wanted, score, np.inf)
    k = min(most, len(units))
    best = np.argsort(score, axis=1, kind="stable")[:, :k]
    rows, columns = np.nonzero(np.take_along_axis(wanted, best, 1))
    donors = best[rows, columns]
    return pd.DataFrame({"event_id": left["event_id"].to_numpy()[rows], "problem": left["problem"].to_numpy()[rows], "unit_id": units[donors], "score": score[rows, donors], "margin": margin[rows, donors]})


def _priced(problems: DataFrame, vectors: DataFrame, *, first: bool = False, most: int = CANDIDATES) -> DataFrame:
    """Donors that improve ``problems`` (..., r, level, scale, donors) among ``vectors`` (event_id, unit_id, x, block, blocks), tile by tile."""
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = problems.select("event_id", "problem", "treated", "without", "r", "level", "scale", "donors", F.pmod(F.xxhash64("problem"), F.col("blocks")).cast("int").alias("i"), others.alias("j"))
    right = vectors.select("event_id", "unit_id", "x", F.col("block").alias("j"), others.alias("i"))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _prices(a, b, first, most)

    found = left.groupBy("event_id", "i", "j").cogroup(right.groupBy("event_id", "i", "j")).applyInPandas(tile, "event_id string, problem string, unit_id string, score double, margin double")
    place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("score", "unit_id"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


_SOLVED = "event_id string, problem string, treated string, without string, blocks int, donors array<string>, weights array<double>, r array<double>, path array<double>, level double, scale double"


def _solve(task: pd.DataFrame) -> pd.DataFrame:
    """One problem over its candidates: weights, the residual that prices other donors, and the gap's path over all steps."""
    own, donors = task[task["own"]].iloc[0], task[~task["own"]].sort_values("unit_id", kind="stable")
    out = {name: [own[name]] for name in ("event_id", "problem", "treated", "without", "blocks")}
    target, x = np.array(own["x"], float), np.array(donors["x"].tolist(), float)
    gram = x @ x.T + own["ridge"] * np.eye(len(x))
    w = simplex_from_gram(gram, x @ target)
    inside = np.flatnonzero(w > 0)
    r = target - w[inside] @ x[inside]
    y = np.array(donors["y"].tolist(), float)
    path = np.array(own["y"], float) - w[inside] @ y[inside]
    level = float(w @ (gram @ w - x @ target))
    scale = float(max(target @ target, np.abs(np.diag(gram)).max(), 1e-300))
    return pd.DataFrame(out | {"donors": [donors["unit_id"].to_numpy()[inside].tolist()], "weights": [w[inside].tolist()], "r": [r.tolist()], "path": [path.tolist()], "level": [level], "scale": [scale]})


def simplex_fits(problems: DataFrame, vectors: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Weights on the simplex of ``problems`` (event_id, problem, treated, without, ridge) over all other units' ``vectors`` (event_id, unit_id, x, y, block, blocks).

    Each minimises |x_treated - sum of w x|^2 + ridge |w|^2.  ``start`` (event_id,
    problem, unit_id) are candidates to begin with, as from a fit that differs
    little; without it they are the nearest donors.  A problem without donors has
    no row.
    """
    own = problems.join(vectors.select("event_id", F.col("unit_id").alias("treated"), "x", "y", "blocks"), ["event_id", "treated"])
    own = settled(own.select(*_KEYS, "treated", "without", "ridge", "x", "y", "blocks"))
    if start is None:
        fresh = own.select(*_KEYS, "treated", "without", "blocks", F.col("x").alias("r"), F.lit(0.0).alias("level"), F.lit(1.0).alias("scale"), F.array().cast("array<string>").alias("donors"))
        start = _priced(fresh, vectors, first=True)
    candidates, done = start.select(*_KEYS, "unit_id"), []
    while True:
        donors = candidates.join(vectors.select("event_id", "unit_id", "x", "y"), ["event_id", "unit_id"]).join(own.select(*_KEYS, "treated", "without", "ridge", "blocks"), _KEYS)
        given = own.join(candidates.select(*_KEYS).distinct(), _KEYS, "left_semi").withColumn("unit_id", F.col("treated"))
        columns = [*_KEYS, "treated", "without", "ridge", "blocks", "unit_id", "x", "y"]
        task = donors.select(*columns, F.lit(False).alias("own")).unionByName(given.select(*columns, F.lit(True).alias("own")))
        solved = settled(task.groupBy(*_KEYS).applyInPandas(_solve, _SOLVED))
        better = settled(_priced(solved, vectors))
        open_ = better.select(*_KEYS).distinct()
        done.append(solved.join(open_, _KEYS, "left_anti"))
        if better.isEmpty():
            return reduce(DataFrame.unionByName, done)
        again = solved.join(open_, _KEYS, "left_semi").select(*_KEYS, F.explode("donors").alias("unit_id"))
        candidates = again.unionByName(better.select(*_KEYS, "unit_id"))


def optimality(fits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(event_id, treated, without, gap): what the best single move of weight would gain, at most, as a share of the problem's scale; 0 is optimal."""
    best = _priced(fits, vectors, most=1).groupBy(*_KEYS).agg(F.min("margin").alias("margin"))
    return fits.join(best, _KEYS, "left").select("event_id", "treated", _without(), F.greatest(-F.coalesce("margin", F.lit(0.0)), F.lit(0.0)).alias("gap"))


def _without() -> Column:
    return F.nullif("without", F.lit("")).alias("without")


def _raw(units: DataFrame) -> DataFrame:
    return units.withColumn("x", F.slice("y", F.lit(1), F.col("n_pre")))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b * b)


def _problem(treated: Column, without: Column) -> Column:
    return F.concat_ws("\u0001", treated, without)


def _control_problems(vectors: DataFrame) -> DataFrame:
    """One problem a unit that has two donors or more."""
    x, m = F.col("x"), _mean(F.col("x"))
    variance = F.greatest(_squares(x) / F.size(x) - m * m, F.lit(0.0))
    donors = F.count("*").over(Window.partitionBy("event_id")) - 1
    out = vectors.select("event_id", F.col("unit_id").alias("treated"), F.lit("").alias("without"), (PENALTY * F.when(variance > 0, variance).otherwise(1.0)).alias("ridge"), donors.alias("n_donors")).where("n_donors >= 2")
    return settled(out.withColumn("problem", _problem(F.col("treated"), F.col("without"))))


def _figures(fits: DataFrame, units: DataFrame, gap: int) -> DataFrame:
    """Effect at the horizon and fit before and after, read off the gap's path."""
    shape = units.select("event_id", F.col("unit_id").alias("treated"), "rel", "n_pre")
    at = fits.join(shape, ["event_id", "treated"])
    base = F.element_at("path", F.array_position("rel", F.lit(-1)).cast("int"))
    zero = F.array_position("rel", F.lit(0)).cast("int")
    pre = F.slice("path", F.lit(1), F.col("n_pre"))
    post = F.transform(F.slice("path", zero, F.size("path")), lambda v: v - F.col("base"))
    at = at.withColumn("base", base).withColumn("pre", pre).withColumn("post", post)
    squares = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b * b)
    return at.select(
        "event_id", "treated", "without", F.element_at("post", -1).alias("tau"), F.sqrt(_squares(F.col("pre")) / F.size("pre")).alias("pre_rmspe"), F.sqrt(_squares(F.col("post")) / F.size("post")).alias("post_rmspe"),
        F.array_max("weights").alias("max_weight"), F.size(F.filter("weights", lambda w: w > 0.01)).alias("n_donors_above_1pct"), (1 / squares).alias("effective_donors"), "donors", "weights", "path", "rel", "n_pre",
    )


def control_fits(units: DataFrame) -> DataFrame:
    """Solved synthetic controls of all units of ``series``."""
    vectors = _raw(units)
    return settled(simplex_fits(_control_problems(vectors), vectors))


def synthetic_control(rows: DataFrame, gap: int) -> DataFrame:
    """(event_id, treated, tau, pre_rmspe, post_rmspe, n_donors, max_weight, n_donors_above_1pct, effective_donors, intercept, penalty): each unit of each event against all others.

    Units of an event with fewer than three complete series have no row; two
    equal series are two donors; an empty table gives no rows.
    """
    units = series(rows, gap)
    return control_report(control_fits(units), units, gap)


def control_report(fits: DataFrame, units: DataFrame, gap: int) -> DataFrame:
    count = units.groupBy("event_id").agg((F.count("*") - 1).cast("int").alias("n_donors"))
    return _figures(fits, units, gap).join(count, "event_id").select("event_id", "treated", "tau", "pre_rmspe", "post_rmspe", "n_donors", "max_weight", "n_donors_above_1pct", "effective_donors", F.lit(0.0).alias("intercept"), F.lit(PENALTY).alias("penalty"))


def donor_weights(fits: DataFrame) -> DataFrame:
    """(event_id, treated, place, donor, weight): each fit's donors by descending weight, ties by name; donors of no weight are left out."""
    one = fits.select("event_id", "treated", F.explode(F.arrays_zip(F.col("donors").alias("donor"), F.col("weights").alias("weight"))).alias("d")).select("event_id", "treated", "d.donor", "d.weight")
    place = F.row_number().over(Window.partitionBy("event_id", "treated").orderBy(F.desc("weight"), "donor"))
    return one.select("event_id", "treated", place.alias("place"), "donor", "weight")


def leave_one_donor_out(rows: DataFrame, gap: int, least: float = WEIGHT_FLOOR) -> DataFrame:
    """(event_id, treated, left_out, tau, shift, pre_rmspe, failure): refits without each donor of more weight than ``least``; the full fit has left_out null.

    A refit starts from what is left of the full fit's donors.  Where fewer than
    two donors are left it is not made, and its row says so in ``failure``.
    """
    units = series(rows, gap)
    vectors, fits = _raw(units), control_fits(units)
    count = units.groupBy("event_id").agg((F.count("*") - 1).alias("n_donors"))
    weighty = fits.select("event_id", "treated", F.explode(F.arrays_zip("donors", "weights")).alias("d"), F.col("donors").alias("kept")).select("event_id", "treated", F.col("d.donors").alias("without"), F.col("d.weights").alias("weight"), "kept").where(F.col("weight") > least)
    weighty = weighty.join(count, "event_id").join(_control_problems(vectors).select("event_id", "treated", "ridge"), ["event_id", "treated"])
    refits = settled(weighty.withColumn("problem", _problem(F.col("treated"), F.col("without"))))
    able = refits.where("n_donors >= 3")
    rest = able.select(*_KEYS, F.explode(F.array_except("kept", F.array("without"))).alias("unit_id"))
    # a full fit of one donor leaves nothing to start from: such refits start at the nearest
    alone = able.where(F.size("kept") < 2)
    columns = ["event_id", "problem", "treated", "without", "ridge"]
    again = simplex_fits(able.where(F.size("kept") >= 2).select(*columns), vectors, rest)
    again = again.unionByName(simplex_fits(alone.select(*columns), vectors))
    full = _figures(fits, units, gap).select("event_id", "treated", F.col("tau").alias("full_tau"), "pre_rmspe")
    found = _figures(again, units, gap).join(full.select("event_id", "treated", "full_tau"), ["event_id", "treated"])
    nothing = F.lit(None).cast("string")
    out = full.select("event_id", "treated", nothing.alias("left_out"), F.col("full_tau").alias("tau"), F.lit(0.0).alias("shift"), "pre_rmspe", nothing.alias("failure"))
    out = out.unionByName(found.select("event_id", "treated", F.col("without").alias("left_out"), "tau", (F.col("tau") - F.col("full_tau")).alias("shift"), "pre_rmspe", nothing.alias("failure")))
    gone = F.lit(None).cast("double")
    return out.unionByName(refits.where("n_donors < 3").select("event_id", "treated", F.col("without").alias("left_out"), gone.alias("tau"), gone.alias("shift"), gone.alias("pre_rmspe"), F.lit("too few donors: fewer than two are left").alias("failure")))


def leave_one_out_summary(refits: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """(event_id, treated, tau, refits, failures, low, high, most_influential, largest_shift, relative_shift, sign_kept[, effective_donors, max_weight, concentrated]) of ``leave_one_donor_out``.

    Without a refit, or with an effect of zero, no sign is kept; the relative
    shift of an effect of zero is infinite.  ``fits`` (event_id, treated,
    effective_donors, max_weight) adds how much rests on few donors.
    """
    other = F.col("left_out").isNotNull() & F.col("failure").isNull()
    a = refits.groupBy("event_id", "treated").agg(
        F.max(F.when(F.col("left_out").isNull(), F.col("tau"))).alias("tau"), F.count(F.when(other, 1)).alias("refits"), F.count("failure").alias("failures"), F.min(F.when(other, F.col("tau"))).alias("low"), F.max(F.when(other, F.col("tau"))).alias("high"),
        F.max_by("left_out", F.when(other, F.struct(F.abs("shift"), "left_out"))).alias("most_influential"), F.max(F.when(other, F.abs("shift"))).alias("largest_shift"),
    )
    relative = F.when(F.col("tau") == 0, F.lit(float("inf"))).otherwise(F.col("largest_shift") / F.abs("tau"))
    kept = (F.col("refits") > 0) & (F.col("tau") != 0) & (F.signum("low") == F.signum("tau")) & (F.signum("high") == F.signum("tau"))
    out = a.withColumn("relative_shift", relative).withColumn("sign_kept", F.coalesce(kept, F.lit(False)))
    if fits is None:
        return out
    return out.join(fits.select("event_id", "treated", "effective_donors", "max_weight"), ["event_id", "treated"]).withColumn("concentrated", (F.col("effective_donors") > 0) & (F.col("effective_donors") < 3))


def _products(units: DataFrame, average: bool) -> DataFrame:
    """(event_id, n, products): of each event the cross-products of (1, steps before, target after), flattened and summed over blocks of units."""

    def block(task: pd.DataFrame) -> pd.DataFrame:
        z = _rows(task.sort_values("unit_id", kind="stable"), average)
        return pd.DataFrame({"event_id": [task["event_id"].iloc[0]], "block": [task["block"].iloc[0]], "products": [(z.T @ z).reshape(-1).tolist()]})

    def event(task: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for row in task.sort_values("block")["products"]:  # one matrix a block of units
            total = total + np.array(row)
        return pd.DataFrame({"event_id": [task["event_id"].iloc[0]], "products": [total.tolist()]})

    blocks = units.select("event_id", "block", "unit_id", "rel", "y", "n_pre").groupBy("event_id", "block").applyInPandas(block, "event_id string, block int, products array<double>")
    return blocks.groupBy("event_id").applyInPandas(event, "event_id string, products array<double>")


def _rows(task: pd.DataFrame, average: bool) -> np.ndarray:
    """A block's rows (1, steps before, target after)."""
    y, rel = np.array(task["y"].tolist(), float), np.array(task["rel"].iloc[0])
    post = y[:, rel >= 0].mean(1) if average else y[:, -1]
    return np.column_stack([np.ones(len(y)), y[:, : int(task["n_pre"].iloc[0])], post])


def time_weights(units: DataFrame, average: bool = False) -> DataFrame:
    """(event_id, treated, time_weights, time_intercept, time_gap): steps before the event that predict the donors' outcome after, for each treated unit.

    Without a penalty, as many donors as steps or fewer leave weights that are
    optimal but not the only ones.
    """

    def run(task: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(task) and len(total):
            task = task.sort_values("unit_id", kind="stable")
            z, n_units = _rows(task, average), int(task["units"].iloc[0])
            whole = np.array(total["products"].iloc[0], float).reshape(z.shape[1], z.shape[1])
            for unit, row in zip(task["unit_id"], z, strict=True):
                if n_units - 1 < 2:
                    continue
                rest = whole - np.outer(row, row)  # the donors' products: all less the treated unit's
                n, mean = rest[0, 0], rest[0, 1:] / rest[0, 0]
                centred = rest[1:, 1:] - n * np.outer(mean, mean)
                gram, target = centred[:-1, :-1], centred[:-1, -1]
                w = simplex_from_gram(gram, target)
                slope = gram @ w - target
                scale = max(np.abs(np.diag(gram)).max(), 1e-300)
                out.append((task["event_id"].iloc[0], unit, w.tolist(), float(mean[-1] - mean[:-1] @ w), float(max(w @ slope - slope.min(), 0.0) / scale)))
        return pd.DataFrame(out, columns=["event_id", "treated", "time_weights", "time_intercept", "time_gap"])

    n = F.count("*").over(Window.partitionBy("event_id"))
    left = units.select("event_id", "block", "unit_id", "rel", "y", "n_pre", n.alias("units"))
    right = _products(units, average).join(units.select("event_id", "block").distinct(), "event_id")
    return left.groupBy("event_id", "block").cogroup(right.groupBy("event_id", "block")).applyInPandas(run, "event_id string, treated string, time_weights array<double>, time_intercept double, time_gap double")


def _zetas(units: DataFrame, average: bool) -> DataFrame:
    """(event_id, unit_id, zeta): the fourth root of the steps after times the deviation of the donors' steps before, as sums over all less the unit's own."""
    steps = F.zip_with(F.slice("y", F.lit(2), F.col("n_pre") - 1), F.slice("y", F.lit(1), F.col("n_pre") - 1), lambda a, b: a - b)
    own = units.select("event_id", "unit_id", F.size(steps).alias("n"), F.aggregate(steps, F.lit(0.0), lambda a, b: a + b).alias("s"), _squares(steps).alias("q"), F.size(F.filter("rel", lambda r: r >= 0)).alias("post"))
    side = Window.partitionBy("event_id")
    n, s, q = (F.sum(c).over(side) - F.col(c) for c in ("n", "s", "q"))
    variance = (q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0))
    after = F.pow(F.col("post").cast("double"), F.lit(0.25)) if average else F.lit(1.0)
    return own.select("event_id", "unit_id", F.coalesce(after * F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)).alias("zeta"))


def did_fits(units: DataFrame, average: bool = False) -> DataFrame:
    """Unit weights (free intercept, ridge of zeta^2 a step) and time weights of all units of ``series``."""
    mean = _mean(F.slice("y", F.lit(1), F.col("n_pre")))
    vectors = settled(units.withColumn("mean", mean).withColumn("x", F.transform(F.slice("y", F.lit(1), F.col("n_pre")), lambda v: v - F.col("mean"))).join(_zetas(units, average), ["event_id", "unit_id"]))
    donors = F.count("*").over(Window.partitionBy("event_id")) - 1
    problems = vectors.select("event_id", F.col("unit_id").alias("treated"), F.lit("").alias("without"), (F.col("zeta") * F.col("zeta") * F.col("n_pre")).alias("ridge"), donors.alias("n_donors")).where("n_donors >= 2")
    fits = simplex_fits(settled(problems.withColumn("problem", _problem(F.col("treated"), F.col("without")))), vectors)
    about = vectors.select("event_id", F.col("unit_id").alias("treated"), "rel", "n_pre", "zeta", F.col("y").alias("own"))
    return settled(fits.join(time_weights(units, average), ["event_id", "treated"]).join(about, ["event_id", "treated"]).join(problems.select("event_id", "treated", "n_donors"), ["event_id", "treated"]))


def did_report(fits: DataFrame, average: bool = False) -> DataFrame:
    """The effects of ``did_fits`` with all that is read off them."""
    zero = F.array_position("rel", F.lit(0)).cast("int")
    base = F.element_at("path", F.array_position("rel", F.lit(-1)).cast("int"))
    pre, post = F.slice("path", F.lit(1), F.col("n_pre")), F.slice("path", zero, F.size("path"))
    after = _mean(F.col("post")) if average else F.element_at("post", -1)
    shift = F.aggregate(F.zip_with("time_weights", "pre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    treated = F.slice("own", zero, F.size("own"))
    squares = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b * b)
    time_squares = F.aggregate("time_weights", F.lit(0.0), lambda a, b: a + b * b)
    at = fits.withColumn("pre", pre).withColumn("post", post).withColumn("base", base).withColumn("level_shift", shift)
    level = F.transform("pre", lambda v: v - F.col("level_shift"))
    moved = F.transform("post", lambda v: v - F.col("base"))
    return at.select(
        "event_id", "treated", (after - F.col("level_shift")).alias("tau"), F.sqrt(_squares(level) / F.size("pre")).alias("pre_rmspe"), F.sqrt(_squares(moved) / F.size("post")).alias("post_rmspe"), "zeta",
        _mean(F.col("pre")).alias("unit_intercept"), "time_intercept", "level_shift", F.col("n_donors").cast("int").alias("n_donors"), F.array_max("weights").alias("max_weight"), F.array_max("time_weights").alias("max_time_weight"),
        (1 / squares).alias("unit_effective"), (1 / time_squares).alias("effective_pre_periods"), (F.size("post") if average else F.lit(1)).alias("estimand_post_periods"),
        (F.element_at("post", -1) - F.col("base")).alias("tau_baselined_last_pre"), (_mean(treated) if average else F.element_at("own", -1)).alias("post_treated_mean"),
    )


def difference_in_differences(rows: DataFrame, gap: int, average: bool = True) -> DataFrame:
    """Synthetic difference in differences of each unit of each event, with its eleven further figures (see ``did_report``).

    tau is the gap after the event (its mean over all steps if ``average``, its
    last step if not) less the time-weighted gap before.  Units of an event with
    fewer than three complete series have no row.
    """
    return did_report(did_fits(series(rows, gap), average), average)


def weighted_cells(fits: DataFrame, units: DataFrame, average: bool = False) -> DataFrame:
    """(event_id, treated, unit_id, rel, y, weight, on): the cells of each treated unit's weighted regression, weight unit times time, cells of no weight left out."""
    zero = F.array_position("rel", F.lit(0))
    last = F.size("rel")
    n_post = (last - zero + 1) if average else F.lit(1)
    after = F.sequence(zero.cast("int"), last.cast("int")) if average else F.array(last.cast("int"))
    pre = F.filter(F.transform(F.sequence(F.lit(1), F.col("n_pre")), lambda k: F.struct(k.alias("k"), F.element_at("time_weights", k).alias("w"), F.lit(False).alias("post"))), lambda s: s["w"] > 0)
    post = F.transform(after, lambda k: F.struct(k.alias("k"), (1.0 / n_post).alias("w"), F.lit(True).alias("post")))
    steps = fits.select("event_id", "treated", "donors", "weights", F.concat(pre, post).alias("steps"))
    parts = F.concat(F.arrays_zip(F.col("donors").alias("unit"), F.col("weights").alias("w")), F.array(F.struct(F.col("treated").alias("unit"), F.lit(1.0).alias("w"))))
    cells = steps.select("event_id", "treated", F.explode(parts).alias("u"), "steps").select("event_id", "treated", F.col("u.unit").alias("unit_id"), F.col("u.w").alias("u"), "steps")
    cells = cells.join(units.select("event_id", "unit_id", "rel", "y"), ["event_id", "unit_id"]).select("event_id", "treated", "unit_id", "u", "rel", "y", F.explode("steps").alias("s"))
    return cells.select("event_id", "treated", "unit_id", F.element_at("rel", F.col("s.k")).alias("rel"), F.element_at("y", F.col("s.k")).alias("y"), (F.col("u") * F.col("s.w")).alias("weight"), ((F.col("unit_id") == F.col("treated")) & F.col("s.post")).cast("double").alias("on"))


def absorbed_slope(rows: DataFrame, by: list[str], effects: tuple[str, ...], y: str, x: str, weight: str, most: int = 200, settle: float = 1e-12) -> DataFrame:
    """(*by, beta, cells, rounds): weighted least squares of ``y`` on ``x`` within groups ``by``, sets of fixed ``effects`` absorbed.

    Weighted means are taken off by one effect after another until no value moves
    by more than ``settle`` of the largest, with no dummy columns; weights that are
    products settle in the second round.  A slope that is not identified is null;
    rows of weight zero take no part.
    """
    at = rows.where(F.col(weight) > 0).select(*by, *effects, F.col(weight).alias("_w"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    at = settled(at)
    largest = at.agg(F.max(F.abs("_y")).alias("y"), F.max(F.abs("_x")).alias("x")).first()
    bounds = {c: settle * max(largest[c[1:]] or 0.0, 1e-300) for c in ("_y", "_x")}
    for rounds in range(1, most + 1):
        moved = at.withColumns({f"{c}_old": F.col(c) for c in bounds})
        for effect in effects:
            side = Window.partitionBy(*by, effect)
            total = F.sum("_w").over(side)
            moved = moved.withColumns({c: F.col(c) - F.sum(F.col("_w") * F.col(c)).over(side) / total for c in bounds})
        moved = settled(moved)
        still = moved.agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}_old"))).alias(c) for c in bounds]).first()
        at = moved.drop(*[f"{c}_old" for c in bounds])
        if all((still[c] or 0.0) <= bound for c, bound in bounds.items()):
            break
    else:
        raise RuntimeError(f"fixed effects have not settled in {most} rounds")
    xx = F.sum(F.col("_w") * F.col("_x") * F.col("_x"))
    # what rounding leaves of a regressor that the effects explain is no variation
    slope = F.when(xx > F.lit((1e3 * bounds["_x"]) ** 2) * F.sum("_w"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")) / xx)
    return at.groupBy(*by).agg(slope.alias("beta"), F.count("*").alias("cells"), F.lit(rounds).alias("rounds"))
