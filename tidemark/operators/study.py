"""All estimators of all events in one grid, each with its placebos: nothing is reported alone.

A task is an event, a date (its own or an earlier placebo date), a unit and an
estimator.  Estimators are kernels registered by name; each gives a row a task,
and a task that cannot be estimated keeps its row and says why.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import effects as E
from tidemark.operators import synthetic as S
from tidemark.operators.reporting import prefit_verdict
from tidemark.operators.settle import settled

MARKET, CONTROL, DOUBLE = "market_model", "synthetic_control", "synthetic_did"
OWN = -1  #: the event's own date among its dates

#: What a kernel gives of each task that it could estimate.
COLUMNS = ["event_id", "unit_id", "tau", "pre_rmspe", "post_rmspe", "effective_donors", "max_weight", "n_donors_above_1pct", "rel", "path"]


@dataclass(frozen=True)
class Grid:
    """Tasks' data: ``rows`` (event_id, unit_id, rel, ret, mkt), complete series only, one event_id a date."""

    rows: DataFrame
    estimation: int
    gap: int
    horizon: int


Kernel = Callable[[Grid], DataFrame]
_KERNELS: dict[str, tuple[Kernel, int]] = {}


def kernel(name: str, donors: int = 0) -> Callable[[Kernel], Kernel]:
    """Register an estimator under ``name``; it takes a Grid and gives COLUMNS. ``donors`` is the least number of other units it needs."""

    def register(run: Kernel) -> Kernel:
        if name in _KERNELS:
            raise ValueError(f"estimator {name} is registered twice")
        _KERNELS[name] = (run, donors)
        return run

    return register


def kernels() -> tuple[str, ...]:
    return tuple(_KERNELS)


@kernel(MARKET)
def market_model(grid: Grid) -> DataFrame:
    """Least squares on the market over the estimation window; the gap is the cumulative abnormal return, whose error before is about its own mean."""
    pre = F.col("rel") < -grid.gap
    fit = grid.rows.groupBy("event_id", "unit_id").agg(F.regr_slope(F.when(pre, F.col("ret")), F.when(pre, F.col("mkt"))).alias("b"), F.regr_intercept(F.when(pre, F.col("ret")), F.when(pre, F.col("mkt"))).alias("a"))
    ar = grid.rows.join(fit, ["event_id", "unit_id"]).withColumn("ar", F.col("ret") - F.col("a") - F.col("b") * F.col("mkt"))
    path = ar.withColumn("g", F.sum("ar").over(Window.partitionBy("event_id", "unit_id").orderBy("rel").rowsBetween(Window.unboundedPreceding, 0)))
    whole = path.groupBy("event_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("rel", "g"))).alias("p"), F.max(F.when(F.col("rel") == -1, F.col("g"))).alias("base"), F.avg(F.when(pre, F.col("g"))).alias("level"))
    before, after = F.filter("p", lambda s: s["rel"] < -grid.gap), F.filter("p", lambda s: s["rel"] >= 0)
    squares = lambda values: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) / F.size(values))
    none = F.lit(None).cast("double")  # the market model has no donors
    return whole.select(
        "event_id", "unit_id", (F.element_at("p", -1)["g"] - F.col("base")).alias("tau"), F.sqrt(F.greatest(F.aggregate(F.transform(before, lambda s: s["g"] - F.col("level")), F.lit(0.0), lambda a, v: a + v * v), F.lit(0.0)) / F.size(before)).alias("pre_rmspe"), squares(F.transform(after, lambda s: s["g"] - F.col("base"))).alias("post_rmspe"),
        none.alias("effective_donors"), none.alias("max_weight"), F.lit(None).cast("int").alias("n_donors_above_1pct"), F.col("p.rel").alias("rel"), F.col("p.g").alias("path"),
    ).where("tau is not null")


@kernel(CONTROL, donors=2)
def synthetic_control(grid: Grid) -> DataFrame:
    units = S.series(grid.rows, grid.gap)
    return S._figures(S.control_fits(units), units, grid.gap).withColumnRenamed("treated", "unit_id").select(*COLUMNS)


@kernel(DOUBLE, donors=2)
def synthetic_did(grid: Grid) -> DataFrame:
    """At the horizon; the gap's path carries the level that the time weights give it."""
    fits = S.did_fits(S.series(grid.rows, grid.gap))
    report = S.did_report(fits).select("event_id", "treated", "tau", "pre_rmspe", "post_rmspe", "level_shift", "max_weight", F.col("unit_effective").alias("effective_donors"))
    out = report.join(fits.select("event_id", "treated", "rel", "path", "weights"), ["event_id", "treated"])
    return out.select("event_id", F.col("treated").alias("unit_id"), "tau", "pre_rmspe", "post_rmspe", "effective_donors", "max_weight", F.size(F.filter("weights", lambda w: w > 0.01)).alias("n_donors_above_1pct"), "rel", F.transform("path", lambda v: v - F.col("level_shift")).alias("path"))


def run_grid(panel: DataFrame, dates: DataFrame, estimation: int, gap: int, horizon: int, names: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, k, unit_id, estimator, COLUMNS..., ratio, error_type, message): one row a date of an event, unit and estimator.

    ``panel`` unit_id, pos, ret, mkt; ``dates`` event_id, k (OWN for the event
    itself), pos.  The market model is always among the estimators.  A unit with
    a missing return in a window is no donor there and fails as IncompleteWindow; a
    date without enough complete units fails as TooFewDonors; what an estimator
    gives no row for fails as NotEstimated.
    """
    unknown = set(names) - set(_KERNELS)
    if unknown:
        raise ValueError(f"unknown estimators: {', '.join(sorted(unknown))}")
    chosen = [n for n in _KERNELS if n == MARKET or not names or n in names]
    spans = dates.select(F.concat_ws("|", "event_id", "k").alias("event_id"), F.col("pos").alias("t0"), F.explode(F.sequence(F.col("pos") - estimation - gap, F.col("pos") + horizon)).alias("pos"))
    rows = settled(panel.join(spans, "pos").select("event_id", "unit_id", (F.col("pos") - F.col("t0")).cast("int").alias("rel"), "ret", "mkt"))
    steps = estimation + gap + horizon + 1
    tasks = rows.groupBy("event_id", "unit_id").agg((F.count(F.when(F.col("ret").isNotNull() & F.col("mkt").isNotNull(), 1)) == steps).alias("whole"))
    tasks = settled(tasks.withColumn("donors", F.sum(F.col("whole").cast("int")).over(Window.partitionBy("event_id")) - F.col("whole").cast("int")))
    grid = Grid(rows.join(tasks.where("whole").select("event_id", "unit_id"), ["event_id", "unit_id"], "left_semi"), estimation, gap, horizon)

    def side(name: str) -> DataFrame:
        run, least = _KERNELS[name]
        found = tasks.join(run(grid), ["event_id", "unit_id"], "left").withColumn("estimator", F.lit(name))
        kind = F.when(F.col("tau").isNotNull(), None).when(~F.col("whole"), "IncompleteWindow").when(F.col("donors") < least, "TooFewDonors").otherwise("NotEstimated")
        return found.withColumn("error_type", kind)

    every = reduce(DataFrame.unionByName, [side(n) for n in chosen])
    message = F.when(F.col("error_type") == "IncompleteWindow", "a return of the window is missing").when(F.col("error_type") == "TooFewDonors", F.concat(F.col("donors").cast("string"), F.lit(" other units have complete windows"))).when(F.col("error_type") == "NotEstimated", "the estimator gave no row")
    ratio = F.when(F.col("pre_rmspe") == 0, F.lit(float("inf"))).otherwise(F.col("post_rmspe") / F.nullif("pre_rmspe", F.lit(0.0)))
    return every.select(F.substring_index("event_id", "|", 1).alias("event_id"), F.substring_index("event_id", "|", -1).cast("int").alias("k"), "unit_id", "estimator", *COLUMNS[2:], ratio.alias("ratio"), "error_type", message.alias("message"))


def in_space(own: DataFrame) -> DataFrame:
    """(event_id, unit_id, estimator, placebos, failed, p_in_space, p_floor): each unit's ratio of errors against all others' under the same estimator."""
    side = Window.partitionBy("event_id", "estimator")
    n = F.count("tau").over(side)
    reach = F.count("ratio").over(side.orderBy(F.col("ratio").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))
    failed = F.count("error_type").over(side)
    out = own.select("event_id", "unit_id", "estimator", "tau", "ratio", (n - 1).alias("placebos"), failed.alias("failed"), (reach / n).alias("p_in_space"), (F.lit(1.0) / n).alias("p_floor"))
    return out.where("tau is not null").drop("tau", "ratio")


def in_time(estimates: DataFrame) -> DataFrame:
    """(event_id, unit_id, estimator, time_placebos, dates_failed, p_in_time): a unit's effect against its own at earlier dates; null without any."""
    real = estimates.where(F.col("k") == OWN).select("event_id", "unit_id", "estimator", F.abs("tau").alias("size"))
    other = estimates.where(F.col("k") != OWN).join(real, ["event_id", "unit_id", "estimator"])
    out = other.groupBy("event_id", "unit_id", "estimator").agg(F.count("tau").alias("time_placebos"), F.count("error_type").alias("dates_failed"), F.count(F.when(F.abs("tau") >= F.col("size"), 1)).alias("extreme"))
    return out.select("event_id", "unit_id", "estimator", "time_placebos", "dates_failed", F.when(F.col("time_placebos") > 0, (1 + F.col("extreme")) / (1 + F.col("time_placebos"))).alias("p_in_time"))


def pre_fit(own: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(event_id, unit_id, estimator, normalised_rmspe, ratio_to_baseline, pre_fit): errors before the event in deviations of the unit's own outcome (event_id, unit_id, sd), and over the market model's on the same windows."""
    base = own.where(F.col("estimator") == MARKET).select("event_id", "unit_id", F.col("pre_rmspe").alias("base"))
    met = own.where("tau is not null").join(base, ["event_id", "unit_id"]).join(outcomes, ["event_id", "unit_id"], "left")

    def over(divisor: Column) -> Column:
        return F.when(divisor > 0, F.col("pre_rmspe") / F.nullif(divisor, F.lit(0.0))).otherwise(F.lit(float("inf")))

    # the market model over itself is 1, however its error came out
    ratio = F.when(F.col("estimator") == MARKET, F.lit(1.0)).otherwise(over(F.col("base")))
    return met.select("event_id", "unit_id", "estimator", over(F.col("sd")).alias("normalised_rmspe"), ratio.alias("ratio_to_baseline"), prefit_verdict(ratio).alias("pre_fit"))


def gap_trends(own: DataFrame, gap: int) -> DataFrame:
    """(event_id, unit_id, estimator, slope_p, drift_z, pretrend_violated) of every estimator's gap."""
    name = F.concat_ws("\u0001", "event_id", "estimator")
    steps = own.where("tau is not null").select(name.alias("event_id"), "unit_id", F.posexplode(F.arrays_zip("rel", "path")).alias("at", "s"), "path")
    ar = steps.select("event_id", "unit_id", F.col("s.rel").alias("rel"), (F.col("s.path") - F.when(F.col("at") > 0, F.element_at("path", F.greatest("at", F.lit(1)))).otherwise(0.0)).alias("ar"))
    ar = settled(ar)
    trend, slopes = E.pretrend(ar, gap), E.newey_west_slope(ar, gap)
    shown = E.pretrend_verdict(trend, slopes).join(trend.select("event_id", "unit_id", "z"), ["event_id", "unit_id"])
    parts = F.split("event_id", "\u0001")
    return shown.select(parts[0].alias("event_id"), "unit_id", parts[1].alias("estimator"), "slope_p", F.col("z").alias("drift_z"), (~F.col("clean")).alias("pretrend_violated"))


def run_events(panel: DataFrame, windows: DataFrame, offsets: DataFrame, estimation: int, gap: int, horizon: int, alpha: float = 0.05) -> DataFrame:
    """One row an event, unit and estimator: effect, both placebo p-values, fit before, trends, leave-one-out and power, or why there is none.

    ``windows`` event_id, t0, reason; ``offsets`` event_id, k, pos of placebo
    dates.  Every unit is treated in turn, so each one's placebos are all others
    under the same estimator.  Donors are left out in turn of the synthetic
    control; the market model has none.
    """
    dates = windows.where("reason is null").select("event_id", F.lit(OWN).alias("k"), F.col("t0").alias("pos")).unionByName(offsets.select("event_id", "k", "pos"))
    estimates = settled(run_grid(panel, settled(dates), estimation, gap, horizon))
    own = estimates.where(F.col("k") == OWN)
    done = own.where("tau is not null")
    keys = ["event_id", "unit_id", "estimator"]

    spans = windows.where("reason is null").select("event_id", "t0", F.explode(F.sequence(F.col("t0") - estimation - gap, F.col("t0") + horizon)).alias("pos"))
    rows = settled(panel.join(spans, "pos").select("event_id", "unit_id", (F.col("pos") - F.col("t0")).cast("int").alias("rel"), "ret").join(done.select("event_id", "unit_id").distinct(), ["event_id", "unit_id"], "left_semi"))
    cumulative = rows.withColumn("y", F.sum("ret").over(Window.partitionBy("event_id", "unit_id").orderBy("rel").rowsBetween(Window.unboundedPreceding, 0)))
    outcomes = cumulative.where(F.col("rel") < -gap).groupBy("event_id", "unit_id").agg(F.stddev_samp("y").alias("sd"))
    left_out = S.leave_one_out_summary(S.leave_one_donor_out(rows, gap)).select("event_id", F.col("treated").alias("unit_id"), F.lit(CONTROL).alias("estimator"), F.col("refits").alias("loo_refits"), F.col("sign_kept").alias("loo_sign_stable"), F.col("relative_shift").alias("loo_relative_shift"), "most_influential")
    power = done.groupBy("event_id", "estimator").agg(F.percentile(F.abs("tau"), F.lit(1 - alpha)).alias("critical"), F.percentile("tau", F.lit(0.2)).alias("_low"))
    power = power.select("event_id", "estimator", "critical", (F.col("critical") - F.col("_low")).alias("mde"))

    out = own.drop("k", "rel", "path")
    for part in (in_space(own), in_time(estimates), pre_fit(own, outcomes), gap_trends(own, gap), left_out):
        out = out.join(part, keys, "left")
    return out.join(power, ["event_id", "estimator"], "left").withColumn("feasible", F.col("p_floor") <= alpha)


def resolution(statuses: DataFrame) -> DataFrame:
    """(event_id, status, units, names): how each event's universe resolved, names in order."""
    return statuses.groupBy("event_id", "status").agg(F.count("*").alias("units"), F.array_join(F.array_sort(F.collect_list("unit_id")), ", ").alias("names"))


def signed_portfolio(units: DataFrame) -> DataFrame:
    """(event_id, unit_id, weight) of treated units (event_id, unit_id, sign): equal shares by size, each with its sign."""
    n = units.groupBy("event_id").agg(F.count("*").alias("_n"))
    return units.join(n, "event_id").select("event_id", "unit_id", (F.col("sign") / F.col("_n")).alias("weight"))
