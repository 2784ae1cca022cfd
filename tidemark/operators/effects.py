"""Market-model effects and what is read off them, all as grouped aggregates.

One pass fits every (event, unit); ladders, cross-sectional tests, placebos,
pre-trends and power are projections of its rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordering import dominated, running
from tidemark.operators.settle import settled


def _spans(windows: DataFrame, first: str, last: str, *keep: str) -> DataFrame:
    """One row a position from first to last (SQL expressions), so that windows meet a panel by an equi-join."""
    return windows.select("event_id", *keep, F.explode(F.sequence(F.expr(first).cast("int"), F.expr(last).cast("int"))).alias("pos"))


def fit_market_model(panel: DataFrame, windows: DataFrame, estimation: int, ridge: float = 0.0) -> DataFrame:
    """(event_id, unit_id, t0, alpha, beta, r2, n): least squares of ret on mkt over complete estimation windows.

    ``ridge`` is added to both diagonal sums of the normal equations, which a
    market without variation needs; it is 0 in use.
    """
    spans = _spans(windows.where("reason is null"), "pre_start", "pre_end - 1", "t0")
    grouped = panel.join(spans, "pos").groupBy("event_id", "unit_id", "t0")
    r2, n = F.regr_r2("ret", "mkt").alias("r2"), F.count("ret").alias("n")
    if not ridge:
        fits = grouped.agg(F.regr_slope("ret", "mkt").alias("beta"), F.regr_intercept("ret", "mkt").alias("alpha"), r2, n)
        return fits.where(F.col("n") == estimation)
    both = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    sums = {"sx": F.col("mkt"), "sy": F.col("ret"), "sxx": F.col("mkt") * F.col("mkt"), "sxy": F.col("mkt") * F.col("ret"), "s1": F.lit(1.0)}
    fits = grouped.agg(*[F.sum(F.when(both, v)).alias(k) for k, v in sums.items()], r2, n)
    nn, xx = F.col("s1") + ridge, F.col("sxx") + ridge
    det = nn * xx - F.col("sx") * F.col("sx")
    beta, alpha = (nn * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(det, F.lit(0.0)), (xx * F.col("sy") - F.col("sx") * F.col("sxy")) / F.nullif(det, F.lit(0.0))
    return fits.where(F.col("n") == estimation).select("event_id", "unit_id", "t0", beta.alias("beta"), alpha.alias("alpha"), "r2", "n")


def abnormal_returns(panel: DataFrame, fits: DataFrame, windows: DataFrame) -> DataFrame:
    """(event_id, unit_id, t0, rel, ret, mkt, ar) from the estimation window's start to the horizon; rel = pos - t0."""
    spans = _spans(windows.where("reason is null"), "pre_start", "post_end")
    return panel.join(spans, "pos").join(fits, ["event_id", "unit_id"]).select("event_id", "unit_id", "t0", (F.col("pos") - F.col("t0")).alias("rel"), "ret", "mkt", (F.col("ret") - F.col("alpha") - F.col("beta") * F.col("mkt")).alias("ar"))


def car(ar: DataFrame, start: int, end: int) -> DataFrame:
    """(event_id, unit_id, car): summed abnormal returns of start..end around the event; incomplete windows are left out."""
    inside = ar.where(F.col("rel").between(start, end)).groupBy("event_id", "unit_id").agg(F.sum("ar").alias("car"), F.count("ar").alias("k"))
    return inside.where(F.col("k") == end - start + 1).drop("k")


def car_ladder(ar: DataFrame, windows: tuple[tuple[int, int], ...] = ((-1, 1), (0, 1), (0, 5), (0, 20))) -> DataFrame:
    """(event_id, unit_id, first, last, car) for each window of the ladder, in one aggregate."""
    steps = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in windows])
    rows = ar.where(F.col("rel") >= min(a for a, _ in windows)).withColumn("w", F.explode(steps)).where("rel between w.first and w.last")
    sums = rows.groupBy("event_id", "unit_id", F.col("w.first").alias("first"), F.col("w.last").alias("last")).agg(F.sum("ar").alias("car"), F.count("ar").alias("k"))
    return sums.where("k = last - first + 1").drop("k")


def prediction_variance(ar: DataFrame, gap: int, horizon: int) -> DataFrame:
    """(event_id, unit_id, tau, se_car, t_stat): CAR over 0..horizon and its out-of-sample standard error."""
    pre = F.col("rel") < -gap
    post = F.col("rel").between(0, horizon)
    a = ar.groupBy("event_id", "unit_id").agg(
        F.sum(F.when(pre, F.col("ar") * F.col("ar"))).alias("sse"), F.count(F.when(pre, F.col("ar"))).alias("n_pre"), F.count(F.when(post, F.col("ar"))).alias("n_post"),
        F.sum(F.when(post, F.col("ar"))).alias("tau"), F.avg(F.when(pre, F.col("mkt"))).alias("m_bar"), F.var_pop(F.when(pre, F.col("mkt"))).alias("m_var"), F.sum(F.when(post, F.col("mkt"))).alias("m_post"),
    )
    variance = F.col("sse") / F.greatest(F.col("n_pre") - 2, F.lit(1)) * (
        F.col("n_post") + F.col("n_post") * F.col("n_post") / F.col("n_pre") + F.pow(F.col("m_post") - F.col("n_post") * F.col("m_bar"), F.lit(2.0)) / F.nullif(F.col("m_var") * F.col("n_pre"), F.lit(0.0))
    )
    return a.where(F.col("n_post") == horizon + 1).select("event_id", "unit_id", "tau", F.sqrt(variance).alias("se_car"), (F.col("tau") / F.nullif(F.sqrt(variance), F.lit(0.0))).alias("t_stat"))


def rmspe_ratio(ar: DataFrame, gap: int) -> DataFrame:
    """(event_id, unit_id, pre_rmspe, post_rmspe, ratio) of the cumulative gap: demeaned before, from the last embargoed step after."""
    order = Window.partitionBy("event_id", "unit_id").orderBy("rel")
    path = ar.withColumn("g", F.sum("ar").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.max(F.when(F.col("rel") == -1, F.col("g")))
    pre = F.sqrt(F.var_pop(F.when(F.col("rel") < -gap, F.col("g"))))
    post = F.avg(F.when(F.col("rel") >= 0, F.col("g") * F.col("g"))) - 2 * base * F.avg(F.when(F.col("rel") >= 0, F.col("g"))) + base * base
    out = path.groupBy("event_id", "unit_id").agg(pre.alias("pre_rmspe"), F.sqrt(F.greatest(post, F.lit(0.0))).alias("post_rmspe"))
    return out.withColumn("ratio", F.when(F.col("pre_rmspe") == 0, F.lit(float("inf"))).otherwise(F.col("post_rmspe") / F.nullif("pre_rmspe", F.lit(0.0))))


def caar_tests(effects: DataFrame) -> DataFrame:
    """(event_id, n, mean, t_naive, t_bmp) of the cross-section of CARs and of CARs over their standard errors."""
    z = F.col("tau") / F.nullif("se_car", F.lit(0.0))
    a = effects.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("tau").alias("mean"), F.stddev_samp("tau").alias("sd"), F.avg(z).alias("mz"), F.stddev_samp(z).alias("sz")).where("n >= 2")
    root = F.sqrt(F.col("n").cast("double"))
    return a.select("event_id", "n", "mean", (F.col("mean") / F.nullif(F.col("sd") / root, F.lit(0.0))).alias("t_naive"), (F.col("mz") * root / F.nullif("sz", F.lit(0.0))).alias("t_bmp"))


def placebo_p_values(effects: DataFrame) -> DataFrame:
    """(event_id, unit_id, rank, p_value, p_floor): each unit's effect against all others as placebos, two-sided.

    p = (1 + others at least as extreme) / (1 + others): a rank with ties shared.
    """
    by = Window.partitionBy("event_id").orderBy(F.abs("tau").desc())
    n = F.count("*").over(Window.partitionBy("event_id"))
    at_least = F.count("*").over(by.rangeBetween(Window.unboundedPreceding, 0))
    return effects.select("event_id", "unit_id", at_least.alias("rank"), (at_least / n).alias("p_value"), (F.lit(1.0) / n).alias("p_floor"))


def placebo_ladder(units: DataFrame, cutoffs: tuple[float, ...] = (float("inf"), 20.0, 5.0, 2.0)) -> DataFrame:
    """(event_id, unit_id, cutoff, placebos, p_ratio, p_tau, p_floor) of ``units`` (event_id, unit_id, pre_rmspe, ratio, score): the placebos are those whose fit before is within a multiple of the unit's own.

    ``score`` is how far an effect goes the expected way (``direction_score``).
    p = (1 + placebos at least as extreme) / (1 + placebos); null without
    placebos.  A missing figure is never as extreme as another, and a missing fit
    is within no finite multiple.  Units are numbered by fit and by each
    statistic, and placebos are counted by dominance over both numbers, an event
    over many tasks.  An event of one unit has no row.
    """
    finite = [c for c in cutoffs if c != float("inf")]
    value = {"pre": F.col("pre_rmspe"), "ratio": -F.col("ratio"), "tau": -F.col("score")}
    value = {k: F.nanvl(v.cast("double"), F.lit(None).cast("double")) for k, v in value.items()}
    units = units.select("event_id", "unit_id", *[v.alias(k) for k, v in value.items()])
    entries = [F.struct(F.lit(k).alias("stat"), F.col(k).alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("cutoff"), F.lit(1).alias("w")) for k in value]
    entries += [F.struct(F.lit("pre").alias("stat"), (F.col("pre") * c).alias("v"), F.lit(1).alias("kind"), F.lit(c).alias("cutoff"), F.lit(0).alias("w")) for c in finite]
    stacked = units.select("event_id", "unit_id", F.explode(F.array(*entries)).alias("e")).select("event_id", "unit_id", "e.*").where("v is not null")
    placed = settled(running(stacked, ["event_id", "stat"], ["v", "kind", "unit_id"], "w"))
    points = placed.where("kind = 0")
    fits = points.where("stat = 'pre'").select("event_id", "unit_id", F.col("running").alias("s"))
    upto = placed.where("kind = 1").select("event_id", "unit_id", "cutoff", F.col("running").alias("t"))
    shown = points.where("stat <> 'pre'").select("event_id", "stat", "unit_id", "v", F.col("running").alias("p"))
    reach = shown.groupBy("event_id", "stat", "v").agg(F.max("p").alias("r"))
    reach = shown.join(reach, ["event_id", "stat", "v"]).select("event_id", "stat", "unit_id", "r")
    both = shown.join(fits, ["event_id", "unit_id"]).select("event_id", "stat", "p", "s")
    asked = reach.join(upto, ["event_id", "unit_id"]).select("event_id", "stat", "unit_id", "cutoff", "r", "t")
    near = dominated(both, asked, ["event_id", "stat"], ["unit_id", "cutoff"]).groupBy("event_id", "unit_id", "cutoff").pivot("stat", ["ratio", "tau"]).agg(F.max("dominated"))
    whole = reach.withColumn("cutoff", F.lit(float("inf"))).groupBy("event_id", "unit_id", "cutoff").pivot("stat", ["ratio", "tau"]).agg(F.max("r"))

    count = units.groupBy("event_id").agg(F.count("*").alias("units"))
    grid = units.join(count, "event_id").where("units > 1").withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    grid = grid.join(fits, ["event_id", "unit_id"], "left").join(upto, ["event_id", "unit_id", "cutoff"], "left").join(near.unionByName(whole).withColumnsRenamed({"ratio": "as_ratio", "tau": "as_tau"}), ["event_id", "unit_id", "cutoff"], "left")
    # the unit itself is among those counted where it is within its own multiple and has the statistic
    endless = F.col("cutoff") == float("inf")
    itself = F.when(endless | (F.col("s") <= F.col("t")), 1).otherwise(0)
    n = F.when(endless, F.col("units")).otherwise(F.coalesce("t", F.lit(0))) - itself

    def p(stat: str) -> Column:
        extreme = F.coalesce(f"as_{stat}", F.lit(0)) - F.when(F.col(stat).isNotNull(), itself).otherwise(0)
        return F.when(n > 0, (1 + extreme) / (1 + n)).alias(f"p_{stat}")

    return grid.select("event_id", "unit_id", "cutoff", n.alias("placebos"), p("ratio"), p("tau"), (F.lit(1.0) / (1 + n)).alias("p_floor"))


def direction_score(tau: Column, expected: Column) -> Column:
    """How far an effect goes the expected way: down where ``expected`` is negative, up where positive, either way else."""
    return F.when(expected == "negative", -tau).when(expected == "positive", tau).otherwise(F.abs(tau))


def pretrend(ar: DataFrame, gap: int) -> DataFrame:
    """(event_id, unit_id, slope, drift, z, n_holdout): trend of the cumulative gap before the embargo, and drift across it in deviations of its steps.

    Steps are the differences of the gap within the estimation window, of which
    the first day has none.
    """
    order = Window.partitionBy("event_id", "unit_id").orderBy("rel")
    path = ar.where("rel < 0").withColumn("g", F.sum("ar").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    path = path.withColumn("step", F.col("g") - F.lag("g").over(order))
    pre = F.col("rel") < -gap
    out = path.groupBy("event_id", "unit_id").agg(
        F.regr_slope(F.when(pre, F.col("g")), F.when(pre, F.col("rel").cast("double"))).alias("slope"),
        (F.max(F.when(F.col("rel") == -1, F.col("g"))) - F.max(F.when(F.col("rel") == -gap - 1, F.col("g")))).alias("drift"),
        F.stddev_samp(F.when(pre, F.col("step"))).alias("sd"), F.count(F.when(~pre, F.col("g"))).alias("n_holdout"),
    )
    scale = F.col("sd") * F.sqrt(F.col("n_holdout").cast("double"))
    return out.select("event_id", "unit_id", "slope", "drift", (F.col("drift") / F.nullif(scale, F.lit(0.0))).alias("z"), "n_holdout")


def pretrend_verdict(trends: DataFrame, slopes: DataFrame, level: float = 0.05, far: float = 1.96) -> DataFrame:
    """(event_id, unit_id, slope_p, trend_before, drift_far, clean): ``pretrend`` rows with the p of ``newey_west_slope``.

    A trend shows where its p is below ``level``, a drift where its z is more than
    ``far`` either way; a missing figure shows nothing.
    """
    p = normal_two_sided(F.col("t"))
    out = trends.join(slopes.select("event_id", "unit_id", "t"), ["event_id", "unit_id"])
    trend, drift = F.coalesce(p < level, F.lit(False)), F.coalesce(F.abs("z") > far, F.lit(False))
    return out.select("event_id", "unit_id", p.alias("slope_p"), trend.alias("trend_before"), drift.alias("drift_far"), (~(trend | drift)).alias("clean"))


def power(effects: DataFrame, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """(event_id, n, critical, mde) from the distribution of placebo effects, two-sided."""
    a = effects.groupBy("event_id").agg(F.count("*").alias("n"), F.percentile(F.abs("tau"), F.lit(1 - alpha)).alias("critical"), F.percentile("tau", F.lit(1 - target)).alias("low"))
    return a.select("event_id", "n", "critical", (F.col("critical") - F.col("low")).alias("mde"))


def directional_power(effects: DataFrame, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """(event_id, expected, n, critical, mde, mde_50, sd) of placebo effects (event_id, tau, expected), one-sided where a direction was recorded.

    The critical value is a quantile of what the test compares, signed effects in
    the expected direction or sizes where it is ambiguous; what has to be added
    to reach it is always a matter of the signed effects.  Figures of a negative
    direction are negative.
    """
    negative, ambiguous = F.col("expected") == "negative", ~F.col("expected").isin("negative", "positive")
    signed = F.when(negative, -F.col("tau")).otherwise(F.col("tau"))
    rows = effects.where("tau is not null").select("event_id", "expected", "tau", signed.alias("s"), F.when(ambiguous, F.abs("tau")).otherwise(signed).alias("c"))
    a = rows.groupBy("event_id", "expected").agg(F.count("*").alias("n"), F.percentile("c", F.lit(1 - alpha)).alias("critical"), F.percentile("s", F.lit(1 - target)).alias("low"), F.percentile("s", F.lit(0.5)).alias("middle"), F.stddev_samp("tau").alias("sd"))
    sign = F.when(negative, -1.0).otherwise(1.0)
    return a.select("event_id", "expected", "n", (sign * F.col("critical")).alias("critical"), (sign * (F.col("critical") - F.col("low"))).alias("mde"), (sign * (F.col("critical") - F.col("middle"))).alias("mde_50"), "sd")


def power_curve(effects: DataFrame, sizes: tuple[float, ...], alpha: float = 0.05) -> DataFrame:
    """(event_id, effect, detected): share of placebos that an added effect lifts to the critical value."""
    critical = effects.groupBy("event_id").agg(F.percentile(F.abs("tau"), F.lit(1 - alpha)).alias("critical"))
    grid = effects.join(critical, "event_id").withColumn("effect", F.explode(F.array(*map(F.lit, sizes))))
    return grid.groupBy("event_id", "effect").agg(F.avg(F.when(F.abs(F.col("tau") + F.col("effect")) >= F.col("critical"), 1.0).otherwise(0.0)).alias("detected"))


UNITS = 256  #: units of a block of the correlation matrix


def _correlations(tile: pd.DataFrame) -> pd.DataFrame:
    """(total, pairs) of the correlations between a tile's two sides, each pair over the steps that both have."""
    i, j = int(tile["i"].iloc[0]), int(tile["j"].iloc[0])
    width = max(len(p) and max(p) for p in tile["pos"]) + 1

    def side(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, m = np.zeros((len(rows), width)), np.zeros((len(rows), width))
        for n, (pos, ret) in enumerate(zip(rows["pos"], rows["ret"], strict=True)):
            x[n, pos], m[n, pos] = ret, 1.0
        return x, m

    tile = tile.sort_values("unit_id", kind="stable")
    (x, mx), (y, my) = side(tile[tile["block"] == i]), side(tile[tile["block"] == j])
    n = mx @ my.T
    sx, sy = x @ my.T, mx @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = (n * (x @ y.T) - sx * sy) / np.sqrt((n * ((x * x) @ my.T) - sx * sx) * (n * (mx @ (y * y).T) - sy * sy))
    if i == j:
        rho = rho[np.triu_indices(len(rho), 1)]
    rho = rho[np.isfinite(rho)]
    return pd.DataFrame({"total": [float(rho.sum())], "pairs": [rho.size]})


def effective_units(panel: DataFrame) -> DataFrame:
    """(units, mean_correlation, effective): pairwise correlations of the units' returns and N / (1 + (N - 1) rho).

    Each unit's series is one row; blocks of units meet in tiles of the
    correlation matrix, each a few matrix products.
    """
    series = panel.where("ret is not null").groupBy("unit_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("ret").alias("ret"))
    units = series.agg(F.count("*").alias("units"))
    blocks = F.greatest(F.ceil(F.col("units") / UNITS), F.lit(1)).cast("int")
    placed = series.crossJoin(units).withColumn("block", F.pmod(F.xxhash64("unit_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = placed.select("unit_id", "block", "pos", "ret", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sums = tiles.groupBy("i", "j").applyInPandas(_correlations, "total double, pairs long").agg((F.sum("total") / F.nullif(F.sum("pairs"), F.lit(0))).alias("mean_correlation"))
    mean = sums.crossJoin(units)
    width = 1 + (F.col("units") - 1) * F.col("mean_correlation")
    return mean.select("units", "mean_correlation", F.when(width <= 0, F.col("units").cast("double")).otherwise(F.col("units") / F.nullif(width, F.lit(0.0))).alias("effective"))


def newey_west_slope(ar: DataFrame, gap: int, lags: int = 10) -> DataFrame:
    """(event_id, unit_id, slope, se, t): trend of the cumulative gap before the embargo with Bartlett-weighted errors.

    Sums of lagged score products come from window lags over each (event, unit) path.
    """
    order = Window.partitionBy("event_id", "unit_id").orderBy("rel")
    whole = Window.partitionBy("event_id", "unit_id")
    path = ar.where(F.col("rel") < -gap).select("event_id", "unit_id", F.col("rel").cast("double").alias("x"), "rel", F.sum("ar").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("g"))
    path = path.withColumn("b", F.regr_slope("g", "x").over(whole)).withColumn("dx", F.col("x") - F.avg("x").over(whole)).withColumn("e", F.col("g") - F.avg("g").over(whole) - F.col("b") * F.col("dx"))
    path = path.withColumn("s", F.col("dx") * F.col("e"))
    products = F.col("s") * F.col("s")
    for k in range(1, lags + 1):
        products = products + 2 * (1 - k / (lags + 1)) * F.col("s") * F.coalesce(F.lag("s", k).over(order), F.lit(0.0))
    sums = path.withColumn("p", products).groupBy("event_id", "unit_id").agg(F.max("b").alias("slope"), F.sum("p").alias("m"), F.sum(F.col("dx") * F.col("dx")).alias("xx"))
    se = F.sqrt(F.greatest("m", F.lit(0.0))) / F.nullif("xx", F.lit(0.0))
    return sums.select("event_id", "unit_id", "slope", se.alias("se"), (F.col("slope") / F.nullif(se, F.lit(0.0))).alias("t"))


def in_time_placebos(panel: DataFrame, windows: DataFrame, offsets: DataFrame, estimation: int, gap: int, horizon: int) -> DataFrame:
    """(event_id, unit_id, tau, placebos, p_value): each event's effect against its own at earlier positions.

    ``offsets`` (event_id, k, pos).  The event and its placebos are fitted in the
    same grouped pass; p = (1 + at least as extreme) / (1 + placebos).
    """
    own = windows.where(F.col("t0") >= estimation + gap).select("event_id", F.lit(-1).alias("k"), F.col("t0").alias("pos"))
    dated = own.unionByName(offsets.select("event_id", "k", "pos"))
    w = dated.select(F.concat_ws("|", "event_id", "k").alias("event_id"), F.col("pos").alias("t0"), F.lit(None).cast("string").alias("reason"), (F.col("pos") - estimation - gap).alias("pre_start"), (F.col("pos") - gap).alias("pre_end"), (F.col("pos") + horizon).alias("post_end"))
    effects = car(abnormal_returns(panel, fit_market_model(panel, w, estimation), w), 0, horizon)
    parts = effects.select(F.substring_index("event_id", "|", 1).alias("event_id"), F.substring_index("event_id", "|", -1).cast("int").alias("k"), "unit_id", "car")
    real = parts.where("k = -1").select("event_id", "unit_id", F.col("car").alias("tau"))
    joined = parts.where("k >= 0").join(real, ["event_id", "unit_id"])
    out = joined.groupBy("event_id", "unit_id", "tau").agg(F.count("*").alias("placebos"), F.count(F.when(F.abs("car") >= F.abs("tau"), 1)).alias("extreme"))
    return out.select("event_id", "unit_id", "tau", "placebos", ((1 + F.col("extreme")) / (1 + F.col("placebos"))).alias("p_value"))


def directional_p(effects: DataFrame) -> DataFrame:
    """(event_id, unit_id, placebos, p_directional, p_two_sided, p_floor) of effects (..., tau, expected).

    At most the effect counts where ``expected`` is negative, at least where it
    is positive, both sides where it is ambiguous.
    """
    whole = F.count("*").over(Window.partitionBy("event_id"))
    side = Window.partitionBy("event_id")
    upto = Window.unboundedPreceding

    def reached(order) -> Column:
        return F.count("*").over(side.orderBy(order).rangeBetween(upto, 0))

    two = reached(F.abs("tau").desc())
    one = F.when(F.col("expected") == "negative", reached(F.col("tau").asc())).when(F.col("expected") == "positive", reached(F.col("tau").desc())).otherwise(two)
    return effects.select("event_id", "unit_id", (whole - 1).alias("placebos"), (one / whole).alias("p_directional"), (two / whole).alias("p_two_sided"), (F.lit(1.0) / whole).alias("p_floor"))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) by the series of the error function, whose terms are all positive."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(acc, n):
        term = acc["term"] * 2.0 * x * x / (2.0 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step)["sum"]
    return F.when(x > 8, 0.0).otherwise(F.greatest(1 - 2 / F.sqrt(F.lit(math.pi)) * F.exp(-x * x) * series, F.lit(0.0)))


def caar_three_tests(ar: DataFrame, effects: DataFrame, gap: int, horizon: int) -> DataFrame:
    """(event_id, test, n, caar, statistic, p_value) of events with two units or more.

    naive: the cross-section's own error, normal; portfolio: the error of the
    equal-weighted portfolio before the event times the root of the steps after,
    normal; standardised: CARs over their errors, t with n - 1 degrees.
    """
    from tidemark.operators.regression import t_two_sided

    members = ar.join(effects.select("event_id", "unit_id"), ["event_id", "unit_id"], "left_semi")
    portfolio = members.where(F.col("rel") < -gap).groupBy("event_id", "rel").agg(F.avg("ar").alias("p")).groupBy("event_id").agg(F.stddev_samp("p").alias("sd"))
    z = F.col("tau") / F.nullif("se_car", F.lit(0.0))
    a = effects.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("tau").alias("caar"), F.stddev_samp("tau").alias("st"), F.avg(z).alias("mz"), F.stddev_samp(z).alias("sz")).where("n >= 2").join(portfolio, "event_id")
    root = F.sqrt(F.col("n").cast("double"))
    tests = F.array(
        F.struct(F.lit("naive").alias("test"), (F.col("caar") / F.nullif(F.col("st") / root, F.lit(0.0))).alias("statistic")),
        F.struct(F.lit("portfolio").alias("test"), (F.col("caar") / F.nullif(F.col("sd") * F.sqrt(F.lit(horizon + 1.0)), F.lit(0.0))).alias("statistic")),
        F.struct(F.lit("standardised").alias("test"), (F.col("mz") * root / F.nullif("sz", F.lit(0.0))).alias("statistic")),
    )
    out = a.select("event_id", "n", "caar", F.explode(tests).alias("t")).select("event_id", "t.test", "n", "caar", "t.statistic")
    p = F.when(F.col("test") == "standardised", t_two_sided(F.col("statistic"), F.col("n") - 1)).otherwise(normal_two_sided(F.col("statistic")))
    return out.withColumn("p_value", p)


def power_verdicts(effects: DataFrame, powers: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(event_id, unit_id, analytic_mde, feasible, observed_over_mde): the market model's own detectable effect, whether the placebos are enough for the level, and the effect as a multiple of what they detect."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = effects.join(powers.select("event_id", (F.col("n") - 1).alias("_j"), "mde"), "event_id")
    return rows.select("event_id", "unit_id", (F.col("se_car") * z).alias("analytic_mde"), (1.0 / (1 + F.col("_j")) <= alpha).alias("feasible"), (F.abs("tau") / F.nullif(F.abs("mde"), F.lit(0.0))).alias("observed_over_mde"))


def combined(space: DataFrame, time: DataFrame) -> DataFrame:
    """(event_id, unit_id, placebo, p_value): both kinds of placebo side by side, never combined into one figure."""
    return space.select("event_id", "unit_id", F.lit("in space").alias("placebo"), "p_value").unionByName(time.select("event_id", "unit_id", F.lit("in time").alias("placebo"), "p_value"))


def first_difference(path: DataFrame, column: str) -> DataFrame:
    """(..., diff): change of a path from step to step; the first step is its own."""
    before = F.lag(column).over(Window.partitionBy("event_id", "unit_id").orderBy("rel"))
    return path.withColumn("diff", F.coalesce(F.col(column) - before, F.col(column)))
