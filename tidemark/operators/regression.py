"""Dose-response with controls and clusters: one Gram matrix a fit, whatever the rows.

Event effects go by demeaning within events (Frisch-Waugh-Lovell), so a fit
needs only the sums of products of exposure, controls and effect: one grouped
aggregate.  Each fit is then one short row, and those rows are solved where they
lie; fits by subsample, by drop depth or by form are more rows of the same
aggregate, not more passes.  Scores by cluster are a second aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.tails import inverse_normal
from tidemark.operators.dose import complete_cases
from tidemark.operators.settle import settled

CONTROLS = ("size", "momentum", "pre_event_vol")
#: Depths of the drop path.
DEPTHS = (1, 2, 3, 5)


def car_panel(units: DataFrame, windows: DataFrame, exposure: DataFrame, controls: DataFrame, fits: DataFrame, effects: DataFrame, listings: DataFrame, clusters: DataFrame, need: int, span: tuple[int, int] = (0, 1)) -> DataFrame:
    """Every unit with every event, each with its figures or the first reason that it has none.

    ``windows`` event_id, day, t0, pre_end, last, reason; ``exposure`` event_id,
    unit_id, exposure, leg (the first leg of a pair wins); ``controls`` event_id,
    unit_id, CONTROLS; ``fits`` and ``effects`` event_id, unit_id (, car);
    ``listings`` unit_id, first, last (absent: always available); ``clusters``
    event_id, cluster_id (absent: the event itself); ``need`` steps of history
    before the estimation window's end that momentum takes.
    """
    first = exposure.groupBy("event_id", "unit_id").agg(F.min_by("exposure", "leg").alias("exposure"))
    # the task grid itself: a row a pair is what is asked for
    grid = units.select("unit_id").distinct().crossJoin(windows.select("event_id", "day", "t0", "pre_end", "last", F.col("reason").alias("_w")))
    key = ["event_id", "unit_id"]
    rows = (
        grid.join(clusters.select("event_id", "cluster_id"), "event_id", "left").join(listings.select("unit_id", F.col("first").alias("_a"), F.col("last").alias("_b")), "unit_id", "left")
        .join(first, key, "left").join(controls.select(*key, *CONTROLS), key, "left")
        .join(fits.select(*key, F.lit(True).alias("_f")), key, "left").join(effects.select(*key, "car"), key, "left")
    )
    there = (F.col("_a").isNull() | (F.col("day") >= F.col("_a"))) & (F.col("_b").isNull() | (F.col("day") <= F.col("_b")))
    reason = (
        F.when(F.col("_w").isNotNull(), F.concat(F.lit("window does not fit: "), "_w"))
        .when(F.col("pre_end") - 1 < need, "controls unavailable")
        .when((F.col("t0") + span[0] < 1) | (F.col("t0") + span[1] > F.col("last")), "window outside the calendar")
        .when(~there, "unit not available").when(F.col("exposure").isNull(), "no exposure row")
        .when(F.col("_f").isNull(), "market model failed").when(F.col("car").isNull(), "gaps inside the event window")
    )
    return rows.select(*key, F.coalesce("cluster_id", "event_id").alias("cluster_id"), "car", "exposure", *CONTROLS, reason.alias("reason"))


def demeaned(rows: DataFrame, terms: tuple[str, ...], *by: str) -> DataFrame:
    """Complete rows with ``y`` and ``x`` (an array by term) less their event means, and the event's size ``m``."""
    whole = complete_cases(rows, "car", *terms)
    key = [*by, "event_id"]
    means = whole.groupBy(*key).agg(F.avg("car").alias("_y"), F.array(*[F.avg(t) for t in terms]).alias("_x"), F.count("*").alias("m"))
    x = F.array(*[F.col(t) - F.col("_x")[i] for i, t in enumerate(terms)])
    return settled(whole.join(means, key).withColumn("y", F.col("car") - F.col("_y")).withColumn("x", x).drop("_y", "_x"))


def _solved(size: int, by: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            beta, inverse, rss, own = [], [], [], []
            for xx, xy, yy in zip(frame["xx"], frame["xy"], frame["yy"], strict=True):
                g, v = np.array(xx, float).reshape(size, size), np.array(xy, float)
                rest = g[0, 0] - g[0, 1:] @ np.linalg.pinv(g[1:, 1:], hermitian=True) @ g[1:, 0] if size > 1 else g[0, 0]
                identified = rest > 1e-10 * max(g[0, 0], 1e-300)
                # scaled to unit diagonal first, as the terms' units differ by orders of magnitude
                scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
                p = np.linalg.pinv(g / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
                b = p @ v
                beta.append(b.tolist() if identified else None)
                inverse.append(p.reshape(-1).tolist())
                rss.append(float(yy - b @ v))
                own.append(float(rest))
            yield frame[[*by, "n", "events", "total"]].assign(beta=beta, inverse=inverse, rss=rss, own=own)

    return run


def fit(d: DataFrame, size: int, *by: str) -> DataFrame:
    """(by..., n, events, total, beta, inverse, rss, own): each group's fit; beta is null where the exposure, the first term, is not identified.

    ``total`` is the sum of squares about the grand mean, ``own`` that of the
    exposure once controls and events are taken out.
    """
    x = [F.col("x")[i] for i in range(size)]
    upper = {(i, j): F.sum(x[i] * x[j]) for i in range(size) for j in range(i, size)}
    grams = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.sum(F.col("y") * F.col("y")).alias("yy"), (F.var_pop("car") * F.count("*")).alias("total"),
        F.array(*[F.sum(v * F.col("y")) for v in x]).alias("xy"), F.array(*[upper[min(i, j), max(i, j)] for i in range(size) for j in range(size)]).alias("xx"),
    )
    types = dict(d.dtypes)
    head = "".join(f"{c} {types[c]}, " for c in by)
    return settled(grams.where("n > 0")).mapInPandas(_solved(size, list(by)), head + "n long, events long, total double, beta array<double>, inverse array<double>, rss double, own double")


def _with(d: DataFrame, solved: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows with their group's fit: one short row a group."""
    return d.join(solved, list(by)) if by else d.crossJoin(solved)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for a whole number of degrees of freedom, by the finite series in the angle atan(t / sqrt(dof))."""
    angle = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2, even = F.pow(F.cos(angle), F.lit(2.0)), dof % 2 == 0
    count = F.floor(F.when(even, dof).otherwise(dof - 1) / 2).cast("int")
    ratio = lambda i: F.when(even, (2.0 * i - 1) / (2.0 * i)).otherwise(2.0 * i / (2.0 * i + 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        term = acc["term"] * ratio(i) * c2
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(count > 1, F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    series = F.when(count > 0, F.aggregate(steps, start, step)["sum"]).otherwise(0.0)
    within = F.when(even, F.sin(angle) * series).otherwise(2 / np.pi * (angle + F.sin(angle) * F.cos(angle) * series))
    return F.greatest(1 - within, F.lit(0.0))


def estimates(rows: DataFrame, exposure: str = "exposure", controls: tuple[str, ...] = CONTROLS, *by: str) -> DataFrame:
    """(by..., term, n, events, clusters, beta, se, t, p, r2): every term with its cluster-robust error.

    Clusters are ``cluster_id``; parameters count the event effects; p takes
    clusters - 1 degrees of freedom.
    """
    terms = (exposure, *controls)
    size = len(terms)
    d = demeaned(rows, terms, *by)
    solved = settled(fit(d, size, *by).where("beta is not null"))
    e = F.col("y") - sum((F.col("beta")[i] * F.col("x")[i] for i in range(1, size)), F.col("beta")[0] * F.col("x")[0])
    scores = _with(d, solved.select(*by, "beta"), by).withColumn("e", e).groupBy(*by, "cluster_id").agg(*[F.sum(F.col("x")[i] * F.col("e")).alias(f"s{i}") for i in range(size)])
    pulls = [sum((F.col("inverse")[j * size + i] * F.col(f"s{i}") for i in range(1, size)), F.col("inverse")[j * size] * F.col("s0")) for j in range(size)]
    meat = _with(scores, solved.select(*by, "inverse"), by).groupBy(*by).agg(F.count("*").alias("clusters"), F.array(*[F.sum(u * u) for u in pulls]).alias("meat"))
    out = _with(solved, meat, by)
    g, n, k = F.col("clusters"), F.col("n"), F.col("events") + size
    factor = g / F.greatest(g - 1, F.lit(1)) * (n - 1) / F.greatest(n - k, F.lit(1))
    out = out.select(*by, "n", "events", "clusters", (1 - F.col("rss") / F.nullif("total", F.lit(0.0))).alias("r2"), "beta", "meat", factor.alias("_c"), F.posexplode(F.array(*map(F.lit, terms))).alias("_i", "term"))
    out = out.withColumn("se", F.sqrt(F.col("_c") * F.element_at("meat", F.col("_i") + 1))).withColumn("beta", F.element_at("beta", F.col("_i") + 1))
    out = out.withColumn("t", F.col("beta") / F.nullif("se", F.lit(0.0)))
    return out.select(*by, "term", "n", "events", "clusters", "beta", "se", "t", t_two_sided(F.col("t"), F.greatest(g - 1, F.lit(1))).alias("p"), "r2")


def detectable(rows: DataFrame, exposure: str = "exposure", controls: tuple[str, ...] = CONTROLS, alpha: float = 0.05, power: float = 0.8, inflation: float = 1.0) -> DataFrame:
    """(n, clusters, residual_sd, exposure_sd, se, mde, effective_n, design_effect).

    The effective number of observations is what independent rows would have
    needed for the same error: (residual_sd / (exposure_sd * se)) squared, null
    where that is undefined.
    """
    terms = (exposure, *controls)
    whole = complete_cases(rows, "car", *terms)
    spread = whole.agg(F.stddev_samp(exposure).alias("exposure_sd"))
    d = demeaned(rows, terms)
    solved = fit(d, len(terms))
    z = inverse_normal(1 - alpha / 2) + inverse_normal(power)
    own = estimates(rows, exposure, controls).where(F.col("term") == exposure).select("n", "clusters", (F.col("se") * inflation).alias("se"))
    out = own.crossJoin(spread).crossJoin(solved.select("rss")).withColumn("residual_sd", F.sqrt(F.col("rss") / F.nullif(F.col("n") - 1, F.lit(0))))
    sound = (F.col("exposure_sd") > 0) & (F.col("se") > 0)
    out = out.withColumn("effective_n", F.when(sound, F.pow(F.col("residual_sd") / (F.col("exposure_sd") * F.col("se")), F.lit(2.0))))
    return out.select("n", "clusters", "residual_sd", "exposure_sd", "se", (F.col("se") * z).alias("mde"), "effective_n", (F.col("n") / F.nullif("effective_n", F.lit(0.0))).alias("design_effect"))


def leverage(rows: DataFrame, exposure: str = "exposure", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(event_id, unit_id, hat, cook, weight): leverage, Cook's distance and share in what identifies the exposure's slope."""
    terms = (exposure, *controls)
    size = len(terms)
    d = demeaned(rows, terms)
    r = d.crossJoin(fit(d, size).where("beta is not null"))
    x = [F.col("x")[i] for i in range(size)]
    quadratic = sum((F.col("inverse")[i * size + j] * x[i] * x[j] for i in range(size) for j in range(size)), F.lit(0.0))
    hat = F.least(F.greatest(1 / F.col("m") + quadratic, F.lit(0.0)), F.lit(1 - 1e-12))
    e = F.col("y") - sum((F.col("beta")[i] * x[i] for i in range(1, size)), F.col("beta")[0] * x[0])
    p = F.col("events") + size
    s2 = F.col("rss") / F.greatest(F.col("n") - p, F.lit(1))
    # row 0 of the inverse over its first entry takes the controls out of the exposure
    pure = sum((F.col("inverse")[i] * x[i] for i in range(1, size)), F.col("inverse")[0] * x[0]) / F.col("inverse")[0]
    out = r.select("event_id", "unit_id", "n", "events", hat.alias("hat"), e.alias("e"), s2.alias("s2"), p.alias("p"), (pure * pure / F.nullif("own", F.lit(0.0))).alias("weight"))
    cook = F.when(F.col("s2") > 0, F.col("e") * F.col("e") / (F.col("p") * F.col("s2")) * F.col("hat") / ((1 - F.col("hat")) * (1 - F.col("hat")))).otherwise(0.0)
    return out.select("event_id", "unit_id", "hat", cook.alias("cook"), "weight", F.col("p").alias("parameters"))


def leverage_report(lever: DataFrame) -> DataFrame:
    """One row: how concentrated the fit is.

    Shares of the top 1 and 5 per cent of rows (one at least) in all leverage,
    firms by participation ratio, Cook's distances over 4 / n, and what follows:
    balanced_share, participation_fraction, concentrated (over half in the top 5 %).
    """
    lever = settled(lever)
    n = lever.agg(F.count("*").alias("n"), F.sum("hat").alias("all"), F.max("cook").alias("max_cook"), F.max("parameters").alias("parameters"))
    # the smallest hat value of the top rows, from a count of values and not from a sort of all rows in one task
    tops = F.greatest(F.ceil(F.col("n") * F.lit(0.05)), F.lit(1)).cast("int"), F.greatest(F.ceil(F.col("n") * F.lit(0.01)), F.lit(1)).cast("int")
    counts = lever.groupBy("hat").agg(F.count("*").alias("c")).crossJoin(n)
    ranked = counts.withColumn("band", F.floor(F.col("hat") * 64)).withColumn("own", F.sum("c").over(Window.partitionBy("band").orderBy(F.desc("hat"))))
    bands = counts.withColumn("band", F.floor(F.col("hat") * 64)).groupBy("band").agg(F.sum("c").alias("b"))
    above = bands.withColumn("above", F.sum("b").over(Window.orderBy(F.desc("band"))) - F.col("b")).select("band", "above")  # 64 rows
    ranked = ranked.join(above, "band").withColumn("upto", F.col("own") + F.col("above"))

    def share(top: Column) -> Column:
        inside = F.least(F.greatest(top - (F.col("upto") - F.col("c")), F.lit(0)), F.col("c"))
        return F.sum(inside * F.col("hat") / F.nullif("all", F.lit(0.0)))

    shares = ranked.agg(share(tops[1]).alias("top_1"), share(tops[0]).alias("top_5"))
    firms = lever.groupBy("unit_id").agg(F.sum("hat").alias("h")).agg(F.count("*").alias("nominal_firms"), (F.sum("h") * F.sum("h") / F.nullif(F.sum(F.col("h") * F.col("h")), F.lit(0.0))).alias("effective_firms"))
    flags = lever.crossJoin(n.select("n")).agg(F.count(F.when(F.col("cook") > 4 / F.col("n"), 1)).alias("cook_flags"))
    weights = lever.agg((F.sum("weight") * F.sum("weight") / F.nullif(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0))).alias("effective_rows"))
    out = n.drop("all").crossJoin(shares).crossJoin(firms).crossJoin(flags).crossJoin(weights)
    return out.select("*", (F.col("parameters") / F.col("n")).alias("balanced_share"), (F.col("effective_firms") / F.col("nominal_firms")).alias("participation_fraction"), (F.col("top_5") > 0.5).alias("concentrated"))


def drop_path(rows: DataFrame, exposure: str = "exposure", controls: tuple[str, ...] = CONTROLS, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(k, dropped, n, beta, retained): the slope without the k most exposed firms, k = 0 included; all depths are one aggregate.

    ``retained`` is the share of the full slope; a depth that is not identified
    has beta null and retains 0.  ``n`` counts complete rows either way.
    """
    top = rows.groupBy("unit_id").agg(F.max(F.abs(exposure)).alias("_m")).where("_m is not null").orderBy(F.desc("_m"), "unit_id").limit(max(depths))
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_m"), "unit_id"))).select("unit_id", "place")  # at most max(depths) rows
    grid = rows.join(placed, "unit_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, (0, *depths))))).where("place is null or place > k")
    terms = (exposure, *controls)
    found = settled(fit(demeaned(grid, terms, "k"), len(terms), "k").select("k", "n", F.col("beta")[0].alias("beta")))
    full = found.where("k = 0").select(F.col("beta").alias("_b"))
    names = placed.crossJoin(found.select("k").distinct()).where("place <= k").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "unit_id"))), lambda s: s["unit_id"]), ", ").alias("dropped"))
    out = found.crossJoin(full).join(names, "k", "left")
    return out.select("k", F.coalesce("dropped", F.lit("")).alias("dropped"), "n", "beta", F.coalesce(F.col("beta") / F.nullif("_b", F.lit(0.0)), F.lit(0.0)).alias("retained"))


def form_agreement(rows: DataFrame, ranked: str, exposure: str = "exposure", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(continuous, rank, agrees): the slope on the exposure and on its rank, and whether both are non-zero and of one sign."""
    forms = rows.withColumn("f", F.explode(F.array(F.struct(F.lit("continuous").alias("form"), F.col(exposure).cast("double").alias("v")), F.struct(F.lit("rank").alias("form"), F.col(ranked).cast("double").alias("v")))))
    forms = forms.select("event_id", "unit_id", "car", *controls, F.col("f.form").alias("form"), F.col("f.v").alias("v"))
    terms = ("v", *controls)
    b = fit(demeaned(forms, terms, "form"), len(terms), "form").select("form", F.col("beta")[0].alias("beta"))
    out = b.agg(*[F.max(F.when(F.col("form") == f, F.col("beta"))).alias(f) for f in ("continuous", "rank")])
    return out.withColumn("agrees", F.coalesce(F.col("continuous") * F.col("rank") > 0, F.lit(False)))


def influence_verdict(path: DataFrame, agreement: DataFrame, report: DataFrame) -> DataFrame:
    """(survives, first_failing, agrees, concentrated, verdict): FRAGILE, CAUTION or ROBUST.

    The drop path survives if each depth keeps the full slope's sign and half of
    its size; a broken path or disagreeing forms are FRAGILE, concentrated
    leverage is CAUTION.
    """
    full = path.where("k = 0").select(F.col("beta").alias("_b"))
    steps = path.where("k > 0").crossJoin(full)
    fails = F.coalesce((F.signum("beta") != F.signum("_b")) | (F.col("retained") < 0.5), F.lit(True))
    a = steps.agg(F.min(F.when(fails, F.col("k"))).alias("first_failing"), F.count("*").alias("_n"))
    a = a.withColumn("survives", F.col("first_failing").isNull() & (F.col("_n") > 0)).crossJoin(agreement.select("agrees")).crossJoin(report.select("concentrated"))
    verdict = F.when(~F.col("survives") | ~F.col("agrees"), "FRAGILE").when(F.col("concentrated"), "CAUTION").otherwise("ROBUST")
    return a.select("survives", "first_failing", "agrees", "concentrated", verdict.alias("verdict"))


def p_floor(clusters: Column, draws: int, points: int) -> Column:
    """Least p of a wild bootstrap: 2 / points ** clusters by enumeration, 1 / (draws + 1) by sampling."""
    return F.greatest(F.least(F.exp(F.greatest(F.log(F.lit(2.0)) - clusters * F.log(F.lit(float(points))), F.lit(-745.0))), F.lit(1.0)), F.lit(1.0 / (draws + 1)))


def sign_consistency(rows: DataFrame, exposure: str = "exposure", controls: tuple[str, ...] = (), draws: int = 2000, points: int = 6) -> DataFrame:
    """One row: slopes on tightening and on loosening events and what their signs say.

    NOT RUN without events of one side; UNDERPOWERED with fewer than two a side
    or a floor of p over 5 %; else PASSES or FAILS by opposite signs.
    """
    terms = (exposure, *controls)
    b = fit(demeaned(rows, terms, "direction"), len(terms), "direction").select("direction", F.col("beta")[0].alias("beta"), "n", "events")
    sides = {"tighten": "tighten", "loosen": "loosen"}
    out = b.agg(
        *[F.max(F.when(F.col("direction") == s, F.col("beta"))).alias(f"beta_{s}") for s in sides], *[F.coalesce(F.max(F.when(F.col("direction") == s, F.col("events"))), F.lit(0)).alias(f"events_{s}") for s in sides]
    )
    out = out.withColumns({f"floor_{s}": p_floor(F.col(f"events_{s}"), draws, points) for s in sides})
    oppose = F.coalesce(F.col("beta_tighten") * F.col("beta_loosen") < 0, F.lit(False))
    thin = (F.least("events_tighten", "events_loosen") < 2) | (F.greatest("floor_tighten", "floor_loosen") > 0.05)
    verdict = F.when(F.least("events_tighten", "events_loosen") == 0, "NOT RUN").when(thin, "UNDERPOWERED").when(oppose, "PASSES").otherwise("FAILS")
    return out.select("*", oppose.alias("signs_oppose"), thin.alias("underpowered"), verdict.alias("verdict"))


def structure(rows: DataFrame, exposure: str = "exposure") -> DataFrame:
    """One row of counts: rows, events, clusters and firms in name, and those that carry identifying information."""
    spread = rows.groupBy("event_id").agg(F.coalesce(F.stddev_samp(exposure), F.lit(0.0)).alias("_s"), F.count_distinct(F.when(F.col(exposure) != 0, F.col("unit_id"))).alias("_e"))
    r = rows.join(spread, "event_id")
    tells = F.col("_s") > 1e-12
    exposed = F.col(exposure) != 0
    a = r.agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.count_distinct("cluster_id").alias("clusters"), F.count_distinct("unit_id").alias("firms"),
        F.count_distinct(F.when(tells, F.col("event_id"))).alias("identifying_events"), F.count_distinct(F.when(tells, F.col("cluster_id"))).alias("identifying_clusters"),
        F.count(F.when(exposed, 1)).alias("nonzero_rows"), F.count_distinct(F.when(exposed, F.col("unit_id"))).alias("exposed_firms"),
        F.count_distinct(F.when(F.col("_e") == 1, F.col("event_id"))).alias("events_of_one_exposed"), F.count_distinct(F.when(F.col("_e") >= 2, F.col("event_id"))).alias("events_of_more_exposed"), F.max("_e").alias("most_exposed_at_once"),
    )
    return a


def dose_notes(clusters: int, events: int, grouped: bool, scheme: str, draws: int = 2000) -> list[str]:
    """What must be said beside a slope: grouping, few clusters, coarse weights, an unreachable level."""
    from tidemark.operators.dose import p_floor as least

    floor = least(clusters, draws, 2 if scheme == "rademacher" else 6)
    notes = []
    if not grouped:
        notes.append("no grouping: each event is its own cluster, which overstates independence if events are close")
    elif clusters < events:
        notes.append(f"{events} events form {clusters} clusters; effects stay by event, errors and the floor of p go by cluster")
    if clusters < 12:
        notes.append(f"{clusters} clusters: the cluster-robust p over-rejects; the wild bootstrap's is the headline")
        if scheme == "rademacher":
            notes.append(f"two-point weights floor p at {floor:.4f}; six-point ones at {least(clusters, draws, 6):.6f}")
    if floor > 0.05:
        notes.append(f"the floor of p, {floor:.4f}, is over 0.05: nothing can be rejected at that level")
    return notes
