"""Queries on the dose-response with controls and clusters, its influence and its verdicts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.operators import effects as E
from tidemark.operators import exposure as O
from tidemark.operators import panel as P
from tidemark.operators import regression as R
from tidemark.operators import reporting as V
from tidemark.operators import resampling as G
from tidemark.operators import timing as T
from tidemark.operators.settle import settled
from tidemark.plans.dose_queries import BOOTED, TAIL, _exposure, booted_sql, resampled
from tidemark.plans.panel_queries import _fits, _GROUPS
from tidemark.plans.panel_queries import _sig as sig
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import cte

MOMENTUM, SKIP = 52, 8
CLOSED, REGION = "2000-12-31", 3  # units of one region are listed until that day


def s(x: str) -> str:
    return f"CAST(printf('%.7e', {x}) AS DOUBLE)"


def panel(spark, folder):
    """The full task grid with figures or reasons, and each event's direction."""
    prices = settled(X.weekly_prices(spark, folder))
    rows, windows, fits = _fits(spark, folder, prices)
    effects = E.car(E.abnormal_returns(rows, fits, windows), 0, 1)
    days = windows.withColumn("day", F.col("dt")).crossJoin(P.market_spine(prices).agg(F.max("pos").alias("last")))
    controls = P.controls(rows, prices, windows.where("reason is null"), momentum=MOMENTUM, skip=SKIP)
    listings = prices.where(F.col("region") == REGION).select("unit_id").distinct().select("unit_id", F.lit(None).cast("date").alias("first"), F.lit(CLOSED).cast("date").alias("last"))
    clusters = T.group_events(X.announcements(spark)).select("event_id", F.col("group_id").alias("cluster_id"))
    exposure = _exposure(spark, folder).select("event_id", "unit_id", "exposure", F.lit(1).alias("leg"))
    return R.car_panel(prices, days, exposure, controls, fits, effects, listings, clusters, MOMENTUM + SKIP)


def kept(spark, folder):
    return settled(panel(spark, folder).where("reason is null").drop("reason"))


_REG = cte("car", "expo", "ev", "units", "fit", "px", "ann") + _GROUPS.removeprefix(cte("ann")).rstrip() + f""",
cl AS (SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY g) > 1 THEN 'grp:' || first_value(event_id) OVER (PARTITION BY g ORDER BY ts, event_id) ELSE event_id END AS cluster_id FROM h),
tv AS (SELECT panel.*, CAST(px.px AS DOUBLE) * px.vol AS tv FROM panel LEFT JOIN px ON px.unit_id = panel.unit_id AND px.dt = panel.dt),
ctl AS (SELECT event_id, unit_id, ln(nullif(avg(tv), 0)) AS size, CASE WHEN count(CASE WHEN pos >= pre_end - {1 + SKIP + MOMENTUM} AND pos < pre_end - {1 + SKIP} THEN 1 END) = {MOMENTUM} THEN exp(sum(CASE WHEN pos >= pre_end - {1 + SKIP + MOMENTUM} AND pos < pre_end - {1 + SKIP} THEN ln(1 + ret) END)) - 1 END AS momentum,
 stddev_samp(ret) * sqrt(252) AS pre_event_vol FROM tv JOIN ev ON pos >= pre_start AND pos < pre_end WHERE reason IS NULL GROUP BY 1, 2),
pan AS (SELECT units.unit_id, ev.event_id, ev.direction, cluster_id, car, exposure, size, momentum, pre_event_vol, CASE WHEN ev.reason IS NOT NULL THEN 'window does not fit: ' || ev.reason WHEN ev.pre_end - 1 < {SKIP + MOMENTUM} THEN 'controls unavailable'
 WHEN region = {REGION} AND CAST(ts AS DATE) > DATE '{CLOSED}' THEN 'unit not available' WHEN exposure IS NULL THEN 'no exposure row' WHEN fit.n IS NULL THEN 'market model failed' WHEN car IS NULL THEN 'gaps inside the event window' END AS reason
 FROM units CROSS JOIN ev JOIN ann ON ann.event_id = ev.event_id JOIN cl ON cl.event_id = ev.event_id LEFT JOIN expo ON expo.unit_id = units.unit_id AND expo.event_id = ev.event_id
 LEFT JOIN ctl ON ctl.unit_id = units.unit_id AND ctl.event_id = ev.event_id LEFT JOIN fit ON fit.unit_id = units.unit_id AND fit.event_id = ev.event_id LEFT JOIN car ON car.unit_id = units.unit_id AND car.event_id = ev.event_id),
reg AS (SELECT * FROM pan WHERE reason IS NULL AND car IS NOT NULL AND exposure IS NOT NULL AND size IS NOT NULL AND momentum IS NOT NULL AND pre_event_vol IS NOT NULL)"""


def taken_out(source: str, by: str = "0") -> str:
    """CTEs that take event effects and the controls out of exposure and effect one after another; ``f`` has z1, z2, z3, x, y and the residual e."""

    def less(column: str, z: str, name: str) -> str:
        return f"{column} - {z} * coalesce(sum({column} * {z}) OVER w / nullif(sum({z} * {z}) OVER w, 0), 0) AS {name}"

    return f""",
f0 AS (SELECT *, {by} AS b_, count(*) OVER v AS m, size - avg(size) OVER v AS z1, momentum - avg(momentum) OVER v AS m0, pre_event_vol - avg(pre_event_vol) OVER v AS v0, exposure - avg(exposure) OVER v AS x0, car - avg(car) OVER v AS y0 FROM {source} WINDOW v AS (PARTITION BY {by}, event_id)),
f1 AS (SELECT *, {less("m0", "z1", "z2")}, {less("v0", "z1", "v1")}, {less("x0", "z1", "x1")}, {less("y0", "z1", "y1")} FROM f0 WINDOW w AS (PARTITION BY b_)),
f2 AS (SELECT *, {less("v1", "z2", "z3")}, {less("x1", "z2", "x2")}, {less("y1", "z2", "y2")} FROM f1 WINDOW w AS (PARTITION BY b_)),
f3 AS (SELECT *, {less("x2", "z3", "x")}, {less("y2", "z3", "y")} FROM f2 WINDOW w AS (PARTITION BY b_)),
f AS (SELECT *, sum(x * y) OVER w / nullif(sum(x * x) OVER w, 0) AS beta, y - x * sum(x * y) OVER w / nullif(sum(x * x) OVER w, 0) AS e FROM f3 WINDOW w AS (PARTITION BY b_))"""


_FIT = taken_out("reg") + """,
sc AS (SELECT cluster_id, sum(x * e) AS u FROM f GROUP BY 1),
est AS (SELECT n, events, g, beta, sqrt(g / greatest(g - 1.0, 1) * (n - 1.0) / greatest(n - events - 4, 1) * uu) / xx AS se, 1 - rss / total AS r2, rss, xsd FROM
 (SELECT count(*) AS n, count(DISTINCT event_id) AS events, any_value(beta) AS beta, sum(x * x) AS xx, sum(e * e) AS rss, var_pop(car) * count(*) AS total, stddev_samp(exposure) AS xsd FROM f), (SELECT count(*) AS g, sum(u * u) AS uu FROM sc))"""


@query("car_panel_with_controls", _REG + f" SELECT unit_id, event_id, cluster_id, {s('car')} AS car, {s('exposure')} AS exposure, {s('size')} AS size, {s('momentum')} AS momentum, {s('pre_event_vol')} AS pre_event_vol FROM pan WHERE reason IS NULL")
def car_panel_with_controls(spark, folder):
    return sig(kept(spark, folder), "car", "exposure", *R.CONTROLS).select("unit_id", "event_id", "cluster_id", "car", "exposure", *R.CONTROLS)


@query("car_panel_reasons", _REG + " SELECT coalesce(split_part(reason, ':', 1), 'kept') AS reason, CAST(count(*) AS BIGINT) AS pairs FROM pan GROUP BY 1")
def car_panel_reasons(spark, folder):
    return panel(spark, folder).groupBy(F.coalesce(F.substring_index("reason", ":", 1), F.lit("kept")).alias("reason")).agg(F.count("*").alias("pairs"))


@query("dose_response_with_controls", _REG + _FIT + f" SELECT CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS events, CAST(g AS BIGINT) AS clusters, {s('beta')} AS beta, {s('se')} AS se, {s('beta / se')} AS t, {s('p')} AS p, {s('r2')} AS r2 FROM (SELECT *, {TAIL} AS p FROM (SELECT *, greatest(g - 1, 1) AS nu, atan(abs(beta / se) / sqrt(greatest(g - 1, 1))) AS a FROM est))")
def dose_response_with_controls(spark, folder):
    out = R.estimates(kept(spark, folder)).where("term = 'exposure'").drop("term")
    return sig(out, "beta", "se", "t", "p", "r2")


_Z = "2.8015852181465855"  # the quantiles of 0.975 and 0.8 of the normal distribution, added


@query("dose_response_detectable", _REG + _FIT + f" SELECT CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS clusters, {s('rsd')} AS residual_sd, {s('xsd')} AS exposure_sd, {s('se')} AS se, {s(f'se * {_Z}')} AS mde, {s('pow(rsd / (xsd * se), 2)')} AS effective_n, {s('n / pow(rsd / (xsd * se), 2)')} AS design_effect FROM (SELECT *, sqrt(rss / (n - 1)) AS rsd FROM est)")
def dose_response_detectable(spark, folder):
    return sig(R.detectable(kept(spark, folder)), "residual_sd", "exposure_sd", "se", "mde", "effective_n", "design_effect")


_HAT = taken_out("reg") + """,
t AS (SELECT sum(z1 * z1) AS a1, sum(z2 * z2) AS a2, sum(z3 * z3) AS a3, sum(x * x) AS ax, sum(e * e) AS rss, count(*) AS n, count(DISTINCT event_id) + 4 AS p FROM f),
hh AS (SELECT event_id, unit_id, n, p, least(1.0 / m + z1 * z1 / a1 + z2 * z2 / a2 + z3 * z3 / a3 + x * x / ax, 1 - 1e-12) AS hat, e, rss / greatest(n - p, 1) AS s2, x * x / ax AS weight FROM f, t),
lev AS (SELECT event_id, unit_id, n, p, hat, e * e / (p * s2) * hat / ((1 - hat) * (1 - hat)) AS cook, weight FROM hh)"""


@query("leverage_with_controls", _REG + _HAT + f" SELECT event_id, unit_id, {s('hat')} AS hat, round(cook, 9) AS cook, round(weight, 9) AS weight FROM lev")
def leverage_with_controls(spark, folder):
    out = sig(R.leverage(kept(spark, folder)), "hat")
    return out.select("event_id", "unit_id", "hat", F.round("cook", 9).alias("cook"), F.round("weight", 9).alias("weight"))


_REPORT = f"""(SELECT CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(p) AS BIGINT) AS parameters, max(cook) AS max_cook, CAST(count(CASE WHEN cook > 4.0 / n THEN 1 END) AS BIGINT) AS cook_flags, sum(CASE WHEN k <= greatest(ceil(0.01 * n), 1) THEN hat END) / sum(hat) AS top_1, sum(CASE WHEN k <= greatest(ceil(0.05 * n), 1) THEN hat END) / sum(hat) AS top_5, sum(weight) * sum(weight) / sum(weight * weight) AS effective_rows
 FROM (SELECT *, row_number() OVER (ORDER BY hat DESC) AS k FROM lev)), (SELECT CAST(count(*) AS BIGINT) AS nominal_firms, sum(h) * sum(h) / sum(h * h) AS effective_firms FROM (SELECT unit_id, sum(hat) AS h FROM lev GROUP BY 1))"""


@query("leverage_report", _REG + _HAT + f" SELECT n, parameters, {s('max_cook')} AS max_cook, cook_flags, {s('top_1')} AS top_1, {s('top_5')} AS top_5, nominal_firms, {s('effective_firms')} AS effective_firms, {s('effective_rows')} AS effective_rows, {s('parameters / CAST(n AS DOUBLE)')} AS balanced_share, {s('effective_firms / nominal_firms')} AS participation_fraction, top_5 > 0.5 AS concentrated FROM {_REPORT}")
def leverage_report(spark, folder):
    return sig(R.leverage_report(R.leverage(kept(spark, folder))), "max_cook", "top_1", "top_5", "effective_firms", "effective_rows", "balanced_share", "participation_fraction")


_DROP = """,
top AS (SELECT unit_id, row_number() OVER (ORDER BY max(abs(exposure)) DESC, unit_id) AS place FROM pan WHERE reason IS NULL GROUP BY unit_id), ks AS (SELECT CAST(v AS INT) AS k FROM (VALUES (0), (1), (2), (3), (5)) AS t(v)),
dk AS (SELECT reg.*, k FROM reg JOIN top ON top.unit_id = reg.unit_id JOIN ks ON place > k)""" + taken_out("dk", "k") + """,
pb AS (SELECT k, count(*) AS n, any_value(beta) AS beta FROM f GROUP BY k),
path AS (SELECT pb.k, (SELECT coalesce(string_agg(unit_id, ', ' ORDER BY place), '') FROM top WHERE place <= pb.k) AS dropped, n, beta, beta / (SELECT beta FROM pb WHERE k = 0) AS retained FROM pb)"""


@query("drop_path_with_controls", _REG + _DROP + f" SELECT k, dropped, CAST(n AS BIGINT) AS n, {s('beta')} AS beta, {s('retained')} AS retained FROM path")
def drop_path_with_controls(spark, folder):
    return sig(R.drop_path(kept(spark, folder)), "beta", "retained")


def _ranked(spark, folder):
    return settled(O.rank_buckets(kept(spark, folder), "exposure", "event_id", 10, "decile"))


_FORMS = """,
rk AS (SELECT *, ceil(round((rank() OVER (PARTITION BY event_id ORDER BY exposure) + (count(*) OVER (PARTITION BY event_id, exposure) - 1) / 2.0) / count(*) OVER (PARTITION BY event_id) * 10, 9)) / 10 AS decile FROM (SELECT * FROM pan WHERE reason IS NULL)),
fo AS (SELECT event_id, unit_id, cluster_id, car, size, momentum, pre_event_vol, 'continuous' AS form, exposure FROM rk UNION ALL SELECT event_id, unit_id, cluster_id, car, size, momentum, pre_event_vol, 'rank', decile FROM rk),
fc AS (SELECT * FROM fo WHERE car IS NOT NULL AND exposure IS NOT NULL AND size IS NOT NULL AND momentum IS NOT NULL AND pre_event_vol IS NOT NULL)"""


@query("functional_form_agreement", _REG + _FORMS + taken_out("fc", "form") + f" SELECT {s('c')} AS continuous, {s('r')} AS rank, c * r > 0 AS agrees FROM (SELECT max(CASE WHEN form = 'continuous' THEN beta END) AS c, max(CASE WHEN form = 'rank' THEN beta END) AS r FROM f)")
def functional_form_agreement(spark, folder):
    return sig(R.form_agreement(_ranked(spark, folder), "decile"), "continuous", "rank")


def _renamed(sql: str, name: str) -> str:
    """The steps of ``taken_out`` under another name, for statements that take out twice."""
    return re.sub(r"\bf([0-3]?)\b", rf"{name}\1", sql)


@query(
    "influence_verdict",
    _REG + _DROP + _renamed(_FORMS + taken_out("fc", "form"), "fu") + _renamed(_HAT, "fv") + f""",
ag AS (SELECT coalesce(max(CASE WHEN form = 'continuous' THEN beta END) * max(CASE WHEN form = 'rank' THEN beta END) > 0, FALSE) AS agrees FROM fu),
fl AS (SELECT min(CASE WHEN sign(p.beta) <> sign(q.beta) OR p.retained < 0.5 THEN p.k END) AS b FROM path p, path q WHERE q.k = 0 AND p.k > 0),
ve AS (SELECT b IS NULL AS survives, CAST(coalesce(b, 0) AS INT) AS first_failing, agrees, top_5 > 0.5 AS concentrated FROM fl, ag, (SELECT top_5 FROM {_REPORT}))
SELECT *, CASE WHEN NOT survives OR NOT agrees THEN 'FRAGILE' WHEN concentrated THEN 'CAUTION' ELSE 'ROBUST' END AS verdict FROM ve""",
)
def influence_verdict(spark, folder):
    rows = _ranked(spark, folder)
    out = R.influence_verdict(R.drop_path(rows), R.form_agreement(rows, "decile"), R.leverage_report(R.leverage(rows)))
    return out.withColumn("first_failing", F.coalesce("first_failing", F.lit(0)))


@query("sign_consistency", _REG + ", dd AS (SELECT * FROM reg)" + taken_out("dd", "direction") + f""", b AS (SELECT direction, any_value(beta) AS beta, count(DISTINCT event_id) AS k FROM f GROUP BY 1),
o AS (SELECT max(CASE WHEN direction = 'tighten' THEN beta END) AS bt, max(CASE WHEN direction = 'loosen' THEN beta END) AS bl, coalesce(max(CASE WHEN direction = 'tighten' THEN k END), 0) AS et, coalesce(max(CASE WHEN direction = 'loosen' THEN k END), 0) AS el FROM b),
w AS (SELECT *, greatest(least(2 / pow(6.0, et), 1.0), 1.0 / 2001) AS ft, greatest(least(2 / pow(6.0, el), 1.0), 1.0 / 2001) AS fl FROM o)
SELECT {s('bt')} AS beta_tighten, {s('bl')} AS beta_loosen, CAST(et AS BIGINT) AS events_tighten, CAST(el AS BIGINT) AS events_loosen, {s('ft')} AS floor_tighten, {s('fl')} AS floor_loosen, coalesce(bt * bl < 0, false) AS signs_oppose, least(et, el) < 2 OR greatest(ft, fl) > 0.05 AS underpowered,
 CASE WHEN least(et, el) = 0 THEN 'NOT RUN' WHEN least(et, el) < 2 OR greatest(ft, fl) > 0.05 THEN 'UNDERPOWERED' WHEN bt * bl < 0 THEN 'PASSES' ELSE 'FAILS' END AS verdict FROM w""")
def sign_consistency(spark, folder):
    rows = kept(spark, folder).join(X.announcements(spark).select("event_id", "direction"), "event_id")
    return sig(R.sign_consistency(rows, controls=R.CONTROLS), "beta_tighten", "beta_loosen", "floor_tighten", "floor_loosen")


@query("exclusion_sensitivity", _REG + ", reg2 AS (SELECT * FROM reg WHERE event_id <> 'a5')" + _FIT.replace("FROM reg ", "FROM reg2 ") + f" SELECT CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS clusters, {s('beta')} AS beta, {s('se')} AS se FROM est")
def exclusion_sensitivity(spark, folder):
    out = R.estimates(kept(spark, folder).where("event_id <> 'a5'")).where("term = 'exposure'")
    return sig(out.select("n", "clusters", "beta", "se"), "beta", "se")


@query(
    "identifying_structure",
    _REG + """, k AS (SELECT * FROM pan WHERE reason IS NULL), e AS (SELECT event_id, coalesce(stddev_samp(exposure), 0) > 1e-12 AS tells, count(DISTINCT CASE WHEN exposure <> 0 THEN unit_id END) AS x FROM k GROUP BY 1), r AS (SELECT k.*, tells, x FROM k JOIN e ON e.event_id = k.event_id)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT event_id) AS BIGINT) AS events, CAST(count(DISTINCT cluster_id) AS BIGINT) AS clusters, CAST(count(DISTINCT unit_id) AS BIGINT) AS firms, CAST(count(DISTINCT CASE WHEN tells THEN event_id END) AS BIGINT) AS identifying_events, CAST(count(DISTINCT CASE WHEN tells THEN cluster_id END) AS BIGINT) AS identifying_clusters,
 CAST(count(CASE WHEN exposure <> 0 THEN 1 END) AS BIGINT) AS nonzero_rows, CAST(count(DISTINCT CASE WHEN exposure <> 0 THEN unit_id END) AS BIGINT) AS exposed_firms, CAST(count(DISTINCT CASE WHEN x = 1 THEN event_id END) AS BIGINT) AS events_of_one_exposed, CAST(count(DISTINCT CASE WHEN x >= 2 THEN event_id END) AS BIGINT) AS events_of_more_exposed, CAST(max(x) AS BIGINT) AS most_exposed_at_once FROM r""",
)
def identifying_structure(spark, folder):
    return R.structure(kept(spark, folder))


@query("wild_bootstrap_with_controls", _REG + taken_out("reg") + ", dr AS (SELECT event_id, unit_id, cluster_id, x0, z1, z2, z3, x, y FROM f)" + resampled("dr", ("z1", "z2", "z3")) + booted_sql(f", {s('p_wild')} AS headline_p, p_floor <= 0.05 AS detectable, p_wild <= p_floor * 1.0001 AS at_the_floor"))
def wild_bootstrap_with_controls(spark, folder):
    return sig(G.verdicts(G.wild_bootstrap(kept(spark, folder), "webb", controls=R.CONTROLS)), *BOOTED, "headline_p")


def headline(spark, folder):
    rows = _ranked(spark, folder)
    lever = R.leverage_report(R.leverage(rows))
    influence = R.influence_verdict(R.drop_path(rows), R.form_agreement(rows, "decile"), lever)
    signs = R.sign_consistency(rows.join(X.announcements(spark).select("event_id", "direction"), "event_id"), controls=R.CONTROLS)
    boot = G.verdicts(G.wild_bootstrap(rows, "webb", controls=R.CONTROLS))
    return V.dose_headline(settled(boot), settled(influence), settled(lever), R.detectable(rows), settled(signs))


_HEAD = (
    _REG + _DROP + _renamed(_FORMS + taken_out("fc", "form"), "fu") + _renamed(_HAT, "fv") + _renamed(", dd AS (SELECT * FROM reg)" + taken_out("dd", "direction"), "fs") + _renamed(taken_out("reg"), "fr")
    + ", dr AS (SELECT event_id, unit_id, cluster_id, x0, z1, z2, z3, x, y FROM fr)" + resampled("dr", ("z1", "z2", "z3"))
    + f""", sb AS (SELECT direction, any_value(beta) AS beta, count(DISTINCT event_id) AS k FROM fs GROUP BY 1),
so AS (SELECT max(CASE WHEN direction = 'tighten' THEN beta END) AS bt, max(CASE WHEN direction = 'loosen' THEN beta END) AS bl, coalesce(max(CASE WHEN direction = 'tighten' THEN k END), 0) AS et, coalesce(max(CASE WHEN direction = 'loosen' THEN k END), 0) AS el FROM sb),
sg AS (SELECT coalesce(bt * bl < 0, FALSE) AS opp, least(et, el) < 2 OR greatest(greatest(least(2 / pow(6.0, et), 1.0), 1.0 / 2001), greatest(least(2 / pow(6.0, el), 1.0), 1.0 / 2001)) > 0.05 AS weak, least(et, el) AS few FROM so),
sv AS (SELECT opp, weak, CASE WHEN few = 0 THEN 'NOT RUN' WHEN weak THEN 'UNDERPOWERED' WHEN opp THEN 'PASSES' ELSE 'FAILS' END AS sign_test FROM sg),
ag AS (SELECT coalesce(max(CASE WHEN form = 'continuous' THEN beta END) * max(CASE WHEN form = 'rank' THEN beta END) > 0, FALSE) AS agrees FROM fu),
fl AS (SELECT min(CASE WHEN sign(p.beta) <> sign(q.beta) OR p.retained < 0.5 THEN p.k END) AS b FROM path p, path q WHERE q.k = 0 AND p.k > 0),
hl AS (SELECT boot.beta, p_wild, p_floor, p_random, nominal_firms, effective_firms, b IS NULL AS survives, agrees, top_5 > 0.5 AS concentrated, sign_test, p_floor <= 0.05 AS reachable, p_wild <= p_floor * 1.0001 AS at_the_floor, weak OR opp AS sign_ok FROM boot, fl, ag, sv, {_REPORT})
"""
)


@query("dose_headline", _HEAD + f"SELECT {s('beta')} AS beta, {s('p_wild')} AS p_wild, {s('p_floor')} AS p_floor, {s('p_random')} AS p_random, CAST(nominal_firms AS BIGINT) AS nominal_firms, {s('effective_firms')} AS effective_firms, survives, agrees, concentrated, CASE WHEN NOT survives OR NOT agrees THEN 'FRAGILE' WHEN concentrated THEN 'CAUTION' ELSE 'ROBUST' END AS influence, sign_test, reachable, at_the_floor, reachable AND NOT at_the_floor AND survives AND agrees AND sign_ok AS trustworthy FROM hl")
def dose_headline(spark, folder):
    """The slope with every verdict that goes beside it, and whether all of its checks passed."""
    return sig(headline(spark, folder).drop("mde"), "beta", "p_wild", "p_floor", "p_random", "effective_firms")
