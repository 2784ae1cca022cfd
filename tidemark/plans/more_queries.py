"""Queries on autocorrelation-robust trends, in-time placebos, refits and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import discovery as V
from tidemark.operators import dose as D
from tidemark.operators import effects as E
from tidemark.operators import exposure as O
from tidemark.operators import panel as P
from tidemark.operators import timing as T
from tidemark.operators.settle import settled
from tidemark.plans.dose_queries import _dose
from tidemark.plans.panel_queries import _ar, _panel, _round, _sig, _windows
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import ESTIMATION, GAP, HORIZON, cte

_LAGS = " + ".join(f"2 * (1 - {k} / 11.0) * s * coalesce(lag(s, {k}) OVER (PARTITION BY event_id, unit_id ORDER BY x), 0)" for k in range(1, 11))


@query(
    "pretrend_slope_hac",
    cte("ar") + f""", g AS (SELECT event_id, unit_id, CAST(rel AS DOUBLE) AS x, sum(ar) OVER (PARTITION BY event_id, unit_id ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ar WHERE rel < -{GAP}),
b AS (SELECT *, regr_slope(g, x) OVER w AS b, x - avg(x) OVER w AS dx, g - avg(g) OVER w AS dg FROM g WINDOW w AS (PARTITION BY event_id, unit_id)),
s AS (SELECT event_id, unit_id, x, b, dx, dx * (dg - b * dx) AS s FROM b), p AS (SELECT event_id, unit_id, b, dx, s * s + {_LAGS} AS p FROM s),
r AS (SELECT event_id, unit_id, max(b) AS slope, sqrt(greatest(sum(p), 0)) / nullif(sum(dx * dx), 0) AS se FROM p GROUP BY 1, 2)
SELECT event_id, unit_id, round(slope, 5) + 0.0 AS slope, round(se, 5) AS se, round(slope / nullif(se, 0), 3) + 0.0 AS t FROM r""",
)
def pretrend_slope_hac(spark, folder):
    return _round(_round(E.newey_west_slope(_ar(spark, folder), GAP), 5, "slope", "se"), 3, "t")


_IN_TIME = """, k AS (SELECT CAST(range AS INT) - 1 AS k FROM range(0, 13)), d AS (SELECT event_id, k, CASE WHEN k = -1 THEN t0 ELSE t0 - 9 - k * 6 END AS p FROM ev, k), dd AS (SELECT * FROM d WHERE p >= 130),
f AS (SELECT event_id, k, unit_id, p, regr_slope(ret, mkt) AS b, regr_intercept(ret, mkt) AS a FROM panel JOIN dd ON pos >= p - 130 AND pos < p - 10 GROUP BY 1, 2, 3, 4 HAVING count(ret) = 120),
c AS (SELECT f.event_id, k, f.unit_id, sum(ret - a - b * mkt) AS car FROM f JOIN panel ON panel.unit_id = f.unit_id AND pos BETWEEN p AND p + 5 GROUP BY 1, 2, 3 HAVING count(ret) = 6)
"""


@query(
    "in_time_placebo_p_values",
    cte("panel", "ev") + _IN_TIME + """SELECT x.event_id, x.unit_id, round(x.car, 5) + 0.0 AS tau, CAST(count(*) AS BIGINT) AS placebos, round((1 + count(CASE WHEN abs(y.car) >= abs(x.car) THEN 1 END)) / CAST(1 + count(*) AS DOUBLE), 6) AS p_value
FROM c x JOIN c y ON x.event_id = y.event_id AND x.unit_id = y.unit_id AND y.k >= 0 WHERE x.k = -1 GROUP BY x.event_id, x.unit_id, x.car""",
)
def in_time_placebo_p_values(spark, folder):
    return _round(_round(_in_time(spark, folder), 5, "tau"), 6, "p_value")


def _in_time(spark, folder):
    windows = _windows(spark, folder)
    offsets = T.placebo_offsets(windows, 120, 10, 5, buffer=3, most=12)
    return E.in_time_placebos(_panel(spark, folder), windows, offsets, 120, 10, 5)


@query(
    "pretrend_verdicts",
    cte("ar") + f""", g AS (SELECT event_id, unit_id, CAST(rel AS DOUBLE) AS x, sum(ar) OVER (PARTITION BY event_id, unit_id ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ar WHERE rel < 0),
b AS (SELECT *, regr_slope(g, x) OVER w AS b, x - avg(x) OVER w AS dx, g - avg(g) OVER w AS dg FROM g WHERE x < -{GAP} WINDOW w AS (PARTITION BY event_id, unit_id)),
s AS (SELECT event_id, unit_id, x, b, dx, dx * (dg - b * dx) AS s FROM b), p AS (SELECT event_id, unit_id, b, dx, s * s + {_LAGS} AS p FROM s),
r AS (SELECT event_id, unit_id, abs(max(b) / nullif(sqrt(greatest(sum(p), 0)) / nullif(sum(dx * dx), 0), 0)) / sqrt(2) AS x FROM p GROUP BY 1, 2),
h AS (SELECT event_id, unit_id, max(CASE WHEN x = -1 THEN g END) - max(CASE WHEN x = -{GAP} - 1 THEN g END) AS drift, stddev_samp(CASE WHEN x < -{GAP} THEN step END) * sqrt(count(CASE WHEN x >= -{GAP} THEN g END)) AS scale FROM (SELECT *, g - lag(g) OVER (PARTITION BY event_id, unit_id ORDER BY x) AS step FROM g) GROUP BY 1, 2),
v AS (SELECT r.event_id, r.unit_id, CASE WHEN x > 8 THEN 0.0 ELSE greatest(1 - exp(-x * x) * list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(greatest(x, 1e-300)) - lgamma(n + 1.5)))), 0) END AS p, abs(drift / nullif(scale, 0)) > 1.96 AS far FROM r JOIN h USING (event_id, unit_id))
SELECT event_id, unit_id, round(p, 6) AS slope_p, coalesce(p < 0.05, FALSE) AS trend_before, coalesce(far, FALSE) AS drift_far, NOT (coalesce(p < 0.05, FALSE) OR coalesce(far, FALSE)) AS clean FROM v""",
)
def pretrend_verdicts(spark, folder):
    ar = settled(_ar(spark, folder))
    return _round(E.pretrend_verdict(E.pretrend(ar, GAP), E.newey_west_slope(ar, GAP)), 6, "slope_p")


@query(
    "combined_placebos",
    cte("panel", "ar") + f""", ef AS (SELECT event_id, unit_id, sum(ar) AS tau FROM ar WHERE rel BETWEEN 0 AND {HORIZON} GROUP BY 1, 2 HAVING count(ar) = {HORIZON + 1})""" + _IN_TIME.rstrip() + """
SELECT event_id, unit_id, 'in space' AS placebo, round(count(*) OVER (PARTITION BY event_id ORDER BY abs(tau) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(*) OVER (PARTITION BY event_id) AS DOUBLE), 6) AS p_value FROM ef
UNION ALL SELECT x.event_id, x.unit_id, 'in time', round((1 + count(CASE WHEN abs(y.car) >= abs(x.car) THEN 1 END)) / CAST(1 + count(*) AS DOUBLE), 6) FROM c x JOIN c y ON x.event_id = y.event_id AND x.unit_id = y.unit_id AND y.k >= 0 WHERE x.k = -1 GROUP BY x.event_id, x.unit_id, x.car""",
)
def combined_placebos(spark, folder):
    """A unit's effect against other units at its date, and against its own at earlier dates, side by side."""
    space = E.placebo_p_values(E.car(_ar(spark, folder), 0, HORIZON).withColumnRenamed("car", "tau"))
    return _round(E.combined(space, _in_time(spark, folder)), 6, "p_value")


@query(
    "winsorised_and_rank_betas",
    cte("dose") + """, q AS (SELECT event_id, quantile_cont(exposure, 0.01) AS lo, quantile_cont(exposure, 0.99) AS hi FROM dose GROUP BY 1),
w AS (SELECT dose.event_id, car, 'winsorised' AS form, greatest(least(exposure, hi), lo) AS x FROM dose JOIN q ON q.event_id = dose.event_id
 UNION ALL SELECT event_id, car, 'continuous', exposure FROM dose
 UNION ALL SELECT event_id, car, 'rank', ceil(round((rank() OVER (PARTITION BY event_id ORDER BY exposure) + (count(*) OVER (PARTITION BY event_id, exposure) - 1) / 2.0) / count(*) OVER (PARTITION BY event_id) * 10, 9)) / 10 FROM dose),
d AS (SELECT form, x - avg(x) OVER (PARTITION BY form, event_id) AS x, car - avg(car) OVER (PARTITION BY form, event_id) AS y FROM w)
SELECT form, CAST(count(*) AS BIGINT) AS n, CAST(printf('%.7e', sum(x * y) / nullif(sum(x * x), 0)) AS DOUBLE) AS beta FROM d GROUP BY form""",
)
def winsorised_and_rank_betas(spark, folder):
    rows = _dose(spark, folder)
    forms = {"continuous": rows, "winsorised": O.winsorise(rows, "exposure", "event_id", 0.01, 0.99), "rank": O.rank_buckets(rows, "exposure", "event_id", 10, "r").withColumn("exposure", F.col("r"))}
    out = None
    for name, frame in forms.items():
        one = D.slope(frame).select(F.lit(name).alias("form"), "n", "beta")
        out = one if out is None else out.unionByName(one)
    return _sig(out, "beta")


@query("separate_reporting", cte("ann") + "SELECT event_id, risk = 'high' OR confounder <> '' OR leak_note <> '' AS flagged FROM ann")
def separate_reporting(spark, folder):
    from tidemark.operators.reporting import report_separately

    return report_separately(X.announcements(spark)).select("event_id", "flagged")


@query(
    "market_model_ridge",
    cte("panel", "ev") + f"""SELECT event_id, unit_id, CAST(printf('%.7e', ((n + 0.5) * sxy - sx * sy) / ((n + 0.5) * (sxx + 0.5) - sx * sx)) AS DOUBLE) AS beta, CAST(printf('%.7e', ((sxx + 0.5) * sy - sx * sxy) / ((n + 0.5) * (sxx + 0.5) - sx * sx)) AS DOUBLE) AS alpha
FROM (SELECT event_id, unit_id, count(ret) AS n, sum(mkt) AS sx, sum(ret) AS sy, sum(mkt * mkt) AS sxx, sum(mkt * ret) AS sxy FROM panel JOIN ev ON pos >= pre_start AND pos < pre_end WHERE reason IS NULL GROUP BY 1, 2 HAVING count(ret) = {ESTIMATION} AND count(mkt) = {ESTIMATION})""",
)
def market_model_ridge(spark, folder):
    fits = E.fit_market_model(_panel(spark, folder), _windows(spark, folder), ESTIMATION, ridge=0.5)
    return _sig(fits.select("event_id", "unit_id", "beta", "alpha"), "beta", "alpha")


@query(
    "directional_power",
    cte("ar", "ann") + f""", ef AS (SELECT ar.event_id, any_value(direction) AS d, unit_id, sum(ar) AS tau FROM ar JOIN ann ON ann.event_id = ar.event_id WHERE rel BETWEEN 0 AND {HORIZON} GROUP BY ar.event_id, unit_id HAVING count(ar) = {HORIZON + 1}),
x AS (SELECT event_id, CASE WHEN event_id = 'a9' THEN 'ambiguous' WHEN d = 'tighten' THEN 'negative' ELSE 'positive' END AS expected, tau FROM ef), y AS (SELECT *, CASE WHEN expected = 'negative' THEN -tau ELSE tau END AS s, CASE expected WHEN 'negative' THEN -tau WHEN 'positive' THEN tau ELSE abs(tau) END AS c, CASE WHEN expected = 'negative' THEN -1 ELSE 1 END AS sg FROM x),
q AS (SELECT event_id, expected, any_value(sg) AS sg, count(*) AS n, quantile_cont(c, 0.95) AS critical, quantile_cont(s, 0.2) AS low, quantile_cont(s, 0.5) AS middle, stddev_samp(tau) AS sd FROM y GROUP BY 1, 2)
SELECT event_id, expected, CAST(n AS BIGINT) AS n, round(sg * critical, 5) + 0.0 AS critical, round(sg * (critical - low), 5) + 0.0 AS mde, round(sg * (critical - middle), 5) + 0.0 AS mde_50, round(sd, 5) AS sd FROM q""",
)
def directional_power(spark, folder):
    tau = E.car(_ar(spark, folder), 0, HORIZON).join(X.announcements(spark).select("event_id", "direction"), "event_id")
    expected = F.when(F.col("event_id") == "a9", "ambiguous").when(F.col("direction") == "tighten", "negative").otherwise("positive")
    return _round(E.directional_power(tau.select("event_id", F.col("car").alias("tau"), expected.alias("expected"))), 5, "critical", "mde", "mde_50", "sd")


@query(
    "loaded_panel",
    cte("px", "spine") + """, li AS (SELECT n_name AS unit_id, n_name AS source, CASE WHEN n_nationkey % 4 = 0 THEN DATE '1995-01-01' END AS first_, NULL::DATE AS last_, n_nationkey % 3 = 0 AS late FROM nation UNION ALL SELECT n_name || '_OLD', n_name, NULL, DATE '1994-12-31', n_nationkey % 3 = 0 FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'NOWHERE', 'none', NULL, NULL, FALSE),
r AS (SELECT unit_id AS source, dt, CAST(px AS DOUBLE) / lag(px) OVER (PARTITION BY unit_id ORDER BY dt) - 1 AS ret FROM px), l AS (SELECT *, lag(ret) OVER (PARTITION BY source ORDER BY dt) AS before_ FROM r),
t AS (SELECT unit_id AS source, avg(CASE WHEN dt BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN CAST(px AS DOUBLE) * vol END) AS turnover FROM px GROUP BY 1)
SELECT li.unit_id, spine.dt, pos, round(CASE WHEN late THEN before_ ELSE ret END, 6) + 0.0 AS ret, CAST(printf('%.7e', turnover) AS DOUBLE) AS turnover, coalesce(turnover < 2e12, TRUE) AS screened_out FROM li CROSS JOIN spine
LEFT JOIN l ON l.source = li.source AND l.dt = spine.dt AND (first_ IS NULL OR l.dt >= first_) AND (last_ IS NULL OR l.dt <= last_) LEFT JOIN t ON t.source = li.source""",
)
def loaded_panel(spark, folder):
    """Series to panel in one: own calendars, late markets, two units on one series, the spine and the screen."""
    nation, k = X.table(spark, folder, "nation"), F.col("n_nationkey")
    none = F.lit(None).cast("date")
    own = nation.select(F.col("n_name").alias("unit_id"), F.col("n_name").alias("source_ticker"), F.when(k % 4 == 0, F.lit("1995-01-01").cast("date")).alias("first"), none.alias("last"), (k % 3 == 0).alias("late"))
    old = nation.where(k % 4 == 0).select(F.concat("n_name", F.lit("_OLD")).alias("unit_id"), F.col("n_name").alias("source_ticker"), none.alias("first"), F.lit("1994-12-31").cast("date").alias("last"), (k % 3 == 0).alias("late"))
    gone = spark.createDataFrame([("NOWHERE", "none", None, None, False)], own.schema)
    prices = settled(X.weekly_prices(spark, folder))
    out = P.build_panel(own.unionByName(old).unionByName(gone), prices.select(F.col("unit_id").alias("source_ticker"), "dt", "px", "vol"), P.market_spine(prices), 2e12, "1997-01-01", "1997-12-31")
    return _sig(_round(out.drop("mkt"), 6, "ret"), "turnover")


@query(
    "controls_without_prices",
    cte("panel", "ev", "px") + """, a AS (SELECT event_id, panel.unit_id, avg(CAST(px AS DOUBLE) * vol) AS t, var_samp(ret) AS v FROM panel JOIN ev ON pos >= pre_start AND pos < pre_end LEFT JOIN px ON px.unit_id = panel.unit_id AND px.dt = panel.dt WHERE reason IS NULL GROUP BY 1, 2)
SELECT event_id, unit_id, FALSE AS size_is_fallback, CAST(printf('%.7e', ln(t / CASE WHEN unit_id < 'G' THEN 100 ELSE 1 END)) AS DOUBLE) AS size FROM a UNION ALL SELECT event_id, unit_id, TRUE, CAST(printf('%.7e', ln(v)) AS DOUBLE) FROM a""",
)
def controls_without_prices(spark, folder):
    """Size from turnover, pence scaled, beside its stand-in from returns alone."""
    prices = settled(X.weekly_prices(spark, folder))
    panel, windows = settled(_panel(spark, folder, prices)), settled(_windows(spark, folder, prices)).where("reason is null")
    priced = P.controls(panel, prices, windows, 52, 8, pence=F.col("unit_id") < "G")
    bare = P.controls(panel, None, windows, 52, 8)
    return _sig(priced.unionByName(bare).select("event_id", "unit_id", "size_is_fallback", "size"), "size")
