"""Queries over the derived weekly panel: returns, windows, effects, placebos, power."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import effects as E
from tidemark.operators import panel as P
from tidemark.operators import timing as T
from tidemark.operators.settle import settled
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import ESTIMATION, GAP, HORIZON, cte


def _round(df, digits: int, *names: str):
    """Rounded, and without negative zeros."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _sig(df, *names: str):
    """Figures at eight significant digits."""
    return df.withColumns({n: F.when(F.col(n).isNotNull(), F.format_string("%.7e", F.col(n)).cast("double")) for n in names})


def _panel(spark, folder, prices=None):
    prices = X.weekly_prices(spark, folder) if prices is None else prices
    return P.align(P.point_in_time_returns(prices), P.market_spine(prices))


def _windows(spark, folder, prices=None):
    events = X.announcements(spark).withColumn("dt", F.to_date("ts"))
    return T.resolve_windows(events, P.market_spine(X.weekly_prices(spark, folder) if prices is None else prices), ESTIMATION, GAP, HORIZON)


def _fits(spark, folder, prices=None):
    # returns, calendar, units and windows all come from the weekly table, and fits and effects from the panel: each is written once
    prices = settled(X.weekly_prices(spark, folder)) if prices is None else prices
    panel, windows = settled(_panel(spark, folder, prices)), settled(_windows(spark, folder, prices))
    return panel, windows, E.fit_market_model(panel, windows, ESTIMATION)


def _ar(spark, folder):
    panel, windows, fits = _fits(spark, folder)
    return E.abnormal_returns(panel, fits, windows)


@query("returns_point_in_time", cte("rets") + "SELECT unit_id, dt, round(ret, 6) + 0.0 AS ret FROM rets")
def returns_point_in_time(spark, folder):
    return _round(P.point_in_time_returns(X.weekly_prices(spark, folder)).select("unit_id", "dt", "ret"), 6, "ret")


@query(
    "returns_with_actions",
    cte("px") + """, act AS (SELECT *, CASE WHEN extract(month FROM dt) = 6 AND extract(day FROM dt) <= 7 THEN 2.0 ELSE 0.0 END AS split, CASE WHEN extract(month FROM dt) = 3 AND extract(day FROM dt) <= 7 THEN 1000.0 ELSE 0.0 END AS div FROM px)
SELECT unit_id, dt, round((CASE WHEN split = 0 THEN 1.0 ELSE split END * CAST(px AS DOUBLE) + div) / nullif(CAST(lag(px) OVER (PARTITION BY unit_id ORDER BY dt) AS DOUBLE), 0) - 1, 6) + 0.0 AS ret FROM act""",
)
def returns_with_actions(spark, folder):
    early = F.dayofmonth("dt") <= 7
    prices = X.weekly_prices(spark, folder)
    prices = prices.withColumn("split", F.when((F.month("dt") == 6) & early, 2.0).otherwise(0.0)).withColumn("div", F.when((F.month("dt") == 3) & early, 1000.0).otherwise(0.0))
    return _round(P.point_in_time_returns(prices, "div", "split").select("unit_id", "dt", "ret"), 6, "ret")


@query(
    "returns_padded",
    cte("px") + """, gaps AS (SELECT unit_id, dt, CASE WHEN vol % 7 = 0 THEN NULL ELSE CAST(px AS DOUBLE) END AS adj FROM px),
filled AS (SELECT unit_id, dt, last_value(adj IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM gaps)
SELECT unit_id, dt, round(k / nullif(lag(k) OVER (PARTITION BY unit_id ORDER BY dt), 0) - 1, 6) + 0.0 AS ret FROM filled""",
)
def returns_padded(spark, folder):
    prices = X.weekly_prices(spark, folder).withColumn("adj", F.when(F.col("vol") % 7 != 0, F.col("px").cast("double")))
    return _round(P.padded_returns(prices, "adj").select("unit_id", "dt", "ret"), 6, "ret")


@query(
    "returns_late_lagged",
    cte("px", "rets") + "SELECT rets.unit_id, rets.dt, round(CASE WHEN region = 0 THEN lag(ret) OVER (PARTITION BY rets.unit_id ORDER BY rets.dt) ELSE ret END, 6) + 0.0 AS ret FROM rets JOIN px ON px.unit_id = rets.unit_id AND px.dt = rets.dt",
)
def returns_late_lagged(spark, folder):
    returns = P.point_in_time_returns(X.weekly_prices(spark, folder))
    return _round(P.lag_late_markets(returns, F.col("region") == 0).select("unit_id", "dt", "ret"), 6, "ret")


@query("spine_aligned_panel", cte("panel") + "SELECT unit_id, dt, pos, round(mkt, 6) + 0.0 AS mkt, round(ret, 6) + 0.0 AS ret FROM panel")
def spine_aligned_panel(spark, folder):
    return _round(_panel(spark, folder), 6, "mkt", "ret")


@query("window_filter", cte("rets") + "SELECT unit_id, dt, round(ret, 6) + 0.0 AS ret FROM rets WHERE dt BETWEEN DATE '1999-01-04' AND DATE '1999-03-29'")
def window_filter(spark, folder):
    returns = P.point_in_time_returns(X.weekly_prices(spark, folder)).select("unit_id", "dt", "ret")
    return _round(P.window(returns, "1999-01-04", "1999-03-29"), 6, "ret")


@query("complete_units_in_window", cte("panel") + "SELECT unit_id FROM panel WHERE dt BETWEEN DATE '1998-01-05' AND DATE '2000-12-25' GROUP BY unit_id HAVING count(*) = count(ret)")
def complete_units_in_window(spark, folder):
    return P.complete_units(P.window(_panel(spark, folder), "1998-01-05", "2000-12-25"))


@query(
    "cumulative_outcome",
    cte("panel") + "SELECT unit_id, dt, round(CASE WHEN ret IS NOT NULL THEN sum(ret) OVER w END, 5) + 0.0 AS simple, round(CASE WHEN ret IS NOT NULL THEN sum(ln(1 + ret)) OVER w END, 5) + 0.0 AS log FROM panel WHERE dt >= DATE '2000-01-03' WINDOW w AS (PARTITION BY unit_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def cumulative_outcome(spark, folder):
    rows = P.window(_panel(spark, folder), "2000-01-03", "2099-01-01")
    simple = P.cumulative(rows).withColumnRenamed("cum", "simple")
    return _round(P.cumulative(simple, log=True).select("unit_id", "dt", "simple", F.col("cum").alias("log")), 5, "simple", "log")


@query("equal_weighted_portfolio", cte("panel") + "SELECT dt, round(avg(ret), 6) + 0.0 AS ret, CAST(count(ret) AS BIGINT) AS units FROM panel GROUP BY dt")
def equal_weighted_portfolio(spark, folder):
    return _round(P.equal_weighted(_panel(spark, folder)), 6, "ret")


@query("liquidity_screen", cte("px") + "SELECT unit_id, round(avg(CASE WHEN dt BETWEEN DATE '2000-01-03' AND DATE '2000-12-25' THEN CAST(px AS DOUBLE) * vol END) / 1e6, 2) + 0.0 AS turnover, coalesce(avg(CASE WHEN dt BETWEEN DATE '2000-01-03' AND DATE '2000-12-25' THEN CAST(px AS DOUBLE) * vol END) / 1e6 < 500000.0, true) AS screened_out FROM px GROUP BY unit_id")
def liquidity_screen(spark, folder):
    out = P.liquidity_screen(X.weekly_prices(spark, folder), 500000.0, "2000-01-03", "2000-12-25", scale=1e-6)
    return _round(out, 2, "turnover")


_HISTORY = cte("px") + """, cand AS (SELECT unit_id FROM (SELECT DISTINCT unit_id FROM px) UNION ALL SELECT 'ABSENT'),
st AS (SELECT unit_id, count(*) AS n, count(CASE WHEN dt BETWEEN DATE '2001-09-01' - INTERVAL 365 DAY AND DATE '2001-09-01' THEN 1 END) AS recent, avg(CASE WHEN dt BETWEEN DATE '2001-09-01' - INTERVAL 365 DAY AND DATE '2001-09-01' THEN CAST(px AS DOUBLE) * vol END) / 100 AS turnover FROM px GROUP BY unit_id),
res AS (SELECT cand.unit_id, n, CASE WHEN n IS NULL THEN 'no_data' WHEN n < 300 THEN 'short_history' WHEN recent = 0 THEN 'no_recent_rows' WHEN turnover < 1e10 THEN 'illiquid' END AS reason FROM cand LEFT JOIN st ON st.unit_id = cand.unit_id),
screened AS (SELECT unit_id, CASE WHEN reason IS NULL THEN 'admitted' WHEN n IS NULL THEN 'no_data' ELSE 'rejected' END AS status, reason FROM res)
"""


def _history(spark, folder):
    prices = X.weekly_prices(spark, folder)
    candidates = prices.select("unit_id").distinct().unionByName(spark.createDataFrame([("ABSENT",)], "unit_id string"))
    return P.history_screen(candidates, prices, 300, "2001-09-01", 1e10)


@query("history_screen_with_reasons", _HISTORY + "SELECT * FROM screened")
def history_screen_with_reasons(spark, folder):
    return _history(spark, folder)


@query("screen_partition_and_survival", _HISTORY + "SELECT CAST(count(*) AS BIGINT) AS candidates, CAST(count(CASE WHEN status = 'admitted' THEN 1 END) AS BIGINT) AS admitted, CAST(count(CASE WHEN status = 'rejected' THEN 1 END) AS BIGINT) AS rejected, CAST(count(CASE WHEN status = 'no_data' THEN 1 END) AS BIGINT) AS no_data, round(1 - count(CASE WHEN status = 'no_data' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS survivorship FROM screened")
def screen_partition_and_survival(spark, folder):
    n = {s: F.count(F.when(F.col("status") == s, 1)) for s in ("admitted", "rejected", "no_data")}
    return _history(spark, folder).agg(F.count("*").alias("candidates"), *[c.alias(s) for s, c in n.items()], F.round(1 - n["no_data"] / F.count("*").cast("double"), 6).alias("survivorship"))


@query("event_windows_resolved", cte("ev") + "SELECT event_id, CAST(t0 AS INT) AS t0, CAST(pre_start AS INT) AS pre_start, CAST(pre_end AS INT) AS pre_end, CAST(post_end AS INT) AS post_end FROM ev WHERE reason IS NULL")
def event_windows_resolved(spark, folder):
    return _windows(spark, folder).where("reason is null").select("event_id", "t0", "pre_start", "pre_end", "post_end")


@query("event_window_rejections", cte("ev") + "SELECT event_id, CAST(t0 AS INT) AS t0, reason FROM ev WHERE reason IS NOT NULL")
def event_window_rejections(spark, folder):
    return _windows(spark, folder).where("reason is not null").select("event_id", "t0", "reason")


@query(
    "placebo_offsets",
    cte("ev") + ", k AS (SELECT CAST(range AS INT) AS k FROM range(0, 12)) SELECT event_id, k, CAST(t0 - 3 - 6 - k * 6 AS INT) AS pos FROM ev, k WHERE t0 - 3 - 6 - k * 6 >= 130",
)
def placebo_offsets(spark, folder):
    return T.placebo_offsets(_windows(spark, folder), 120, 10, 5, buffer=3, most=12)


_GROUPS = cte("ann") + """, g AS (SELECT event_id, ts, CASE WHEN floor((epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts, event_id))) / 86400) < 14 THEN 0 ELSE 1 END AS n FROM ann),
h AS (SELECT event_id, ts, sum(n) OVER (ORDER BY ts, event_id) AS g FROM g)
"""


def _orders(spark, folder):
    """(customer, event_id, ts, confounder): a customer's orders stand for a dictionary of events, urgent ones for confounded."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "budget").otherwise("")
    return X.table(spark, folder, "orders").select(F.col("o_custkey").alias("customer"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id"), F.col("o_orderdate").alias("ts"), urgent.alias("confounder"))


_ORDERS = """WITH e AS (SELECT o_custkey AS customer, 'o' || o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS ts, CASE WHEN o_orderpriority = '1-URGENT' THEN 'budget' ELSE '' END AS confounder FROM orders),
b AS (SELECT *, lag(event_id) OVER w AS previous, floor((epoch(ts) - epoch(lag(ts) OVER w)) / 86400) AS gap, lag(confounder) OVER w AS c2 FROM e WINDOW w AS (PARTITION BY customer ORDER BY ts, event_id))"""


@query("event_groups_transitive", _ORDERS + """, h AS (SELECT *, sum(CASE WHEN gap < 14 THEN 0 ELSE 1 END) OVER (PARTITION BY customer ORDER BY ts, event_id) AS g FROM b)
SELECT customer, event_id, CASE WHEN count(*) OVER (PARTITION BY customer, g) > 1 THEN 'grp:' || first_value(event_id) OVER (PARTITION BY customer, g ORDER BY ts, event_id) ELSE event_id END AS group_id FROM h""")
def event_groups_transitive(spark, folder):
    return T.group_events(_orders(spark, folder), 14, "customer").select("customer", "event_id", "group_id")


@query("event_spacing_violations", _ORDERS + " SELECT customer, event_id, previous, CAST(gap AS BIGINT) AS gap_days FROM b WHERE gap < 14 AND confounder = '' AND c2 = ''")
def event_spacing_violations(spark, folder):
    return T.spacing_violations(_orders(spark, folder), 14, "customer")


@query(
    "event_timing_sessions",
    """WITH cal AS (SELECT CAST(d AS DATE) AS dt FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-09', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5),
e AS (SELECT event_id, ts, event_id % 3 <> 0 AS known, CAST(ts AS DATE) AS day FROM events),
j AS (SELECT e.*, cal.dt AS here, (SELECT min(dt) FROM cal WHERE dt > e.day) AS nxt FROM e LEFT JOIN cal ON cal.dt = e.day)
SELECT event_id, CASE WHEN known AND here + INTERVAL 480 MINUTE < ts AND ts < here + INTERVAL 990 MINUTE THEN here END AS straddling_day,
 CASE WHEN known AND here IS NOT NULL AND here + INTERVAL 480 MINUTE >= ts THEN here ELSE nxt END AS first_clean_day,
 coalesce(CASE WHEN known AND here + INTERVAL 480 MINUTE < ts AND ts < here + INTERVAL 990 MINUTE THEN here END, CASE WHEN known AND here IS NOT NULL AND here + INTERVAL 480 MINUTE >= ts THEN here ELSE nxt END) AS t0 FROM j""",
)
def event_timing_sessions(spark, folder):
    events = X.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 != 0).alias("time_known"))
    out = T.first_clean_days(events, T.business_days(spark, "2024-01-01", "2024-02-09"), "2023-12-30", "2024-02-09")
    return out.select("event_id", "straddling_day", "first_clean_day", "t0")


_ZONES = ("Europe/London", "America/New_York", "Europe/Paris", "Asia/Tokyo", "Europe/Copenhagen")


@query(
    "clock_alignment",
    f"""WITH ex AS (SELECT user_id, CAST(ts AS DATE) AS day, {list(_ZONES)}[1 + user_id % 5] AS zone, CAST(max(hour(ts) * 60 + minute(ts)) AS INT) AS close_minute FROM events GROUP BY 1, 2),
o AS (SELECT *, CAST((epoch((TIMESTAMP '2024-01-17' + to_minutes(close_minute)) AT TIME ZONE zone) - epoch((TIMESTAMP '2024-01-17' + to_minutes(990)) AT TIME ZONE 'Europe/London')) / 60 AS INT) AS a, CAST((epoch((TIMESTAMP '2024-07-17' + to_minutes(close_minute)) AT TIME ZONE zone) - epoch((TIMESTAMP '2024-07-17' + to_minutes(990)) AT TIME ZONE 'Europe/London')) / 60 AS INT) AS b FROM ex),
m AS (SELECT user_id, day, zone, close_minute, CASE WHEN abs(b) > abs(a) THEN b ELSE a END AS offset_minutes FROM o)
SELECT user_id, day, zone, close_minute, offset_minutes, CASE WHEN offset_minutes > 15 THEN 'LATE' WHEN offset_minutes < -15 THEN 'EARLY' ELSE 'ALIGNED' END AS clock FROM m""",
)
def clock_alignment(spark, folder):
    """A user stands for an exchange, in a zone dealt by its number, whose session of a day closes with its last event."""
    ts = F.col("ts")
    events = X.table(spark, folder, "events").select("user_id", F.to_date(ts).alias("day"), F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("user_id") % len(_ZONES) + 1).cast("int")).alias("zone"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute"))
    return T.clock_alignment(events.groupBy("user_id", "day", "zone").agg(F.max("minute").alias("close_minute")))


@query("market_model_fit", cte("fit") + "SELECT event_id, unit_id, round(beta, 4) + 0.0 AS beta, round(alpha, 4) + 0.0 AS alpha, round(r2, 4) + 0.0 AS r2, n FROM fit")
def market_model_fit(spark, folder):
    return _round(_fits(spark, folder)[2].drop("t0"), 4, "beta", "alpha", "r2")


@query("market_model_car", cte("car") + "SELECT event_id, unit_id, round(car, 5) + 0.0 AS car FROM car")
def market_model_car(spark, folder):
    return _round(E.car(_ar(spark, folder), 0, 1), 5, "car")


@query("car_window_ladder", cte("ar") + ", w AS (SELECT * FROM (VALUES (-1, 1), (0, 1), (0, 5), (0, 20)) AS v(f, l)) SELECT event_id, unit_id, CAST(f AS INT) AS first, CAST(l AS INT) AS last, round(sum(ar), 5) + 0.0 AS car FROM ar JOIN w ON rel BETWEEN f AND l GROUP BY event_id, unit_id, f, l HAVING count(ar) = l - f + 1")
def car_window_ladder(spark, folder):
    return _round(E.car_ladder(_ar(spark, folder)), 5, "car")


_EFFECTS = cte("ar") + f""", agg AS (SELECT event_id, unit_id, sum(CASE WHEN rel < -{GAP} THEN ar * ar END) AS sse, count(CASE WHEN rel < -{GAP} THEN ar END) AS n_pre, count(CASE WHEN rel BETWEEN 0 AND {HORIZON} THEN ar END) AS n_post,
 sum(CASE WHEN rel BETWEEN 0 AND {HORIZON} THEN ar END) AS tau, avg(CASE WHEN rel < -{GAP} THEN mkt END) AS mb, var_pop(CASE WHEN rel < -{GAP} THEN mkt END) AS mv, sum(CASE WHEN rel BETWEEN 0 AND {HORIZON} THEN mkt END) AS mp FROM ar GROUP BY 1, 2),
eff AS (SELECT event_id, unit_id, tau, sqrt(sse / greatest(n_pre - 2, 1) * (n_post + n_post * n_post / CAST(n_pre AS DOUBLE) + pow(mp - n_post * mb, 2) / nullif(mv * n_pre, 0))) AS se FROM agg WHERE n_post = {HORIZON + 1})
"""


def _effects(spark, folder):
    return E.prediction_variance(_ar(spark, folder), GAP, HORIZON)


@query("car_prediction_variance", _EFFECTS + "SELECT event_id, unit_id, round(tau, 5) + 0.0 AS tau, round(se, 5) + 0.0 AS se_car, round(tau / nullif(se, 0), 4) + 0.0 AS t_stat FROM eff")
def car_prediction_variance(spark, folder):
    return _round(_round(_effects(spark, folder), 5, "tau", "se_car"), 4, "t_stat")


@query("caar_tests", _EFFECTS + "SELECT event_id, CAST(count(*) AS BIGINT) AS n, round(avg(tau), 5) + 0.0 AS mean, round(avg(tau) / nullif(stddev_samp(tau) / sqrt(count(*)), 0), 4) + 0.0 AS t_naive, round(avg(tau / nullif(se, 0)) * sqrt(count(*)) / nullif(stddev_samp(tau / nullif(se, 0)), 0), 4) + 0.0 AS t_bmp FROM eff GROUP BY event_id HAVING count(*) >= 2")
def caar_tests(spark, folder):
    return _round(_round(E.caar_tests(_effects(spark, folder)), 5, "mean"), 4, "t_naive", "t_bmp")


@query("in_space_placebo_p_values", _EFFECTS + "SELECT event_id, unit_id, CAST(r AS BIGINT) AS rank, round(r / CAST(n AS DOUBLE), 6) AS p_value, round(1.0 / n, 6) AS p_floor FROM (SELECT event_id, unit_id, count(*) OVER (PARTITION BY event_id ORDER BY abs(tau) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER (PARTITION BY event_id) AS n FROM eff)")
def in_space_placebo_p_values(spark, folder):
    return _round(E.placebo_p_values(_effects(spark, folder)), 6, "p_value", "p_floor")


_RATIOS = cte("ar") + f""", path AS (SELECT *, sum(ar) OVER (PARTITION BY event_id, unit_id ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ar),
ra AS (SELECT event_id, unit_id, sqrt(var_pop(CASE WHEN rel < -{GAP} THEN g END)) AS pre, avg(CASE WHEN rel >= 0 THEN g * g END) AS g2, avg(CASE WHEN rel >= 0 THEN g END) AS g1, max(CASE WHEN rel = -1 THEN g END) AS b FROM path GROUP BY 1, 2),
rr AS (SELECT event_id, unit_id, pre, sqrt(greatest(g2 - 2 * b * g1 + b * b, 0)) AS post, sqrt(greatest(g2 - 2 * b * g1 + b * b, 0)) / nullif(pre, 0) AS ratio FROM ra)
"""


@query("rmspe_ratios", _RATIOS + "SELECT event_id, unit_id, round(pre, 4) + 0.0 AS pre_rmspe, round(post, 4) + 0.0 AS post_rmspe, round(ratio, 4) + 0.0 AS ratio FROM rr")
def rmspe_ratios(spark, folder):
    return _round(E.rmspe_ratio(_ar(spark, folder), GAP), 4, "pre_rmspe", "post_rmspe", "ratio")


_LADDER = _RATIOS.replace(cte("ar"), cte("ar", "ann")).rstrip() + f""", ta AS (SELECT event_id, unit_id, sum(ar) AS tau FROM ar WHERE rel BETWEEN 0 AND {HORIZON} GROUP BY 1, 2 HAVING count(ar) = {HORIZON + 1}),
us AS (SELECT rr.event_id, rr.unit_id, pre, ratio, CASE direction WHEN 'tighten' THEN -tau WHEN 'loosen' THEN tau ELSE abs(tau) END AS score FROM rr JOIN ann ON ann.event_id = rr.event_id LEFT JOIN ta ON ta.event_id = rr.event_id AND ta.unit_id = rr.unit_id),
c AS (SELECT * FROM (VALUES (CAST('inf' AS DOUBLE)), (20.0), (5.0), (2.0)) AS v(cutoff)),
pl AS (SELECT a.event_id, a.unit_id, cutoff, count(CASE WHEN near THEN 1 END) AS n, count(CASE WHEN near AND more THEN 1 END) AS r, count(CASE WHEN near AND further THEN 1 END) AS t FROM
 (SELECT a.event_id, a.unit_id, cutoff, isinf(cutoff) OR b.pre <= a.pre * cutoff AS near, b.ratio >= a.ratio AS more, b.score >= a.score AS further FROM us a JOIN us b ON a.event_id = b.event_id AND a.unit_id <> b.unit_id, c) a GROUP BY 1, 2, 3)
"""


@query("placebo_ladder", _LADDER + "SELECT event_id, unit_id, CASE WHEN isinf(cutoff) THEN NULL ELSE cutoff END AS cutoff, CAST(n AS BIGINT) AS placebos, CASE WHEN n > 0 THEN round((1 + r) / CAST(1 + n AS DOUBLE), 6) END AS p_ratio, CASE WHEN n > 0 THEN round((1 + t) / CAST(1 + n AS DOUBLE), 6) END AS p_tau, round(1.0 / (1 + n), 6) AS p_floor FROM pl")
def placebo_ladder(spark, folder):
    ar = settled(_ar(spark, folder))
    tau = E.car(ar, 0, HORIZON).join(X.announcements(spark).select("event_id", "direction"), "event_id")
    expected = F.when(F.col("direction") == "tighten", "negative").when(F.col("direction") == "loosen", "positive").otherwise("ambiguous")
    units = E.rmspe_ratio(ar, GAP).join(tau.select("event_id", "unit_id", E.direction_score(F.col("car"), expected).alias("score")), ["event_id", "unit_id"], "left")
    out = E.placebo_ladder(settled(units))
    return _round(out.withColumn("cutoff", F.nullif("cutoff", F.lit(float("inf")))), 6, "p_ratio", "p_tau", "p_floor")


@query(
    "pretrend_and_drift",
    cte("ar") + f", path AS (SELECT *, sum(ar) OVER (PARTITION BY event_id, unit_id ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ar WHERE rel < 0), a AS (SELECT event_id, unit_id, regr_slope(CASE WHEN rel < -{GAP} THEN g END, CASE WHEN rel < -{GAP} THEN CAST(rel AS DOUBLE) END) AS slope, max(CASE WHEN rel = -1 THEN g END) - max(CASE WHEN rel = -{GAP} - 1 THEN g END) AS drift, stddev_samp(CASE WHEN rel < -{GAP} THEN step END) AS sd, count(CASE WHEN rel >= -{GAP} THEN g END) AS n_holdout FROM (SELECT *, g - lag(g) OVER (PARTITION BY event_id, unit_id ORDER BY rel) AS step FROM path) GROUP BY 1, 2) SELECT event_id, unit_id, round(slope, 5) + 0.0 AS slope, round(drift, 4) + 0.0 AS drift, round(drift / nullif(sd * sqrt(n_holdout), 0), 4) + 0.0 AS z, n_holdout FROM a",
)
def pretrend_and_drift(spark, folder):
    return _round(_round(E.pretrend(_ar(spark, folder), GAP), 4, "drift", "z"), 5, "slope")


@query("power_mde", _EFFECTS + "SELECT event_id, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(abs(tau), 0.95), 5) + 0.0 AS critical, round(quantile_cont(abs(tau), 0.95) - quantile_cont(tau, 0.2), 5) + 0.0 AS mde FROM eff GROUP BY event_id")
def power_mde(spark, folder):
    return _round(E.power(_effects(spark, folder), 0.05, 0.8), 5, "critical", "mde")


@query("power_curve", _EFFECTS + ", q AS (SELECT event_id, quantile_cont(abs(tau), 0.95) AS c FROM eff GROUP BY 1), s AS (SELECT CAST(v AS DOUBLE) AS effect FROM (VALUES (0.0), (0.5), (1.0), (2.0), (4.0)) AS t(v)) SELECT eff.event_id, effect, round(avg(CASE WHEN abs(tau + effect) >= c THEN 1.0 ELSE 0.0 END), 6) AS detected FROM eff JOIN q ON q.event_id = eff.event_id, s GROUP BY 1, 2")
def power_curve(spark, folder):
    return _round(E.power_curve(_effects(spark, folder), (0.0, 0.5, 1.0, 2.0, 4.0)), 6, "detected")


@query("effective_number_of_units", cte("panel") + ", p AS (SELECT a.unit_id, b.unit_id AS o, corr(a.ret, b.ret) AS rho FROM panel a JOIN panel b ON a.pos = b.pos AND a.unit_id < b.unit_id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2), m AS (SELECT avg(rho) AS r, (SELECT count(DISTINCT unit_id) FROM panel WHERE ret IS NOT NULL) AS n FROM p) SELECT CAST(n AS BIGINT) AS units, round(r, 5) + 0.0 AS mean_correlation, round(CASE WHEN 1 + (n - 1) * r <= 0 THEN n ELSE n / (1 + (n - 1) * r) END, 3) + 0.0 AS effective FROM m")
def effective_number_of_units(spark, folder):
    return _round(_round(E.effective_units(_panel(spark, folder)), 5, "mean_correlation"), 3, "effective")


@query(
    "controls_size_momentum_vol",
    cte("panel", "ev", "px") + """, r AS (SELECT panel.*, CAST(px.px AS DOUBLE) * px.vol AS tv FROM panel LEFT JOIN px ON px.unit_id = panel.unit_id AND px.dt = panel.dt)
SELECT event_id, unit_id, round(ln(nullif(avg(CASE WHEN pos >= pre_start AND pos < pre_end THEN tv END), 0)), 4) + 0.0 AS size,
 round(CASE WHEN count(CASE WHEN pos >= pre_end - 1 - 8 - 52 AND pos < pre_end - 1 - 8 THEN 1 END) = 52 THEN exp(sum(CASE WHEN pos >= pre_end - 1 - 8 - 52 AND pos < pre_end - 1 - 8 THEN ln(1 + ret) END)) - 1 END, 4) + 0.0 AS momentum,
 round(stddev_samp(CASE WHEN pos >= pre_start AND pos < pre_end THEN ret END) * sqrt(252), 4) + 0.0 AS pre_event_vol
FROM r JOIN ev ON pos >= pre_start AND pos < pre_end WHERE reason IS NULL GROUP BY 1, 2""",
)
def controls_size_momentum_vol(spark, folder):
    out = P.controls(_panel(spark, folder), X.weekly_prices(spark, folder), _windows(spark, folder).where("reason is null"), momentum=52, skip=8).drop("size_is_fallback")
    return _round(out, 4, "size", "momentum", "pre_event_vol")
