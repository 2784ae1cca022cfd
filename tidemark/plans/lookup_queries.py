"""Queries on look-ups, formats, disclosures, whole-dictionary checks and the joint study of all estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lookups as L
from tidemark.operators import study as Y
from tidemark.operators import timing as T
from tidemark.operators.settle import settled
from tidemark.plans.panel_queries import _panel, _round, _windows
from tidemark.plans.registry import query
from tidemark.plans.text_queries import status_resolution
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import ESTIMATION, GAP, HORIZON, cte


@query("projected_units", cte("panel") + "SELECT unit_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(ret) AS BIGINT) AS known FROM panel JOIN nation ON n_name = unit_id WHERE n_nationkey % 3 = 0 GROUP BY 1")
def projected_units(spark, folder):
    wanted = X.table(spark, folder, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("unit_id")).unionByName(spark.createDataFrame([("nowhere",)], "unit_id string"))
    return L.of_units(_panel(spark, folder), wanted).groupBy("unit_id").agg(F.count("*").alias("rows"), F.count("ret").alias("known"))


@query("largest_orders", "SELECT o_orderpriority, arg_min(o_orderkey, struct_pack(a := -abs(d), b := o_orderkey)) AS o_orderkey, round(arg_min(d, struct_pack(a := -abs(d), b := o_orderkey)), 4) AS d FROM (SELECT o_orderpriority, o_orderkey, o_totalprice - 150000 AS d FROM orders) GROUP BY 1")
def largest_orders(spark, folder):
    rows = X.table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_totalprice") - 150000).alias("d"))
    return L.largest(rows, "o_orderkey", "d", "o_orderpriority").withColumn("d", F.round("d", 4))


@query("config_order", "SELECT n_name, CAST(coalesce(nullif(list_position(['KENYA', 'CHINA', 'PERU'], n_name), 0), 4) AS INT) AS place, CAST(row_number() OVER (ORDER BY CASE WHEN n_name = 'PERU' THEN 0 ELSE 1 END, n_name) AS INT) AS named FROM nation")
def config_order(spark, folder):
    from pyspark.sql.window import Window

    rows = L.in_config_order(X.table(spark, folder, "nation").select("n_name"), "n_name", ["KENYA", "CHINA", "PERU"])
    return rows.withColumn("named", F.row_number().over(Window.orderBy(*L.named_first("n_name", "PERU"))))


@query("formatted_figures", "SELECT n_name, printf('%+.4f', k / 8.0) AS signed, printf('%+d', k) AS count, printf('%.2f%%', k / 16.0 * 100) AS percent, format('{:,}', k * 12345) AS grouped, CAST(k + 40 AS INT) AS days FROM (SELECT n_name, CAST(n_nationkey AS INT) - 12 AS k FROM nation)")
def formatted_figures(spark, folder):
    k = F.col("n_nationkey").cast("int") - 12
    day = F.lit("2020-01-01").cast("date")
    return X.table(spark, folder, "nation").select("n_name", L.signed(k / 8.0).alias("signed"), L.signed_count(k).alias("count"), L.percent(k / 16.0).alias("percent"), L.grouped((k * 12345).cast("double")).alias("grouped"), L.span_days(day, F.date_add(day, k + 40)).alias("days"))


@query("provenance_caveats", "SELECT n_name, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'retroactive adjustment' END, CASE WHEN k % 3 = 0 THEN 'unadjusted prices' END, CASE WHEN k % 5 = 0 THEN 'survivorship' END, CASE WHEN k % 4 = 1 THEN 'lagged: A, ' || n_name END, CASE WHEN k % 4 = 2 THEN 'early close: ' || n_name END, CASE WHEN k % 7 = 0 THEN 'screened out: ' || n_name END], lambda x: x IS NOT NULL), '; ') AS caveats FROM (SELECT n_name, n_nationkey AS k FROM nation)")
def provenance_caveats(spark, folder):
    k, name, none = F.col("n_nationkey"), F.col("n_name"), F.array().cast("array<string>")
    rows = X.table(spark, folder, "nation").select(
        "n_name", (k % 2 == 0).alias("retroactive"), (k % 3 == 0).alias("unadjusted"), (k % 5 == 0).alias("survivors_only"), F.when(k % 4 == 1, F.array(name, F.lit("A"))).otherwise(none).alias("lagged"),
        F.when(k % 4 == 2, F.array(name)).alias("early"), F.when(k % 7 == 0, F.create_map(name, F.lit("illiquid"))).alias("screened"),
    )
    return L.caveats(rows).select("n_name", F.array_join("caveats", "; ").alias("caveats"))


@query("collection_documents", "SELECT DISTINCT 'c' || n_regionkey AS slug, '/d/' || n_nationkey AS path, n_name AS title FROM nation")
def collection_documents(spark, folder):
    one = F.struct(F.concat(F.lit("/d/"), F.col("n_nationkey").cast("string")).alias("base_path"), F.col("n_name").alias("title"))
    docs = X.table(spark, folder, "nation").groupBy(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("slug")).agg(F.collect_list(one).alias("d"))
    payloads = docs.select("slug", F.to_json(F.struct(F.struct(F.concat("d", "d").alias("documents")).alias("links"))).alias("payload"))
    return L.collection(payloads.unionByName(spark.createDataFrame([("empty", "{}")], "slug string, payload string"))).select("slug", "path", "title")


@query("found_collections", "SELECT r_name AS query, 'c' || r_regionkey AS slug, r_name AS title, 0 AS place FROM region")
def found_collections(spark, folder):
    hit = F.struct(F.concat(F.lit("/collections/c"), F.col("r_regionkey").cast("string")).alias("link"), F.col("r_name").alias("title"))
    rows = X.table(spark, folder, "region").select(F.col("r_name").alias("query"), F.to_json(F.struct(F.array(hit, F.struct(F.lit(None).cast("string").alias("link"), F.lit("none").alias("title"))).alias("results"))).alias("payload"))
    return L.find_collections(rows).select("query", "slug", "title", "place")


@query(
    "dictionary_issues",
    """WITH e AS (SELECT 'o' || o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS policy, CASE WHEN o_orderkey % 50 = 0 THEN ' Boats; RAIL' ELSE 'rail;road ' END AS affected_sectors FROM orders),
t AS (SELECT date, lower(policy) AS p FROM e GROUP BY 1, 2 HAVING count(*) > 1)
SELECT event_id, 'affected_sectors' AS "column", 'unknown: boats' AS message, true AS fatal FROM e WHERE affected_sectors LIKE '%Boats%' UNION ALL SELECT event_id, 'date+policy', 'repeated', false FROM e JOIN t ON t.date = e.date AND t.p = lower(policy)
UNION ALL SELECT * FROM (VALUES ('', 'source_url', 'missing column', true), ('', 'affected_sectors', 'unknown column', false)) AS v""",
)
def dictionary_issues(spark, folder):
    sectors = F.when(F.col("o_orderkey") % 50 == 0, " Boats; RAIL").otherwise("rail;road ")
    rows = X.table(spark, folder, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_id"), F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_orderstatus").alias("policy"), sectors.alias("affected_sectors"))
    known = spark.createDataFrame([("Rail",), ("road",)], "sector string")
    whole = L.table_issues(rows, ("event_id", "date", "policy", "source_url"), ())
    return whole.unionByName(L.membership_issues(rows, "event_id", "affected_sectors", known, "sector")).unionByName(L.repeats(rows, "event_id", "date", "policy"))


@query("resolution_tables", """WITH n AS (SELECT n_name AS u, n_nationkey AS k FROM nation), e AS (SELECT * FROM (VALUES ('e1', DATE '2000-01-10', 'x'), ('e2', DATE '2001-01-10', 'y')) AS v(id, d, tag)),
r AS (SELECT id AS event_id, u AS unit_id, CASE WHEN k % 5 = 4 AND d > DATE '2000-06-30' THEN 'dropped' WHEN k % 5 = 3 AND d BETWEEN DATE '2001-01-01' AND DATE '2001-01-10' THEN 'dropped' WHEN k % 5 = 2 AND tag = 'x' THEN 'error' WHEN k % 5 = 1 AND tag = 'x' THEN 'treated' ELSE 'donor' END AS status FROM n CROSS JOIN e)
SELECT event_id, status, CAST(count(*) AS BIGINT) AS units, string_agg(unit_id, ', ' ORDER BY unit_id) AS names FROM r GROUP BY 1, 2""")
def resolution_tables(spark, folder):
    return Y.resolution(status_resolution(spark, folder))


@query("signed_portfolio_weights", "SELECT CAST(n_regionkey AS VARCHAR) AS event_id, n_name AS unit_id, round(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END / CAST(count(*) OVER (PARTITION BY n_regionkey) AS DOUBLE), 9) AS weight FROM nation")
def signed_portfolio_weights(spark, folder):
    rows = X.table(spark, folder, "nation").select(F.col("n_regionkey").cast("string").alias("event_id"), F.col("n_name").alias("unit_id"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return _round(Y.signed_portfolio(rows), 9, "weight")


_GRID = cte("panel", "ev", "ann") + f""", w AS (SELECT event_id, unit_id, pos - t0 AS rel, ret, mkt FROM panel JOIN ev ON pos BETWEEN pre_start AND post_end WHERE reason IS NULL),
tk AS (SELECT event_id, unit_id, whole, sum(CAST(whole AS INT)) OVER (PARTITION BY event_id) - CAST(whole AS INT) AS donors FROM (SELECT event_id, unit_id, count(CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END) = {ESTIMATION + GAP + HORIZON + 1} AS whole FROM w GROUP BY 1, 2)),
es AS (SELECT * FROM (VALUES ('market_model', 0), ('synthetic_control', 2), ('synthetic_did', 2)) AS v(estimator, least_))
"""


def _study(spark, folder):
    prices = settled(X.weekly_prices(spark, folder))
    return settled(_panel(spark, folder, prices)), settled(_windows(spark, folder, prices))


def _grid(spark, folder):
    panel, windows = _study(spark, folder)
    dates = windows.where("reason is null").select("event_id", F.lit(Y.OWN).alias("k"), F.col("t0").alias("pos"))
    return settled(Y.run_grid(panel, dates, ESTIMATION, GAP, HORIZON))


@query("event_study_outcomes", _GRID + "SELECT event_id, unit_id, estimator, CASE WHEN NOT whole THEN 'IncompleteWindow' WHEN donors < least_ THEN 'TooFewDonors' END AS error_type, CASE WHEN NOT whole THEN 'a return of the window is missing' WHEN donors < least_ THEN donors || ' other units have complete windows' END AS message FROM tk, es")
def event_study_outcomes(spark, folder):
    """Every task of the grid: estimated, or why not."""
    return _grid(spark, folder).select("event_id", "unit_id", "estimator", "error_type", "message")


@query(
    "event_study_baseline",
    _GRID + f""", fi AS (SELECT w.event_id, w.unit_id, regr_slope(CASE WHEN rel < -{GAP} THEN ret END, CASE WHEN rel < -{GAP} THEN mkt END) AS b, regr_intercept(CASE WHEN rel < -{GAP} THEN ret END, CASE WHEN rel < -{GAP} THEN mkt END) AS a FROM w JOIN tk ON tk.event_id = w.event_id AND tk.unit_id = w.unit_id WHERE whole GROUP BY 1, 2),
pa AS (SELECT w.event_id, w.unit_id, rel, sum(ret - a - b * mkt) OVER (PARTITION BY w.event_id, w.unit_id ORDER BY rel) AS g FROM w JOIN fi ON fi.event_id = w.event_id AND fi.unit_id = w.unit_id),
ba AS (SELECT event_id, unit_id, max(CASE WHEN rel = -1 THEN g END) AS base, max(CASE WHEN rel = {HORIZON} THEN g END) AS last_, sqrt(var_pop(CASE WHEN rel < -{GAP} THEN g END)) AS pre FROM pa GROUP BY 1, 2),
mm AS (SELECT ba.event_id, ba.unit_id, any_value(last_) - any_value(base) AS tau, any_value(pre) AS pre, sqrt(avg((g - base) * (g - base))) AS post FROM ba JOIN pa ON pa.event_id = ba.event_id AND pa.unit_id = ba.unit_id AND rel >= 0 GROUP BY 1, 2),
pr AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, count(*) OVER (PARTITION BY event_id ORDER BY post / pre DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM mm),
fl AS (SELECT event_id, count(CASE WHEN NOT whole THEN 1 END) AS failed FROM tk GROUP BY 1)
SELECT pr.event_id, unit_id, round(tau, 6) + 0.0 AS tau, round(pre, 6) AS pre_rmspe, round(post, 6) AS post_rmspe, round(post / pre, 4) AS ratio, CAST(n - 1 AS BIGINT) AS placebos, failed, round(r / CAST(n AS DOUBLE), 6) AS p_in_space, round(1.0 / n, 6) AS p_floor FROM pr JOIN fl ON fl.event_id = pr.event_id""",
)
def event_study_baseline(spark, folder):
    """The market model's tasks with their placebos, which every other estimator is held against."""
    own = _grid(spark, folder).where(F.col("estimator") == Y.MARKET)
    out = own.where("tau is not null").join(Y.in_space(own), ["event_id", "unit_id", "estimator"])
    out = out.select("event_id", "unit_id", "tau", "pre_rmspe", "post_rmspe", "ratio", "placebos", "failed", "p_in_space", "p_floor")
    return _round(_round(out, 6, "tau", "pre_rmspe", "post_rmspe", "p_in_space", "p_floor"), 4, "ratio")


@query("event_study")
def event_study(spark, folder):
    panel, windows = _study(spark, folder)
    offsets = T.placebo_offsets(windows.where("reason is null"), ESTIMATION, GAP, HORIZON, buffer=3, most=12)
    return Y.run_events(panel, windows, offsets, ESTIMATION, GAP, HORIZON)
