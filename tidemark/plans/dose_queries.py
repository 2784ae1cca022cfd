"""Queries on exposure and on how effects grow with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import draws as U
from tidemark.operators import dose as D
from tidemark.operators import effects as E
from tidemark.operators import exposure as O
from tidemark.operators import regression as R
from tidemark.operators import resampling as G
from tidemark.operators.settle import settled
from tidemark.plans.panel_queries import _ar, _fits, _round, _sig
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import cte


def _exposure(spark, folder):
    return O.event_exposure(X.attributes(spark, folder), X.announcements(spark))


def _dose(spark, folder):
    car = E.car(_ar(spark, folder), 0, 1)
    # at most one row an event and unit, which every later sum reads
    return settled(car.join(_exposure(spark, folder), ["event_id", "unit_id"]).select("event_id", "unit_id", "direction", "car", "exposure"))


@query("attributes_withheld_counts", cte("attr", "ann") + "SELECT event_id, CAST(count(CASE WHEN knowable < CAST(ts AS DATE) THEN 1 END) AS BIGINT) AS knowable, CAST(count(CASE WHEN knowable >= CAST(ts AS DATE) THEN 1 END) AS BIGINT) AS withheld FROM attr CROSS JOIN ann GROUP BY 1")
def attributes_withheld_counts(spark, folder):
    return O.knowable_counts(X.attributes(spark, folder), X.announcements(spark))


@query("attributes_latest_asof", cte("attr", "ann") + "SELECT event_id, unit_id, attribute, round(value, 6) AS value, as_of, knowable FROM (SELECT event_id, unit_id, attribute, value, as_of, knowable, row_number() OVER (PARTITION BY event_id, unit_id, attribute ORDER BY knowable DESC, as_of DESC) AS k FROM attr JOIN ann ON knowable < CAST(ts AS DATE)) WHERE k = 1")
def attributes_latest_asof(spark, folder):
    return _round(O.latest_known(X.attributes(spark, folder), X.announcements(spark)), 6, "value")


@query("exposure_panel", cte("expo") + "SELECT event_id, direction, unit_id, round(exposure, 6) AS exposure FROM expo")
def exposure_panel(spark, folder):
    return _round(_exposure(spark, folder), 6, "exposure")


_Z = cte("expo") + """, q AS (SELECT event_id, quantile_cont(exposure, 0.0) AS lo, quantile_cont(exposure, 0.9) AS hi FROM expo GROUP BY 1),
w AS (SELECT expo.event_id, direction, unit_id, greatest(least(exposure, hi), lo) AS e FROM expo JOIN q ON q.event_id = expo.event_id),
s AS (SELECT event_id, avg(e) AS m, stddev_samp(e) AS s FROM w GROUP BY 1)
"""


@query("exposure_winsorised_standardised", _Z + "SELECT w.event_id, unit_id, round(e, 6) AS exposure, round(CASE WHEN s > 0 THEN (e - m) / nullif(s, 0) ELSE 0.0 END, 4) + 0.0 AS z FROM w JOIN s ON s.event_id = w.event_id")
def exposure_winsorised_standardised(spark, folder):
    rows = O.winsorise(_exposure(spark, folder), "exposure", "event_id", 0.0, 0.9)
    return _round(_round(O.standardise(rows, "exposure", "event_id", "z").select("event_id", "unit_id", "exposure", "z"), 6, "exposure"), 4, "z")


@query("exposure_rank_deciles", cte("expo") + "SELECT event_id, unit_id, ceil(round((rank() OVER (PARTITION BY event_id ORDER BY exposure) + (count(*) OVER (PARTITION BY event_id, exposure) - 1) / 2.0) / count(*) OVER (PARTITION BY event_id) * 10, 9)) / 10 AS decile FROM expo")
def exposure_rank_deciles(spark, folder):
    return O.rank_buckets(_exposure(spark, folder), "exposure", "event_id", 10, "decile").select("event_id", "unit_id", "decile")


@query("exposure_dispersion", cte("expo") + "SELECT event_id, CAST(count(*) AS BIGINT) AS n_units, CAST(count(CASE WHEN exposure <> 0 THEN 1 END) AS BIGINT) AS n_nonzero, round(stddev_samp(exposure), 6) AS sd, round(min(exposure), 6) AS low, round(max(exposure), 6) AS high FROM expo GROUP BY 1")
def exposure_dispersion(spark, folder):
    return _round(O.dispersion(_exposure(spark, folder), "exposure"), 6, "sd", "low", "high")


@query(
    "share_below_band",
    "SELECT n_name AS unit_id, round(coalesce(CAST(sum(CASE WHEN b > 4 THEN c ELSE 0 END) AS DOUBLE) / nullif(sum(c), 0), 0.0), 6) AS magnitude FROM (SELECT n_name, 1 + (p_size - 1) // 8 AS b, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1",
)
def share_below_band(spark, folder):
    lines = X.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    parts = X.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.element_at(F.array(*map(F.lit, O.BANDS)), (1 + F.floor((F.col("p_size") - 1) / 8)).cast("int")).alias("band"))
    units = X.table(spark, folder, "supplier").join(X.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("unit_id"))
    bands = lines.join(parts, "l_partkey").join(units, "l_suppkey").groupBy("unit_id", "band").agg(F.count("*").alias("n"))
    return _round(O.share_below(bands, "D"), 6, "magnitude")


@query(
    "channel_scores",
    """WITH l AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, p_size, p_retailprice, p_brand, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT month, l_suppkey, CASE WHEN month(month) % 2 = 0 THEN 'tighten' ELSE 'loosen' END AS direction,
 CASE WHEN count(CASE WHEN p_brand = 'Brand#11' THEN 1 END) > 0 THEN sum(CASE WHEN p_brand = 'Brand#11' THEN cents ELSE 0 END) / CAST(sum(cents) AS DOUBLE) END AS residential,
 CASE WHEN any_value(s_acctbal) >= 1000 THEN (sum(CASE WHEN p_size <= 30 THEN cents ELSE 0 END) + sum(CASE WHEN p_retailprice < 1100 THEN cents ELSE 0 END)) / CAST(sum(cents) AS DOUBLE) END AS shares,
 CASE WHEN any_value(s_acctbal) < 9000 THEN 1 - 2 * (sum(CASE WHEN l_returnflag = 'R' THEN cents ELSE 0 END) / CAST(sum(cents) AS DOUBLE)) END AS domestic
 FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN shares IS NOT NULL AND domestic IS NOT NULL THEN least(shares, 1.0) * least(greatest(domestic, 0.0), 1.0) END AS product FROM v)
SELECT month, l_suppkey AS unit_id, CASE WHEN residential IS NOT NULL THEN 'residential' WHEN product IS NOT NULL THEN 'product' ELSE 'none' END AS channel, round(coalesce(residential, product, 0.0), 6) + 0.0 AS magnitude,
 round(coalesce(residential, product, 0.0) * CASE WHEN residential IS NOT NULL THEN -1 WHEN product IS NOT NULL THEN 1 ELSE 0 END * CASE direction WHEN 'tighten' THEN 1 ELSE -1 END, 6) + 0.0 AS signed FROM c""",
)
def channel_scores(spark, folder):
    """A supplier's channels in every month that it sold in, from shares of its sales: one brand stands for homes, two overlapping categories for products, what is kept less what comes back for the domestic share."""
    lines = X.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", F.trunc(F.to_date("l_shipdate"), "month").alias("month"), F.rint(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    parts = X.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", "p_retailprice")
    cents = lambda condition: F.sum(F.when(condition, F.col("cents")).otherwise(0))
    home, kinds, back = F.col("p_brand") == "Brand#11", (F.col("p_size") <= 30, F.col("p_retailprice") < 1100), F.col("l_returnflag") == "R"
    sums = lines.join(parts, "l_partkey").groupBy("month", "l_suppkey").agg(F.sum("cents").alias("t"), F.when(F.count(F.when(home, 1)) > 0, cents(home)).alias("h"), (cents(kinds[0]) + cents(kinds[1])).alias("k"), cents(back).alias("r"))
    rows = sums.join(X.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey").select(
        "month", F.col("l_suppkey").alias("unit_id"), F.when(F.month("month") % 2 == 0, "tighten").otherwise("loosen").alias("direction"), (F.col("h") / F.col("t")).alias("residential"),
        O.product_channel(F.when(F.col("s_acctbal") >= 1000, F.col("k") / F.col("t")), F.when(F.col("s_acctbal") < 9000, 1 - 2 * (F.col("r") / F.col("t")))).alias("product"),
    )
    out = O.score(rows, ("residential", "product"), {"residential": -1, "product": 1})
    return _round(out.select("month", "unit_id", "channel", "magnitude", "signed"), 6, "magnitude", "signed")


_PANEL = cte("car", "expo", "ev", "units") + """, grid AS (SELECT units.unit_id, ev.event_id, ev.reason AS r FROM units CROSS JOIN ev),
cp AS (SELECT grid.unit_id, grid.event_id, car, exposure, CASE WHEN r IS NOT NULL THEN 'window: ' || r WHEN expo.exposure IS NULL THEN 'no exposure row' WHEN car.car IS NULL THEN 'gaps: estimation window' END AS reason
 FROM grid LEFT JOIN expo ON expo.unit_id = grid.unit_id AND expo.event_id = grid.event_id LEFT JOIN car ON car.unit_id = grid.unit_id AND car.event_id = grid.event_id)
"""


def _car_panel(spark, folder):
    prices = settled(X.weekly_prices(spark, folder))
    panel, windows, fits = _fits(spark, folder, prices)
    units = prices.select("unit_id").distinct()
    # the task grid itself: every unit with every event, each with a row or a reason
    grid = units.crossJoin(windows.select("event_id", F.col("reason").alias("r")))
    out = grid.join(_exposure(spark, folder).drop("direction"), ["unit_id", "event_id"], "left").join(E.car(E.abnormal_returns(panel, fits, windows), 0, 1), ["unit_id", "event_id"], "left")
    reason = F.when(F.col("r").isNotNull(), F.concat(F.lit("window: "), "r")).when(F.col("exposure").isNull(), "no exposure row").when(F.col("car").isNull(), "gaps: estimation window")
    return out.withColumn("reason", reason)


@query("car_panel", _PANEL + "SELECT unit_id, event_id, round(car, 5) + 0.0 AS car, round(exposure, 6) AS exposure FROM cp WHERE reason IS NULL")
def car_panel(spark, folder):
    rows = _car_panel(spark, folder).where("reason is null").select("unit_id", "event_id", "car", "exposure")
    return _round(_round(rows, 5, "car"), 6, "exposure")


@query("car_panel_attrition", _PANEL + "SELECT CASE WHEN reason IS NULL THEN 'kept' WHEN strpos(reason, ':') > 0 THEN split_part(reason, ':', 1) ELSE reason END AS reason, CAST(count(*) AS BIGINT) AS pairs FROM cp GROUP BY 1")
def car_panel_attrition(spark, folder):
    return _car_panel(spark, folder).groupBy(F.coalesce(F.substring_index("reason", ":", 1), F.lit("kept")).alias("reason")).agg(F.count("*").alias("pairs"))


_DM = cte("dose") + ", dm AS (SELECT *, car - avg(car) OVER (PARTITION BY event_id) AS y, exposure - avg(exposure) OVER (PARTITION BY event_id) AS x FROM dose), b AS (SELECT count(*) AS n, sum(x * y) / nullif(sum(x * x), 0) AS beta, sum(x * x) AS sxx FROM dm), sc AS (SELECT event_id, sum(x * (y - beta * x)) AS score, sum(x * x) AS exx, count(*) AS n FROM dm, b GROUP BY event_id)\n"


@query("identification_structure", cte("dose") + "SELECT CAST(count(*) AS BIGINT) AS \"rows\", CAST(count(DISTINCT event_id) AS BIGINT) AS events, CAST(count(DISTINCT unit_id) AS BIGINT) AS units, CAST(count(CASE WHEN exposure <> 0 THEN 1 END) AS BIGINT) AS nonzero, CAST(count(DISTINCT CASE WHEN exposure <> 0 THEN unit_id END) AS BIGINT) AS exposed_units FROM dose")
def identification_structure(spark, folder):
    exposed = F.when(F.col("exposure") != 0, F.col("unit_id"))
    return _dose(spark, folder).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.count_distinct("unit_id").alias("units"), F.count(exposed).alias("nonzero"), F.count_distinct(exposed).alias("exposed_units"))


@query("dose_response_beta", _DM + "SELECT n, CAST(printf('%.7e', beta) AS DOUBLE) AS beta FROM b")
def dose_response_beta(spark, folder):
    return _sig(D.slope(_dose(spark, folder)), "beta")


@query("cluster_scores", _DM + "SELECT event_id, round(score, 5) + 0.0 AS score, round(exx, 7) AS sxx, CAST(n AS BIGINT) AS n FROM sc")
def cluster_scores(spark, folder):
    rows = _dose(spark, folder)
    return _round(_round(D.cluster_scores(rows, D.slope(rows)), 5, "score"), 7, "sxx")


@query("cluster_robust_error", _DM + "SELECT CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS clusters, CAST(printf('%.7e', beta) AS DOUBLE) AS beta, CAST(printf('%.7e', se) AS DOUBLE) AS se, CAST(printf('%.7e', beta / nullif(se, 0)) AS DOUBLE) AS t FROM (SELECT any_value(b.n) AS n, count(*) AS g, any_value(beta) AS beta, sqrt(count(*) / CAST(greatest(count(*) - 1, 1) AS DOUBLE) * (any_value(b.n) - 1) / greatest(any_value(b.n) - count(*) - 1, 1) * sum(score * score)) / nullif(any_value(sxx), 0) AS se FROM sc, b)")
def cluster_robust_error(spark, folder):
    return _sig(D.cluster_error(_dose(spark, folder)), "beta", "se", "t")


@query("direction_subsample_betas", _DM + "SELECT direction, CAST(count(*) AS BIGINT) AS n, CAST(printf('%.7e', sum(x * y) / nullif(sum(x * x), 0)) AS DOUBLE) AS beta FROM dm GROUP BY direction")
def direction_subsample_betas(spark, folder):
    return _sig(D.slope(_dose(spark, folder), "exposure", "direction"), "beta")


@query("leave_one_event_out", _DM + "SELECT a.event_id AS left_out, CAST(count(*) AS BIGINT) AS n, CAST(printf('%.7e', sum(x * y) / nullif(sum(x * x), 0)) AS DOUBLE) AS beta FROM (SELECT DISTINCT event_id FROM dm) a JOIN dm ON dm.event_id <> a.event_id GROUP BY 1")
def leave_one_event_out(spark, folder):
    # sums by event, then the total less each event's own: no row is read twice
    d = D.demean(_dose(spark, folder), "event_id", "car", "exposure")
    s = d.groupBy("event_id").agg(F.sum(F.col("exposure_d") * F.col("car_d")).alias("xy"), F.sum(F.col("exposure_d") * F.col("exposure_d")).alias("xx"), F.count("*").alias("n"))
    total = s.agg(F.sum("xy").alias("txy"), F.sum("xx").alias("txx"), F.sum("n").alias("tn"))
    out = s.crossJoin(total).select(F.col("event_id").alias("left_out"), (F.col("tn") - F.col("n")).alias("n"), ((F.col("txy") - F.col("xy")) / F.nullif(F.col("txx") - F.col("xx"), F.lit(0.0))).alias("beta"))
    return _sig(out, "beta")


_FW = _DM[:-1] + ", fw AS (SELECT event_id, unit_id, x * x / sum(x * x) OVER () AS weight FROM dm)\n"


@query("fwl_row_weights", _FW + "SELECT event_id, unit_id, round(weight, 5) AS weight FROM fw")
def fwl_row_weights(spark, folder):
    return _round(D.row_weights(_dose(spark, folder)), 5, "weight")


@query("effective_rows", _FW + "SELECT CAST(count(*) AS BIGINT) AS \"rows\", round(sum(weight) * sum(weight) / nullif(sum(weight * weight), 0), 3) AS effective FROM fw")
def effective_rows(spark, folder):
    return _round(D.effective_rows(D.row_weights(_dose(spark, folder))), 3, "effective")


@query("topk_exposed_units", cte("dose") + "SELECT unit_id, round(m, 6) AS exposure, CAST(k AS INT) AS place FROM (SELECT unit_id, max(abs(exposure)) AS m, row_number() OVER (ORDER BY max(abs(exposure)) DESC, unit_id) AS k FROM dose GROUP BY unit_id) WHERE k <= 5")
def topk_exposed_units(spark, folder):
    from pyspark.sql.window import Window

    top = _dose(spark, folder).groupBy("unit_id").agg(F.max(F.abs("exposure")).alias("exposure")).orderBy(F.desc("exposure"), "unit_id").limit(5)
    return _round(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("exposure"), "unit_id"))), 6, "exposure")


@query("spearman_of_forms", cte("dose") + ", r AS (SELECT rank() OVER (ORDER BY exposure) + (count(*) OVER (PARTITION BY exposure) - 1) / 2.0 AS a, rank() OVER (ORDER BY car) + (count(*) OVER (PARTITION BY car) - 1) / 2.0 AS b FROM dose) SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 4) + 0.0 AS rho FROM r")
def spearman_of_forms(spark, folder):
    rows = O.average_rank(O.average_rank(_dose(spark, folder), "exposure", "a"), "car", "b")
    return _round(rows.agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho")), 4, "rho")


def _floor_sql(points: int) -> str:
    return f"round(greatest(least(exp(greatest(ln(2) - g * ln({points}), -745.0)), 1.0), 1.0 / 2001), 9)"


@query("bootstrap_floor_curve", f"WITH d AS (SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS g FROM orders GROUP BY 1) SELECT CAST(g AS INT) AS clusters, CAST(count(*) AS BIGINT) AS designs, {_floor_sql(2)} AS rademacher, {_floor_sql(6)} AS webb FROM d GROUP BY g")
def bootstrap_floor_curve(spark, folder):
    """Least p by number of clusters, and how many designs have that number: a customer's orders are a design, their months its clusters."""
    months = X.table(spark, folder, "orders").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
    curve = months.groupBy("o_custkey").agg(F.count_distinct("month").alias("clusters")).groupBy("clusters").agg(F.count("*").alias("designs"))
    floors = {n: F.round(R.p_floor(F.col("clusters"), 2000, len(D.WEIGHTS[n])), 9) for n in ("rademacher", "webb")}
    return curve.withColumns(floors).withColumn("clusters", F.col("clusters").cast("int"))


@query(
    "design_limits",
    """WITH d AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderpriority AS priority, CAST(count(DISTINCT o_custkey) - 1 AS INT) AS donors FROM orders GROUP BY GROUPING SETS ((1, 2), (1)))
SELECT week, priority, donors, round(1.0 / (donors + 1), 9) AS least_p, CAST(ceil(1 / 0.05 - 1) AS INT) AS donors_for_5_percent, donors >= ceil(1 / 0.05 - 1) AS feasible FROM d""",
)
def design_limits(spark, folder):
    """What each week's pool, whole and by priority, can show: one customer who orders in it is treated, the others are donors."""
    orders = X.table(spark, folder, "orders").select(F.trunc(F.to_date("o_orderdate"), "week").alias("week"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    pools = orders.groupingSets([["week", "priority"], ["week"]], "week", "priority").agg((F.count_distinct("o_custkey") - 1).cast("int").alias("donors"))
    need = F.ceil(1 / F.lit(0.05) - 1).cast("int")
    return pools.select("week", "priority", "donors", F.round(1.0 / (F.col("donors") + 1), 9).alias("least_p"), need.alias("donors_for_5_percent"), (F.col("donors") >= need).alias("feasible"))


def resampled(rows: str, controls: tuple[str, ...], seed: int = 20260815, draws: int = 2000) -> str:
    """CTEs after one named ``rows`` (event_id, unit_id, cluster_id, exposure x0 and effect y less event means, orthogonal controls, x and y less those); the last, ``boot``, has one row of all figures.

    Weights have six points; sums by cluster give each draw's slope and error.
    """
    points = "[-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)]"
    k = range(len(controls))
    by_cluster = "".join(f", sum(x * {z}) AS xz{i}, sum({z} * y) AS zy{i}" for i, z in enumerate(controls))
    squares = "".join(f", sum({z} * {z}) AS zz{i}" for i, z in enumerate(controls))
    gammas = "".join(f", sum(w * zy{i}) / any_value(zz{i}) AS g{i}" for i in k)
    taken = "".join(f" - g{i} * xz{i}" for i in k)
    shares = "".join(f" - pow(sum(p.x0 * q.{z}), 2) / any_value(zz{i})" for i, z in enumerate(controls))
    error = f"sqrt(g / greatest(g - 1.0, 1) * (n - 1.0) / greatest(n - events - {len(controls) + 1}, 1) * sum(pow(score, 2))) / any_value(xx)"
    return f""",
cs AS (SELECT cluster_id, sum(x * y) AS xy, sum(x * x) AS xx{by_cluster}, {U.stream_sql(str(seed), "cluster_id")} AS s FROM {rows} GROUP BY 1),
al AS (SELECT count(*) AS n, count(DISTINCT event_id) AS events, count(DISTINCT cluster_id) AS g, sum(x * x) AS xx, sum(x0 * x0) AS x0x0, sum(x * y) / sum(x * x) AS beta{squares} FROM {rows}),
w AS (SELECT 0 AS draw, 1.0 AS w, cs.* FROM cs UNION ALL SELECT range + 1, {points}[1 + {U.below_sql(U.hash_sql("s", "range"), "6")}], cs.* FROM cs, range({draws})),
bd AS (SELECT draw, sum(w * cs.xy) / any_value(al.xx) AS b{gammas} FROM w cs, al GROUP BY draw),
bt AS (SELECT draw, any_value(b) AS b, any_value(b) / ({error}) AS t FROM (SELECT w.draw, b, n, events, g, al.xx, w * xy - b * w.xx{taken} AS score FROM w JOIN bd ON bd.draw = w.draw, al) GROUP BY draw, n, events, g),
wild AS (SELECT any_value(o.b) AS beta, any_value(o.t) AS t0, count(CASE WHEN abs(a.t) >= abs(o.t) * (1 - 1e-9) THEN 1 END) AS extreme, count(CASE WHEN isfinite(a.t) THEN 1 END) AS finite_ FROM bt a, bt o WHERE a.draw > 0 AND o.draw = 0),
us AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY unit_id) AS k, {U.stream_sql(str(seed), "event_id", "unit_id")} AS s FROM {rows}),
pm AS (SELECT range AS draw, event_id, x0, row_number() OVER (PARTITION BY range, event_id ORDER BY {U.hash_sql("s", "range")}, unit_id) AS k FROM us, range({draws})),
pr AS (SELECT p.draw, sum(p.x0 * q.y) / (any_value(al.x0x0){shares}) AS b FROM pm p JOIN us q ON q.event_id = p.event_id AND q.k = p.k, al GROUP BY p.draw),
rnd AS (SELECT avg(CASE WHEN abs(pr.b) >= abs(al.beta) * (1 - 1e-9) THEN 1.0 ELSE 0.0 END) AS p_random, count(*) AS draws FROM pr, al),
boot AS (SELECT wild.beta, t0 AS t, g, greatest(g - 1, 1) AS nu, atan(abs(t0) / sqrt(greatest(g - 1, 1))) AS a, greatest(least(2 / pow(6.0, g), 1.0), 1.0 / {draws + 1}) AS p_floor, (1.0 + extreme) / (finite_ + 1) AS p_wild, p_random, draws FROM wild, rnd, al)"""


BOOTED = ("beta", "t", "p_cluster", "p_floor", "p_wild", "p_random")


def booted_sql(more: str = "") -> str:
    return " SELECT " + ", ".join(f"CAST(printf('%.7e', {TAIL if c == 'p_cluster' else c}) AS DOUBLE) AS {c}" for c in BOOTED) + f", CAST(draws AS BIGINT) AS draws{more} FROM boot"


#: The two-sided tail of Student's t with ``nu`` degrees, ``a`` the arctangent of |t| over their root.
TAIL = """CASE WHEN nu % 2 = 0 THEN 1 - sin(a) * list_sum(list_transform(range(0, nu // 2), lambda i: gamma(i + 0.5) / (gamma(0.5) * gamma(i + 1)) * pow(cos(a), 2 * i)))
 ELSE 1 - 2 / pi() * (a + CASE WHEN nu > 1 THEN sin(a) * cos(a) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda i: gamma(i + 1) * gamma(1.5) / gamma(i + 1.5) * pow(cos(a), 2 * i))) ELSE 0 END) END"""


@query("wild_bootstrap_p", _DM.rstrip() + ", dr AS (SELECT event_id, unit_id, event_id AS cluster_id, x AS x0, x, y FROM dm)" + resampled("dr", ()) + booted_sql())
def wild_bootstrap_p(spark, folder):
    return _sig(G.wild_bootstrap(_dose(spark, folder), "webb"), *BOOTED)


@query("minimum_detectable_slope", _DM + "SELECT CAST(printf('%.7e', se) AS DOUBLE) AS se, CAST(printf('%.7e', se * 2.8015852181465855) AS DOUBLE) AS mde FROM (SELECT sqrt(count(*) / CAST(greatest(count(*) - 1, 1) AS DOUBLE) * (any_value(b.n) - 1) / greatest(any_value(b.n) - count(*) - 1, 1) * sum(score * score)) / nullif(any_value(sxx), 0) AS se FROM sc, b)")
def minimum_detectable_slope(spark, folder):
    out = D.minimum_detectable(D.cluster_error(_dose(spark, folder)))
    return out.withColumns({n: F.format_string("%.7e", F.col(n)).cast("double") for n in ("se", "mde")})
