"""Queries on synthetic controls, resampling and influence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import draws as U
from tidemark.operators import kernels as K
from tidemark.operators import synthetic as S
from tidemark.operators.settle import settled
from tidemark.plans.dose_queries import _dose
from tidemark.plans.panel_queries import _ar, _panel, _round, _sig, _windows
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import ESTIMATION, GAP, HORIZON, cte


def _tasks(spark, folder):
    """(event_id, unit_id, rel, ret) of the units of full data of each event whose windows fit."""
    prices = settled(X.weekly_prices(spark, folder))
    spans = _windows(spark, folder, prices).where("reason is null").select("event_id", "t0", F.explode(F.sequence("pre_start", "post_end")).alias("pos"))
    rows = settled(_panel(spark, folder, prices).join(spans, "pos").select("event_id", "unit_id", (F.col("pos") - F.col("t0")).alias("rel"), "ret"))
    whole = rows.groupBy("event_id", "unit_id").agg(F.count("ret").alias("n"), F.count("*").alias("m")).where("n = m")
    return rows.join(whole.select("event_id", "unit_id"), ["event_id", "unit_id"])


@query("synthetic_control")
def synthetic_control(spark, folder):
    return S.synthetic_control(_tasks(spark, folder), GAP)


@query("synthetic_control_placebos")
def synthetic_control_placebos(spark, folder):
    return K.estimator_placebos(settled(S.synthetic_control(_tasks(spark, folder), GAP)))


@query("synthetic_difference_in_differences")
def synthetic_difference_in_differences(spark, folder):
    return S.difference_in_differences(_tasks(spark, folder), GAP)


@query("synthetic_did_at_horizon")
def synthetic_did_at_horizon(spark, folder):
    return S.difference_in_differences(_tasks(spark, folder), GAP, average=False)


_WHOLE = cte("panel", "ev") + """, w AS (SELECT event_id, unit_id, region, pos - t0 AS rel, ret FROM panel JOIN ev ON pos BETWEEN pre_start AND post_end WHERE reason IS NULL),
full_ AS (SELECT event_id, unit_id, count(*) OVER (PARTITION BY event_id) - 1 AS n_donors FROM (SELECT event_id, unit_id FROM w GROUP BY 1, 2 HAVING count(ret) = count(*)))
"""


@query("synthetic_control_optimality", _WHOLE + "SELECT event_id, unit_id AS treated, CAST(n_donors AS BIGINT) AS n_donors, 1.0 AS total_weight, TRUE AS optimal FROM full_ WHERE n_donors >= 2")
def synthetic_control_optimality(spark, folder):
    """Every unit's weights sum to one, and no move of weight between donors gains more than 1e-9 of its scale."""
    units = S.series(_tasks(spark, folder), GAP)
    fits = S.control_fits(units)
    total = fits.select("event_id", "treated", F.round(F.aggregate("weights", F.lit(0.0), lambda a, b: a + b), 9).alias("total_weight"))
    count = units.groupBy("event_id").agg((F.count("*") - 1).alias("n_donors"))
    gaps = S.optimality(fits, S._raw(units)).select("event_id", "treated", (F.col("gap") < 1e-9).alias("optimal"))
    return gaps.join(total, ["event_id", "treated"]).join(count, "event_id").select("event_id", "treated", "n_donors", "total_weight", "optimal")


@query(
    "two_way_regression",
    _WHOLE + f""", c AS (SELECT w.event_id, w.unit_id, region, rel, sum(ret) OVER (PARTITION BY w.event_id, w.unit_id ORDER BY rel) AS y FROM w JOIN full_ f ON f.event_id = w.event_id AND f.unit_id = w.unit_id),
m AS (SELECT event_id, unit_id, region, row_number() OVER (PARTITION BY event_id ORDER BY unit_id) AS k, sum(CASE WHEN rel < 0 THEN (rel + {GAP + 11}) * y END) / 55 AS before, avg(CASE WHEN rel >= 0 THEN y END) AS after FROM c WHERE rel >= 0 OR rel BETWEEN -{GAP + 10} AND -{GAP + 1} GROUP BY 1, 2, 3)
SELECT u.event_id, u.unit_id AS treated, CAST(printf('%.7e', any_value(u.after - u.before) - sum(d.k * (d.after - d.before)) / sum(d.k)) AS DOUBLE) AS beta FROM m u JOIN m d ON d.event_id = u.event_id AND d.region = u.region AND d.unit_id <> u.unit_id GROUP BY 1, 2""",
)
def two_way_regression(spark, folder):
    """Each unit against its region's others, weighted by unit and step, unit and step effects absorbed."""
    rows = _tasks(spark, folder)
    order = Window.partitionBy("event_id", "unit_id").orderBy("rel")
    region = X.table(spark, folder, "nation").select(F.col("n_name").alias("unit_id"), F.col("n_regionkey").alias("region"))
    path = rows.withColumn("y", F.sum("ret").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rel") >= 0) | F.col("rel").between(-GAP - 10, -GAP - 1)).join(region, "unit_id")
    path = settled(path.withColumn("k", F.dense_rank().over(Window.partitionBy("event_id").orderBy("unit_id"))).withColumn("step", F.when(F.col("rel") < 0, F.col("rel") + GAP + 11).otherwise(1)))
    treated = path.select("event_id", F.col("unit_id").alias("treated"), "region").distinct()
    cells = path.join(treated, ["event_id", "region"]).withColumn("weight", (F.col("k") * F.col("step")).cast("double")).withColumn("on", ((F.col("unit_id") == F.col("treated")) & (F.col("rel") >= 0)).cast("double"))
    out = S.absorbed_slope(cells, ["event_id", "treated"], ("unit_id", "rel"), "y", "on", "weight")
    return _sig(out.where("beta is not null").select("event_id", "treated", "beta"), "beta")


@query("two_way_equals_synthetic_did", _WHOLE + "SELECT event_id, unit_id AS treated, TRUE AS equal, TRUE AS time_optimal FROM full_ WHERE n_donors >= 2")
def two_way_equals_synthetic_did(spark, folder):
    """The weighted regression's coefficient against the closed form of the effect, to eight digits, for every event and unit."""
    units = S.series(_tasks(spark, folder), GAP)
    fits = S.did_fits(units, average=True)
    beta = S.absorbed_slope(S.weighted_cells(fits, units, average=True), ["event_id", "treated"], ("unit_id", "rel"), "y", "on", "weight")
    tau = S.did_report(fits, average=True).select("event_id", "treated", "tau", "pre_rmspe")
    both = beta.join(tau, ["event_id", "treated"]).join(fits.select("event_id", "treated", "time_gap"), ["event_id", "treated"])
    size = F.greatest(F.abs("tau"), F.col("pre_rmspe"))
    return both.select("event_id", "treated", (F.abs(F.col("beta") - F.col("tau")) <= 1e-8 * size).alias("equal"), (F.col("time_gap") < 1e-9).alias("time_optimal"))


_ZETA = cte("panel", "ev") + f""", w AS (SELECT event_id, unit_id, pos - t0 AS rel, ret FROM panel JOIN ev ON pos BETWEEN pre_start AND post_end WHERE reason IS NULL),
full_ AS (SELECT event_id, unit_id FROM w GROUP BY 1, 2 HAVING count(ret) = count(*)),
p AS (SELECT w.event_id, w.unit_id, rel, ret FROM w JOIN full_ f ON f.event_id = w.event_id AND f.unit_id = w.unit_id WHERE rel < -{GAP}),
d AS (SELECT event_id, unit_id, ret AS step FROM p WHERE rel > -{GAP + ESTIMATION}),
s AS (SELECT event_id, count(*) AS n, sum(step) AS a, sum(step * step) AS b FROM d GROUP BY 1), o AS (SELECT event_id, unit_id, count(*) AS n, sum(step) AS a, sum(step * step) AS b FROM d GROUP BY 1, 2)
SELECT o.event_id, o.unit_id AS treated, round(pow({HORIZON + 1}, 0.25) * sqrt(((s.b - o.b) - (s.a - o.a) * (s.a - o.a) / (s.n - o.n)) / (s.n - o.n - 1)), 9) AS zeta FROM o JOIN s ON s.event_id = o.event_id WHERE s.n > 2 * o.n
"""


@query("regularisation_constants", _ZETA)
def regularisation_constants(spark, folder):
    return _round(S.difference_in_differences(_tasks(spark, folder), GAP).select("event_id", "treated", "zeta"), 9, "zeta")


@query("leave_one_donor_out")
def leave_one_donor_out(spark, folder):
    return S.leave_one_donor_out(_tasks(spark, folder), GAP)


@query("leave_one_out_summary")
def leave_one_out_summary(spark, folder):
    rows = _tasks(spark, folder)
    return S.leave_one_out_summary(S.leave_one_donor_out(rows, GAP), S.synthetic_control(rows, GAP))


_BLOCK, _DRAWS, _SEED = 5, 2000, 20260815
_BLOCKS = -(-(HORIZON + 1) // _BLOCK)


@query(
    "block_bootstrap_car",
    cte("ar") + f""", pre AS (SELECT event_id, unit_id, list(ar - m ORDER BY rel) AS a FROM (SELECT event_id, unit_id, rel, ar, avg(ar) OVER (PARTITION BY event_id, unit_id) AS m FROM ar WHERE rel < -{GAP}) GROUP BY 1, 2 HAVING count(ar) = count(*)),
post AS (SELECT event_id, unit_id, sum(ar) AS tau FROM ar WHERE rel BETWEEN 0 AND {HORIZON} GROUP BY 1, 2 HAVING count(ar) = {HORIZON + 1}),
src AS (SELECT event_id, unit_id, tau, len(a) AS n, list_concat(a, a[1:{_BLOCK}]) AS c, {U.stream_sql(str(_SEED), "event_id", "unit_id")} AS s FROM pre JOIN post USING (event_id, unit_id)),
sums AS (SELECT event_id, unit_id, tau, n, s, list_transform(range(1, n + 1), lambda i: list_sum(c[i:i + {_BLOCK - 1}])) AS whole, list_transform(range(1, n + 1), lambda i: list_sum(c[i:i + {HORIZON - _BLOCK * (_BLOCKS - 1)}])) AS cut FROM src),
d AS (SELECT event_id, unit_id, range AS draw, unnest(range({_BLOCKS})) AS b, tau, n, s FROM (SELECT event_id, unit_id, tau, n, s FROM sums), range({_DRAWS})),
h AS (SELECT event_id, unit_id, draw, b, {U.below_sql(U.hash_sql("s", f"draw * {_BLOCKS} + b"), "n")} AS start FROM d),
t AS (SELECT h.event_id, h.unit_id, draw, any_value(tau) AS tau, sum(CASE WHEN b < {_BLOCKS - 1} THEN whole[start + 1] ELSE cut[start + 1] END) AS v FROM h JOIN sums USING (event_id, unit_id) GROUP BY 1, 2, 3)
SELECT event_id, unit_id, round(any_value(tau), 5) + 0.0 AS tau, avg(CASE WHEN abs(v) >= abs(tau) THEN 1.0 ELSE 0.0 END) AS p, round(quantile_cont(v, 0.025), 5) + 0.0 AS low, round(quantile_cont(v, 0.975), 5) + 0.0 AS high FROM t GROUP BY 1, 2""",
)
def block_bootstrap_car(spark, folder):
    return _round(K.block_bootstrap(_ar(spark, folder), GAP, HORIZON, _BLOCK, _DRAWS, _SEED), 5, "tau", "low", "high")


@query(
    "leverage_and_cooks_distance",
    cte("dose") + """, d AS (SELECT event_id, unit_id, exposure - avg(exposure) OVER w AS x, car - avg(car) OVER w AS y, count(*) OVER w AS m FROM dose WINDOW w AS (PARTITION BY event_id)),
t AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, count(*) AS n, count(DISTINCT event_id) AS g FROM d),
h AS (SELECT event_id, unit_id, least(1.0 / m + x * x / nullif(xx, 0), 1 - 1e-12) AS hat, y - xy / nullif(xx, 0) * x AS e, (yy - xy * xy / nullif(xx, 0)) / greatest(n - g - 1, 1) AS s2, g + 1 AS p FROM d, t)
SELECT event_id, unit_id, round(hat, 5) AS hat, round(e * e / nullif(p * s2, 0) * hat / ((1 - hat) * (1 - hat)), 4) AS cook FROM h""",
)
def leverage_and_cooks_distance(spark, folder):
    return _round(_round(K.leverage(_dose(spark, folder)), 5, "hat"), 4, "cook")


@query(
    "drop_path",
    cte("dose") + """, top AS (SELECT unit_id, row_number() OVER (ORDER BY max(abs(exposure)) DESC, unit_id) AS place FROM dose GROUP BY unit_id), k AS (SELECT CAST(v AS INT) AS k FROM (VALUES (0), (1), (2), (3), (5)) AS t(v)),
g AS (SELECT k, event_id, exposure - avg(exposure) OVER (PARTITION BY k, event_id) AS x, car - avg(car) OVER (PARTITION BY k, event_id) AS y FROM dose JOIN top ON top.unit_id = dose.unit_id JOIN k ON place > k)
SELECT k, CAST(count(*) AS BIGINT) AS n, CAST(printf('%.7e', sum(x * y) / nullif(sum(x * x), 0)) AS DOUBLE) AS beta FROM g GROUP BY k""",
)
def drop_path(spark, folder):
    return _sig(K.drop_path(_dose(spark, folder)), "beta")
