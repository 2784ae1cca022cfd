"""Queries on screening, configuration checks, channels, and the verdicts of placebos, tests and power."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import effects as E
from tidemark.operators import exposure as O
from tidemark.operators import screening as N
from tidemark.operators.settle import settled
from tidemark.plans.panel_queries import _ar
from tidemark.plans.registry import query
from tidemark.plans.regression_queries import s, sig
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import GAP, HORIZON, cte

_NAMES = ("Investment Trust", "Income REIT", "Holdings", "Growth & Income", "Plant Hire", "Breitling Fund", "Reitmans")


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CAND = f"""WITH c AS (SELECT 'T' || s_suppkey % 60 AS ticker, CASE WHEN s_suppkey % 11 = 0 THEN '  Ruffer Investment Company ' WHEN s_suppkey % 13 = 0 THEN 'MOLTEN Ventures' WHEN s_suppkey % 17 = 0 THEN ' ' ELSE s_name || ' ' || [{_list(_NAMES)}][s_suppkey % 7 + 1] END AS name, s_suppkey AS place FROM supplier),
f AS (SELECT ticker, arg_min(name, place) AS name FROM c GROUP BY ticker), l AS (SELECT *, lower(trim(name, ' ')) AS n FROM f),
r AS (SELECT ticker, name, CASE WHEN CAST(substr(ticker, 2) AS INT) % 9 = 0 THEN 'curated' WHEN n <> '' AND NOT regexp_matches(n, '\\breit\\b') AND (n IN ({_list(N.VEHICLES)}) OR {' OR '.join(f"contains(n, '{w}')" for w in N.VEHICLE_WORDS)}) THEN 'investment vehicle' END AS reason FROM l)
"""


@query("candidate_filter", _CAND + "SELECT ticker, name, reason FROM r")
def candidate_filter(spark, folder):
    k = F.col("s_suppkey")
    name = F.when(k % 11 == 0, "  Ruffer Investment Company ").when(k % 13 == 0, "MOLTEN Ventures").when(k % 17 == 0, " ").otherwise(F.concat("s_name", F.lit(" "), F.element_at(F.array(*map(F.lit, _NAMES)), (k % 7 + 1).cast("int"))))
    rows = X.table(spark, folder, "supplier").select(F.concat(F.lit("T"), (k % 60).cast("string")).alias("ticker"), name.alias("name"), k.alias("place"))
    curated = spark.range(0, 60, 9).select(F.concat(F.lit(" t"), F.col("id").cast("string"), F.lit(" ")).alias("ticker"))
    return N.filter_candidates(rows, curated)


@query("usable_instruments", "SELECT o_orderpriority AS grade, CAST(count(*) AS BIGINT) AS usable, CAST(count(CASE WHEN o_orderkey % 3 <> 0 THEN 1 END) AS BIGINT) AS independent FROM orders WHERE substr(o_orderpriority, 1, 1) <> '3' AND o_orderkey NOT IN (1, 2, 3) GROUP BY 1")
def usable_instruments(spark, folder):
    rows = X.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderpriority").startswith("3"), "C").otherwise("A").alias("grade"), (F.col("o_orderkey") % 3 != 0).alias("independent"))
    known = [r[0] for r in rows.where("o_orderkey in (1, 2, 3)").select("o_orderkey").collect()]
    rows = N.without(rows, "o_orderkey", known)
    all_, own = N.usable(rows), N.usable(rows, scheduled=False)
    return all_.groupBy(F.col("o_orderpriority").alias("grade")).agg(F.count("*").alias("usable")).join(own.groupBy(F.col("o_orderpriority").alias("grade")).agg(F.count("*").alias("independent")), "grade")


_FX = "(VALUES ('GBP', 1.0), ('EUR', 0.85), ('USD', 0.79)) AS v(currency, rate)"


@query("donor_turnover_in_one_currency", cte("px") + f", m AS (SELECT unit_id, avg(CAST(px AS DOUBLE) * vol) AS m, CASE WHEN any_value(region) = 0 THEN 'GBP' WHEN any_value(region) = 1 THEN 'EUR' WHEN any_value(region) = 2 THEN 'USD' ELSE 'JPY' END AS currency FROM px GROUP BY 1) SELECT unit_id, {s('m * rate')} AS turnover, coalesce(m * rate >= 1e12, false) AS passes, CASE WHEN rate IS NULL THEN 'no rate' END AS problem FROM m LEFT JOIN (SELECT currency, CAST(rate AS DOUBLE) AS rate FROM {_FX}) r ON r.currency = m.currency")
def donor_turnover_in_one_currency(spark, folder):
    prices = X.weekly_prices(spark, folder)
    currency = F.when(F.col("region") == 0, "GBP").when(F.col("region") == 1, "EUR").when(F.col("region") == 2, "USD").otherwise("JPY")
    rates = spark.createDataFrame([("GBP", 1.0), ("EUR", 0.85), ("USD", 0.79)], "currency string, rate double")
    return sig(N.donor_turnover(prices, prices.groupBy("unit_id").agg(F.first("region").alias("region")).select("unit_id", currency.alias("currency")), rates, 1e12), "turnover")


@query("aliased_unit_returns", cte("rets") + f", l AS (SELECT DISTINCT unit_id AS src FROM rets), u AS (SELECT src || ' old' AS unit_id, src, CAST(NULL AS DATE) AS f, DATE '1995-06-30' AS l FROM l UNION ALL SELECT src || ' new', src, DATE '1995-07-01', NULL FROM l) SELECT u.unit_id, CAST(count(*) AS BIGINT) AS days, min(dt) AS first, max(dt) AS last, {s('sum(ret)')} AS total FROM u JOIN rets ON rets.unit_id = src WHERE (f IS NULL OR dt >= f) AND (l IS NULL OR dt <= l) GROUP BY 1")
def aliased_unit_returns(spark, folder):
    from tidemark.operators import panel as P

    rets = P.point_in_time_returns(X.weekly_prices(spark, folder)).select(F.col("unit_id").alias("source_ticker"), "dt", "ret")
    names = X.table(spark, folder, "nation").select(F.col("n_name").alias("source_ticker"))
    none = F.lit(None).cast("date")
    listings = names.select(F.concat("source_ticker", F.lit(" old")).alias("unit_id"), "source_ticker", none.alias("first"), F.lit("1995-06-30").cast("date").alias("last"))
    listings = listings.unionByName(names.select(F.concat("source_ticker", F.lit(" new")).alias("unit_id"), "source_ticker", F.lit("1995-07-01").cast("date").alias("first"), none.alias("last")))
    return sig(N.listed_returns(listings, rets).groupBy("unit_id").agg(F.count("*").alias("days"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.sum("ret").alias("total")), "total")


@query(
    "universe_issues",
    """WITH l AS (SELECT CASE WHEN k = 24 THEN '' WHEN k = 3 THEN 'u2' ELSE 'u' || k END AS unit_id, 'N' || k || CASE k % 4 WHEN 0 THEN '.L' WHEN 1 THEN '.PA' WHEN 2 THEN '' ELSE '.XX' END AS source_ticker, k % 4 AS m, CASE WHEN k % 5 = 1 THEN 'none' ELSE 'lag' END AS alignment, CASE WHEN k = 7 THEN 'XAU' ELSE 'GBP' END AS currency FROM (SELECT n_nationkey AS k FROM nation))
SELECT source_ticker AS subject, 'missing unit_id' AS message FROM l WHERE unit_id = '' UNION ALL SELECT unit_id, 'duplicate unit_id' FROM l GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT unit_id, 'unknown suffix' FROM l WHERE m = 3
UNION ALL SELECT unit_id, 'unaligned clock' FROM l WHERE alignment = 'none' AND m IN (1, 2) UNION ALL SELECT DISTINCT currency, 'no rate' FROM l WHERE currency = 'XAU' UNION ALL SELECT CAST(count(*) AS VARCHAR), 'too many donors' FROM l HAVING count(*) > 20
UNION ALL SELECT * FROM (VALUES ('o1', 'duplicate override'), ('o2', 'empty override'), ('u4', 'exclusion ends before it starts')) AS v""",
)
def universe_issues(spark, folder):
    k = F.col("n_nationkey")
    unit = F.when(k == 24, "").when(k == 3, "u2").otherwise(F.concat(F.lit("u"), k.cast("string")))
    suffix = F.element_at(F.array(*map(F.lit, (".L", ".PA", "", ".XX"))), (k % 4 + 1).cast("int"))
    listings = X.table(spark, folder, "nation").select(unit.alias("unit_id"), F.concat(F.lit("N"), k.cast("string"), suffix).alias("source_ticker"), F.lit("donor").alias("group"), F.when(k % 5 == 1, "none").otherwise("lag").alias("alignment"), F.when(k == 7, "XAU").otherwise("GBP").alias("currency"))
    overrides = spark.createDataFrame([("o1", ["x"], []), ("o1", [], ["e1"]), ("o2", [], [])], "override_id string, tags array<string>, ids array<string>")
    exclusions = spark.sql("SELECT * FROM VALUES ('u4', DATE '2001-02-01', DATE '2001-01-01'), ('u5', DATE '2001-01-01', DATE '2001-01-01') AS v(unit_id, start, end)")
    suffixes = spark.createDataFrame([(".L", "Europe/London"), (".PA", "Europe/Paris"), ("", "America/New_York")], "suffix string, zone string")
    rates = spark.createDataFrame([("GBP", 1.0)], "currency string, rate double")
    return N.universe_issues(listings, overrides, exclusions, suffixes, rates, 20)


_ATTR = """WITH b AS (SELECT n_name AS unit_id, n_nationkey AS k, chr(CAST(65 + (p_size - 1) // 8 AS INT)) AS band, CAST(count(*) AS DOUBLE) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
t AS (SELECT * FROM (VALUES ('t1', 'domestic_prs', 'C'), ('t2', 'social_rented', 'D'), ('t3', 'all_domestic', 'E'), ('t4', 'new_build', 'B')) AS v(target_id, scope, band))
"""


@query(
    "channel_magnitudes",
    _ATTR + f""", st AS (SELECT unit_id, target_id, 'stock' AS channel, sum(CASE WHEN b.band > t.band THEN c ELSE 0 END) / sum(c) AS m FROM b JOIN t ON (k % 3 = 0 AND scope IN ('domestic_prs', 'all_domestic')) OR (k % 3 = 1 AND scope IN ('social_rented', 'all_domestic')) GROUP BY 1, 2),
de AS (SELECT unit_id, target_id, 'delivered' AS channel, CASE WHEN k % 2 = 0 THEN 0.0 ELSE sum(CASE WHEN b.band > t.band THEN c ELSE 0 END) / sum(c) END AS m FROM b JOIN t ON scope = 'new_build' WHERE k % 3 = 2 GROUP BY 1, 2, k)
SELECT unit_id, target_id, channel, {s('m')} AS magnitude FROM (SELECT * FROM st UNION ALL SELECT * FROM de)""",
)
def channel_magnitudes(spark, folder):
    lines = X.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    parts = X.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.element_at(F.array(*map(F.lit, O.BANDS)), (1 + F.floor((F.col("p_size") - 1) / 8)).cast("int")).alias("band"))
    units = X.table(spark, folder, "supplier").join(X.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("unit_id"), F.col("n_nationkey").alias("k"))
    counts = settled(lines.join(parts, "l_partkey").join(units, "l_suppkey").groupBy("unit_id", "k", "band").agg(F.count("*").cast("double").alias("value")))
    prefix = F.when(F.col("k") % 3 == 0, "dwellings_prs_band_").when(F.col("k") % 3 == 1, "dwellings_social_band_").otherwise("delivered_units_band_")
    attributes = counts.select("unit_id", F.concat(prefix, "band").alias("attribute"), "value")
    standard = counts.select("unit_id", "k").distinct().select("unit_id", F.lit("build_standard_band").alias("attribute"), F.when(F.col("k") % 2 == 0, 2.0).otherwise(5.0).alias("value"))
    attributes = attributes.unionByName(standard)
    targets = spark.createDataFrame([("t1", "domestic_prs", "C"), ("t2", "social_rented", "D"), ("t3", "all_domestic", "E"), ("t4", "new_build", "B")], "target_id string, scope string, band string")
    out = O.stock_channel(attributes, targets).withColumn("channel", F.lit("stock")).unionByName(O.delivered_channel(attributes, targets).withColumn("channel", F.lit("delivered")))
    return sig(out.select("unit_id", "target_id", "channel", "magnitude"), "magnitude")


@query(
    "product_doses",
    cte("shares") + f""", a AS (SELECT unit_id, attribute, value FROM shares WHERE as_of = DATE '1997-12-31'), t AS (SELECT * FROM (VALUES ('t1', ['brand#11', 'brand#12']), ('t2', ['none'])) AS v(target_id, cats)),
h AS (SELECT n_name AS unit_id, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE n_nationkey / 20.0 END AS home FROM nation),
m AS (SELECT a.unit_id, target_id, sum(CASE WHEN list_contains(cats, lower(substr(attribute, 15))) THEN value END) AS total FROM a, t GROUP BY 1, 2)
SELECT m.unit_id, target_id, {s('CASE WHEN total IS NULL THEN 0.0 ELSE least(total, 1.0) * least(greatest(home, 0.0), 1.0) END')} AS magnitude FROM m LEFT JOIN h ON h.unit_id = m.unit_id WHERE total IS NULL OR home IS NOT NULL""",
)
def product_doses(spark, folder):
    own = X.attributes(spark, folder).where("as_of = date'1997-12-31' and year(knowable) = 1998").select("unit_id", "attribute", "value")
    home = X.table(spark, folder, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_name").alias("unit_id"), F.lit("uk_revenue_share").alias("attribute"), (F.col("n_nationkey") / 20.0).alias("value"))
    targets = spark.createDataFrame([("t1", ["Brand#11 ", "brand#12"]), ("t2", ["none"])], "target_id string, categories array<string>")
    return sig(O.product_dose(own.unionByName(home), targets), "magnitude")


@query("scoreable_targets", "SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS targets, CAST(count(CASE WHEN p_size % 3 = 0 OR p_size % 2 = 0 THEN 1 END) AS BIGINT) AS scoreable, CAST(count(CASE WHEN p_size % 5 < 3 THEN 1 END) AS BIGINT) AS opposite, CAST(sum(CASE WHEN p_size % 5 < 3 THEN -1 ELSE 1 END) AS BIGINT) AS merged FROM part GROUP BY 1")
def scoreable_targets(spark, folder):
    size = F.col("p_size")
    rows = X.table(spark, folder, "part").select("p_brand", F.when(size % 3 == 0, "C").otherwise(" ").alias("band"), F.when(size % 2 == 0, "a; b").alias("categories"), F.when(size % 5 < 3, -1).otherwise(1).alias("sign"))
    first = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(1))
    both = N.merged(first, F.create_map(F.lit("y"), F.col("sign")))
    rows = N.scoreable(rows).withColumn("m", both)
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("targets"), F.count(F.when(F.col("scoreable"), 1)).alias("scoreable"), F.count(F.when(N.opposite_channels(F.col("m")), 1)).alias("opposite"), F.sum(F.col("m")["y"]).alias("merged"))


@query("best_titles", "WITH t AS (SELECT item_id, lower(text) AS x, CAST(item_id % 7 AS INT) AS month FROM benchmark), d AS (SELECT doc_id, text, CAST(doc_id % 7 AS INT) AS month FROM documents), h AS (SELECT item_id, doc_id, text AS title, len(list_filter(['er', 'the', 'qu', 'sch'], lambda w: contains(x, w) AND contains(lower(text), w))) AS hits FROM t JOIN d USING (month)) SELECT item_id AS id, arg_min(title, struct_pack(a := -hits, b := doc_id, c := title)) AS title, CAST(max(hits) AS INT) AS hits FROM h WHERE hits > 0 GROUP BY 1")
def best_titles(spark, folder):
    terms = F.filter(F.array(*map(F.lit, ("er", "the", "qu", "sch"))), lambda w: F.contains(F.lower("text"), w))
    rows = X.table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 7).cast("int").alias("month"), terms.alias("terms"))
    sweep = X.table(spark, folder, "documents").where("text is not null").select((F.col("doc_id") % 7).cast("int").alias("month"), F.col("doc_id").alias("published"), F.col("text").alias("title"))
    return N.best_title(rows, sweep)


_EFF = cte("ar", "ann") + f""", pv AS (SELECT event_id, unit_id, sum(CASE WHEN rel < -{GAP} THEN ar * ar END) AS sse, count(CASE WHEN rel < -{GAP} THEN ar END) AS n1, count(CASE WHEN rel BETWEEN 0 AND {HORIZON} THEN ar END) AS n2, sum(CASE WHEN rel BETWEEN 0 AND {HORIZON} THEN ar END) AS tau, avg(CASE WHEN rel < -{GAP} THEN mkt END) AS mb, var_pop(CASE WHEN rel < -{GAP} THEN mkt END) AS mv, sum(CASE WHEN rel BETWEEN 0 AND {HORIZON} THEN mkt END) AS mp FROM ar GROUP BY 1, 2),
ef AS (SELECT pv.event_id, unit_id, direction, tau, sqrt(sse / greatest(n1 - 2, 1) * (n2 + n2 * n2 / CAST(n1 AS DOUBLE) + pow(mp - n2 * mb, 2) / nullif(mv * n1, 0))) AS se FROM pv JOIN ann ON ann.event_id = pv.event_id WHERE n2 = {HORIZON + 1})"""


def _effects(spark, folder):
    ar = settled(_ar(spark, folder))
    effects = settled(E.prediction_variance(ar, GAP, HORIZON))
    return ar, effects, effects.join(X.announcements(spark).select("event_id", "direction"), "event_id")


@query("directional_placebo_p", _EFF + " SELECT a.event_id, a.unit_id, CAST(count(b.unit_id) AS BIGINT) AS placebos, round((1 + count(CASE WHEN (a.direction = 'tighten' AND b.tau <= a.tau) OR (a.direction = 'loosen' AND b.tau >= a.tau) THEN 1 END)) / CAST(1 + count(b.unit_id) AS DOUBLE), 9) AS p_directional, round((1 + count(CASE WHEN abs(b.tau) >= abs(a.tau) THEN 1 END)) / CAST(1 + count(b.unit_id) AS DOUBLE), 9) AS p_two_sided, round(1 / CAST(1 + count(b.unit_id) AS DOUBLE), 9) AS p_floor FROM ef a LEFT JOIN ef b ON a.event_id = b.event_id AND a.unit_id <> b.unit_id GROUP BY a.event_id, a.unit_id, a.direction")
def directional_placebo_p(spark, folder):
    *_, rows = _effects(spark, folder)
    expected = F.when(F.col("direction") == "tighten", "negative").when(F.col("direction") == "loosen", "positive").otherwise("ambiguous")
    out = E.directional_p(rows.withColumn("expected", expected))
    return out.withColumns({c: F.round(c, 9) for c in ("p_directional", "p_two_sided", "p_floor")})


_NORMAL = "1 - exp(-x * x) * list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(greatest(x, 1e-300)) - lgamma(n + 1.5))))"
_TTAIL = """CASE WHEN nu % 2 = 0 THEN 1 - sin(a) * list_sum(list_transform(range(0, nu // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1)) * pow(cos(a), 2 * i)))
 ELSE 1 - 2 / pi() * (a + CASE WHEN nu > 1 THEN sin(a) * cos(a) * list_sum(list_transform(range(0, (nu - 1) // 2), lambda i: exp(lgamma(i + 1) + lgamma(1.5) - lgamma(i + 1.5)) * pow(cos(a), 2 * i))) ELSE 0 END) END"""


@query(
    "caar_three_tests",
    _EFF + f""", po AS (SELECT event_id, rel, avg(ar) AS p FROM (SELECT ar.* FROM ar JOIN ef ON ef.event_id = ar.event_id AND ef.unit_id = ar.unit_id) GROUP BY 1, 2), sp AS (SELECT event_id, stddev_samp(p) AS sd FROM po WHERE rel < -{GAP} GROUP BY 1),
g AS (SELECT ef.event_id, count(*) AS n, avg(tau) AS m, stddev_samp(tau) AS st, avg(tau / se) AS mz, stddev_samp(tau / se) AS sz, any_value(sd) AS sd FROM ef JOIN sp ON sp.event_id = ef.event_id GROUP BY 1 HAVING count(*) >= 2),
u AS (SELECT event_id, n, m, 'naive' AS test, m / (st / sqrt(n)) AS stat FROM g UNION ALL SELECT event_id, n, m, 'portfolio', m / (sd * sqrt({HORIZON + 1})) FROM g UNION ALL SELECT event_id, n, m, 'standardised', mz * sqrt(n) / sz FROM g),
w AS (SELECT *, abs(stat) / sqrt(2) AS x, CAST(n - 1 AS BIGINT) AS nu, atan(abs(stat) / sqrt(n - 1)) AS a FROM u)
SELECT event_id, test, CAST(n AS BIGINT) AS n, {s('m')} AS caar, {s('stat')} AS statistic, round(greatest(CASE WHEN test = 'standardised' THEN {_TTAIL} ELSE {_NORMAL} END, 0), 9) AS p_value FROM w""",
)
def caar_three_tests(spark, folder):
    ar, effects, _ = _effects(spark, folder)
    out = E.caar_three_tests(ar, effects, GAP, HORIZON)
    return sig(out, "caar", "statistic").withColumn("p_value", F.round("p_value", 9))


_Q = "1.959963984540054"  # the quantile of 0.975 of the normal distribution


@query("power_verdicts", _EFF + f", q AS (SELECT event_id, count(*) - 1 AS j, quantile_cont(abs(tau), 0.95) - quantile_cont(tau, 0.2) AS mde FROM ef GROUP BY 1) SELECT ef.event_id, ef.unit_id, {s(f'se * {_Q}')} AS analytic_mde, 1.0 / (1 + j) <= 0.05 AS feasible, {s('abs(tau) / abs(nullif(mde, 0))')} AS observed_over_mde FROM ef JOIN q ON q.event_id = ef.event_id")
def power_verdicts(spark, folder):
    _, effects, _ = _effects(spark, folder)
    return sig(E.power_verdicts(effects, E.power(effects)), "analytic_mde", "observed_over_mde")


@query("abnormal_from_gap", cte("ar") + f" SELECT event_id, unit_id, CAST(count(*) AS BIGINT) AS steps, {s('sum(ar)')} AS total FROM ar WHERE rel BETWEEN -5 AND {HORIZON} AND ar IS NOT NULL GROUP BY 1, 2 HAVING count(*) = {HORIZON + 6}")
def abnormal_from_gap(spark, folder):
    from pyspark.sql.window import Window

    order = Window.partitionBy("event_id", "unit_id").orderBy("rel")
    path = _ar(spark, folder).where(F.col("rel").between(-5, HORIZON)).withColumn("gap", F.sum("ar").over(order))
    rows = E.first_difference(path, "gap").where("ar is not null")
    out = rows.groupBy("event_id", "unit_id").agg(F.count("*").alias("steps"), F.sum("diff").alias("total")).where(F.col("steps") == HORIZON + 6)
    return sig(out, "total")
