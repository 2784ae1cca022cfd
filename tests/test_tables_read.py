"""Queries that once made their rows up: each reads its table, and the rules they ran on literal rows hold in the operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks, discovery, exposure, regression, timing, universe
from tidemark.plans import catalogue
from tidemark.sources import fixtures

SF = "/root/testdata/sf0.001"
READ = {"bootstrap_floor_curve": {"orders"}, "channel_scores": {"lineitem", "part", "supplier"}, "clock_alignment": {"events"}, "dated_references": {"documents"}, "design_limits": {"orders"}, "discovery_score": {"lineitem", "orders"}, "event_groups_transitive": {"orders"}, "event_spacing_violations": {"orders"}, "event_dictionary_issues": {"orders"}, "exchange_by_suffix": {"customer"}}


@pytest.mark.parametrize("name", sorted(READ))
def test_query_reads_its_tables(spark, name):
    files = catalogue.queries()[name](spark, SF).inputFiles()
    assert {f.rsplit("/", 1)[-1].removesuffix(".parquet") for f in files} == READ[name]


def test_floor_of_p_by_clusters(spark):
    rows = spark.range(1, 1200).select(F.col("id").alias("g"), *[regression.p_floor(F.col("id"), 2000, n).alias(f"p{n}") for n in (2, 6)])
    got = {r["g"]: (r["p2"], r["p6"]) for r in rows.where("g in (1, 5, 30, 1199)").collect()}
    assert got[1] == pytest.approx((1.0, 1 / 3)) and got[5] == pytest.approx((1 / 16, 1 / 2001)) and got[30] == got[1199] == pytest.approx((1 / 2001, 1 / 2001))


def test_curve_counts_every_customer_once(spark):
    rows = catalogue.queries()["bootstrap_floor_curve"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert rows.agg(F.sum("designs")).first()[0] == orders.select("o_custkey").distinct().count()


def test_channels_decide_in_their_order(spark):
    rows = [("u1", "tighten", 0.4, None, None), ("u2", "loosen", None, 1.3, 0.5), ("u3", "tighten", None, None, None), ("u4", "tighten", None, 0.2, -1.0), ("u5", "loosen", 0.0, 0.9, 1.0)]
    frame = spark.createDataFrame(rows, "unit_id string, direction string, residential double, shares double, domestic double")
    out = exposure.score(frame.withColumn("product", exposure.product_channel(F.col("shares"), F.col("domestic"))), ("residential", "product"), {"residential": -1, "product": 1})
    got = {r["unit_id"]: (r["channel"], r["magnitude"], r["signed"]) for r in out.collect()}
    assert got == {"u1": ("residential", 0.4, -0.4), "u2": ("product", 0.5, -0.5), "u3": ("none", 0.0, 0.0), "u4": ("product", 0.0, 0.0), "u5": ("residential", 0.0, 0.0)}


def test_clocks_of_five_exchanges(spark):
    rows = [("Europe/London", 990), ("America/New_York", 960), ("Europe/Paris", 1050), ("Asia/Tokyo", 900), ("Europe/Copenhagen", 1020), ("Europe/London", 1006), ("Europe/London", 975)]
    got = [tuple(r) for r in timing.clock_alignment(spark.createDataFrame(rows, "zone string, close_minute int")).collect()]
    assert [r[2:] for r in got] == [(0, "ALIGNED"), (270, "LATE"), (0, "ALIGNED"), (-630, "EARLY"), (-30, "EARLY"), (16, "LATE"), (-15, "ALIGNED")]


def test_months_beside_instruments_outside_apparatus(spark):
    rows = [
        ("d1", "The scheme for home insulation was closed in March 2012 after a review of its costs."),
        ("d1", "In July 2013 nothing of note was said about any of the houses in the survey area."),
        ("d2", "A consultation on the levy opened in November 2015 and ran for twelve weeks in all."),
        ("d2", "HC Deb 12 March 2014, on the obligation of suppliers to fund measures in homes."),
        ("d3", "The new standard applies from April 2018 to all privately rented homes in the country."),
    ]
    got = discovery.dated_references(spark.createDataFrame(rows, "doc string, sentence string"), "doc").select("doc", "month").collect()
    assert {tuple(r) for r in got} == {("d1", datetime.date(2012, 3, 1)), ("d2", datetime.date(2015, 11, 1)), ("d3", datetime.date(2018, 4, 1))} and len(got) == 3


def test_limits_of_every_week_of_orders(spark):
    rows = {(str(r["week"]), r["priority"]): r for r in catalogue.queries()["design_limits"](spark, SF).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").select(F.trunc(F.to_date("o_orderdate"), "week").cast("string").alias("w"), "o_orderpriority", "o_custkey").toPandas()
    for by, one in ((orders.groupby(["w", "o_orderpriority"]), None), (orders.groupby("w"), 0)):
        for key, n in by["o_custkey"].nunique().items():
            r = rows.pop(key if one is None else (key, None))
            assert (r["donors"], r["donors_for_5_percent"], r["feasible"]) == (n - 1, 19, n >= 20) and r["least_p"] == pytest.approx(1 / n, abs=1e-9)
    assert not rows


def test_finds_partition_the_reference(spark):
    reference = spark.createDataFrame([("i1", "levy", "2012-03"), ("i2", "levy", "2014-01"), ("i3", "ban", "2015-05"), ("i4", "grant", "2016-02")], "id string, family string, month string")
    found = spark.createDataFrame([("levy", "2012-03"), ("levy", "2013-01"), ("ban", "2015-05")], "family string, month string")
    got = discovery.discovery_score(reference, found).first()
    assert (got["found"], got["misdated"], got["missed"], got["total"], got["coverage"]) == (2, 1, 1, 4, 0.75) and got["date_accuracy"] == pytest.approx(2 / 3)


def test_chains_of_announcements(spark):
    got = dict(timing.group_events(fixtures.announcements(spark)).select("event_id", "group_id").collect())
    assert got == {e: "grp:a2" if e in ("a2", "a3", "a4") else e for e in (a[0] for a in fixtures.ANNOUNCEMENTS)}


def _dictionaries(spark):
    rows = [("x", "a", "2020-01-01", ""), ("y", "b", "2020-01-03", ""), ("x", "c", "2020-01-10", ""), ("x", "d", "2020-01-24", ""), ("y", "e", "2020-01-05", " budget "), ("y", "f", "2020-01-06", "")]
    return spark.createDataFrame(rows, "owner string, event_id string, day string, confounder string").withColumn("ts", F.col("day").cast("timestamp"))


def test_chains_end_with_their_dictionary(spark):
    rows = timing.group_events(_dictionaries(spark), 14, "owner").select("owner", "event_id", "group_id").collect()
    assert {tuple(r) for r in rows} == {("x", "a", "grp:a"), ("x", "c", "grp:a"), ("x", "d", "d"), ("y", "b", "grp:b"), ("y", "e", "grp:b"), ("y", "f", "grp:b")}


def test_spacing_within_a_dictionary(spark):
    assert {tuple(r) for r in timing.spacing_violations(fixtures.announcements(spark)).collect()} == {("a3", "a2", 9), ("a4", "a3", 8)}
    assert [tuple(r) for r in timing.spacing_violations(_dictionaries(spark), 14, "owner").collect()] == [("x", "c", "a", 9)]


def test_every_check_of_a_dictionary(spark):
    rows = [
        ("e1", "2020-01-10", "2020-01-10T09:00:00+00:00", "p", "https://x.org/a", "low", "positive", "s", "tighten", "", "", "", ""),
        ("e2", "2020-01-15", "2020-01-15T00:00:00Z", "", "https://x.org", "High", "up", "", "loosen", "", "", "", ""),
        ("e3", "2020-07-01", "2020-06-30T23:30:00Z", "q", "", "medium", "ambiguous", "s;t", "", "true", "", "", ""),
        ("e3", "2020-07-10", "2020-07-10T10:00:00", "q", "http://y.org/b", "low", "negative", "s", "tighten", "", "", "", ""),
        ("e4", "bad", "soon", "r", "mailto:z", "low", "negative", "s", "tighten", "", "", "", ""),
        ("e5", "2030-01-01", "2030-01-01T00:00:00Z", "r", "https://x.org/c", "low", "negative", "s", "tighten", "yes", "c", "", ""),
    ]
    names = "event_id date announcement_timestamp_utc policy source_url anticipation_risk expected_direction affected_sectors direction time_known confounders leak_note notes"
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    stamp, close = "announcement_timestamp_utc", ("e2", "announcement_timestamp_utc", "too close to the event before", True)
    want = [
        ("e2", "source_url", "bare domain", False), ("e2", "time_known", "midnight without time_known", False), ("e2", "policy", "blank", True), ("e2", "expected_direction", "unknown value", True), ("e2", "affected_sectors", "blank", True),
        ("e2", "anticipation_risk", "high", False), ("e2", "leak_note", "high risk without a note", False), close, ("e3", "source_url", "missing or not http(s)", True), ("e3", "direction", "blank", True),
        ("e3", stamp, "no offset", True), ("e3", "event_id", "duplicate", True), ("e4", "source_url", "missing or not http(s)", True), ("e4", stamp, "not a timestamp", True), ("e4", "date", "not the London date", True),
        ("e5", "time_known", "known time at midnight", False), ("e5", stamp, "in the future", False),
    ]
    assert sorted(tuple(r) for r in checks.event_issues(frame, "2024-01-01 00:00:00").collect()) == sorted(want)
    apart = checks.event_issues(frame.withColumn("owner", F.col("event_id")), "2024-01-01 00:00:00", 14, "owner")
    assert sorted(tuple(r) for r in apart.collect()) == sorted(w for w in want if w != close)


def test_orders_hold_every_defect(spark):
    found = catalogue.queries()["event_dictionary_issues"](spark, SF).select("column", "message").distinct().collect()
    assert len(found) == 21


def test_exchanges_of_five_listings(spark):
    listings = spark.createDataFrame([("u1", "AAA.L", None), ("u2", "BBB", None), ("u3", "CC.C.PA", None), ("u4", "D.XX", None), ("u5", "^IDX", ".L")], "unit_id string, source_ticker string, exchange string")
    known = spark.createDataFrame([(".L", "Europe/London"), ("", "America/New_York"), (".PA", "Europe/Paris")], "suffix string, zone string")
    got = {r["unit_id"]: (r["suffix"], r["zone"], r["problem"]) for r in universe.exchanges(listings, known).collect()}
    assert got == {"u1": (".L", "Europe/London", None), "u2": ("", "America/New_York", None), "u3": (".PA", "Europe/Paris", None), "u4": (".XX", None, "unknown suffix"), "u5": (".L", "Europe/London", None)}
