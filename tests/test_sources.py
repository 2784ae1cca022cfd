"""Vintages, landed payloads, row numbers and ordered rules on awkward input."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import checks, promotion
from tidemark.sources import landed, readers, sinks


def prices(spark, rows):
    return spark.createDataFrame(rows, "source_ticker string, px double, vintage string")


def test_a_vintage_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "prices")
    sinks.write_vintage(prices(spark, [("A", 1.0, "2024-01-01"), ("B", 2.0, "2024-01-01"), ("A", 9.0, "2023-01-01")]), path)
    sinks.write_vintage(prices(spark, [("A", 3.0, "2024-01-01")]), path)
    wanted = spark.createDataFrame([("A",), ("B",), ("A",)], "source_ticker string")
    rows, absent = readers.vintage(spark, path, "2024-01-01", wanted)
    assert [(r["source_ticker"], r["px"]) for r in rows.collect()] == [("A", 3.0)] and [r[0] for r in absent.collect()] == ["B"]
    assert [r["px"] for r in readers.vintage(spark, path, "2023-01-01", wanted)[0].collect()] == [9.0]
    with pytest.raises(readers.VintageCutOff):
        readers.vintage(spark, path, "1999-01-01", wanted)
    prices(spark, [("C", 4.0, "2023-01-01")]).write.mode("append").partitionBy("vintage").parquet(path)  # not by the writer
    with pytest.raises(readers.VintageCutOff):
        readers.vintage(spark, path, "2023-01-01", wanted)
    with pytest.raises(ValueError, match="without a vintage"):
        sinks.write_vintage(prices(spark, [("A", 1.0, None)]), path)


def test_payloads_land_and_are_read_with_what_became_of_them(spark, tmp_path):
    folder = str(tmp_path / "landed")
    fetched = [("a/b^c", "<p>x &amp; y</p>", None), ("é", "", None), ("bad", None, "timed out"), ("", "empty key", None), (None, "nobody", None), ("later", None, "first try")]
    frame = lambda rows: spark.createDataFrame(rows, "key string, body string, error string")
    landed.land(frame(fetched), folder, shards=3)
    landed.land(frame([("later", "second try", None)]), folder, shards=3)
    shard = os.path.join(folder, sorted(os.listdir(folder))[0])
    with open(os.path.join(shard, "raw.body"), "wb") as f:
        f.write(b"\xff\xfe")
    wanted = spark.createDataFrame([("a/b^c",), ("é",), ("bad",), ("",), ("later",), ("raw",), ("never",), ("never",), (None,)], "key string")
    got = landed.landed(spark, folder, wanted)
    rows = {r["key"]: (r["status"], r["body"], r["error"]) for r in got.collect()}
    assert rows == {"a/b^c": ("ok", "<p>x &amp; y</p>", None), "é": ("empty", None, None), "bad": ("failed", None, "timed out"), "": ("ok", "empty key", None), "later": ("ok", "second try", None), "raw": ("failed", None, "not UTF-8: invalid start byte"), "never": ("absent", None, None)}
    verdict = landed.verdict(got).first()
    assert (verdict["verdict"], verdict["wanted"], verdict["failed"], verdict["absent"]) == ("unreachable", 7, 2, 1)
    assert landed.verdict(got.where("status in ('ok', 'empty')")).first()["verdict"] == "incomplete" and landed.verdict(got.where("status = 'ok'")).first()["verdict"] == "complete" and landed.verdict(got.where("status = 'empty'")).first()["verdict"] == "unreachable"
    pages = landed.document_pages(spark.createDataFrame([("t", "one\ftwo\f"), ("h", "<p>x &amp; y</p>"), ("p", "a < b"), ("n", None)], "key string, body string"), scalars.strip_html)
    assert {(r["key"], r["page"], r["page_text"]) for r in pages.collect()} == {("t", 1, "one"), ("t", 2, "two"), ("t", 3, ""), ("h", 1, "x & y"), ("p", 1, "a < b")}
    assert landed.landed(spark, str(tmp_path), wanted.limit(1)).first()["status"] == "absent"
    links = spark.createDataFrame([("<a href=1><a href=1><a href=2><a href=3>",), ("",), (None,)], "body string").select(landed.first_links(F.col("body"), "href=([0-9])", 2)).collect()
    assert [r[0] for r in links] == [["1", "2"], [], None]


def test_issues_carry_their_row(spark):
    rows = [("u1", "a", "1", "2020-01-01", "2020-02-01", "s", 0), (" ", "a", "x", "2020-01-01", "2019-01-01", "s", 1), ("zz", "a", None, "1/1/20", "2020-01-01", "", 7)]
    frame = spark.createDataFrame(rows, "unit_id string, attribute string, value string, as_of_date string, knowable_from string, source_url string, position long")
    got = {(r["row"], r["column"], r["message"]) for r in checks.attribute_issues(frame, spark.createDataFrame([("u1 ",)], "unit_id string"), "position").collect()}
    assert got == {(3, "unit_id", "blank"), (3, "unit_id", "unknown unit"), (3, "value", "not a number"), (3, "knowable_from", "before the as-of date"), (9, "unit_id", "unknown unit"), (9, "value", "blank"), (9, "as_of_date", "not a date"), (9, "source_url", "blank")}
    targets = spark.createDataFrame([("e1", "New_Build ", "loosen", "C", ""), ("e2", None, "up", None, " ")], "event_id string, scope string, direction string, mandated_min_band string, affected_categories string")
    assert {tuple(r) for r in checks.target_issues(targets, spark.createDataFrame([("e1",)], "event_id string")).collect()} == {("e2", "event_id", "unknown event", True), ("e2", "scope", "unknown value", True), ("e2", "direction", "unknown value", True), ("e2", "mandated_min_band", "scores nothing", False)}


def test_promotion_keeps_its_order_of_rules(spark):
    base = {"date": "2020-06-10", "title": "A, b", "family": ["eco"], "direction": "tighten", "channel_targets": ["delivered_stock"], "date_grade": "A", "leak_risk": "", "scheduled": False}
    changes = [{}, {"date_grade": "C", "scheduled": True}, {"scheduled": True, "date": "2020-??-01"}, {"date": "2020-06-??"}, {"channel_targets": ["none"]}, {"date": "2020-06-20", "family": None, "direction": "mixed", "leak_risk": "confirmed", "channel_targets": ["product_revenue", "none", "residential_stock"]}, {"date": "2020-06-20", "leak_risk": None, "direction": "loosen", "family": ["fiscal"]}, {"channel_targets": None}, {"date": None}, {"date": "2020-12-24"}]
    names = "place int, id string, date string, title string, family array<string>, direction string, channel_targets array<string>, date_grade string, leak_risk string, scheduled boolean"
    items = [base | c for c in changes]
    inventory = spark.createDataFrame([(k, f"i{k}", *(i[n] for n in base)) for k, i in enumerate(items)], names)
    sources = spark.createDataFrame([(k, "https://x/y") for k in range(len(items)) if k != 9], "place int, url string")
    dropped = spark.createDataFrame([("i7",)], "id string")
    moved = spark.createDataFrame([("i5", dt.date(2020, 6, 18))], "id string, day date")
    stamped = spark.createDataFrame([("i6", dt.datetime(2020, 6, 20, 23, 30))], "id string, ts timestamp_ntz")
    got = {r["event_id"]: r for r in promotion.promote(inventory, sources, dropped, moved, stamped).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"i0": None, "i1": "date of grade C", "i2": "scheduled", "i3": "no exact day", "i4": "no sector", "i5": None, "i6": None, "i7": "leaked", "i8": "no exact day", "i9": "no source"}
    first, second, third = got["i0"], got["i5"], got["i6"]
    assert first["policy"] == "A; b" and first["overlap_ack"] == "" and first["expected_direction"] == "positive" and first["time_known"] is False
    assert second["ts"] == dt.datetime(2020, 6, 18) and second["leak_note"] == "moved to 2020-06-18" and second["anticipation_risk"] == "high" and (second["expected_direction"], second["direction"]) == ("ambiguous", "loosen") and second["affected_sectors"] == "insulation_and_materials;residential_landlords" and (second["groups_with"], second["gap_days"]) == ("i0", 8) and second["confounders"] == ""
    # half past eleven in the evening is the next day in London's summer
    assert third["date"] == dt.date(2020, 6, 21) and third["time_known"] and third["confounders"] == "fiscal_statement" and third["anticipation_risk"] == "medium" and (third["groups_with"], third["gap_days"]) == ("i5", 2)
    assert got["i1"]["ts"] is None and got["i1"]["overlap_ack"] is None
    empty = promotion.promote(inventory.limit(0), sources, dropped, moved, stamped)
    assert empty.count() == 0


def test_shortlist_names_the_first_rule(spark):
    rows = [("f", None, "2020-01", ["product_revenue"]), ("f", "green_paper", "2000-01", ["product_revenue"]), ("f", "strategy", "2012-12", None), ("fiscal_events", "strategy", "2020-01", None), ("f", "strategy", "2013-01", None), ("f", "strategy", "2013-01", ["domestic_supply"]), ("f", "strategy", "2013-01", ["domestic_supply", "delivered_stock"])]
    got = [r["reason"] for r in promotion.shortlist(spark.createDataFrame(rows, "family string, stage string, month string, channels array<string>"), "2013-01").collect()]
    assert got == ["no stage", "seldom news", "before the sample", "reported apart", "no signed channel", "no signed channel", None]
