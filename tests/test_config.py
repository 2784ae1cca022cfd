"""Configuration files: a round trip, and a refusal with its place for each thing that can be wrong."""

import copy
import datetime as dt

import pytest
import yaml

from tidemark.operators import universe as resolution
from tidemark.sources import config

GOOD = {
    "meta": {"base_currency": "GBP", "return_type": "simple", "min_pre_window_days": 250, "require_full_pre_window": True, "min_avg_daily_volume_gbp": 1000000, "max_donors": 3, "alignment": "lag", "outcome": "cumulative", "fx_screen_rates_to_gbp": {"GBp": 0.01, "USD": 0.79}, "exchange_calendars": {".L": {"tz": "Europe/London", "close": "16:30", "currency": "GBp"}, "": {"tz": "America/New_York", "close": "16:00", "currency": "USD"}}},
    "treated": {"builders": {"expected_sign": "negative", "members": [{"unit_id": "OLD", "source_ticker": "NEW.L", "available_to": dt.date(2024, 10, 3), "note": "one\n  two"}, "BB.L"], "exclusion_windows": [{"unit_id": ["OLD", "BB.L"], "start": "2024-02-01", "end": dt.date(2024, 10, 31)}, {"unit_id": "BB.L", "start": "2020-01-01", "end": "2020-01-01"}]}},
    "donors": {"banks": ["HSBA.L", {"ticker": "JPM", "name": "J"}], "other": [{"unit_id": "^IDX", "exchange": ".L"}]},
    "excluded": {"grids": ["NG.L"]}, "market_index": {"unit_id": "^ALL", "exchange": ".L"},
    "event_overrides": [{"id": "a", "match": {"event_tags": ["MEES"]}, "set": {"HSBA.L": "treated", "JPM": "excluded"}, "reason": "r"}, {"match": {"event_ids": ["e9"]}, "set": {"BB.L": "donor"}}],
    "unresolved": [{"name": "Gone plc"}], "notes": {"fx": "local"},
}


def write(tmp_path, content, name="universe.yaml"):
    path = tmp_path / name
    path.write_text(yaml.safe_dump(content, sort_keys=False))
    return str(path)


def test_universe_becomes_tables_that_resolve(spark, tmp_path):
    u = config.universe(spark, write(tmp_path, GOOD))
    rows = u.listings.orderBy("place").collect()
    assert [r["unit_id"] for r in rows] == ["OLD", "BB.L", "HSBA.L", "JPM", "^IDX", "NG.L", "^ALL"] and [r["status"] for r in rows] == ["treated", "treated", "donor", "donor", "donor", "excluded", "market_index"]
    assert rows[0]["suffix"] == ".L" and rows[0]["note"] == "one two" and rows[0]["last"] == dt.date(2024, 10, 3) and rows[3]["zone"] == "America/New_York" and rows[4]["currency"] == "GBp"
    assert [r["unit_id"] for r in u.of("donor").collect()] == ["HSBA.L", "JPM", "^IDX"] and u.listing("JPM")["name"] == "J" and u.meta["min_avg_daily_volume_gbp"] == 1e6
    with pytest.raises(KeyError):
        u.listing("none")
    assert u.exclusions.count() == 3 and {(r["override_id"], r["unit_id"], tuple(r["tags"]), tuple(r["ids"])) for r in u.overrides.collect()} == {("a", "HSBA.L", ("mees",), ()), ("a", "JPM", ("mees",), ()), ("override_1", "BB.L", (), ("e9",))}
    events = spark.createDataFrame([("e1", dt.date(2024, 3, 1), [" Mees"]), ("e9", dt.date(2025, 1, 1), [])], "event_id string, day date, tags array<string>")
    got = {(r["event_id"], r["unit_id"]): r["status"] for r in resolution.resolve(events, u.listings.select("unit_id", "status", "first", "last"), u.overrides, u.exclusions).collect()}
    assert got["e1", "HSBA.L"] == "treated" and got["e9", "HSBA.L"] == "donor" and got["e9", "BB.L"] == "donor" and got["e1", "BB.L"] == got["e1", "OLD"] == got["e9", "OLD"] == "dropped" and got["e1", "^ALL"] == "market_index"


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for key in path[:-1]:
        at = at[key]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


@pytest.mark.parametrize("path, value, said", [
    (("meta", "max_donors"), None, "meta.max_donors: missing"), (("meta", "max_donors"), True, "meta.max_donors: True is not of kind int"), (("meta", "max_donors"), 2, "3 donors are more than"), (("meta", "colour"), "x", "meta.colour: unknown field"),
    (("meta", "alignment"), "none", "not London's: JPM"), (("meta", "fx_screen_rates_to_gbp"), {"GBp": 0.01}, "no screening rate for USD"), (("meta", "exchange_calendars"), {".L": GOOD["meta"]["exchange_calendars"][".L"]}, "no exchange has the suffix ''"),
    (("donors", "banks"), "HSBA.L", "donors.banks: a list is expected"), (("donors", "banks"), [{"name": "No id"}], "No id of banks has no unit_id"), (("donors", "banks", 1), {"unit_id": ["a"]}, "donors.banks[1].unit_id: ['a'] is not of kind str"), (("excluded", "grids"), ["BB.L"], "unit ids held twice: BB.L"),
    (("treated", "builders", "exclusion_windows", 0, "start"), "2025-01-01", "the window of OLD ends before"), (("treated", "builders", "exclusion_windows", 0, "start"), "soon", "treated.builders.exclusion_windows[0].start: 'soon' is not a date"),
    (("event_overrides", 0, "set"), {}, "override a sets nothing"), (("event_overrides", 0, "set"), {"JPM": "friend"}, "event_overrides[0].set.JPM: 'friend' is none of"), (("event_overrides", 1, "id"), "a", "override ids held twice"), (("market_index",), None, "market_index: missing"), (("treated",), [1], "treated: a mapping is expected"),
])
def test_each_refusal_names_its_place(spark, tmp_path, path, value, said):
    with pytest.raises(config.ConfigRefused, match=".*") as refused:
        config.universe(spark, write(tmp_path, changed(path, value)))
    assert said in str(refused.value) and "universe.yaml" in str(refused.value)


def test_exposure_and_newest_inventory(spark, tmp_path):
    good = {"meta": {"epc_bands": ["a", "B"], "winsorise_quantiles": [0, 0.9], "default_magnitude": 0, "rank_buckets": 10}, "channels": {"stock": {"channel_sign": -1}, "supply": {"sign_ambiguous": True}}}
    meta, channels = config.exposure(spark, write(tmp_path, good, "exposure.yaml"))
    assert meta["epc_bands"] == ["A", "B"] and meta["default_magnitude"] == 0.0 and [tuple(r)[1:4] for r in channels.orderBy("place").collect()] == [("stock", -1.0, False), ("supply", 0.0, True)]
    for quantiles, said in (([0.9, 0.1], "in order"), ([0.1], "2 items")):
        with pytest.raises(config.ConfigRefused, match=said):
            config.exposure(spark, write(tmp_path, good | {"meta": good["meta"] | {"winsorise_quantiles": quantiles}}, "exposure.yaml"))
    with pytest.raises(FileNotFoundError):
        config.inventory(spark, str(tmp_path))
    write(tmp_path, {"events": [{"id": "old"}]}, "inventory_2024-01.yaml")
    write(tmp_path, {"events": [{"id": "i1", "date": dt.date(2020, 1, 2), "family": "eco", "direction_by_channel": {"a": "tighten"}}, {"id": "i2", "date": "2020-01-??", "family": ["x", "y"], "date_grade": "A", "scheduled": True}]}, "inventory_2025-06.yaml")
    rows = config.inventory(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["place"], r["id"], r["date"], r["family"], r["date_grade"], r["scheduled"], r["direction_by_channel"]) for r in rows] == [(1, "i1", "2020-01-02", ["eco"], "C", False, {"a": "tighten"}), (2, "i2", "2020-01-??", ["x", "y"], "A", True, {})]
    write(tmp_path, {"events": [{"id": "i1"}, {"id": "i1"}]}, "inventory_2025-07.yaml")
    with pytest.raises(config.ConfigRefused, match="held twice"):
        config.inventory(spark, str(tmp_path))
