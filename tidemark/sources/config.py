"""Nested configuration files, read strictly, as tables.

A file is checked against a declared shape; whatever does not fit is refused
with its path (``donors.banks[2].unit_id``).  Files are small and curated; their
listings, overrides and windows become DataFrames that joins work on.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_MISSING = object()


class ConfigRefused(ValueError):
    """A configuration file does not have its declared shape, or contradicts itself."""


@dataclass(frozen=True)
class Scalar:
    """One value of a kind; ``default`` makes it optional."""

    kind: type
    default: Any = _MISSING
    among: tuple[Any, ...] = ()

    def read(self, value: Any, at: str) -> Any:
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if self.kind is dt.date and isinstance(value, str):
            try:
                value = dt.date.fromisoformat(value)
            except ValueError:
                raise ConfigRefused(f"{at}: {value!r} is not a date") from None
        if self.kind is str and isinstance(value, (int, float, dt.date)) and not isinstance(value, bool):
            value = str(value)  # an unquoted number or day
        if not isinstance(value, self.kind) or (self.kind is not bool and isinstance(value, bool)):
            raise ConfigRefused(f"{at}: {value!r} is not of kind {self.kind.__name__}")
        if self.kind is str:
            value = " ".join(value.split())
        if self.among and value not in self.among:
            raise ConfigRefused(f"{at}: {value!r} is none of {', '.join(map(str, self.among))}")
        return value


@dataclass(frozen=True)
class Block:
    """A mapping of declared fields; others are refused. ``alone`` names the field that a bare value stands for."""

    fields: Mapping[str, Any]
    default: Any = _MISSING
    alone: str = ""

    def read(self, value: Any, at: str) -> dict[str, Any]:
        if self.alone and not isinstance(value, Mapping):
            value = {self.alone: value}
        if not isinstance(value, Mapping):
            raise ConfigRefused(f"{at or 'file'}: a mapping is expected")
        strange = sorted(str(k) for k in value if k not in self.fields)
        if strange:
            raise ConfigRefused(f"{_under(at, strange[0])}: unknown field")
        out = {}
        for name, shape in self.fields.items():
            given = value.get(name)
            if given is None:
                if shape.default is _MISSING:
                    raise ConfigRefused(f"{_under(at, name)}: missing")
                out[name] = shape.default
            else:
                out[name] = shape.read(given, _under(at, name))
        return out


@dataclass(frozen=True)
class Many:
    """A list; with ``or_one`` a bare item is a list of one."""

    item: Any
    default: Any = _MISSING
    or_one: bool = False
    length: int = 0

    def read(self, value: Any, at: str) -> list[Any]:
        if not isinstance(value, list):
            if not self.or_one:
                raise ConfigRefused(f"{at}: a list is expected")
            value = [value]
        if self.length and len(value) != self.length:
            raise ConfigRefused(f"{at}: {self.length} items are expected")
        return [self.item.read(v, f"{at}[{k}]") for k, v in enumerate(value)]


@dataclass(frozen=True)
class Keyed:
    """A mapping from free keys, in the file's order."""

    item: Any
    default: Any = _MISSING

    def read(self, value: Any, at: str) -> dict[str, Any]:
        if not isinstance(value, Mapping):
            raise ConfigRefused(f"{at}: a mapping is expected")
        return {str(k): self.item.read(v, _under(at, str(k))) for k, v in value.items()}


def _under(at: str, name: str) -> str:
    return f"{at}.{name}" if at else name


def load(path: str, shape: Block) -> dict[str, Any]:
    """The file's content in its declared shape, or a refusal that names the file and the place."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        content = yaml.safe_load(f)
    try:
        return shape.read({} if content is None else content, "")
    except ConfigRefused as problem:
        raise ConfigRefused(f"{path}: {problem}") from None


def newest(folder: str, pattern: str) -> str:
    """The last file of a pattern by name, which carries its date."""
    found = sorted(glob.glob(os.path.join(folder, pattern)))
    if not found:
        raise FileNotFoundError(f"nothing in {folder} is named {pattern}")
    return found[-1]


TEXT, NOTE, DAY = Scalar(str), Scalar(str, ""), Scalar(dt.date, None)
STATUSES = ("treated", "donor", "excluded", "market_index")
LISTING = Block({"unit_id": Scalar(str, None), "ticker": Scalar(str, None), "name": Scalar(str, None), "source_ticker": Scalar(str, None), "exchange": Scalar(str, None), "available_from": DAY, "available_to": DAY, "verify": Scalar(bool, False), "note": NOTE}, alone="unit_id")
UNIVERSE = Block({
    "meta": Block({
        "base_currency": TEXT, "return_type": TEXT, "min_pre_window_days": Scalar(int), "require_full_pre_window": Scalar(bool), "min_avg_daily_volume_gbp": Scalar(float), "max_donors": Scalar(int),
        "alignment": TEXT, "outcome": TEXT, "fx_screen_rates_to_gbp": Keyed(Scalar(float), {}), "exchange_calendars": Keyed(Block({"tz": TEXT, "close": TEXT, "currency": TEXT})),
    }),
    "treated": Keyed(Block({"expected_sign": TEXT, "sign_rationale": NOTE, "members": Many(LISTING, []), "exclusion_windows": Many(Block({"unit_id": Many(TEXT, or_one=True), "start": Scalar(dt.date), "end": Scalar(dt.date), "reason": NOTE}), [])}), {}),
    "donors": Keyed(Many(LISTING), {}), "excluded": Keyed(Many(LISTING), {}), "market_index": LISTING,
    "event_overrides": Many(Block({"id": Scalar(str, None), "match": Block({"event_tags": Many(TEXT, []), "event_ids": Many(TEXT, [])}), "set": Keyed(Scalar(str, among=STATUSES)), "reason": NOTE}), []),
    "unresolved": Many(Block({"name": TEXT, "proposed_ticker": NOTE, "checked": NOTE, "finding": NOTE}), []),
    "screening_universe": Block({"path": TEXT, "min_history_days": Scalar(int), "min_avg_daily_volume_gbp": Scalar(float), "note": NOTE}, None), "notes": Keyed(TEXT, {}),
})
EXPOSURE = Block({
    "meta": Block({"epc_bands": Many(TEXT), "winsorise_quantiles": Many(Scalar(float), length=2), "default_magnitude": Scalar(float), "rank_buckets": Scalar(int)}),
    "channels": Keyed(Block({"channel_sign": Scalar(float, 0.0), "sign_ambiguous": Scalar(bool, False), "sign_rationale": NOTE, "description": NOTE})), "notes": Keyed(TEXT, {}),
})
_MANY = Many(TEXT, [], or_one=True)
INVENTORY = Block({
    "meta": Keyed(NOTE, {}),
    "events": Many(Block({
        "id": TEXT, "date": NOTE, "title": NOTE, "family": _MANY, "stage": NOTE, "direction": NOTE, "channel_targets": _MANY, "date_grade": Scalar(str, "C", ("A", "B", "C")), "time_known": NOTE, "formal_date": NOTE, "leak_risk": NOTE,
        "scheduled": Scalar(bool, False), "missing_from_sweep": Scalar(bool, False), "supersedes": _MANY, "resolves": _MANY, "pairs_with": _MANY, "needs": NOTE, "note": NOTE, "alt_dates": _MANY, "direction_by_channel": Keyed(TEXT, {}),
    }), []),
})


@dataclass(frozen=True)
class Universe:
    """A universe as tables: listings in the file's order, groups, overrides, windows, names without a symbol."""

    meta: dict[str, Any]
    listings: DataFrame
    groups: DataFrame
    overrides: DataFrame
    exclusions: DataFrame
    unresolved: DataFrame
    notes: dict[str, str] = field(default_factory=dict)

    def of(self, status: str) -> DataFrame:
        return self.listings.where(self.listings["status"] == status).orderBy("place")

    def listing(self, unit_id: str) -> dict[str, Any]:
        found = self.listings.where(self.listings["unit_id"] == unit_id).collect()
        if not found:
            raise KeyError(unit_id)
        return found[0].asDict()


def _refuse(condition: bool, message: str) -> None:
    if condition:
        raise ConfigRefused(message)


def universe(spark: SparkSession, path: str) -> Universe:
    """Read a universe and refuse one that contradicts itself.

    Refused: a listing without an id, an id held twice, a ticker whose suffix has
    no exchange, more donors than allowed, other exchanges than London's where
    clocks are not aligned, a currency without a screening rate, a window that
    ends before it starts, an override that sets nothing or whose id is held twice.
    """
    raw = load(path, UNIVERSE)
    meta, calendars = raw["meta"], raw["meta"]["exchange_calendars"]
    sources = [(g, "treated", e) for g, b in raw["treated"].items() for e in b["members"]] + [(g, "donor", e) for g, b in raw["donors"].items() for e in b] + [(g, "excluded", e) for g, b in raw["excluded"].items() for e in b] + [("market_index", "market_index", raw["market_index"])]
    rows = []
    for place, (group, status, entry) in enumerate(sources):
        unit = entry["unit_id"] or entry["ticker"]
        _refuse(unit is None, f"{path}: {entry['name'] or 'a listing'} of {group} has no unit_id")
        ticker = entry["source_ticker"] or unit
        suffix = entry["exchange"] if entry["exchange"] is not None else f".{ticker.rpartition('.')[2]}" if "." in ticker else ""
        _refuse(suffix not in calendars, f"{path}: {unit}: no exchange has the suffix {suffix!r}")
        rows.append((place, unit, entry["name"] or unit, group, status, ticker, suffix, calendars[suffix]["tz"], calendars[suffix]["currency"], entry["available_from"], entry["available_to"], entry["verify"], entry["note"]))
    ids = [r[1] for r in rows]
    twice = sorted({u for u in ids if ids.count(u) > 1})
    _refuse(bool(twice), f"{path}: unit ids held twice: {', '.join(twice)}")
    donors = sum(r[4] == "donor" for r in rows)
    _refuse(donors > meta["max_donors"], f"{path}: {donors} donors are more than meta.max_donors {meta['max_donors']}")
    abroad = [r[1] for r in rows if r[6] != ".L"]
    _refuse(meta["alignment"] == "none" and bool(abroad), f"{path}: clocks are not aligned, and these are not London's: {', '.join(abroad)}")
    unrated = sorted({r[8] for r in rows} - set(meta["fx_screen_rates_to_gbp"]))
    _refuse(bool(unrated), f"{path}: no screening rate for {', '.join(unrated)}")
    windows = [(unit, w["start"], w["end"], w["reason"]) for b in raw["treated"].values() for w in b["exclusion_windows"] for unit in w["unit_id"]]
    for unit, start, end, _ in windows:
        _refuse(start > end, f"{path}: the window of {unit} ends before it starts")
    overrides, names = [], []
    for k, entry in enumerate(raw["event_overrides"]):
        name = entry["id"] if entry["id"] is not None else f"override_{k}"
        names.append(name)
        _refuse(not entry["set"], f"{path}: override {name} sets nothing")
        overrides += [(name, unit, status, [t.lower() for t in entry["match"]["event_tags"]], entry["match"]["event_ids"], entry["reason"]) for unit, status in entry["set"].items()]
    _refuse(len(set(names)) < len(names), f"{path}: override ids held twice")
    frame: Callable[[list, str], DataFrame] = spark.createDataFrame
    return Universe(
        meta,
        frame(rows, "place int, unit_id string, name string, grp string, status string, source_ticker string, suffix string, zone string, currency string, first date, last date, verify boolean, note string"),
        frame([(k, g, b["expected_sign"], b["sign_rationale"]) for k, (g, b) in enumerate(raw["treated"].items())], "place int, grp string, expected_sign string, sign_rationale string"),
        frame(overrides, "override_id string, unit_id string, status string, tags array<string>, ids array<string>, reason string"),
        frame(windows, "unit_id string, start date, end date, why string"),
        frame([(e["name"], e["proposed_ticker"], e["checked"], e["finding"]) for e in raw["unresolved"]], "name string, proposed_ticker string, checked string, finding string"),
        raw["notes"],
    )


def exposure(spark: SparkSession, path: str) -> tuple[dict[str, Any], DataFrame]:
    """The scoring's figures, and its channels (place, channel, channel_sign, sign_ambiguous, sign_rationale, description)."""
    raw = load(path, EXPOSURE)
    low, high = raw["meta"]["winsorise_quantiles"]
    _refuse(not 0 <= low <= high <= 1, f"{path}: meta.winsorise_quantiles: {low}, {high} are no quantiles in order")
    meta = raw["meta"] | {"epc_bands": [b.upper() for b in raw["meta"]["epc_bands"]]}
    rows = [(k, c, b["channel_sign"], b["sign_ambiguous"], b["sign_rationale"], b["description"]) for k, (c, b) in enumerate(raw["channels"].items())]
    return meta, spark.createDataFrame(rows, "place int, channel string, channel_sign double, sign_ambiguous boolean, sign_rationale string, description string")


def inventory(spark: SparkSession, folder: str, pattern: str = "inventory_*.yaml") -> DataFrame:
    """The instruments of the newest inventory of a folder, in its order (place from 1)."""
    path = newest(folder, pattern)
    raw = load(path, INVENTORY)
    names = [e["id"] for e in raw["events"]]
    _refuse(len(set(names)) < len(names), f"{path}: instrument ids held twice")
    kinds = {"family": "array<string>", "channel_targets": "array<string>", "supersedes": "array<string>", "resolves": "array<string>", "pairs_with": "array<string>", "alt_dates": "array<string>", "scheduled": "boolean", "missing_from_sweep": "boolean", "direction_by_channel": "map<string,string>"}
    fields = list(INVENTORY.fields["events"].item.fields)
    return spark.createDataFrame([(k, *(e[f] for f in fields)) for k, e in enumerate(raw["events"], 1)], "place int, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in fields))
