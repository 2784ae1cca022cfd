"""Validation as data: checks give rows of issues, and guards refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S


class ValidationRefused(ValueError):
    """A table has fatal issues."""


def issue(condition: Column, column: str, message: str, fatal: bool) -> Column:
    """An issue where the condition holds, else null; a null condition is no issue."""
    return F.when(condition, F.struct(F.lit(column).alias("column"), F.lit(message).alias("message"), F.lit(fatal).alias("fatal")))


def explode_issues(rows: DataFrame, key: str, issues: list[Column]) -> DataFrame:
    """(key, column, message, fatal) of all issues, found in one pass over the rows."""
    return rows.select(key, F.explode(F.array_compact(F.array(*issues))).alias("i")).select(key, "i.column", "i.message", "i.fatal")


def event_issues(rows: DataFrame, now: str, min_days: int = 14, *by: str) -> DataFrame:
    """(event_id, column, message, fatal) of an event dictionary whose cells are all strings.

    Columns ``by`` name the dictionary of an event, whose events are spaced by themselves; without any all are one.

    Columns: event_id, date, announcement_timestamp_utc, policy, source_url,
    anticipation_risk, expected_direction, affected_sectors, direction,
    time_known, confounders, leak_note, notes.
    """
    stamp = F.col("announcement_timestamp_utc")
    # cells that many checks read are parsed once, in columns of their own
    rows = rows.withColumns({"_ts": F.try_to_timestamp(F.trim(stamp)), "_day": F.try_to_date(F.trim("date"), "yyyy-MM-dd"), "_known": S.parse_bool(F.col("time_known")), "_url": S.url_issue(F.col("source_url"))})
    ts, day, known, url = map(F.col, ("_ts", "_day", "_known", "_url"))
    rows = rows.withColumns({"_offset": S.is_blank(stamp) | F.trim(stamp).rlike(r"(Z|[+-]\d\d:?\d\d)$"), "_midnight": F.date_format(ts, "HH:mm:ss") == "00:00:00"})
    offset, midnight = F.col("_offset"), F.col("_midnight")
    london = F.to_date(F.from_utc_timestamp(ts, "Europe/London"))

    def enum(name: str, allowed: tuple[str, ...]) -> list[Column]:
        value = F.lower(F.trim(name))
        return [issue(S.is_blank(F.col(name)), name, "blank", True), issue(~S.is_blank(F.col(name)) & ~value.isin(*allowed), name, "unknown value", True)]

    issues = [
        issue(url.isin("blank", "not http(s)"), "source_url", "missing or not http(s)", True),
        issue(url == "bare domain", "source_url", "bare domain", False),
        issue(S.is_blank(stamp), "announcement_timestamp_utc", "blank", True),
        issue(~S.is_blank(stamp) & ts.isNull(), "announcement_timestamp_utc", "not a timestamp", True),
        issue(ts.isNotNull() & ~offset, "announcement_timestamp_utc", "no offset", True),
        issue(offset & midnight & known.isNull(), "time_known", "midnight without time_known", False),
        issue(offset & midnight & F.coalesce(known, F.lit(False)), "time_known", "known time at midnight", False),
        issue(day.isNull() | (ts.isNotNull() & offset & (day != london)), "date", "not the London date", True),
        issue(offset & (ts > F.lit(now).cast("timestamp")), "announcement_timestamp_utc", "in the future", False),
        issue(S.is_blank(F.col("policy")), "policy", "blank", True),
        *enum("anticipation_risk", ("low", "medium", "high")), *enum("expected_direction", ("positive", "negative", "ambiguous")), *enum("direction", ("tighten", "loosen")),
        issue(F.size(S.parse_list(F.col("affected_sectors"))) == 0, "affected_sectors", "blank", True),
        issue(F.lower(F.trim("anticipation_risk")) == "high", "anticipation_risk", "high", False),
        issue((F.lower(F.trim("anticipation_risk")) == "high") & S.is_blank(F.col("leak_note")) & S.is_blank(F.col("notes")), "leak_note", "high risk without a note", False),
    ]
    by_row = explode_issues(rows, "event_id", issues)
    # adjacency over one curated dictionary: one row an event
    order = Window.partitionBy(*by).orderBy("ts", "event_id")
    timed = rows.withColumn("ts", ts).where(F.col("ts").isNotNull() & offset).withColumn("ack", ~S.is_blank(F.col("confounders")))
    gap = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(order))) / 86400)
    close = timed.select("event_id", gap.alias("gap"), (F.col("ack") | F.lag("ack").over(order)).alias("ack")).where((F.col("gap") < min_days) & ~F.col("ack"))
    spaced = close.select("event_id", F.lit("announcement_timestamp_utc").alias("column"), F.lit("too close to the event before").alias("message"), F.lit(True).alias("fatal"))
    twice = rows.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id", F.lit("event_id").alias("column"), F.lit("duplicate").alias("message"), F.lit(True).alias("fatal"))
    return by_row.unionByName(spaced).unionByName(twice)


def _row_issues(rows: DataFrame, key: str, issues: list[Column], position: str | None) -> DataFrame:
    """``explode_issues``, with each issue's spreadsheet row (the header is row 1) where ``position`` counts rows from 0."""
    if position is None:
        return explode_issues(rows, key, issues)
    numbered = rows.select(key, (F.col(position) + 2).alias("row"), F.explode(F.array_compact(F.array(*issues))).alias("i"))
    return numbered.select(key, "row", "i.column", "i.message", "i.fatal")


def _listed(rows: DataFrame, column: str, known: DataFrame | None, name: str) -> tuple[DataFrame, Column]:
    """``rows`` with whether a cell is in a list of its own, and that as a condition; without a list everything is."""
    if known is None:
        return rows.withColumn("_listed", F.lit(True)), F.lit(True)
    own = known.select(F.trim(name).alias("_key")).distinct().withColumn("_known", F.lit(True))
    return rows.withColumn("_key", F.trim(column)).join(own, "_key", "left").withColumn("_listed", F.coalesce("_known", F.lit(False))).drop("_key", "_known"), F.col("_listed")


def attribute_issues(rows: DataFrame, known: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """(unit_id[, row], column, message, fatal) of a firm attribute table whose cells are all strings; ``known`` lists units (unit_id)."""
    value, as_of, known_from = F.expr("try_cast(trim(value) as double)"), F.try_to_date(F.trim("as_of_date"), "yyyy-MM-dd"), F.try_to_date(F.trim("knowable_from"), "yyyy-MM-dd")
    rows, listed = _listed(rows, "unit_id", known, "unit_id")
    sources = [c for c in ("unit_id", "attribute", "value", "as_of_date", "knowable_from", "source_url", "vintage") if c in rows.columns]
    issues = [
        *[issue(S.is_blank(F.col(c)), c, "blank", True) for c in sources],
        issue(~S.is_blank(F.col("value")) & value.isNull(), "value", "not a number", True),
        issue(~S.is_blank(F.col("as_of_date")) & as_of.isNull(), "as_of_date", "not a date", True),
        issue(~S.is_blank(F.col("knowable_from")) & known_from.isNull(), "knowable_from", "not a date", True),
        issue(known_from < as_of, "knowable_from", "before the as-of date", True),
        issue(F.datediff(known_from, as_of) > 400, "knowable_from", "long disclosure lag", False),
        issue(~listed, "unit_id", "unknown unit", True),
    ]
    return _row_issues(rows, "unit_id", issues, position)


#: What a policy target may cover, and its directions.
SCOPES, DIRECTIONS = ("all_domestic", "domestic_prs", "social_rented", "off_gas_grid", "new_build"), ("tighten", "loosen")


def target_issues(rows: DataFrame, known: DataFrame | None = None, position: str | None = None, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """(event_id[, row], column, message, fatal) of a policy target table whose cells are all strings; ``known`` lists events (event_id).

    A target with neither a mandated band nor a category scores nothing, which is
    said and not fatal.
    """
    rows, listed = _listed(rows, "event_id", known, "event_id")
    issues = [
        issue(~listed, "event_id", "unknown event", True),
        *[issue(~F.coalesce(F.lower(F.trim(c)).isin(*allowed), F.lit(False)), c, "unknown value", True) for c, allowed in (("scope", scopes), ("direction", DIRECTIONS))],
        issue(S.is_blank(F.col("mandated_min_band")) & S.is_blank(F.col("affected_categories")), "mandated_min_band", "scores nothing", False),
    ]
    return _row_issues(rows, "event_id", issues, position)


def refuse_if_fatal(issues: DataFrame) -> None:
    worst = issues.where("fatal").limit(5).collect()
    if worst:
        raise ValidationRefused("; ".join(f"{r['column']}: {r['message']}" for r in worst))


def check_partition(wanted: DataFrame, *parts: DataFrame, key: str = "unit_id") -> DataFrame:
    """(key, problem): keys that no part or more than one part has."""
    all_parts = parts[0].select(key)
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p.select(key))
    counts = all_parts.groupBy(key).agg(F.count("*").alias("n"))
    out = wanted.select(key).join(counts, key, "left").withColumn("problem", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated"))
    return out.where("problem is not null").select(key, "problem")
