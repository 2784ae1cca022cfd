"""Listings and how events resolve their status: availability, overrides, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def available(day: Column, first: Column, last: Column) -> Column:
    """Whether a day is within inclusive bounds; a null bound is open."""
    return (first.isNull() | (day >= first)) & (last.isNull() | (day <= last))


def override_matches(tags: Column, event_id: Column, wanted_tags: Column, wanted_ids: Column) -> Column:
    """An override matches by a shared tag (case and margins aside) or by the event's id."""
    low = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.arrays_overlap(low, wanted_tags) | F.array_contains(wanted_ids, event_id)


def resolve(events: DataFrame, units: DataFrame, overrides: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(event_id, unit_id, status, reason): each unit's status for each event.

    ``events`` event_id, day, tags; ``units`` unit_id, status, first, last;
    ``overrides`` unit_id, status, tags, ids; ``exclusions`` unit_id, start,
    end, why.  Not available, then excluded, then contradictory overrides
    (status error), then an override, then the default decide.
    """
    def keyed(rows: DataFrame, tags: Column, ids: Column, *keep: Column) -> DataFrame:
        low = F.transform(tags, lambda t: F.struct(F.lit("tag").alias("kind"), F.lower(F.trim(t)).alias("key")))
        own = F.transform(ids, lambda i: F.struct(F.lit("id").alias("kind"), i.alias("key")))
        return rows.select(*keep, F.explode(F.concat(low, own)).alias("k")).select("*", "k.kind", "k.key").drop("k").distinct()

    # an override meets an event by a tag or an id that both have: an equi-join, where override_matches would be a loop
    wanted = keyed(overrides, F.coalesce("tags", F.array()), F.coalesce("ids", F.array()), F.col("unit_id"), F.col("status").alias("o"))
    hits = wanted.join(keyed(events, F.coalesce("tags", F.array()), F.array("event_id"), F.col("event_id")), ["kind", "key"])
    forced = hits.groupBy("event_id", "unit_id").agg(F.count_distinct("o").alias("n"), F.min("o").alias("o"))
    # windows are spread over their months, so that they meet events by an equi-join
    months = F.when(F.col("start") <= F.col("end"), F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month")))
    shut = exclusions.withColumn("month", F.explode(months)).join(events.withColumn("month", F.trunc("day", "month")), "month").where(F.col("day").between(F.col("start"), F.col("end"))).groupBy("event_id", "unit_id").agg(F.min("why").alias("why"))
    # the resolution table itself: every event with every unit
    base = events.select("event_id", "day").crossJoin(units).join(forced, ["event_id", "unit_id"], "left").join(shut, ["event_id", "unit_id"], "left")
    there = available(F.col("day"), F.col("first"), F.col("last"))
    status = F.when(~there, "dropped").when(F.col("why").isNotNull(), "dropped").when(F.col("n") > 1, "error").otherwise(F.coalesce("o", "status"))
    reason = F.when(~there, "not available").when(F.col("why").isNotNull(), F.concat(F.lit("excluded: "), "why")).when(F.col("n") > 1, "conflicting overrides")
    return base.select("event_id", "unit_id", status.alias("status"), reason.alias("reason"))


def exchanges(listings: DataFrame, known: DataFrame) -> DataFrame:
    """(unit_id, source_ticker, suffix, zone, problem): each listing's exchange by the suffix of its ticker, or by its override."""
    own = listings.withColumn("suffix", F.coalesce("exchange", S.symbol_suffix(F.col("source_ticker"))))
    out = own.join(known, "suffix", "left")
    return out.select("unit_id", "source_ticker", "suffix", "zone", F.when(F.col("zone").isNull(), "unknown suffix").alias("problem"))
