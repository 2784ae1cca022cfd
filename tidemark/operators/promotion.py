"""From a curated inventory to a dictionary of events, and from candidates to a shortlist: ordered rules, nothing dropped without a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.discovery import reasons
from tidemark.operators.ordering import running
from tidemark.operators.settle import settled

#: What an exposure channel is called among the treated groups.
SECTORS = {"residential_stock": "residential_landlords", "delivered_stock": "housebuilders", "product_revenue": "insulation_and_materials", "domestic_supply": "utilities_and_suppliers"}
#: How a leak's grade reads as anticipation; other grades are medium.
ANTICIPATION = {"confirmed": "high", "high": "high", "medium": "medium", "low": "low"}
#: Stages that usually carry news, and channels with a sign.
NEWSWORTHY = ("consultation_outcome", "strategy", "scheme_launch", "scheme_amendment", "scheme_closure", "target_change")
SIGNED = ("residential_stock", "delivered_stock", "product_revenue")
SPACING = 14  #: days under which an event is grouped with the one before


def _mapped(table: dict[str, str], of):
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(of == key, value).otherwise(out)
    return out


def promote(inventory: DataFrame, sources: DataFrame, dropped: DataFrame, moved: DataFrame, stamped: DataFrame, spacing: int = SPACING) -> DataFrame:
    """One row an instrument: the event that it becomes, or the first rule that keeps it out (``reason``).

    ``inventory`` place, id, date, title, family, direction, channel_targets,
    date_grade, leak_risk, scheduled; ``sources`` place, url; ``dropped`` id;
    ``moved`` id, day; ``stamped`` id, ts.  In this order: dropped for a leak, a
    date of grade C, scheduled, no exact day, no source, no sector.  A stamp
    gives the time, else midnight of the day, which a leak may have moved.  An
    event within ``spacing`` days of the one before declares its group.
    """
    day = S.exact_day(F.col("date"))
    rows = inventory.join(sources.select("place", "url"), "place", "left").join(dropped.select("id").distinct().withColumn("_dropped", F.lit(True)), "id", "left")
    rows = rows.join(moved.select("id", F.col("day").alias("_moved")), "id", "left").join(stamped.select("id", F.col("ts").alias("_stamp")), "id", "left")
    sectors = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("channel_targets", F.array()), lambda c: _mapped(SECTORS, c)), lambda s: s.isNotNull())))
    rows = rows.withColumn("_day", day).withColumn("_sectors", sectors)
    graded = reasons(rows, [
        ("leaked", F.coalesce("_dropped", F.lit(False))), ("date of grade C", ~F.coalesce(F.col("date_grade").isin("A", "B"), F.lit(False))), ("scheduled", F.coalesce("scheduled", F.lit(False))),
        ("no exact day", F.col("_day").isNull()), ("no source", S.is_blank(F.col("url"))), ("no sector", F.size("_sectors") == 0),
    ])
    kept, ts = F.col("reason").isNull(), F.coalesce("_stamp", F.coalesce("_moved", "_day").cast("timestamp_ntz"))
    out = graded.select(
        "place", F.col("id").alias("event_id"), "reason", F.when(kept, ts).alias("ts"),
        F.when(kept, F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), "Europe/London"))).alias("date"), F.when(kept, F.col("_stamp").isNotNull()).alias("time_known"), F.when(kept, F.substring(F.replace("title", F.lit(","), F.lit(";")), 1, 180)).alias("policy"), F.when(kept, F.col("url")).alias("source_url"),
        F.when(kept, F.coalesce(_mapped(ANTICIPATION, F.col("leak_risk")), F.lit("medium"))).alias("anticipation_risk"),
        F.when(kept, F.when(F.col("direction") == "mixed", "ambiguous").when(F.col("direction") == "loosen", "negative").otherwise("positive")).alias("expected_direction"),
        F.when(kept, F.when(F.col("direction").isin("loosen", "mixed"), "loosen").otherwise("tighten")).alias("direction"), F.when(kept, F.array_join("_sectors", ";")).alias("affected_sectors"),
        F.when(kept, F.when(F.array_contains("family", "fiscal"), "fiscal_statement").otherwise("")).alias("confounders"), F.when(kept, F.when(F.col("_moved").isNotNull(), F.concat(F.lit("moved to "), F.col("_moved").cast("string"))).otherwise("")).alias("leak_note"),
    )
    out = settled(out)
    # the event before, by number over dealt ranges
    numbered = settled(running(out.where("reason is null").select("event_id", "ts", "place", F.lit(0).alias("_all"), F.lit(1).alias("_one")), ["_all"], ["ts", "place"], "_one", "number"))
    before = numbered.select((F.col("number") + 1).alias("number"), F.col("event_id").alias("groups_with"), F.col("ts").alias("_before"))
    gap = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_before").cast("timestamp"))) / 86_400_000_000)
    near = numbered.join(before, "number").withColumn("gap_days", gap).where(F.col("gap_days") < spacing).select("event_id", "groups_with", "gap_days")
    return out.join(near, "event_id", "left").withColumn("overlap_ack", F.when(F.col("reason").isNull(), F.when(F.col("gap_days").isNotNull(), "true").otherwise("")))


def shortlist(candidates: DataFrame, first_month: str, apart: str = "fiscal_events") -> DataFrame:
    """``candidates`` (family, stage, month, channels) with the first rule that keeps each off the list, or null.

    In this order: no stage, a stage that seldom carries news, before the
    sample's first month (yyyy-MM), a family that is reported apart, no channel
    with a sign.
    """
    return reasons(candidates, [
        ("no stage", S.is_blank(F.col("stage"))), ("seldom news", ~F.col("stage").isin(*NEWSWORTHY)), ("before the sample", F.col("month") < first_month),
        ("reported apart", F.col("family") == apart), ("no signed channel", ~F.coalesce(F.arrays_overlap("channels", F.array(*map(F.lit, SIGNED))), F.lit(False))),
    ])


def answered(cells: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """(key..., newsworthy, finds, answered, gap): each cell of a family-stage grid (key, stage, checked): whether something was found or its absence was checked; a gap is a newsworthy cell that is neither."""
    n = found.groupBy(*key).agg(F.count("*").alias("finds"))
    out = cells.join(n, list(key), "left").withColumn("finds", F.coalesce("finds", F.lit(0)))
    news, done = F.col("stage").isin(*NEWSWORTHY), (F.col("finds") > 0) | F.coalesce("checked", F.lit(False))
    return out.select(*key, news.alias("newsworthy"), "finds", done.alias("answered"), (news & ~done).alias("gap"))
