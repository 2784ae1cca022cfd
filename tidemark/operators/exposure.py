"""Point-in-time exposure: as-of attributes, channel scores, standardising and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordering import following, running

#: Energy bands from best to worst.
BANDS = ("A", "B", "C", "D", "E", "F", "G")


def split_knowable(attributes: DataFrame, cutoff: Column) -> DataFrame:
    """(attribute columns, withheld): knowable strictly before one date, else withheld, never dropped; a missing date is withheld."""
    return attributes.withColumn("withheld", F.coalesce(F.col("knowable") >= cutoff, F.lit(True)))


def _months(first: Column, last: Column) -> Column:
    """The months from one date to another, as days; none where they are the wrong way round."""
    return F.when(first <= last, F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")))


def in_force(steps: DataFrame, events: DataFrame, since: str, until: str) -> DataFrame:
    """``steps`` (..., since, until) joined with ``events`` (event_id, cutoff) after ``since`` and up to ``until``, open where that is null.

    A step is spread over the months that it lasts and meets the events of each
    by an equi-join; steps end with the last event at the latest.
    """
    spread = steps.crossJoin(F.broadcast(events.agg(F.max("cutoff").alias("_end"))))  # one row
    upto = F.least(F.coalesce(F.col(until), F.col("_end")), F.col("_end"))
    spread = spread.withColumn("_month", F.explode(_months(F.col(since), upto))).drop("_end")
    dated = events.select("event_id", "cutoff", F.trunc("cutoff", "month").alias("_month"))
    return spread.join(dated, "_month").where((F.col(since) < F.col("cutoff")) & (F.col(until).isNull() | (F.col("cutoff") <= F.col(until)))).drop("_month")


def latest_known(attributes: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, unit_id, attribute, value, as_of, knowable): the last published value before each event.

    Ties on the publication date go to the later as-of date, then to the larger
    value.  A publication holds until the next of its series, found by one ordered
    pass however long the series; what is never knowable holds nowhere.
    """
    known = attributes.where("knowable is not null").select("unit_id", "attribute", "value", "as_of", "knowable")
    steps = following(known, ["unit_id", "attribute"], ["knowable", "as_of", "value"], "knowable", "_until")
    found = in_force(steps, events.select("event_id", F.to_date("ts").alias("cutoff")), "knowable", "_until")
    return found.select("event_id", "unit_id", "attribute", "value", "as_of", "knowable")


def knowable_counts(attributes: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, knowable, withheld): how many rows were knowable before each event and how many were not, from running counts by date."""
    by_day = attributes.groupBy("knowable").agg(F.count("*").alias("n"))
    whole = by_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    dated = running(by_day.where("knowable is not null").withColumn("_g", F.lit(0)), ["_g"], ["knowable"], "n", "upto")
    steps = following(dated, ["_g"], ["knowable"], "knowable", "_until").select("knowable", "_until", "upto")
    cut = events.select("event_id", F.to_date("ts").alias("cutoff"))
    found = cut.join(in_force(steps, cut, "knowable", "_until").select("event_id", "upto"), "event_id", "left").crossJoin(whole)
    return found.select("event_id", F.coalesce("upto", F.lit(0)).alias("knowable"), (F.col("all") - F.coalesce("upto", F.lit(0))).alias("withheld"))


def event_exposure(attributes: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, direction, unit_id, exposure): each unit's share in the event's target, as last known before it."""
    wanted = events.select("event_id", "direction", F.to_date("ts").alias("cutoff"), F.concat(F.lit("revenue_share_"), "brand").alias("attribute"))
    known = attributes.join(wanted, "attribute").where("knowable < cutoff")
    return known.groupBy("event_id", "direction", "unit_id").agg(F.max_by("value", F.struct("knowable", "as_of")).alias("exposure"))


def band_place(band: Column) -> Column:
    """1 for the best band; a band that is none is an error, never taken as good."""
    place = F.array_position(F.array(*map(F.lit, BANDS)), band)
    return F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown band: "), F.coalesce(band.cast("string"), F.lit("null")))).cast("long"))


def share_below(bands: DataFrame, floor: str) -> DataFrame:
    """(unit_id, magnitude): share of the stock in bands strictly worse than ``floor``; negative counts are 0, an empty stock gives 0, an unknown band is refused."""
    if floor not in BANDS:
        raise ValueError(f"unknown band: {floor}")
    n = F.greatest(F.col("n"), F.lit(0))
    worse = F.sum(F.when(band_place(F.col("band")) > BANDS.index(floor) + 1, n).otherwise(0))
    return bands.groupBy("unit_id").agg(F.coalesce(worse / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0)).alias("magnitude"))


#: The tenures whose stock a target's scope reaches.
SCOPES = {"domestic_prs": ("dwellings_prs_",), "social_rented": ("dwellings_social_",), "all_domestic": ("dwellings_", "dwellings_prs_", "dwellings_social_")}


def stock_channel(attributes: DataFrame, targets: DataFrame) -> DataFrame:
    """(unit_id, target_id, magnitude): dose of landlords, the share of the stock in scope that is worse than the target's band.

    ``attributes`` unit_id, attribute (a prefix of the tenure and a band letter),
    value; ``targets`` target_id, scope, band.  A unit without stock of the
    tenure has no row: the channel does not apply, which is not a dose of zero.
    """
    tenure = F.regexp_extract("attribute", "^(dwellings_(?:prs_|social_)?)band_([A-Z])$", 1)
    stock = attributes.withColumn("prefix", tenure).where("prefix <> ''").withColumn("own", F.regexp_extract("attribute", "([A-Z])$", 1))
    reach = F.coalesce(*[F.when(F.col("scope") == s, F.array(*map(F.lit, p))) for s, p in SCOPES.items()])
    wanted = targets.withColumn("prefix", F.explode(reach)).select("target_id", "prefix", "band")
    met = stock.join(wanted, "prefix")
    n = F.greatest(F.col("value"), F.lit(0.0))
    worse = F.sum(F.when(band_place(F.col("own")) > band_place(F.col("band")), n).otherwise(0.0))
    return met.groupBy("unit_id", "target_id").agg(F.coalesce(worse / F.nullif(F.sum(n), F.lit(0.0)), F.lit(0.0)).alias("magnitude"))


def delivered_channel(attributes: DataFrame, targets: DataFrame) -> DataFrame:
    """(unit_id, target_id, magnitude): dose of builders for new-build targets, 0 where their own standard already meets the band.

    The build standard is an attribute of its own, the place of a band from 1.
    """
    delivered = attributes.withColumn("own", F.nullif(F.regexp_extract("attribute", "^delivered_units_band_([A-Z])$", 1), F.lit("")))
    standard = attributes.where("attribute = 'build_standard_band'").groupBy("unit_id").agg(F.max("value").alias("standard"))
    met = delivered.where("own is not null").crossJoin(targets.where("scope = 'new_build'").select("target_id", "band"))  # targets are a curated few
    n = F.greatest(F.col("value"), F.lit(0.0))
    worse = F.sum(F.when(band_place(F.col("own")) > band_place(F.col("band")), n).otherwise(0.0))
    a = met.groupBy("unit_id", "target_id", "band").agg(F.coalesce(worse / F.nullif(F.sum(n), F.lit(0.0)), F.lit(0.0)).alias("m"))
    meets = F.coalesce(F.col("standard") <= band_place(F.col("band")), F.lit(False))
    return a.join(standard, "unit_id", "left").select("unit_id", "target_id", F.when(meets, 0.0).otherwise(F.col("m")).alias("magnitude"))


def supply_channel(value: Column) -> Column:
    """Domestic supply share within 0 and 1; null where it is not disclosed."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def product_dose(attributes: DataFrame, targets: DataFrame) -> DataFrame:
    """(unit_id, target_id, magnitude): share of revenue in the target's categories, at most 1, times the domestic share.

    ``targets`` target_id, categories (an array).  A unit with revenue shares but
    none in the categories has dose 0; one whose domestic share is unknown has
    no row, as 1 would be an assumption.
    """
    shares = attributes.where(F.col("attribute").startswith("revenue_share_")).withColumn("category", F.lower(F.substring("attribute", len("revenue_share_") + 1, 1 << 20)))
    wanted = targets.select("target_id", F.transform("categories", lambda c: F.lower(F.trim(c))).alias("categories"))
    inside = F.array_contains("categories", F.col("category"))
    a = shares.crossJoin(wanted).groupBy("unit_id", "target_id").agg(F.sum(F.when(inside, F.greatest(F.col("value"), F.lit(0.0)))).alias("total"))  # targets are a curated few
    home = attributes.where("attribute = 'uk_revenue_share'").groupBy("unit_id").agg(F.max("value").alias("home"))
    m = F.when(F.col("total").isNull(), 0.0).otherwise(product_channel(F.col("total"), F.col("home")))
    return a.join(home, "unit_id", "left").select("unit_id", "target_id", m.alias("magnitude")).where("magnitude is not null")


def product_channel(shares: Column, domestic: Column) -> Column:
    """Share of products in scope, at most 1, times the domestic share within 0 and 1; null where either is unknown."""
    return F.when(shares.isNotNull() & domestic.isNotNull(), F.least(shares, F.lit(1.0)) * F.least(F.greatest(domestic, F.lit(0.0)), F.lit(1.0)))


def score(candidates: DataFrame, channels: tuple[str, ...], signs: dict[str, int]) -> DataFrame:
    """(..., channel, magnitude, signed): the first channel that is not null decides; none gives an explicit zero.

    ``signed`` is magnitude times the channel's sign times +1 (tighten) or -1 (loosen).
    """
    channel = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in channels], F.lit("none"))
    magnitude = F.coalesce(*[F.col(c) for c in channels], F.lit(0.0))
    sign = F.coalesce(*[F.when(F.col("channel") == c, F.lit(s)) for c, s in signs.items()], F.lit(0))
    direction = F.when(F.col("direction") == "tighten", 1).when(F.col("direction") == "loosen", -1)
    out = candidates.withColumn("channel", channel).withColumn("magnitude", magnitude)
    return out.withColumn("signed", F.col("magnitude") * sign * direction)


def winsorise(rows: DataFrame, column: str, by: str, low: float, high: float) -> DataFrame:
    """``column`` clipped to its exact quantiles (linear interpolation) within each group."""
    q = rows.groupBy(by).agg(F.percentile(column, F.lit(low)).alias("_lo"), F.percentile(column, F.lit(high)).alias("_hi"))
    return rows.join(q, by).withColumn(column, F.greatest(F.least(column, "_hi"), "_lo")).drop("_lo", "_hi")


def standardise(rows: DataFrame, column: str, by: str, into: str) -> DataFrame:
    """(x - mean) / sample deviation within each group; 0 where the deviation is missing or not positive."""
    s = rows.groupBy(by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).otherwise(0.0)
    return rows.join(s, by).withColumn(into, z).drop("_m", "_s")


def average_rank(rows: DataFrame, column: str, name: str, buckets: int = 64) -> DataFrame:
    """(..., name): rank from 1 among all rows that have the column, ties sharing their mean; null where it is null.

    Values are counted and dealt over ranges between approximate quantiles, so
    that no task orders all of them; only the ranges' totals, ``buckets`` rows,
    are summed in one place.
    """
    cuts = sorted(set(rows.select(F.col(column).cast("double").alias("v")).where("v is not null").approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = sum((F.when(F.col("_v") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c")).withColumn("_b", bucket)
    own = counts.withColumn("_own", F.sum("_c").over(Window.partitionBy("_b").orderBy("_v")))
    before = counts.groupBy("_b").agg(F.sum("_c").alias("_t"))
    before = before.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    rank = own.join(before, "_b").select("_v", (F.col("_before") + F.col("_own") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))
    return rows.join(rank, F.col(column) == F.col("_v"), "left").drop("_v")


def rank_buckets(rows: DataFrame, column: str, by: str, buckets: int, into: str) -> DataFrame:
    """Average-tie rank over the group's size, in ``buckets`` steps, as a share: ceil(rank / n * buckets) / buckets."""
    order = Window.partitionBy(by).orderBy(column)
    ties = F.count("*").over(Window.partitionBy(by, column))
    share = (F.rank().over(order) + (ties - 1) / 2) / F.count("*").over(Window.partitionBy(by))
    return rows.withColumn(into, F.ceil(F.round(share * buckets, 9)) / buckets)


def dispersion(rows: DataFrame, column: str) -> DataFrame:
    """(event_id, n_units, n_nonzero, sd, low, high) of a score."""
    return rows.groupBy("event_id").agg(F.count("*").alias("n_units"), F.count(F.when(F.col(column) != 0, 1)).alias("n_nonzero"), F.stddev_samp(column).alias("sd"), F.min(column).alias("low"), F.max(column).alias("high"))
