"""What a firm is, decided before any price is seen: vehicles, curated names, instruments, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.settle import settled

# Words and names of closed-end vehicles.
VEHICLE_WORDS = (
    "investment trust", "investment company", "investments", "capital partners", "private equity", "smaller companies", "emerging markets", "growth & income", "dividend income", "income fund",
    "income trust", "opportunity fund", "infrastructure company", "infrastructure investments", " fund", " trust",
)
VEHICLES = (
    "3i group", "3i infrastructure", "aberdeen asia focus", "aberforth smaller companies trust", "allianz technology trust", "ashoka india equity investment trust", "avi global trust",
    "bankers investment trust", "bh macro", "biopharma credit", "bluefield solar income fund", "brunner investment trust", "caledonia investments", "capital gearing trust", "chrysalis investments",
    "city of london investment trust", "edinburgh investment trust", "edinburgh worldwide investment trust", "european smaller companies trust", "foresight environmental infrastructure",
    "gcp infrastructure investments", "global smaller companies trust", "greencoat uk wind", "harbourvest global private equity", "herald investment trust", "hg capital trust",
    "hicl infrastructure company", "icg enterprise trust", "impax environmental markets", "international public partnerships", "invesco asia dragon trust", "ip group", "law debenture",
    "mercantile investment trust", "merchants trust", "molten ventures", "monks investment trust", "murray income trust", "murray international trust", "nb private equity partners",
    "north atlantic smaller companies investment trust", "oakley capital investments", "pacific horizon investment trust", "pantheon infrastructure", "pantheon international",
    "partners group private equity", "patria private equity trust", "personal assets trust", "polar capital global healthcare trust", "rit capital partners", "rtw biotech opportunities",
    "ruffer investment company", "schiehallion fund", "scottish american investment company", "scottish mortgage investment trust", "sequoia economic infrastructure income fund", "syncona",
    "temple bar investment trust", "the renewables infrastructure group", "tr property investment trust", "twentyfour income fund", "utilico emerging markets", "vietnam enterprise investments",
    "vinacapital vietnam opportunity fund", "worldwide healthcare trust", "pershing square holdings",
)


class UnknownId(KeyError):
    """An id that is to be dropped does not exist."""


def is_vehicle(name: Column) -> Column:
    """Whether a name is a closed-end vehicle's: a blank or a REIT is not, a listed name is, else one of the words tells."""
    low = F.lower(F.trim(name))
    return F.when(S.is_blank(name), False).when(low.rlike(r"\breit\b"), False).when(low.isin(*VEHICLES), True).otherwise(S.has_any(low, VEHICLE_WORDS))


def filter_candidates(candidates: DataFrame, curated: DataFrame) -> DataFrame:
    """(ticker, name, reason) of ``candidates`` (ticker, name, place): the first row of a ticker wins; reason null is a survivor.

    ``curated`` (ticker) holds those that enter with curated exposure instead.
    """
    first = candidates.groupBy("ticker").agg(F.min_by("name", "place").alias("name"))
    known = curated.select(F.upper(F.trim("ticker")).alias("_t")).distinct().withColumn("_k", F.lit(True))
    rows = first.join(known, F.upper("ticker") == F.col("_t"), "left")
    reason = F.when(F.col("_k"), "curated").when(is_vehicle(F.col("name")), "investment vehicle")
    return rows.select("ticker", "name", reason.alias("reason"))


def usable(instruments: DataFrame, scheduled: bool = True) -> DataFrame:
    """Instruments (grade, independent, ...) of a date grade other than C; with ``scheduled`` also those that are not independent."""
    kept = instruments.where(F.coalesce(F.col("grade") != "C", F.lit(False)))
    return kept if scheduled else kept.where("independent")


def without(rows: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """``rows`` less those ids; refused if one does not exist, as dropping nothing would read as robustness."""
    found = {r[key] for r in rows.where(F.col(key).isin(*ids)).select(key).distinct().collect()} if ids else set()
    if missing := sorted(set(ids) - found):
        raise UnknownId(", ".join(missing))
    return rows.where(~F.col(key).isin(*ids)) if ids else rows


def donor_turnover(prices: DataFrame, currencies: DataFrame, rates: DataFrame, floor: float) -> DataFrame:
    """(unit_id, turnover, passes, problem): mean turnover in one currency against a floor.

    ``currencies`` unit_id, currency; ``rates`` currency, rate.  A currency
    without a rate is a problem and passes nothing.
    """
    mean = prices.groupBy("unit_id").agg(F.avg(F.col("px").cast("double") * F.col("vol")).alias("_m"))
    rows = mean.join(currencies, "unit_id", "left").join(rates, "currency", "left")
    turnover = F.col("_m") * F.col("rate")
    return rows.select("unit_id", turnover.alias("turnover"), F.coalesce(turnover >= floor, F.lit(False)).alias("passes"), F.when(F.col("rate").isNull(), "no rate").alias("problem"))


def listed_returns(listings: DataFrame, returns: DataFrame) -> DataFrame:
    """(unit_id, dt, ret): each unit's returns from its source ticker's series, several units on one series, cut to its listing.

    ``listings`` unit_id, source_ticker, first, last; ``returns`` source_ticker,
    dt, ret, which were computed before the cut, so that a unit's first day has
    its return.
    """
    inside = (F.col("first").isNull() | (F.col("dt") >= F.col("first"))) & (F.col("last").isNull() | (F.col("dt") <= F.col("last")))
    return listings.join(returns, "source_ticker").where(inside).select("unit_id", "dt", "ret")


def universe_issues(listings: DataFrame, overrides: DataFrame, exclusions: DataFrame, suffixes: DataFrame, rates: DataFrame, most_donors: int) -> DataFrame:
    """(subject, message) of a universe's configuration, as rows.

    ``listings`` unit_id, source_ticker, group, alignment, currency;
    ``overrides`` override_id, tags, ids; ``exclusions`` unit_id, start, end;
    ``suffixes`` suffix, zone; ``rates`` currency, rate.
    """
    def rows(found: DataFrame, subject: Column, message: str) -> DataFrame:
        return found.select(F.coalesce(subject.cast("string"), F.lit("")).alias("subject"), F.lit(message).alias("message"))

    placed = listings.withColumn("suffix", S.symbol_suffix(F.col("source_ticker"))).join(suffixes.select("suffix", "zone", F.lit(True).alias("_s")), "suffix", "left")
    out = [
        rows(listings.where(S.is_blank(F.col("unit_id"))), F.col("source_ticker"), "missing unit_id"),
        rows(listings.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1"), F.col("unit_id"), "duplicate unit_id"),
        rows(placed.where("_s is null"), F.col("unit_id"), "unknown suffix"),
        rows(placed.where("alignment = 'none' and zone <> 'Europe/London'"), F.col("unit_id"), "unaligned clock"),
        rows(listings.join(rates, "currency", "left_anti").select("currency").distinct(), F.col("currency"), "no rate"),
        rows(listings.where("`group` = 'donor'").agg(F.count("*").alias("n")).where(F.col("n") > most_donors), F.col("n"), "too many donors"),
        rows(suffixes.agg(F.count(F.when(F.col("suffix") == "", 1)).alias("n")).where("n = 0"), F.lit(""), "no exchange for tickers without a suffix"),
        rows(overrides.groupBy("override_id").agg(F.count("*").alias("n")).where("n > 1"), F.col("override_id"), "duplicate override"),
        rows(overrides.where((F.size("tags") <= 0) & (F.size("ids") <= 0)), F.col("override_id"), "empty override"),
        rows(exclusions.where("start > end"), F.col("unit_id"), "exclusion ends before it starts"),
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def scoreable(targets: DataFrame) -> DataFrame:
    """(..., scoreable): a target with a mandated band or affected categories can be scored."""
    return targets.withColumn("scoreable", ~S.is_blank(F.col("band")) | (F.size(S.parse_list(F.coalesce("categories", F.lit("")))) > 0))


def opposite_channels(channels: Column) -> Column:
    """Whether a map of channels to signs holds more than one sign."""
    return F.size(F.array_distinct(F.map_values(channels))) > 1


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; the second's values win."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


def best_title(rows: DataFrame, sweep: DataFrame) -> DataFrame:
    """(id, title, hits): for each row (id, month, terms) the document of its month whose title holds most of the terms, ties by date and title; none without a hit.

    ``sweep`` has month, published, title.  Documents of a month that hold the
    same of its terms are one candidate, their first, and rows of the same terms
    one question, so that neither all rows nor all documents meet.
    """
    asked = rows.select("id", "month", F.array_sort(F.transform("terms", lambda t: F.lower(t))).alias("terms"))
    wanted = settled(asked.select("month", "terms").distinct())
    known = wanted.select("month", F.explode("terms").alias("term")).groupBy("month").agg(F.array_sort(F.collect_set("term")).alias("known"))
    held = sweep.join(known, "month").withColumn("held", F.filter("known", lambda t: F.contains(F.lower("title"), t))).where(F.size("held") > 0)
    firsts = held.groupBy("month", "held").agg(F.min(F.struct("published", "title")).alias("first"))
    hits = F.size(F.filter("terms", lambda t: F.array_contains("held", t)))
    best = wanted.join(firsts, "month").withColumn("hits", hits).where("hits > 0").groupBy("month", "terms").agg(F.min(F.struct((-F.col("hits")).alias("h"), "first.published", "first.title")).alias("b"))
    return asked.join(best, ["month", "terms"]).select("id", "b.title", (-F.col("b.h")).alias("hits"))
