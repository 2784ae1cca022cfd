"""Small rules over configuration and results: look-ups that refuse, orders, formats, disclosures and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.operators.screening import UnknownId


def of_units(panel: DataFrame, wanted: DataFrame, key: str = "unit_id") -> DataFrame:
    """The panel's rows of the wanted units; units that the panel lacks are passed over."""
    return panel.join(wanted.select(key).distinct(), key, "left_semi")


def look_up(rows: DataFrame, key: str, value: str) -> dict:
    """The one row under a key, or a refusal that names the key."""
    found = rows.where(F.col(key) == value).limit(2).collect()
    if len(found) != 1:
        raise UnknownId(value)
    return found[0].asDict()


def in_config_order(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(..., place): the place of each row's key in a configured order; keys outside it come last, by name."""
    places = F.array_position(F.array(*map(F.lit, names)), F.col(key))
    return rows.withColumn("place", F.when(places > 0, places).otherwise(len(names) + 1).cast("int"))


def named_first(key: str, name: str) -> list[Column]:
    """Sort keys that put one named value first, then the others ascending, nulls before them."""
    return [F.when(F.col(key) == name, 0).otherwise(1), F.col(key).asc_nulls_first()]


def by_size(*columns: str) -> list[Column]:
    """Sort keys by falling absolute value."""
    return [F.abs(c).desc() for c in columns]


def largest(rows: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """(by..., key, value) of the largest absolute value, ties by key."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(key, value), F.struct((-F.abs(value)).alias("a"), key)).alias("b")).select(*by, f"b.{key}", f"b.{value}")


def signed(x: Column) -> Column:
    return F.format_string("%+.4f", x)


def signed_count(x: Column) -> Column:
    return F.format_string("%+d", x)


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def grouped(x: Column) -> Column:
    return F.format_string("%,.0f", x)


def caveats(rows: DataFrame) -> DataFrame:
    """(..., caveats) of provenance rows (retroactive, unadjusted, survivors_only, lagged, early, screened): what must be disclosed, in a fixed order.

    ``lagged`` and ``early`` are arrays of tickers, ``screened`` a map of units to reasons.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    notes = F.array(
        F.when(F.col("retroactive"), "retroactive adjustment"), F.when(F.col("unadjusted"), "unadjusted prices"), F.when(F.col("survivors_only"), "survivorship"),
        F.when(some("lagged"), F.concat(F.lit("lagged: "), F.array_join(F.array_sort("lagged"), ", "))), F.when(some("early"), F.concat(F.lit("early close: "), F.array_join(F.array_sort("early"), ", "))),
        F.when(some("screened"), F.concat(F.lit("screened out: "), F.array_join(F.array_sort(F.map_keys("screened")), ", "))),
    )
    return rows.withColumn("caveats", F.array_compact(notes))


def span_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def collection(payloads: DataFrame) -> DataFrame:
    """(slug, place, path, title) of the documents that JSON payloads (slug, payload) of collections list, in order; a document twice in one collection counts where it comes first."""
    shape = "links struct<documents: array<struct<base_path: string, title: string>>>"
    rows = payloads.select("slug", F.posexplode(F.coalesce(F.from_json("payload", shape)["links"]["documents"], F.array())).alias("place", "d")).where("d.base_path is not null")
    first = rows.groupBy("slug", F.col("d.base_path").alias("path")).agg(F.min(F.struct("place", "d.title")).alias("f"))
    return first.select("slug", F.col("f.place").alias("place"), "path", F.col("f.title").alias("title"))


def search(payloads: DataFrame, count: int, organisations: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """(query, place, link, title, published, type, organisation) of the first ``count`` results of each search (query, payload) that one of the organisations issued and that are of one of the types; none given means any."""
    shape = "results array<struct<link: string, title: string, public_timestamp: string, content_store_document_type: string, organisations: array<struct<slug: string>>>>"
    rows = payloads.select("query", F.posexplode(F.coalesce(F.from_json("payload", shape)["results"], F.array())).alias("at", "r")).where("r.link is not null")
    issued = F.transform(F.coalesce("r.organisations", F.array()), lambda o: o["slug"])
    if organisations:
        rows = rows.where(F.arrays_overlap(issued, F.array(*map(F.lit, organisations))))
    if types:
        rows = rows.where(F.col("r.content_store_document_type").isin(*types))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at"))
    out = rows.withColumn("place", place).where(F.col("place") <= count)
    return out.select("query", "place", "r.link", "r.title", F.col("r.public_timestamp").alias("published"), F.col("r.content_store_document_type").alias("type"), F.array_join(issued, ";").alias("organisation"))


def find_collections(payloads: DataFrame) -> DataFrame:
    """(query, place, slug, title) of JSON search payloads (query, payload): results in order, those without a link left out."""
    shape = "results array<struct<link: string, title: string>>"
    rows = payloads.select("query", F.posexplode(F.coalesce(F.from_json("payload", shape)["results"], F.array())).alias("place", "r"))
    return rows.where("r.link is not null").select("query", "place", F.regexp_extract("r.link", "([^/]+)/?$", 1).alias("slug"), "r.title")


def table_issues(rows: DataFrame, required: tuple[str, ...], optional: tuple[str, ...], key: str = "event_id") -> DataFrame:
    """(key, column, message, fatal) of a dictionary as a whole: required columns that it lacks, columns unknown to it, no rows.

    Without its required columns a dictionary has no row issues: check this first.
    """
    spark = rows.sparkSession
    found = [("", c, "missing column", True) for c in required if c not in rows.columns]
    found += [("", c, "unknown column", False) for c in rows.columns if c not in (*required, *optional)]
    whole = spark.createDataFrame(found, f"{key} string, column string, message string, fatal boolean")
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias(key), F.lit("").alias("column"), F.lit("no rows").alias("message"), F.lit(False).alias("fatal"))
    return whole.unionByName(empty)


def membership_issues(rows: DataFrame, key: str, column: str, known: DataFrame, name: str, fatal: bool = True) -> DataFrame:
    """(key, column, message, fatal) of the items of a list cell that a whitelist (a column ``name``) lacks, case and margins aside."""
    items = rows.select(key, F.explode(F.array_distinct(F.transform(S.parse_list(F.col(column)), lambda x: F.lower(F.trim(x))))).alias("_x"))
    strange = items.join(known.select(F.lower(F.trim(name)).alias("_x")).distinct(), "_x", "left_anti")
    return strange.select(key, F.lit(column).alias("column"), F.concat(F.lit("unknown: "), "_x").alias("message"), F.lit(fatal).alias("fatal"))


def repeats(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, column, message, fatal): a warning for each key that shares its values, case aside, with another row."""
    low = [F.lower(F.trim(c)).alias(f"_{n}") for n, c in enumerate(columns)]
    pairs = rows.select(key, *low)
    twice = pairs.groupBy(*[f"_{n}" for n in range(len(columns))]).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.join(twice, [f"_{n}" for n in range(len(columns))]).select(key, F.lit("+".join(columns)).alias("column"), F.lit("repeated").alias("message"), F.lit(False).alias("fatal"))
