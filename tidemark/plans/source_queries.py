"""Queries through landed payloads, scanned files with row numbers, and the rules that make a dictionary of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import checks as C
from tidemark.operators import promotion as M
from tidemark.operators.ordering import file_positions
from tidemark.operators.settle import scratch
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources import landed as D
from tidemark.sources.readers import csv_strings

_HREF = '<a href="([^"]*)"'


def _landed(spark, folder):
    """The pages as fetched payloads: every fortieth fetch failed, every fiftieth page has a sibling that never landed."""
    pages = X.table(spark, folder, "pages")
    place = scratch(spark, "landed")
    failed = F.col("page_id") % 40 == 7
    fetched = pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("key"), F.when(~failed, F.col("html")).alias("body"), F.when(failed, "timed out").alias("error"))
    D.land(fetched, place)
    wanted = fetched.select("key").unionByName(pages.where("page_id % 50 = 3").select(F.concat(F.lit("gone^"), F.col("page_id").cast("string")).alias("key")))
    return D.landed(spark, place, wanted)


_WANTED = "WITH w AS (SELECT 'p/' || page_id AS key, CASE WHEN page_id % 40 = 7 THEN 'failed' WHEN coalesce(html, '') = '' THEN 'empty' ELSE 'ok' END AS status, CASE WHEN page_id % 40 <> 7 AND html <> '' THEN html END AS body, CASE WHEN page_id % 40 = 7 THEN 'timed out' END AS error FROM pages UNION ALL SELECT 'gone^' || page_id, 'absent', NULL, NULL FROM pages WHERE page_id % 50 = 3)\n"


@query("landed_payloads", _WANTED + """, l AS (SELECT key, link, min(i) AS i FROM (SELECT key, unnest(x) AS link, generate_subscripts(x, 1) AS i FROM (SELECT key, regexp_extract_all(body, '<a href="([^"]*)"', 1) AS x FROM w)) GROUP BY 1, 2),
k AS (SELECT key, string_agg(link, ' ' ORDER BY i) AS links FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS n FROM l) WHERE n <= 3 GROUP BY 1)
SELECT w.key, status, error, CAST(strlen(body) AS BIGINT) AS bytes, md5(body) AS digest, CASE WHEN body IS NOT NULL THEN coalesce(links, '') END AS links FROM w LEFT JOIN k ON k.key = w.key""")
def landed_payloads(spark, folder):
    rows = _landed(spark, folder)
    return rows.select("key", "status", "error", F.octet_length("body").cast("long").alias("bytes"), F.md5(F.col("body").cast("binary")).alias("digest"), F.array_join(D.first_links(F.col("body"), _HREF, 3), " ").alias("links"))


@query("landed_verdict", _WANTED + "SELECT CASE WHEN failed > 0 OR (empty > 0 AND ok = 0) THEN 'unreachable' WHEN empty > 0 THEN 'incomplete' ELSE 'complete' END AS verdict, * FROM (SELECT count(*) AS wanted, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status = 'empty' THEN 1 END) AS empty, count(CASE WHEN status = 'failed' THEN 1 END) AS failed, count(CASE WHEN status = 'absent' THEN 1 END) AS absent FROM w)")
def landed_verdict(spark, folder):
    return D.verdict(_landed(spark, folder))


_FILES = 16


def _scanned(spark, folder, name: str, rows):
    """``rows`` (k, cells...) written as files of cells by k modulo the number of files, each in order of k, and scanned as a curated file is."""
    place = scratch(spark, name)
    cells = [c for c in rows.columns if c != "k"]
    dealt = rows.withColumn("file", (F.col("k") % _FILES).cast("int")).repartition(_FILES, "file").sortWithinPartitions("file", "k")
    dealt.select(*cells, "file").write.partitionBy("file").csv(place, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return file_positions(csv_strings(spark, place))


_ATTR = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 16 AS file, CASE WHEN o_orderkey % 37 = 0 THEN ' ' WHEN o_orderkey % 41 = 0 THEN 'nobody' ELSE 'c' || o_custkey END AS unit_id, CASE WHEN o_orderkey % 29 = 0 THEN 'n/a' WHEN o_orderkey % 31 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS value,
 CASE WHEN o_orderkey % 23 = 0 THEN '31/12/1995' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_of_date, CASE WHEN o_orderkey % 19 = 0 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate + INTERVAL 401 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%d') END AS knowable_from, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'u' END AS source_url FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) + 1 AS row FROM o), known AS (SELECT DISTINCT 'c' || c_custkey AS u FROM customer)
"""


@query(
    "attribute_file_issues",
    _ATTR + """SELECT unit_id, row, 'unit_id' AS "column", 'blank' AS message, TRUE AS fatal FROM r WHERE unit_id = ' ' UNION ALL SELECT unit_id, row, 'unit_id', 'unknown unit', TRUE FROM r WHERE trim(unit_id) NOT IN (SELECT u FROM known)
UNION ALL SELECT unit_id, row, 'value', 'blank', TRUE FROM r WHERE value = '' UNION ALL SELECT unit_id, row, 'value', 'not a number', TRUE FROM r WHERE value = 'n/a' UNION ALL SELECT unit_id, row, 'as_of_date', 'not a date', TRUE FROM r WHERE as_of_date LIKE '%/%' UNION ALL SELECT unit_id, row, 'source_url', 'blank', TRUE FROM r WHERE source_url = ''
UNION ALL SELECT unit_id, row, 'knowable_from', 'before the as-of date', TRUE FROM r WHERE k % 19 = 0 AND k % 23 <> 0 UNION ALL SELECT unit_id, row, 'knowable_from', 'long disclosure lag', FALSE FROM r WHERE k % 17 = 0 AND k % 19 <> 0 AND k % 23 <> 0""",
)
def attribute_file_issues(spark, folder):
    """Every issue of the attribute files with its spreadsheet row."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = X.table(spark, folder, "orders").select(
        k.alias("k"), F.when(k % 37 == 0, " ").when(k % 41 == 0, "nobody").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("unit_id"), F.lit("share").alias("attribute"), F.when(k % 29 == 0, "n/a").when(k % 31 == 0, "").otherwise(k.cast("string")).alias("value"),
        F.when(k % 23 == 0, "31/12/1995").otherwise(day.cast("string")).alias("as_of_date"), F.when(k % 19 == 0, F.date_sub(day, 1)).when(k % 17 == 0, F.date_add(day, 401)).otherwise(F.date_add(day, 400)).cast("string").alias("knowable_from"), F.when(k % 13 == 0, "").otherwise("u").alias("source_url"),
    )
    known = X.table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("unit_id"))
    return C.attribute_issues(_scanned(spark, folder, "attributes", rows), known, "position")


@query(
    "target_file_issues",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 16 AS file, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS event_id, CASE WHEN o_orderkey % 7 = 0 THEN 'everywhere' ELSE ' New_Build' END AS scope, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Loosen' END AS direction, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'C' END AS band, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'a;b' END AS cats FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) + 1 AS row FROM o)
SELECT event_id, row, 'event_id' AS "column", 'unknown event' AS message, TRUE AS fatal FROM r WHERE event_id = 'x' UNION ALL SELECT event_id, row, 'scope', 'unknown value', TRUE FROM r WHERE scope = 'everywhere' UNION ALL SELECT event_id, row, 'direction', 'unknown value', TRUE FROM r WHERE direction = '' UNION ALL SELECT event_id, row, 'mandated_min_band', 'scores nothing', FALSE FROM r WHERE band = ' ' AND cats = ''""",
)
def target_file_issues(spark, folder):
    """Every issue of the policy target files with its spreadsheet row."""
    k = F.col("o_orderkey")
    rows = X.table(spark, folder, "orders").select(
        k.alias("k"), F.when(k % 11 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("event_id"), F.when(k % 7 == 0, "everywhere").otherwise(" New_Build").alias("scope"), F.when(k % 5 == 0, "").otherwise("Loosen").alias("direction"),
        F.when(k % 3 == 0, " ").otherwise("C").alias("mandated_min_band"), F.when(k % 2 == 0, "").otherwise("a;b").alias("affected_categories"),
    )
    known = X.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("event_id"))
    return C.target_issues(_scanned(spark, folder, "targets", rows), known, "position")


_INVENTORY = """WITH i AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 17 = 0 THEN 'leaked' WHEN o_orderkey % 7 = 0 THEN 'date of grade C' WHEN o_orderkey % 13 = 0 THEN 'scheduled' WHEN o_orderkey % 11 = 0 THEN 'no exact day' WHEN o_orderkey % 19 = 0 THEN 'no source' WHEN substr(o_orderpriority, 1, 1) IN ('4', '5') THEN 'no sector' END AS reason, o_orderkey % 29 = 0 AS stamped, o_orderkey % 23 = 0 AS moved,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'residential_landlords' WHEN '2' THEN 'housebuilders;insulation_and_materials' WHEN '3' THEN 'utilities_and_suppliers' END AS affected_sectors, o_orderkey % 3 AS dir, o_orderkey % 4 AS leak, o_orderkey % 5 = 0 AS fiscal FROM orders),
p AS (SELECT *, CASE WHEN stamped THEN CAST(d AS TIMESTAMP) + INTERVAL 870 MINUTE WHEN moved THEN CAST(d - INTERVAL 3 DAY AS TIMESTAMP) ELSE CAST(d AS TIMESTAMP) END AS ts FROM i WHERE reason IS NULL),
g AS (SELECT *, lag(event_id) OVER w AS before_, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000) AS BIGINT) AS gap FROM p WINDOW w AS (ORDER BY ts, k))
"""


def _promoted(spark, folder):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    orders = X.table(spark, folder, "orders")
    name = F.concat(F.lit("o"), k.cast("string")).alias("id")
    first = F.substring("o_orderpriority", 1, 1)
    channels = F.when(first == "1", F.array(F.lit("residential_stock"))).when(first == "2", F.array(F.lit("product_revenue"), F.lit("delivered_stock"), F.lit("delivered_stock"))).when(first == "3", F.array(F.lit("domestic_supply"))).when(first == "4", F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    inventory = orders.select(
        k.alias("place"), name, F.when(k % 11 == 0, F.concat(F.date_format(day, "yyyy-MM"), F.lit("-??"))).otherwise(day.cast("string")).alias("date"), F.concat(F.lit("a, "), "o_orderpriority").alias("title"), F.when(k % 5 == 0, F.array(F.lit("eco"), F.lit("fiscal"))).otherwise(F.array(F.lit("eco"))).alias("family"),
        F.when(k % 3 == 0, "loosen").when(k % 3 == 1, "tighten").otherwise("mixed").alias("direction"), channels.alias("channel_targets"), F.when(k % 7 == 0, "C").when(k % 7 < 4, "A").otherwise("B").alias("date_grade"), F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "low").when(k % 4 == 2, "").otherwise("odd").alias("leak_risk"), (k % 13 == 0).alias("scheduled"),
    )
    sources = orders.where("o_orderkey % 19 <> 0").select(k.alias("place"), F.lit("https://x.org/a").alias("url"))
    moved = orders.where("o_orderkey % 23 = 0").select(name, F.date_sub(day, 3).alias("day"))
    stamped = orders.where("o_orderkey % 29 = 0").select(name, (day.cast("timestamp_ntz") + F.expr("interval 870 minutes")).alias("ts"))
    return M.promote(inventory, sources, orders.where("o_orderkey % 17 = 0").select(name), moved, stamped)


@query("promoted_events", _INVENTORY + """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS date, stamped AS time_known, CASE leak WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS anticipation_risk, CASE dir WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'ambiguous' END AS expected_direction, CASE WHEN dir = 1 THEN 'tighten' ELSE 'loosen' END AS direction, affected_sectors,
 CASE WHEN fiscal THEN 'fiscal_statement' ELSE '' END AS confounders, CASE WHEN moved THEN 'moved to ' || strftime(d - INTERVAL 3 DAY, '%Y-%m-%d') ELSE '' END AS leak_note, CASE WHEN gap < 14 THEN 'true' ELSE '' END AS overlap_ack, CASE WHEN gap < 14 THEN before_ END AS groups_with, CASE WHEN gap < 14 THEN gap END AS gap_days FROM g""")
def promoted_events(spark, folder):
    out = _promoted(spark, folder).where("reason is null")
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("date").cast("string").alias("date"), "time_known", "anticipation_risk", "expected_direction", "direction", "affected_sectors", "confounders", "leak_note", "overlap_ack", "groups_with", "gap_days")


@query("promotion_outcomes", _INVENTORY + "SELECT coalesce(reason, 'promoted') AS reason, CAST(count(*) AS BIGINT) AS instruments FROM i GROUP BY 1")
def promotion_outcomes(spark, folder):
    return _promoted(spark, folder).groupBy(F.coalesce("reason", F.lit("promoted")).alias("reason")).agg(F.count("*").alias("instruments"))


_STAGES = ("", "green_paper", *M.NEWSWORTHY)


def _candidates(spark, folder):
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*map(F.lit, _STAGES)), (k % len(_STAGES) + 1).cast("int"))
    channels = F.when(k % 3 == 0, F.array(F.lit("domestic_supply"))).when(k % 3 == 1, F.array(F.lit("product_revenue"), F.lit("domestic_supply"))).otherwise(F.array(F.lit("residential_stock")))
    return X.table(spark, folder, "orders").select(F.when(k % 5 == 0, "fiscal_events").otherwise(F.concat(F.lit("f"), (k % 5).cast("string"))).alias("family"), stage.alias("stage"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), channels.alias("channels"))


_CASES = "['" + "', '".join(_STAGES) + f"'][1 + o_orderkey % {len(_STAGES)}]"


@query("shortlist_rejections", f"SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderkey % {len(_STAGES)} = 0 THEN 'no stage' WHEN o_orderkey % {len(_STAGES)} = 1 THEN 'seldom news' WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'before the sample' WHEN o_orderkey % 5 = 0 THEN 'reported apart' WHEN o_orderkey % 3 = 0 THEN 'no signed channel' END AS reason FROM orders) GROUP BY 1")
def shortlist_rejections(spark, folder):
    return M.shortlist(_candidates(spark, folder), "1993-01").groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("grid_gaps", f"WITH o AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'fiscal_events' ELSE 'f' || o_orderkey % 5 END AS family, {_CASES} AS stage FROM orders), f AS (SELECT family, stage, count(*) AS n FROM o WHERE length(family || stage) % 3 <> 0 GROUP BY 1, 2), c AS (SELECT DISTINCT family, s AS stage FROM o, (SELECT unnest({list(M.NEWSWORTHY) + ['green_paper']}) AS s)) SELECT c.family, c.stage, c.stage <> 'green_paper' AS newsworthy, CAST(coalesce(n, 0) AS BIGINT) AS finds, coalesce(n, 0) > 0 OR length(c.family) % 2 = 1 AS answered, c.stage <> 'green_paper' AND NOT (coalesce(n, 0) > 0 OR length(c.family) % 2 = 1) AS gap FROM c LEFT JOIN f ON f.family = c.family AND f.stage = c.stage")
def grid_gaps(spark, folder):
    found = _candidates(spark, folder)
    cells = found.select("family").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, (*M.NEWSWORTHY, "green_paper"))))).withColumn("checked", F.length("family") % 2 == 1)
    return M.answered(cells, found.where(F.length(F.concat("family", "stage")) % 3 != 0), "family", "stage")


@query("document_pages", "SELECT 'p/' || page_id AS key, CAST(i AS INT) AS page, md5(t) AS digest FROM (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '</?(p|h1|h2)[^>]*>', chr(12), 'g'), chr(12)) AS x FROM pages WHERE page_id % 40 <> 7 AND html <> ''))")
def document_pages(spark, folder):
    """Landed documents whose pages are cut by form feeds."""
    rows = _landed(spark, folder).where("body is not null").select("key", F.regexp_replace("body", "</?(p|h1|h2)[^>]*>", "\f").alias("body"))
    return D.document_pages(rows, S.strip_html).select("key", "page", F.md5(F.col("page_text").cast("binary")).alias("digest"))
