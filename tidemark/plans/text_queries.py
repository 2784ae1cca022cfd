"""Queries on documents, pages, inventories, validation and the universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import checks as C
from tidemark.operators import discovery as V
from tidemark.operators import universe as U
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X

_SENT = """WITH flat AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS t FROM documents),
cut AS (SELECT doc_id, string_split(regexp_replace(trim(t, ' '), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS a FROM flat),
s AS (SELECT doc_id, sentence FROM (SELECT doc_id, unnest(a) AS sentence FROM cut) WHERE length(sentence) > 40 AND length(sentence) < 400)
"""


def _sentences(spark, folder):
    return V.sentence_rows(X.table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


@query("sentences_extracted", _SENT + "SELECT doc_id, CAST(count(*) AS BIGINT) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, min(sentence) AS first, max(sentence) AS last FROM s GROUP BY doc_id")
def sentences_extracted(spark, folder):
    return _sentences(spark, folder).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.min("sentence").alias("first"), F.max("sentence").alias("last"))


_APPARATUS = (
    "(contains(lower(sentence), 'industrial strategy') OR contains(lower(sentence), 'department for business, energy') OR contains(lower(sentence), 'energy and industrial')"
    r" OR regexp_matches(sentence, '(?im)\bPQ\s*\d|\bHC\s+Deb\b|\bHL\s+Deb\b|\bop\.?\s*cit\b|\bibid\b|https?://|\[subscription required\]|\bDeposited paper\b|^\s*\d{1,3}\s+[A-Z][a-z]+.{0,40},|\b(?:Financial Times|The Times|The Guardian|BBC News|Telegraph|Reuters)\b')"
    r" OR regexp_matches(sentence, '(?:\b\d{1,2}\.\d\b.*){3,}|(?:\s\d{1,3}\s){4,}|^\s*\d{1,3}\s+\d{1,2}\.\d|^\s*[A-Z][a-z]+ [A-Z][a-z]+ \d{1,3} Commons Library|^\s*\d{1,3}\s+[A-Z]')"
    r" OR length(regexp_replace(sentence, '[^0-9]', '', 'g')) / CAST(greatest(length(sentence), 1) AS DOUBLE) > 0.12)"
)
_MONTH = r"regexp_matches(sentence, '\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:19|20)\d\d')"


@query("apparatus_flags", _SENT + f"SELECT doc_id, CAST(count(CASE WHEN {_APPARATUS} THEN 1 END) AS BIGINT) AS apparatus, CAST(count(*) AS BIGINT) AS sentences FROM s GROUP BY doc_id")
def apparatus_flags(spark, folder):
    return _sentences(spark, folder).groupBy("doc_id").agg(F.count(F.when(V.is_apparatus(F.col("sentence")), 1)).alias("apparatus"), F.count("*").alias("sentences"))


_FAMILIES = {"licence": ("license", "licensed"), "tion": ("tion", "ción"), "ing": ("ing ",), "none": ("zzzz",)}


@query("coverage_by_family", _SENT + ", f AS (SELECT * FROM (VALUES ('licence', 'license'), ('licence', 'licensed'), ('tion', 'tion'), ('tion', 'ción'), ('ing', 'ing '), ('none', 'zzzz')) AS v(family, term)), h AS (SELECT family, sentence, bool_or(contains(lower(sentence), term)) AS hit FROM (SELECT row_number() OVER () AS id, sentence FROM s) x, f GROUP BY family, id, sentence)" + f" SELECT family, CAST(count(CASE WHEN hit THEN 1 END) AS BIGINT) AS mentions, CAST(count(CASE WHEN hit AND NOT {_APPARATUS} THEN 1 END) AS BIGINT) AS clean, CAST(count(CASE WHEN hit AND NOT {_APPARATUS} AND {_MONTH} THEN 1 END) AS BIGINT) AS dated, round(coalesce(count(CASE WHEN hit AND NOT {_APPARATUS} THEN 1 END) / CAST(nullif(count(CASE WHEN hit THEN 1 END), 0) AS DOUBLE), 0.0), 6) AS share FROM h GROUP BY family")
def coverage_by_family(spark, folder):
    return V.coverage(_sentences(spark, folder), _FAMILIES).withColumn("share", F.round("share", 6))


def _any(words, x="sentence"):
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


_MONTHS = S.MONTHS.split("|")
_DATED = f"""SELECT doc_id, sentence || CASE doc_id % 5 WHEN 0 THEN ' It was announced in ' || m || '.' WHEN 1 THEN ' In ' || m || ' little was said.' WHEN 2 THEN ' HC Deb 12 ' || m || '.' WHEN 3 THEN ' It was announced in spring.' ELSE '' END AS sentence
 FROM (SELECT *, {_MONTHS}[1 + doc_id % 12] || ' ' || (1990 + doc_id % 40) AS m FROM s)"""


@query(
    "dated_references",
    _SENT + f", y AS ({_DATED}), r AS (SELECT doc_id, regexp_extract(sentence, '\\b((?:{S.MONTHS})\\s+(?:19|20)\\d\\d)', 1) AS m FROM y WHERE {_any(V.INSTRUMENTS)} AND NOT {_APPARATUS})"
    " SELECT doc_id, CAST(strptime('1 ' || m, '%d %B %Y') AS DATE) AS month, CAST(count(*) AS BIGINT) AS n FROM r WHERE m <> '' GROUP BY 1, 2",
)
def dated_references(spark, folder):
    """The documents' sentences with a month of their own behind them, since the given prose names none: beside an instrument, alone, in a citation."""
    k = F.col("doc_id")
    month = F.concat(F.element_at(F.array(*map(F.lit, _MONTHS)), (k % 12 + 1).cast("int")), F.lit(" "), (k % 40 + 1990).cast("string"))
    tails = (" It was announced in ", "."), (" In ", " little was said."), (" HC Deb 12 ", ".")
    tail = F.when(k % 5 == 3, " It was announced in spring.").otherwise("")
    for n, (before, after) in enumerate(tails):
        tail = F.when(k % 5 == n, F.concat(F.lit(before), month, F.lit(after))).otherwise(tail)
    rows = _sentences(spark, folder).withColumn("sentence", F.concat("sentence", tail))
    return V.dated_references(rows, "doc_id").groupBy("doc_id", "month").agg(F.count("*").alias("n"))


_DECODED = "regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"
for _name, _text in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("nbsp", "\u00a0"), ("copy", "\u00a9"), ("mdash", "\u2014"), ("middot", "\u00b7"), ("amp", "&")):  # the references that the pages hold, the ampersand last
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};?', '{_text}', 'g')"


@query("html_text", f"SELECT page_id, trim(regexp_replace({_DECODED}, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ') AS text FROM pages")
def html_text(spark, folder):
    return X.table(spark, folder, "pages").select("page_id", S.strip_html(F.col("html")).alias("text"))


@query("page_links_first_by_target", "SELECT page_id, link, CAST(min(n) AS INT) AS n FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS n FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)) GROUP BY 1, 2")
def page_links_first_by_target(spark, folder):
    rows = X.table(spark, folder, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("n", "link"))
    return rows.groupBy("page_id", "link").agg(F.min("n").alias("n"))


@query("json_navigation", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_navigation(spark, folder):
    k = F.from_json("props", "k int")["k"]
    return X.table(spark, folder, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("first_publication", "SELECT * FROM (VALUES ('/a', '2019-01-02T09:00:00Z', 'first', 2), ('/b', '2020-05-05T00:00:00Z', NULL, 0)) AS v(path, published, note, changes)")
def first_publication(spark, folder):
    rows = [
        ("/a", '{"first_published_at": "2021-01-01T00:00:00Z", "details": {"change_history": [{"public_timestamp": "2020-02-02T10:00:00Z", "note": "second"}, {"public_timestamp": "2019-01-02T09:00:00Z", "note": "first"}]}}'),
        ("/b", '{"first_published_at": "2020-05-05T00:00:00Z", "details": {}}'),
    ]
    return V.first_publication(spark.createDataFrame(rows, "path string, payload string"))


@query("stratified_shortlist", "WITH r AS (SELECT o_orderpriority AS family, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS round FROM orders), t AS (SELECT *, row_number() OVER (ORDER BY round, family) AS place FROM r) SELECT family, id, CAST(round AS INT) AS round, CAST(place AS INT) AS place FROM t WHERE place <= 25")
def stratified_shortlist(spark, folder):
    rows = X.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return V.round_robin(rows, "family", ["o_orderdate", "id"], 25).select("family", "id", "round", "place")


@query("first_by_evidence", "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY lower(substr(text, 1, 80)) ORDER BY item_id) AS k FROM (SELECT * FROM benchmark UNION ALL SELECT item_id + 1000000, upper(text) FROM benchmark WHERE item_id % 2 = 0 AND text = regexp_replace(text, '[^a-zA-Z ,.]', '', 'g'))) WHERE k = 1")
def first_by_evidence(spark, folder):
    rows = X.table(spark, folder, "benchmark")
    again = rows.where((F.col("item_id") % 2 == 0) & (F.col("text") == F.regexp_replace("text", "[^a-zA-Z ,.]", ""))).select((F.col("item_id") + 1000000).alias("item_id"), F.upper("text").alias("text"))
    return V.first_by_evidence(rows.unionByName(again), "text", [F.col("item_id")]).select("item_id")


@query("completeness_grid", "WITH h AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1, 2) SELECT a.r AS \"row\", b.c AS col, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT o_orderpriority AS r FROM orders) a CROSS JOIN (SELECT * FROM (VALUES ('F'), ('O'), ('P'), ('X')) AS v(c)) b LEFT JOIN h ON h.r = a.r AND h.c = b.c")
def completeness_grid(spark, folder):
    rows = X.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("row"), F.col("o_orderstatus").alias("col"), "o_totalprice")
    return V.grid(rows.where("o_totalprice > 300000"), rows.select("row").distinct(), spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "col string"))


@query(
    "discovery_score",
    """WITH f AS (SELECT DISTINCT o_custkey AS family, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 40),
s AS (SELECT CASE WHEN f.family IS NOT NULL THEN 'found' WHEN o_custkey IN (SELECT family FROM f) THEN 'misdated' ELSE 'missed' END AS state FROM orders LEFT JOIN f ON f.family = o_custkey AND f.month = strftime(o_orderdate, '%Y-%m')),
n AS (SELECT CAST(count(CASE WHEN state = 'found' THEN 1 END) AS BIGINT) AS found, CAST(count(CASE WHEN state = 'misdated' THEN 1 END) AS BIGINT) AS misdated, CAST(count(CASE WHEN state = 'missed' THEN 1 END) AS BIGINT) AS missed, CAST(count(*) AS BIGINT) AS total FROM s)
SELECT *, round((found + misdated) / CAST(total AS DOUBLE), 6) AS coverage, round(found / CAST(found + misdated AS DOUBLE), 6) AS date_accuracy FROM n""",
)
def discovery_score(spark, folder):
    """Orders stand for dated instruments, their customers for families; large returned items, dated by shipment, are the finds."""
    orders, month = X.table(spark, folder, "orders"), lambda c: F.date_format(c, "yyyy-MM")
    reference = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), month("o_orderdate").alias("month"))
    items = X.table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), month("l_shipdate").alias("month"))
    found = items.join(orders.select("o_orderkey", F.col("o_custkey").alias("family")), "o_orderkey").select("family", "month")
    return V.discovery_score(reference, found).withColumns({c: F.round(c, 6) for c in ("coverage", "date_accuracy")})


_SCALARS = [(" bt.a. ", "a; b ;;c", "YES", "2018-11-??", "https://x.org/a"), ("vod", "", "n", "2019-0?-1?", "https://x.org"), ("", None, "maybe", "2020-02-03", "ftp://x/y"), (None, " ; ", None, None, None)]


@query(
    "scalar_functions",
    "SELECT * FROM (VALUES (0, 'BT-A.L', 'a|b|c', 'true', DATE '2018-11-01', CAST(NULL AS DATE), CAST(NULL AS VARCHAR), 'bt-a'), (1, 'VOD.L', '', 'false', CAST(NULL AS DATE), CAST(NULL AS DATE), 'bare domain', 'vod'), (2, NULL, '', NULL, DATE '2020-02-01', DATE '2020-02-03', 'not http(s)', 'event'), (3, NULL, '', NULL, NULL, NULL, 'blank', 'event')) AS v(id, symbol, items, flag, month, day, url, slug)",
)
def scalar_functions(spark, folder):
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(_SCALARS)], "id int, a string, b string, c string, d string, e string")
    a, b, c, d, e = map(F.col, "abcde")
    return frame.select("id", S.listed_symbol(a).alias("symbol"), F.array_join(S.parse_list(b), "|").alias("items"), S.parse_bool(c).cast("string").alias("flag"), S.partial_month(d).alias("month"), S.exact_day(d).alias("day"), S.url_issue(e).alias("url"), S.slug(a).alias("slug"))


#: The cells of a dictionary of events, from orders, with every defect that the checks know: ``k`` is the order's number, ``d`` its date as text.
_CELLS = {
    "event_id": "'o' || CAST(k - CASE WHEN k % 101 = 1 THEN 1 ELSE 0 END AS STRING)",
    "date": "CASE WHEN k % 47 = 6 THEN 'bad' ELSE d END",
    "announcement_timestamp_utc": "CASE WHEN k % 23 = 0 THEN d || 'T00:00:00Z' WHEN k % 29 = 1 THEN 'soon' WHEN k % 31 = 2 THEN d || 'T10:00:00' WHEN k % 37 = 3 THEN ' ' WHEN k % 41 = 4 THEN d || 'T23:30:00Z' WHEN k % 43 = 5 THEN d || 'T00:30:00+01:00' ELSE d || 'T09:00:00+00:00' END",
    "policy": "CASE WHEN k % 7 = 0 THEN ' ' ELSE o_orderstatus END",
    "source_url": "CASE k % 11 WHEN 0 THEN 'https://x.org' WHEN 1 THEN '' WHEN 2 THEN 'mailto:z' ELSE 'https://x.org/a' END",
    "anticipation_risk": "CASE WHEN k % 5 = 0 THEN 'High' WHEN k % 13 = 1 THEN '' WHEN k % 17 = 2 THEN 'severe' ELSE 'low' END",
    "expected_direction": "CASE k % 19 WHEN 0 THEN 'up' WHEN 1 THEN '' ELSE 'Positive' END",
    "affected_sectors": "CASE WHEN k % 9 = 0 THEN ' ; ' ELSE 's;t' END",
    "direction": "CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'sideways' ELSE 'tighten' END",
    "time_known": "CASE k % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END",
    "confounders": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'budget' ELSE '' END",
    "leak_note": "CASE WHEN k % 4 = 0 THEN 'briefed' ELSE '' END",
    "notes": "CASE WHEN k % 3 = 0 THEN 'seen' ELSE '' END",
}
_BASE = "SELECT o_custkey AS customer, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, o_orderstatus, o_orderpriority FROM "
_FOUND = (
    ("NOT regexp_matches(source_url, '^https?://[^/]')", "source_url", "missing or not http(s)", True), ("regexp_matches(source_url, '^https?://[^/]+/*$')", "source_url", "bare domain", False),
    ("trim(stamp) = ''", "announcement_timestamp_utc", "blank", True), ("trim(stamp) <> '' AND ts IS NULL", "announcement_timestamp_utc", "not a timestamp", True), ("ts IS NOT NULL AND NOT zoned", "announcement_timestamp_utc", "no offset", True),
    ("zoned AND CAST(ts AS TIME) = TIME '00:00:00' AND time_known = ''", "time_known", "midnight without time_known", False), ("zoned AND CAST(ts AS TIME) = TIME '00:00:00' AND time_known = 'yes'", "time_known", "known time at midnight", False),
    ("day IS NULL OR (zoned AND ts IS NOT NULL AND day <> london)", "date", "not the London date", True), ("zoned AND ts > TIMESTAMP '2001-01-01'", "announcement_timestamp_utc", "in the future", False), ("trim(policy) = ''", "policy", "blank", True),
    *[(f"trim({c}) = ''", c, "blank", True) for c in ("anticipation_risk", "expected_direction", "direction")],
    *[(f"trim({c}) <> '' AND lower({c}) NOT IN {allowed}", c, "unknown value", True) for c, allowed in (("anticipation_risk", ("low", "medium", "high")), ("expected_direction", ("positive", "negative", "ambiguous")), ("direction", ("tighten", "loosen")))],
    ("trim(replace(affected_sectors, ';', ' ')) = ''", "affected_sectors", "blank", True), ("lower(anticipation_risk) = 'high'", "anticipation_risk", "high", False), ("lower(anticipation_risk) = 'high' AND leak_note = '' AND notes = ''", "leak_note", "high risk without a note", False),
)


@query(
    "event_dictionary_issues",
    f"""WITH e AS (SELECT customer, {', '.join(f'{x} AS "{c}"' for c, x in _CELLS.items())} FROM ({_BASE} orders)),
z AS (SELECT *, announcement_timestamp_utc AS stamp, try_strptime(left(announcement_timestamp_utc, 19), '%Y-%m-%dT%H:%M:%S') - CASE WHEN announcement_timestamp_utc LIKE '%+01:00' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS ts, trim(announcement_timestamp_utc) = '' OR regexp_matches(announcement_timestamp_utc, '(Z|[+-]\\d\\d:?\\d\\d)$') AS zoned, try_cast("date" AS DATE) AS day FROM e),
p AS (SELECT *, CAST(timezone('Europe/London', timezone('UTC', ts)) AS DATE) AS london FROM z),
g AS (SELECT event_id, floor((epoch(ts) - epoch(lag(ts) OVER w)) / 86400) AS gap, confounders, lag(confounders) OVER w AS c2 FROM p WHERE ts IS NOT NULL AND zoned WINDOW w AS (PARTITION BY customer ORDER BY ts, event_id))
{' UNION ALL '.join(f"SELECT event_id, '{c}' AS {chr(34)}column{chr(34)}, '{m}' AS message, {str(fatal).lower()} AS fatal FROM p WHERE {x}" for x, c, m, fatal in _FOUND)}
UNION ALL SELECT event_id, 'announcement_timestamp_utc', 'too close to the event before', true FROM g WHERE gap < 14 AND confounders = '' AND c2 = ''
UNION ALL SELECT event_id, 'event_id', 'duplicate', true FROM e GROUP BY event_id HAVING count(*) > 1""",
)
def event_dictionary_issues(spark, folder):
    """All orders as dictionaries of events, one a customer."""
    rows = X.table(spark, folder, "orders").selectExpr(*_BASE.removeprefix("SELECT ").removesuffix(" FROM ").split(", ")).select("customer", *[F.expr(x).alias(c) for c, x in _CELLS.items()])
    return C.event_issues(rows, "2001-01-01 00:00:00", 14, "customer")


@query("exposure_input_issues", "SELECT * FROM (VALUES ('u2', 'value', 'not a number', true), ('u2', 'knowable_from', 'before the as-of date', true), ('u3', 'value', 'blank', true), ('u3', 'as_of_date', 'not a date', true), ('u3', 'source_url', 'blank', true), ('u4', 'knowable_from', 'long disclosure lag', false)) AS v(unit_id, \"column\", message, fatal)")
def exposure_input_issues(spark, folder):
    rows = [("u1", "a", "1.5", "2020-12-31", "2021-03-15", "s"), ("u2", "a", "x", "2020-12-31", "2020-03-15", "s"), ("u3", "a", " ", "31/12/2020", "2021-03-15", ""), ("u4", "a", "2", "2018-12-31", "2021-03-15", "s")]
    return C.attribute_issues(spark.createDataFrame(rows, "unit_id string, attribute string, value string, as_of_date string, knowable_from string, source_url string"))


@query(
    "status_resolution",
    """WITH n AS (SELECT n_name AS u, n_nationkey AS k FROM nation), e AS (SELECT * FROM (VALUES ('e1', DATE '2000-01-10', 'x'), ('e2', DATE '2001-01-10', 'y')) AS v(id, d, tag))
SELECT id AS event_id, u AS unit_id, CASE WHEN k % 5 = 4 AND d > DATE '2000-06-30' THEN 'dropped' WHEN k % 5 = 3 AND d BETWEEN DATE '2001-01-01' AND DATE '2001-01-10' THEN 'dropped' WHEN k % 5 = 2 AND tag = 'x' THEN 'error' WHEN k % 5 = 1 AND tag = 'x' THEN 'treated' ELSE 'donor' END AS status,
CASE WHEN k % 5 = 4 AND d > DATE '2000-06-30' THEN 'not available' WHEN k % 5 = 3 AND d BETWEEN DATE '2001-01-01' AND DATE '2001-01-10' THEN 'excluded: bid' WHEN k % 5 = 2 AND tag = 'x' THEN 'conflicting overrides' END AS reason FROM n CROSS JOIN e""",
)
def status_resolution(spark, folder):
    nation = X.table(spark, folder, "nation")
    k = F.col("n_nationkey") % 5
    units = nation.select(F.col("n_name").alias("unit_id"), F.lit("donor").alias("status"), F.lit(None).cast("date").alias("first"), F.when(k == 4, F.lit("2000-06-30").cast("date")).alias("last"))
    events = spark.sql("SELECT * FROM VALUES ('e1', DATE '2000-01-10', array(' X ')), ('e2', DATE '2001-01-10', array('y')) AS v(event_id, day, tags)")
    overrides = nation.where(k.isin(1, 2)).select(F.col("n_name").alias("unit_id"), F.lit("treated").alias("status"), F.array(F.lit("x")).alias("tags"), F.array().cast("array<string>").alias("ids"))
    overrides = overrides.unionByName(nation.where(k == 2).select(F.col("n_name").alias("unit_id"), F.lit("excluded").alias("status"), F.array().cast("array<string>").alias("tags"), F.array(F.lit("e1")).alias("ids")))
    exclusions = nation.where(k == 3).select(F.col("n_name").alias("unit_id"), F.lit("2001-01-01").cast("date").alias("start"), F.lit("2001-01-10").cast("date").alias("end"), F.lit("bid").alias("why"))
    return U.resolve(events, units, overrides, exclusions)


@query(
    "exchange_by_suffix",
    """WITH l AS (SELECT c_custkey, upper(left(c_mktsegment, 3)) AS s, c_nationkey % 5 AS n FROM customer),
t AS (SELECT c_custkey AS unit_id, CASE n WHEN 0 THEN s || c_custkey || '.L' WHEN 1 THEN s || c_custkey WHEN 2 THEN s || '.C' || c_custkey || '.PA' WHEN 3 THEN s || c_custkey || '.XX' ELSE '^' || s || c_custkey END AS source_ticker, CASE WHEN n = 4 THEN '.L' WHEN n = 3 AND c_custkey % 4 = 0 THEN '.PA' END AS exchange FROM l),
k AS (SELECT *, coalesce(exchange, regexp_extract(source_ticker, '[.][^.]*$')) AS suffix FROM t)
SELECT unit_id, source_ticker, suffix, zone, CASE WHEN zone IS NULL THEN 'unknown suffix' END AS problem FROM (SELECT *, CASE suffix WHEN '.L' THEN 'Europe/London' WHEN '' THEN 'America/New_York' WHEN '.PA' THEN 'Europe/Paris' END AS zone FROM k)""",
)
def exchange_by_suffix(spark, folder):
    """Customers as listings: their nation deals a London, bare, Paris, unknown or index ticker, some with an exchange of their own."""
    key, n = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 5
    start = F.upper(F.left("c_mktsegment", F.lit(3)))
    forms = (F.concat(start, key, F.lit(".L")), F.concat(start, key), F.concat(start, F.lit(".C"), key, F.lit(".PA")), F.concat(start, key, F.lit(".XX")), F.concat(F.lit("^"), start, key))
    own = F.when(n == 4, ".L").when((n == 3) & (F.col("c_custkey") % 4 == 0), ".PA")
    listings = X.table(spark, folder, "customer").select(F.col("c_custkey").alias("unit_id"), F.element_at(F.array(*forms), (n + 1).cast("int")).alias("source_ticker"), own.alias("exchange"))
    known = spark.createDataFrame([(".L", "Europe/London"), ("", "America/New_York"), (".PA", "Europe/Paris")], "suffix string, zone string")
    return U.exchanges(listings, known)


@query("markdown_tables", "SELECT * FROM (VALUES ('f', 4, 'Levies', 'a|1'), ('f', 5, 'Levies', 'b|2'), ('f', 9, 'Bans', 'c|3')) AS v(file, n, heading, cells)")
def markdown_tables(spark, folder):
    lines = ["# Title", "", "## Levies", "| --- | --- |", "| a | 1 |", "| b | 2 |", "text", "## Bans", "|:--|--:|", "| c | 3 |"]
    frame = spark.createDataFrame([("f", n, line) for n, line in enumerate(lines)], "file string, n int, line string")
    return V.carry_headings(frame, "file").withColumn("cells", F.array_join("cells", "|"))


_STAGED = [(stage, markers) for stage, markers in V.STAGES]


_CANDIDATES = _SENT + f""", c AS (SELECT * FROM s WHERE NOT {_APPARATUS}),
b AS (SELECT doc_id, {', '.join(f"bool_or({_any(m)}) AS s{n}" for n, (_, m) in enumerate(_STAGED))}, bool_or({_any(V.LOOSEN)}) AS l, bool_or({_any(V.TIGHTEN)}) AS t, arg_max(sentence, struct_pack(a := length(sentence), b := sentence)) AS evidence FROM c GROUP BY doc_id),
g AS (SELECT *, list_filter([{', '.join(f"CASE WHEN s{n} THEN '{stage}' END" for n, (stage, _) in enumerate(_STAGED))}], lambda x: x IS NOT NULL) AS stages FROM b),
i AS (SELECT *, coalesce(list_filter(stages, lambda x: x IN ({', '.join(f"'{x}'" for x in V.NEWSWORTHY)}))[1], stages[1], '') AS stage FROM g),
d AS (SELECT *, CASE stage {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STAGE_DIRECTION.items())} ELSE '' END AS base FROM i)
"""


@query("candidate_stages", _CANDIDATES + "SELECT doc_id, list_aggregate(stages, 'string_agg', '|') AS stages, stage, CASE WHEN l AND NOT t THEN 'loosen' WHEN t AND NOT l THEN CASE WHEN base = '' THEN 'tighten' ELSE base END ELSE base END AS direction, evidence FROM d WHERE len(stages) > 0")
def candidate_stages(spark, folder):
    out = V.candidates(_sentences(spark, folder), "doc_id").where(F.size("stages") > 0)
    return out.withColumn("stages", F.array_join("stages", "|"))


_DEFER = (("scheme", ("scheme", "tion")), ("target", ("target", "ing ")), ("rest", ("es ",)))
_YEARED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sentence || ' It was delayed in 2015.' WHEN doc_id % 3 = 1 THEN sentence || ' It is shelved.' ELSE sentence END AS sentence FROM s"


@query("deferral_counts", _SENT + f", y AS ({_YEARED}), k AS (SELECT sentence FROM y WHERE {_any(V.DEFERRALS)} AND NOT {_APPARATUS}) SELECT coalesce(family, 'undated') AS family, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN NOT regexp_matches(sentence, '\\b(?:19|20)\\d{{2}}\\b') THEN NULL {' '.join(f'WHEN {_any(t)} THEN {chr(39)}{n}{chr(39)}' for n, t in _DEFER)} ELSE '_unattributed' END AS family FROM k) GROUP BY 1")
def deferral_counts(spark, folder):
    rows = _sentences(spark, folder)
    tail = F.when(F.col("doc_id") % 3 == 0, " It was delayed in 2015.").when(F.col("doc_id") % 3 == 1, " It is shelved.").otherwise("")
    return V.deferrals(rows.withColumn("sentence", F.concat("sentence", tail)), _DEFER).groupBy(F.coalesce("family", F.lit("undated")).alias("family")).agg(F.count("*").alias("n"))


@query(
    "announcement_filter",
    "SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n, CAST(min(gap) AS BIGINT) AS least_gap, CAST(max(gap) AS BIGINT) AS most_gap FROM (SELECT CASE WHEN kind NOT IN ('press_release', 'news_story', 'speech') THEN 'type' WHEN day < DATE '2013-01-01' THEN 'date' WHEN regexp_matches(title, 'explained|in demand') THEN 'title' END AS reason, doc_id % 97 AS gap FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'press_release' WHEN 1 THEN 'news_story' WHEN 2 THEN 'guidance' ELSE 'speech' END AS kind, CAST(DATE '2012-01-01' + CAST(doc_id % 3000 AS INT) AS DATE) AS day, CASE doc_id % 5 WHEN 0 THEN 'boilers in demand' WHEN 1 THEN 'the rules explained' ELSE 'a decision' END AS title FROM documents)) GROUP BY 1",
)
def announcement_filter(spark, folder):
    docs = X.table(spark, folder, "documents").select("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("press_release", "news_story", "guidance", "speech"))), (F.col("doc_id") % 4 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 5 == 0, "Boilers IN demand").when(F.col("doc_id") % 5 == 1, "The rules explained").otherwise("A decision")
    day = F.date_add(F.lit("2012-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int"))
    first = F.lit("2020-01-01 00:00:00").cast("timestamp")
    gap = V.redating_gap(F.timestamp_seconds(F.unix_seconds(first) + F.col("doc_id") % 97 * 86400 + 3600), first)
    rows = docs.select(V.announcement_reason(kind, day, title).alias("reason"), gap.alias("gap"))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"))
