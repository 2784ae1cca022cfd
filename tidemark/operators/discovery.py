"""Rule-based mining of policy documents and of curated inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

# Words, patterns and markers that the results hang on.
INSTRUMENTS = (
    "consultation", "consulted", "regulations", "standard", "scheme", "strategy", "announced", "announcement", "laid before", "published", "response", "came into force",
    "launched", "closed", "extended", "amended", "uplift", "target", "commitment", "phase out", "phased out", "delayed", "scrapped",
)
FALSE_FRIENDS = ("industrial strategy", "department for business, energy", "energy and industrial")
CITATIONS = (
    r"\bPQ\s*\d", r"\bHC\s+Deb\b", r"\bHL\s+Deb\b", r"\bop\.?\s*cit\b", r"\bibid\b", r"https?://", r"\[subscription required\]", r"\bDeposited paper\b",
    r"^\s*\d{1,3}\s+[A-Z][a-z]+.{0,40},", r"\b(?:Financial Times|The Times|The Guardian|BBC News|Telegraph|Reuters)\b",
)
CONTENTS = (r"(?:\b\d{1,2}\.\d\b.*){3,}", r"(?:\s\d{1,3}\s){4,}", r"^\s*\d{1,3}\s+\d{1,2}\.\d", r"^\s*[A-Z][a-z]+ [A-Z][a-z]+ \d{1,3} Commons Library")
STAGES = (
    ("consultation_launch", ("consultation on", "consulted on", "sought views")),
    ("consultation_outcome", ("consultation response", "response to the consultation", "government response")),
    ("strategy", ("strategy", "roadmap", "plan")),
    ("regulations_laid", ("regulations", "laid before", "came into force", "statutory instrument")),
    ("scheme_launch", ("launched", "opened", "introduced", "came into effect")),
    ("scheme_amendment", ("amended", "uplift", "increased", "raised", "changed")),
    ("scheme_extension", ("extended", "extension")),
    ("scheme_closure", ("closed", "scrapped", "cancelled", "ended", "withdrawn")),
    ("target_change", ("target", "phase out", "phased out", "delayed", "pushed back", "commitment")),
    ("review", ("review", "evaluation", "reported on")),
)
NEWSWORTHY = ("consultation_outcome", "strategy", "scheme_launch", "scheme_amendment", "scheme_closure", "target_change")
STAGE_DIRECTION = {"scheme_launch": "tighten", "scheme_extension": "tighten", "scheme_amendment": "tighten", "strategy": "tighten", "scheme_closure": "loosen"}
LOOSEN = ("delay", "delayed", "scrap", "cancel", "clos", "withdraw", "push back", "pushed back", "rolled back", "roll back", "weaken", "exempt", "axe")
TIGHTEN = ("brought forward", "raise", "raised", "increase", "increased", "uplift", "extend", "extended", "strengthen", "mandate", "require")
DEFERRALS = (
    "delay", "delayed", "postpone", "postponed", "pushed back", "put back", "deferred", "defer", "scrapped", "scrap", "cancelled", "cancel", "abandoned", "dropped", "rolled back", "roll back",
    "watered down", "weakened", "exempt", "exemption", "no longer", "will not proceed", "not proceed", "shelved", "paused", "axed", "reversed", "u-turn", "moved back", "extended the deadline", "relaxed",
)
ANNOUNCEMENT_TYPES = ("press_release", "news_story", "speech", "written_statement", "oral_statement", "consultation_outcome", "policy_paper")
NOT_A_DECISION = (
    "applications surge", "applications up", "grant applications", "in demand", "demand for heat pumps", "reasons to get", "explained", "what you need to know", "case study", "statistics show",
    "research reveals", "satisfaction among",
)


def pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """(document columns, page, page_text): pages of a document, cut at form feeds, numbered from 1."""
    return documents.select(*[c for c in documents.columns if c != text], F.posexplode(F.split(F.col(text), "\f")).alias("page", "page_text")).withColumn("page", F.col("page") + 1)


def sentence_rows(documents: DataFrame, key: str, text: str, least: int = 40, most: int = 400) -> DataFrame:
    """(key, n, sentence): sentences of moderate length in order, numbered from 0."""
    return documents.select(key, F.posexplode(S.sentences(F.col(text), least, most)).alias("n", "sentence"))


def is_apparatus(x: Column) -> Column:
    """Citations, contents lines, page furniture and tables rather than prose."""
    out = S.has_any(x, FALSE_FRIENDS)
    for pattern in CITATIONS:
        out = out | x.rlike(f"(?im){pattern}")
    for pattern in CONTENTS:
        out = out | x.rlike(pattern)
    return out | x.rlike(r"^\s*\d{1,3}\s+[A-Z]") | (S.digit_density(x) > 0.12)


def stages(x: Column) -> Column:
    """The stages whose markers a text holds, in their fixed order."""
    return F.array_compact(F.array(*[F.when(S.has_any(x, markers), stage) for stage, markers in STAGES]))


def inferred_stage(found: Column) -> Column:
    """The first newsworthy stage, else the first; empty without any."""
    news = F.filter(found, lambda s: s.isin(*NEWSWORTHY))
    return F.coalesce(F.get(news, F.lit(0)), F.get(found, F.lit(0)), F.lit(""))


def proposed_direction(x: Column, stage: Column) -> Column:
    """loosen or tighten by marker words if only one kind occurs, else what the stage implies; empty if nothing does."""
    base = F.lit("")
    for name, direction in STAGE_DIRECTION.items():
        base = F.when(stage == name, direction).otherwise(base)
    loosen, tighten = S.has_any(x, LOOSEN), S.has_any(x, TIGHTEN)
    return F.when(loosen & ~tighten, "loosen").when(tighten & ~loosen, F.coalesce(F.nullif(base, F.lit("")), F.lit("tighten"))).otherwise(base)


def candidates(sentences: DataFrame, key: str) -> DataFrame:
    """(key, stages, stage, direction, evidence) over each key's clean sentences; the evidence is the longest, ties by text."""
    clean = sentences.where(~is_apparatus(F.col("sentence")))
    # whether any sentence holds a marker is what the joined text says, so flags meet in a partial aggregate and sentences never do
    flags = [F.bool_or(S.has_any(F.col("sentence"), markers)).alias(f"_s{n}") for n, (_, markers) in enumerate(STAGES)]
    a = clean.groupBy(key).agg(*flags, F.bool_or(S.has_any(F.col("sentence"), LOOSEN)).alias("_l"), F.bool_or(S.has_any(F.col("sentence"), TIGHTEN)).alias("_t"), F.max_by("sentence", F.struct(F.length("sentence"), "sentence")).alias("evidence"))
    a = a.withColumn("stages", F.array_compact(F.array(*[F.when(F.col(f"_s{n}"), stage) for n, (stage, _) in enumerate(STAGES)]))).withColumn("stage", inferred_stage(F.col("stages")))
    base = F.lit("")
    for name, direction in STAGE_DIRECTION.items():
        base = F.when(F.col("stage") == name, direction).otherwise(base)
    direction = F.when(F.col("_l") & ~F.col("_t"), "loosen").when(F.col("_t") & ~F.col("_l"), F.coalesce(F.nullif(base, F.lit("")), F.lit("tighten"))).otherwise(base)
    return a.select(key, "stages", "stage", direction.alias("direction"), "evidence")


def deferrals(sentences: DataFrame, families: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """(..., family): clean sentences of a deferral that name a year, under the first family whose terms they hold, else _unattributed; undated ones have family null."""
    x = F.col("sentence")
    family = F.lit("_unattributed")
    for name, terms in reversed(families):
        family = F.when(S.has_any(x, terms), name).otherwise(family)
    rows = sentences.where(S.has_any(x, DEFERRALS) & ~is_apparatus(x))
    return rows.withColumn("family", F.when(x.rlike(r"\b(?:19|20)\d{2}\b"), family))


def announcement_reason(kind: Column, published: Column, title: Column, since: str = "2013-01-01") -> Column:
    """Why a document is no dated decision: its type, its date, or its title; null if it may be one."""
    return F.when(~F.coalesce(kind.isin(*ANNOUNCEMENT_TYPES), F.lit(False)), "type").when(F.coalesce(published < F.lit(since).cast("date"), F.lit(True)), "date").when(F.coalesce(S.has_any(title, NOT_A_DECISION), F.lit(False)), "title")


def redating_gap(search: Column, first: Column) -> Column:
    """Whole days between the search stamp and the first publication."""
    return F.floor((F.unix_seconds(search) - F.unix_seconds(first)) / 86400)


def dated_references(sentences: DataFrame, key: str) -> DataFrame:
    """(key, month, sentence): sentences that name a month and an instrument and are no apparatus; the month as its first day."""
    month = S.month_year(F.col("sentence"))
    rows = sentences.withColumn("_m", month).where(F.col("_m").isNotNull() & S.has_any(F.col("sentence"), INSTRUMENTS) & ~is_apparatus(F.col("sentence")))
    return rows.select(key, F.to_date(F.concat(F.lit("1 "), "_m"), "d MMMM yyyy").alias("month"), "sentence")


def coverage(sentences: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """(family, mentions, clean, dated, share): how often each family's terms occur, outside apparatus, and there with a month, in one pass."""
    flags = [F.struct(F.lit(k).alias("family"), S.has_any(F.col("sentence"), terms).alias("hit")) for k, terms in sorted(families.items())]
    rows = sentences.select(is_apparatus(F.col("sentence")).alias("apparatus"), S.month_year(F.col("sentence")).isNotNull().alias("dated"), F.explode(F.array(*flags)).alias("f"))
    a = rows.groupBy(F.col("f.family").alias("family")).agg(F.count(F.when(F.col("f.hit"), 1)).alias("mentions"), F.count(F.when(F.col("f.hit") & ~F.col("apparatus"), 1)).alias("clean"), F.count(F.when(F.col("f.hit") & ~F.col("apparatus") & F.col("dated"), 1)).alias("dated"))
    return a.withColumn("share", F.coalesce(F.col("clean") / F.nullif("mentions", F.lit(0)), F.lit(0.0)))


def grid(hits: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(row, col, n): completeness grid of two enumerations with the hits of each cell, empty cells included."""
    counts = hits.groupBy("row", "col").agg(F.count("*").alias("n"))
    # two short enumerations: their product is the grid that is asked for
    return rows.crossJoin(columns).join(counts, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def round_robin(items: DataFrame, family: str, order: list[str], most: int) -> DataFrame:
    """Items picked one a family and round until ``most``, each family in the order of some columns: (columns, round, place).

    No family gives more than ``most``, so buckets of each are cut to that many
    before the families are ranked.
    """
    bucket = items.withColumn("_b", F.pmod(F.xxhash64(*items.columns), F.lit(1024)))
    few = bucket.withColumn("_r", F.row_number().over(Window.partitionBy(family, "_b").orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_b")
    ranked = few.withColumn("round", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("round") <= most)
    top = ranked.orderBy("round", family).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("round", family)))


def first_by_evidence(items: DataFrame, evidence: str, order: list[Column]) -> DataFrame:
    """One row for each lower-cased 80-character start of the evidence: the first by ``order``."""
    key = F.lower(F.substring(evidence, 1, 80))
    return items.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def reasons(items: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``items`` with the name of the first rule that rejects each, or null: nothing is dropped without a reason."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return items.withColumn("reason", out)


def discovery_score(reference: DataFrame, found: DataFrame) -> DataFrame:
    """(found, misdated, missed, total, coverage, date_accuracy): reference instruments (id, family, month) against finds (family, month).

    A reference is found if its family has a find in its month, misdated if only
    in another month, missed otherwise: one case expression, so a partition.
    """
    exact = found.select("family", "month").distinct().withColumn("_e", F.lit(True))
    loose = found.select("family").distinct().withColumn("_l", F.lit(True))
    state = F.when(F.col("_e"), "found").when(F.col("_l"), "misdated").otherwise("missed")
    rows = reference.join(exact, ["family", "month"], "left").join(loose, "family", "left").withColumn("state", state)
    n = {s: F.count(F.when(F.col("state") == s, 1)) for s in ("found", "misdated", "missed")}
    a = rows.agg(*[c.alias(s) for s, c in n.items()], F.count("*").alias("total"))
    seen = F.col("found") + F.col("misdated")
    return a.withColumn("coverage", F.coalesce(seen / F.nullif("total", F.lit(0)), F.lit(0.0))).withColumn("date_accuracy", F.coalesce(F.col("found") / F.nullif(seen, F.lit(0)), F.lit(0.0)))


def carry_headings(lines: DataFrame, key: str) -> DataFrame:
    """(key, n, heading, cells) of the table rows of Markdown lines (key, n, line), each under the heading above it."""
    heading = F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ +", ""))
    above = F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("heading", above).where(F.col("line").rlike(r"^\|") & ~F.col("line").rlike(r"^\|[ :|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select(key, "n", "heading", cells.alias("cells"))


def first_publication(payloads: DataFrame) -> DataFrame:
    """(path, published, note, changes): the earliest entry of a JSON change history, or the stated first publication."""
    shape = "first_published_at string, details struct<change_history: array<struct<public_timestamp: string, note: string>>>"
    j = payloads.select("path", F.from_json("payload", shape).alias("j")).select("path", "j.first_published_at", F.coalesce("j.details.change_history", F.array()).alias("h"))
    first = F.array_min(F.filter("h", lambda e: e["public_timestamp"].isNotNull()))
    return j.select("path", F.coalesce(first["public_timestamp"], "first_published_at").alias("published"), first["note"].alias("note"), F.size("h").alias("changes"))
