"""Scalar expressions: cells, tickers, dates, URLs, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.references import unescape

SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"

#: Accepted spellings of a yes and a no.
YES, NO = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")


def is_blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def parse_list(x: Column) -> Column:
    """Items of a ``;``-separated cell, trimmed, blanks left out; a null cell is an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), lambda i: F.trim(i)), lambda i: i != "")


def parse_bool(x: Column) -> Column:
    """True, false, or null for anything else."""
    low = F.lower(F.trim(x))
    return F.when(low.isin(*YES), True).when(low.isin(*NO), False)


def listed_symbol(x: Column) -> Column:
    """Exchange symbol of a London ticker: upper case, final dots dropped, inner dots as dashes, .L behind; null if blank."""
    core = F.regexp_replace(F.upper(F.trim(x)), r"\.+$", "")
    return F.when(core != "", F.concat(F.replace(core, F.lit("."), F.lit("-")), F.lit(".L")))


def slug(x: Column) -> Column:
    """The first five words, lower-cased and joined by dashes; ``event`` if there is none."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 5), "-"), F.lit("")), F.lit("event"))


def symbol_suffix(x: Column) -> Column:
    """What follows the last dot; empty without one."""
    return F.when(F.contains(x, F.lit(".")), F.concat(F.lit("."), F.substring_index(x, ".", -1))).otherwise("")


def cache_name(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("/"), F.lit("_")), F.lit("^"), F.lit("idx_"))


def url_issue(x: Column) -> Column:
    """'blank', 'not http(s)', 'bare domain', or null for a full address."""
    protocol, host, path = (F.try_parse_url(F.trim(x), F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH"))
    good = F.coalesce(F.lower(protocol).isin("http", "https"), F.lit(False)) & F.coalesce(host != "", F.lit(False))
    return F.when(is_blank(x), "blank").when(~good, "not http(s)").when(F.coalesce(F.regexp_replace(path, "/", ""), F.lit("")) == "", "bare domain")


def partial_month(x: Column) -> Column:
    """First day of the month of a date whose unknown parts are question marks."""
    return F.trunc(F.try_to_date(F.replace(F.replace(x, F.lit("??"), F.lit("01")), F.lit("?"), F.lit("0")), "yyyy-MM-dd"), "month")


def exact_day(x: Column) -> Column:
    """The day itself, where no part is unknown."""
    return F.when(~F.contains(x, F.lit("?")), F.try_to_date(x, "yyyy-MM-dd"))


def strip_html(x: Column) -> Column:
    """Text of a page: scripts and styles out, tags as spaces, character references decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(bare), SPACES, " "))


def sentences(x: Column, least: int = 40, most: int = 400) -> Column:
    """Sentences (split after . ! or ?) longer than ``least`` and shorter than ``most`` characters."""
    flat = F.trim(F.regexp_replace(x, "[ \\t\\n\\r\\f]+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: (F.length(s) > least) & (F.length(s) < most))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def month_year(x: Column) -> Column:
    """The first 'Month yyyy' of a sentence, or null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(x, rf"\b((?:{MONTHS})\s+(?:19|20)\d\d)", 1), r"\s+", " "), F.lit(""))


def has_any(x: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs, case aside; a disjunction that stays inside generated code."""
    low = F.lower(x)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def digit_density(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", "")) / F.greatest(F.length(x), F.lit(1))
