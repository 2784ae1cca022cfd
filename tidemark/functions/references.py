"""Character references of HTML decoded inside expressions, once and in one pass.

A text is split at its references; each reference is decoded by itself, so that
what a decoded one spells (``&amp;lt;``) is never decoded again.  The names and
the replacements of disallowed numbers are those of the Python library's table
of HTML 5.
"""

from __future__ import annotations

import html.entities
import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0c <&#;]{1,32};?)"


BUCKETS = 1024  #: of the table of names, so that a look-up compares a few


def _table() -> Column:
    """The names' texts as maps, each name in the map that its checksum points at."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, text in html.entities.html5.items():
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = text
    # one literal, parsed once when the plan is made
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")


def _named(name: Column, table: Column) -> Column:
    """The text of a name, or of its longest beginning that is one, with what follows it; null if there is none."""

    def known(part: Column) -> Column:
        return F.get(table, (F.crc32(part.cast("binary")) % BUCKETS).cast("int"))[part]

    lengths = F.sequence(F.char_length(name) - 1, F.lit(2), F.lit(-1))
    at = F.get(F.filter(lengths, lambda n: known(F.substring(name, F.lit(1), n)).isNotNull()), F.lit(0))
    begun = F.concat(known(F.substring(name, F.lit(1), at)), F.substring(name, at + 1, F.char_length(name)))
    return F.coalesce(known(name), F.when(F.char_length(name) > 2, begun))


#: What the numbers 128 to 159 stand for, by the Windows code page, where it has a character.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}


def _numbered(number: Column) -> Column:
    """The character of a number; numbers that name none are the replacement character, controls and noncharacters nothing."""
    spelt = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    out = F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("�"))
    out = out.when(number == 13, F.lit("\r"))
    out = out.when(number.between(128, 159), F.get(F.array(*[F.lit(text or chr(n)) for n, text in _WINDOWS.items()]), (number - 128).cast("int")))
    nothing = number.between(1, 8) | number.isin(11, 127) | number.between(14, 31) | number.between(0xFDD0, 0xFDEF) | ((number % 0x10000) >= 0xFFFE)
    return out.when(nothing, F.lit("")).otherwise(spelt)


def _decoded(reference: Column, table: Column) -> Column:
    inner = F.substring(reference, F.lit(2), F.char_length(reference))
    bare = F.rtrim(inner, F.lit(";"))
    digits = F.when(F.lower(F.substring(bare, 2, 1)) == "x", F.conv(F.ltrim(F.substring(bare, F.lit(3), F.char_length(bare)), F.lit("0")), 16, 10)).otherwise(F.ltrim(F.substring(bare, F.lit(2), F.char_length(bare)), F.lit("0")))
    # beyond nine digits a number is no character, however long
    number = F.when(F.char_length(digits) > 9, F.lit(0x110000).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.when(F.substring(inner, 1, 1) == "#", _numbered(number)).otherwise(F.coalesce(_named(inner, table), reference))


def unescape(text: Column) -> Column:
    """``text`` with its character references decoded; null stays null."""
    pieces = F.split(text, PATTERN, -1)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    table = _table()
    decoded = F.zip_with(pieces, found, lambda piece, reference: F.concat(piece, F.coalesce(_decoded(reference, table), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)
