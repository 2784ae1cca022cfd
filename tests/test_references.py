"""Character references against the Python library's decoder."""

import html
import re

import pytest

from tidemark.functions import scalars
from tidemark.functions.references import unescape

CASES = ["", "no reference", "a & b &c", "&amp;lt; &amp;amp;amp;", "&lt;b&gt;&LT;x&AMP", "&notit; &notin; &not &noti", "&#65;&#x41;&#X41&#065;z", "&#0;&#13;&#128;&#x9f;&#129;&#150;", "&#xD800;&#x110000;&#99999999999999999999;", "&#1;&#11;&#31;&#xfdd0;&#xffff;&#x1fffe;", "&#x1F600;&nbsp;x&eacute;&Eacute;", "&ampamp; &amp&amp &;&&", "&fjlig;&NotEqualTilde;", "&unknown; &gtrsim;&gtx", "&a &ab", "&#;&#x;&#xg;", "x&", "&CounterClockwiseContourIntegral;", None, "&ampé&é;", "&#9;&#10;&#32;"]


def test_decoder_equals_the_library(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "k int, t string")
    got = dict(rows.select("k", unescape(rows["t"]).alias("t")).collect())
    for k, text in enumerate(CASES):
        assert got[k] == (None if text is None else html.unescape(text)), text


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_all_pages_equal_a_plain_reading(spark, size):
    pages = spark.read.parquet(f"/root/testdata/sf{size}/pages.parquet")
    for r in pages.select("html", scalars.strip_html(pages["html"]).alias("text")).toLocalIterator():
        bare = re.sub("<[^>]+>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ", r["html"]))
        assert r["text"] == re.sub(r"\s+", " ", html.unescape(bare)).strip()
