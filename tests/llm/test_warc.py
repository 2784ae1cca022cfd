"""The archive against a parser of WARC files written here, and on awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.store import Workspace

PAGES = "page_id long, url string, html string, record long, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7, "x") for i, u, h in rows], PAGES)


def parsed(raw: bytes):
    """Fields and block of one record, by the standard's grammar."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    assert rest[len(block) :] == b"\r\n\r\n"
    return fields, block


ROWS = [(3, "http://a/\r\nX: y", "é" * 600), (9, "http://b", "é" * 600), (5, None, "é" * 600), (9, "http://b", "é" * 600), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "v", "z" * 1000), (-8, "v", "z" * 1000), (7, "w", "q" * 3_000_000), (8, "w", "w" * 999), (10, "w", "w" * 999)]


def test_records_come_back_whole(spark):
    heads, payloads = warc.archive(spark, pages(spark, ROWS))
    assert payloads.count() == len({h or "" for _, _, h in ROWS})
    read = [(bytes(r["bytes"]), bytes(r["payload"])) for r in warc.restore(heads, payloads).collect()]
    got = [(*parsed(raw), payload) for raw, payload in read]
    assert sorted(p for *_, p in got) == sorted((h or "").encode() for _, _, h in ROWS)
    byid = {f["WARC-Record-ID"]: (f, b, p) for f, b, p in got}
    assert len(byid) == len(ROWS)
    for f, block, payload in got:
        http, body = block.split(b"\r\n\r\n", 1)
        assert f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(payload).hexdigest() and http.startswith(b"HTTP/1.1 200")
        if f["WARC-Type"] == "revisit":
            first, _, same = byid[f["WARC-Refers-To"]]
            assert body == b"" and same == payload and first["WARC-Type"] == "response"
        else:
            assert body == payload
    assert {f.get("WARC-Target-URI") for f, *_ in got} == {"http://a/%0D%0AX: y", "http://b", None, "u", "v", "w"}


def test_round_trip_of_awkward_rows(spark):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages(spark, ROWS)).collect()), key=str)
    seen, want = set(), []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        same = [j for j, _, k in ROWS if (k or "").encode() == raw]
        top = max(same, key=lambda x: -(10**9) if x is None else x)
        first = len(raw) < 1000 or (i == top and (i, raw) not in seen)
        seen.add((i, raw))
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else top))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, pages(spark, [])).collect() == []


def test_digests_of_two_payloads_and_spoilt_bytes_are_refused(spark):
    table = pages(spark, ROWS)
    with pytest.raises(ValueError, match="more than one payload"):
        warc.archive(spark, table, digest=lambda p: (F.octet_length(p) % 7).cast("string"), ws=Workspace(spark, "t"))
    heads, payloads = warc.archive(spark, table)
    with pytest.raises(Exception, match="not that of its digest"):
        warc.restore(heads, payloads.withColumn("payload", F.concat("payload", F.lit(b"x")))).collect()
    with pytest.raises(Exception, match="no payload of digest"):
        warc.restore(heads, payloads.where(F.octet_length("payload") != 5)).collect()


def test_many_copies_are_stored_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("c" * 2000)).otherwise(F.concat(F.col("id").cast("string"), F.lit("d" * 1500))).alias("html"))
    heads, payloads = warc.archive(spark, rows)
    assert payloads.count() == 2001 and payloads.agg(F.max("n_records")).first()[0] == 1000
    out = warc.round_trip(spark, rows)
    assert out.where("record_type = 'revisit' and refers_to = 2997").count() == 999 and out.where("record_type = 'response'").count() == 2001
