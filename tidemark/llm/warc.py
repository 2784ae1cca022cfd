"""A content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256; the exact header text of
every record is kept apart, one row a record; the original records come back
through a join on the digest.

Plan
1. ``index``: one narrow row a page (record number, sizes, digests), written
   once so that record numbers are settled.
2. Per digest the record of the largest page_id, by a partially aggregated
   maximum over narrow rows, whatever the number of copies.  Only digests that
   several records share go into the join that names the record referred to;
   its hot digests are split by Spark's adaptive skew join.
3. ``heads``: the header block of each record as it stands in a WARC file.
4. ``payloads``: grouped by the digest and by the bytes themselves, so that
   copies collapse before the shuffle and the grouping compares every byte.  A
   digest that ends with two rows stands for two payloads: the archive is
   refused before anything is restored from it.
5. ``restore`` joins both tables, hashes each payload again and refuses bytes
   that are not those of their digest.

Cases: a null html is an empty payload; a null url leaves out the target line,
line breaks in one are percent-encoded; repeated rows are records of their own,
of which one is the response; a null page_id sorts below all others; an empty
table gives an empty archive; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import Workspace, merging

LEAST_REVISIT = 1000  #: bytes from which an equal payload is a revisit
DATE = "1970-01-01T00:00:00Z"  #: pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n"

_URN = "urn:x-page:"


def strong(payload: Column) -> Column:
    return F.sha2(payload, 256)


def _urn(page: Column, record: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), record.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def archive(spark: SparkSession, pages: DataFrame, *, name: str = "warc", least: int = LEAST_REVISIT, date: str = DATE, digest: Callable[[Column], Column] = strong, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the records of ``pages`` (page_id, url, html): header rows (record, digest, head) and payload rows (digest, payload, n_records).

    Of records with equal payloads of at least ``least`` bytes the one of the
    largest page_id is a response and the others revisit it.
    """
    ws = ws or Workspace(spark, name)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    hashed = pages.withColumn("digest", digest(F.col("payload")))
    index = ws.save(hashed.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes")), "index")

    large = index.where(F.col("n_bytes") >= least)
    shared = large.groupBy("digest").agg(F.max(F.struct("page_id", "record", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    named = index.join(merging(shared.select("digest", "first")), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record") != F.col("record"))
    length = F.octet_length(F.lit(HTTP)) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("record"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first.page_id"), F.col("first.record")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, _uri(F.col("first.url")))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(END),
    )
    heads = ws.save(named.select("record", "digest", head.alias("head")), "heads")
    ws.drop(index)

    payloads = ws.save(hashed.groupBy("digest", "payload").agg(F.count("*").alias("n_records")), "payloads")
    doubled = payloads.groupBy("digest").count().where("count > 1").select("digest").take(3)
    if doubled:
        raise ValueError(f"digests that stand for more than one payload: {[row['digest'] for row in doubled]}")
    return heads, payloads


def restore(heads: DataFrame, payloads: DataFrame, digest: Callable[[Column], Column] = strong) -> DataFrame:
    """The original records: record, head, block (what follows the header), payload (of revisits too), bytes (the record as in a file)."""
    sound = F.when(digest(F.col("payload")) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored payload is not that of its digest "), F.col("digest"))).cast("binary"))
    # a header without its payload would be lost by an inner join; it is refused as well
    joined = heads.join(merging(payloads.select("digest", sound.alias("payload"))), "digest", "left")
    whole = F.coalesce(F.col("payload"), F.raise_error(F.concat(F.lit("no payload of digest "), F.col("digest"))).cast("binary"))
    joined = joined.withColumn("payload", whole)
    body = F.when(F.col("head").startswith(f"WARC/1.1{END}WARC-Type: revisit{END}"), F.lit(b"")).otherwise(F.col("payload"))
    block = F.concat(F.lit(HTTP.encode()), body)
    end = F.lit((END * 2).encode())
    return joined.select("record", "head", block.alias("block"), "payload", F.concat(F.col("head").cast("binary"), block, end).alias("bytes"))


def field(name: str, head: Column | None = None) -> Column:
    """A named field of a header block, null where it has none."""
    found = F.regexp_extract(F.col("head") if head is None else head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def page_of(urn: Column) -> Column:
    """The page_id in a record's name, null where it bears none."""
    return F.regexp_extract(urn, rf"^<{_URN}(-?[0-9]+):", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, name: str = "warc") -> DataFrame:
    """Archive the pages, read the records back and describe each from what was read."""
    records = restore(*archive(spark, pages, name=name))
    revisit = field("WARC-Type") == "revisit"
    return records.select(
        page_of(field("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(revisit, page_of(field("WARC-Refers-To"))).alias("refers_to"),
    )
