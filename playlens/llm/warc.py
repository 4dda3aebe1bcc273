"""WARC archives with revisit records, written and read back.

Headers alone are shuffled by payload digest to find each payload's first capture; payloads move once, to the archive
that they are written into, and only for the records that keep them. A revisit has no payload; it names the original.
The archives are text files of Spark's writer (gzip), each a sequence of records that end with an empty line; they are
read back whole by Spark's binary reader, record by record by Content-Length, and every payload is held against its digest.

Null html is the empty payload; null urls are written as ``about:blank``. Of rows that repeat a page id and payload, one
is the response. A page without an id comes after all others; white space and control characters in a url are escaped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from playlens.llm.common import text_of
from playlens.session import shared_dir

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LAST = (1 << 63) - 1


def base32(sha: Column) -> Column:
    """Of 40 hex digits: five of them are four digits to the base of 32."""
    each = (F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*each), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, sha) of every capture, without the payload."""
    html = text_of("html")
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha"))


def resolve(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``found`` with copy (which of the rows that repeat id and payload), original (page_id) and whether it is a revisit.

    Payloads under ``least_bytes`` are always responses. Equal payloads are those of equal digest and length.
    """
    rank = F.coalesce("page_id", F.lit(LAST))
    again = Window.partitionBy("page_id", "sha", "payload_bytes").orderBy("url")
    first = found.groupBy("sha", "payload_bytes").agg(F.min(rank).alias("original"))
    rows = found.withColumn("copy", F.row_number().over(again)).join(first, ["sha", "payload_bytes"])
    again = (rank != F.col("original")) | (F.col("copy") > 1)
    return rows.withColumn("revisit", again & (F.col("payload_bytes") >= least_bytes)).withColumn("original", F.when(F.col("original") != LAST, F.col("original")))


def _uuid(*of: Column) -> Column:
    h = F.md5(F.concat_ws("|", *of).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is null is left out."""
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in pairs))


def records(resolved: DataFrame, pages: DataFrame, date: str) -> DataFrame:
    """One text column: each row a whole record but for its closing empty line."""
    c = F.col
    who = lambda page: _uuid(F.coalesce(page.cast("string"), F.lit("none")), c("sha"))
    own = _uuid(F.coalesce(c("page_id").cast("string"), F.lit("none")), c("sha"), F.when(c("copy") > 1, c("copy").cast("string")))
    both = lambda kind, target: (
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", c("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(c("sha")))), ("X-Payload-Length", c("payload_bytes")), ("X-Page-ID", c("page_id")), *target,
    )
    revisit = _fields(
        *both("revisit", (("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", who(c("original"))), ("X-Refers-To-Page-ID", c("original")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.lit(len(HTTP))),
    )
    response = _fields(*both("response", ()), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", c("payload_bytes") + len(HTTP)))
    html = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("html").alias("html")).withColumn("sha", F.sha1(c("html").cast("binary")))
    # A capture that repeats id and payload needs the payload for one of its rows only.
    kept = resolved.filter(~c("revisit"))
    joined = kept.withColumn("page_key", F.coalesce("page_id", F.lit(LAST))).join(
        html.withColumn("page_key", F.coalesce("page_id", F.lit(LAST))).drop("page_id").dropDuplicates(["page_key", "sha"]), ["page_key", "sha"]
    )
    return joined.select(F.concat(response, F.lit(END + HTTP), c("html")).alias("value")).unionByName(
        resolved.filter("revisit").select(F.concat(revisit, F.lit(END + HTTP)).alias("value"))
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str | None = None) -> None:
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved = resolve(headers(pages), least_bytes)
    records(resolved, pages, date).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; raises where a record isn't one."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or stream.read(4) != END.encode():
            raise ValueError(f"{fields.get('WARC-Record-ID')} is cut short")
        yield fields, block


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for content in pdf["content"]:
            rows = []
            for fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response":
                    payload = block[block.index(END.encode()) + 4 :]
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']} doesn't hold what its digest says")
                page, original = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                rows.append((page and int(page), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], original and int(original), fields["WARC-Target-URI"]))
            got = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
            yield got.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_read, _READ)


def rewritten(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
