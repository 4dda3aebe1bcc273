"""Streams give the rows of their SQL whatever order the log is in and however small the Arrow batches are; whole keys."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from __spark_entry__ import registry
from playlens.functions import text as tx
from playlens.operators import dedupe as dd, reports as rp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shuffled(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shuffled")
    for name in os.listdir(SF):
        if not name.startswith("event"):
            os.symlink(f"{SF}/{name}", folder / name)
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/events.parquet' ORDER BY hash(event_id)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_throttle", "stream_reports", "stream_verdicts"])
def test_streams_do_not_depend_on_order(spark, shuffled, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        status, n, _, _, note = check.compare(spark, registry()[name], shuffled, check.connect(shuffled))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert status == "ok" and n > 0, note


def test_texts_that_differ_late_are_not_duplicates(spark):
    head = "x" * (300 * 1024)
    docs = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a")], "id long, text string")
    got = dd.duplicates(docs, dd.content_key(F.col("text")), "id").collect()
    assert [(r.n, r.first) for r in got] == [(2, 1)]


def test_short_files_have_a_key(spark):
    files = spark.createDataFrame([("a", b"short"), ("b", b"short"), ("c", b"other")], "path string, content binary").withColumn("length", F.octet_length("content"))
    keys = {r.path: r.hash for r in dd.end_hash(files).collect()}
    assert keys["a"] == keys["b"] != keys["c"] and None not in keys.values()


def test_kinds_that_share_their_beginning_stay_apart(spark):
    same = "e" * 60
    body = '{"stats":{"errors":[{"details":"%sA"},{"details":"%sB"}]}}' % (same, same)
    rows = rp.parse_reports(spark.createDataFrame([(1, body)], "id long, body string"))
    assert {r.kind for r in rp.error_kinds(rows, "id").collect()} == {same + "A", same + "B"}


def test_long_offsets_are_not_the_whole_file(spark):
    df = spark.createDataFrame([("bytes=0000000000000000000005-9",), ("bytes=12345678901234567890-",), ("bytes=-5",), ("bytes=-",)], "h string")
    got = [tuple(r.b) for r in df.select(tx.byte_range(F.col("h"), F.lit(100)).alias("b")).collect()]
    assert got == [(206, 5, 9), (416, None, None), (206, 95, 99), (200, None, None)]
