"""State of the streams over several batches: what is told, kept and forgotten, and that no key costs a call of its own."""

import pytest
from pyspark.sql import functions as F

from playlens.streaming import jobs

DAY, MS = 86_400_000_000, 1000


def stream(spark, folder, batches, schema):
    """One file a batch, in this order; ``at`` in microseconds is its time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return read.withColumn("ts", F.timestamp_micros("at"))


@pytest.mark.parametrize("offset, kept", [(-1, False), (0, False), (1, True), (500, True), (MS, True)])
def test_a_verdict_is_forgotten_to_the_microsecond(spark, tmp_path, offset, kept):
    end = 30 * DAY
    first = end - 3600 * 1000 * MS - 7 * DAY + offset
    rows = [(1, first, 1, "old"), (2, end + 999, 2, "new")]
    found = stream(spark, tmp_path, [rows], "key long, at long, event_id long, why string")
    got = {r.key: r.why for r in jobs.stream_verdicts(found, "1 hour").collect()}
    assert got == ({1: "old", 2: "new"} if kept else {2: "new"})


def test_the_last_verdict_of_several_batches(spark, tmp_path):
    batches = [
        [(1, 1 * DAY, 1, "a"), (2, 1 * DAY, 2, "gone"), (3, 1 * DAY, 3, "first")],
        [(1, 2 * DAY, 5, "b"), (1, 2 * DAY, 4, "c"), (4, 9 * DAY, 6, "x")],
        [(1, 3 * DAY, 7, "late"), (3, 20 * DAY, 8, "back"), (4, 20 * DAY, 9, "y")],
    ]
    found = stream(spark, tmp_path, batches, "key long, at long, event_id long, why string")
    assert {r.key: (r["at"], r.why) for r in jobs.stream_verdicts(found, "1 hour").collect()} == {3: (20 * DAY, "back"), 4: (20 * DAY, "y")}


def test_verdicts_are_aggregated_by_spark(spark, tmp_path, monkeypatch):
    plans = []
    drained = jobs.drain_batches
    monkeypatch.setattr(jobs, "drain_batches", lambda df, *a: plans.append(df._jdf.queryExecution().logical().toString()) or drained(df, *a))
    found = stream(spark, tmp_path, [[(1, DAY, 1, "a")]], "key long, at long, event_id long, why string")
    assert [tuple(r) for r in jobs.stream_verdicts(found, "1 hour").collect()] == [(1, DAY, "a")]
    assert len(plans) == 1 and "Python" not in plans[0] and "InPandas" not in plans[0]


BODY = '{"stats":{"browser":"b"}}'


def test_first_reports_over_several_batches(spark, tmp_path):
    batches = [
        [(1, 5 * DAY, 10, BODY), (1, 4 * DAY, 11, BODY), (2, 4 * DAY, 20, BODY), (None, 4 * DAY, 30, BODY)],
        # An earlier report that comes later is the third one taken; a session without an id is a session.
        [(1, 5 * DAY + 5, 12, BODY), (1, 5 * DAY, 13, BODY), (None, 5 * DAY, 32, BODY), (None, 5 * DAY, 31, BODY), (None, 5 * DAY, 33, BODY)],
        [(1, 6 * DAY, 14, BODY), (2, 30 * DAY, 21, BODY), (3, 30 * DAY, 40, "not json")],
        # Session 1 was forgotten a week after its last report, and starts anew, whatever the batches; 2 was not.
        [(1, 31 * DAY, i, BODY) for i in (15, 16, 17, 18)] + [(2, 31 * DAY, i, BODY) for i in (22, 23, 24)],
    ]
    bodies = stream(spark, tmp_path, batches, "session long, at long, event_id long, body string")
    got = sorted((r.session or 0, r.event_id) for r in jobs.stream_reports(bodies, "1 hour").collect())
    assert got == [(0, 30), (0, 31), (0, 32), (1, 10), (1, 11), (1, 13), (1, 15), (1, 16), (1, 17), (2, 20), (2, 21), (2, 22)]


def test_sessions_share_rows_of_state(spark, tmp_path, monkeypatch):
    plans = []
    drained = jobs.drain_batches
    monkeypatch.setattr(jobs, "drain_batches", lambda df, *a: plans.append(df._jdf.queryExecution().logical().toString()) or drained(df, *a))
    monkeypatch.setattr(jobs, "SESSION_BUCKETS", 2, raising=False)
    rows = [(s, DAY + i, 10 * s + i, BODY) for s in range(40) for i in range(5)]
    bodies = stream(spark, tmp_path, [rows[:90], rows[90:]], "session long, at long, event_id long, body string")
    got = sorted((r.session, r.event_id) for r in jobs.stream_reports(bodies, "1 hour").collect())
    assert got == [(s, 10 * s + i) for s in range(40) for i in range(3)]
    assert "'bucket" in plans[0] and "TransformWithState" not in plans[0]
