"""Structured Streaming forms of the session, limit, throttle, metric and report rules.

Sources are file streams; every query drains what there is (``availableNow``) into files under the shared folder, with its
checkpoint beside them, and hands back the sink as a DataFrame. State and sinks so outlive any executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from playlens.operators import reports as rp
from playlens.operators.sessions import LOG_EVERY, REPORTS_PER_SESSION, STARTS_PER_MINUTE, VERDICT_TTL, throttle
from playlens.session import ROCKSDB, shared_dir

_c = F.col
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def event_stream(spark: SparkSession, folder: str, name: str = "event*") -> DataFrame:
    """The event log as a stream. A glob, since a file stream reads a folder; zone-less times become instants."""
    pattern = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(pattern).schema
    return spark.readStream.schema(schema).parquet(pattern).withColumn("ts", _c("ts").cast("timestamp"))


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run an append query to the end of its input and read its sink back."""
    spark = df.sparkSession
    sink, state = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    schema = df.schema
    query = (
        df.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def drain_batches(df: DataFrame, name: str, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As :func:`drain` through ``foreachBatch``: a batch run again replaces its own folder. Rows carry their ``epoch``."""
    spark = df.sparkSession
    sink, state = shared_dir(spark, name), shared_dir(spark, f"{name}-state")

    def write(batch: DataFrame, epoch: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(sink)


def with_rocksdb(spark: SparkSession) -> None:
    if spark.conf.get(_PROVIDER, "") != ROCKSDB:
        spark.conf.set(_PROVIDER, ROCKSDB)


def stream_sessions(events: DataFrame, gap: Column, delay: str) -> DataFrame:
    """(owner, start, end, n): sessions closed by a gap that is each event's own."""
    # Sessions of one owner are merged before the shuffle as well as after it.
    events.sparkSession.conf.set(_LOCAL_MERGE, "true")
    out = (
        events.withWatermark("ts", delay)
        .groupBy("owner", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("owner", _c("w.start").alias("start"), _c("w.end").alias("end"), "n")
    )
    return drain(out, "sessions")


def stream_rate_limit(starts: DataFrame, delay: str, per: int = STARTS_PER_MINUTE, minute: str = "1 minute") -> DataFrame:
    """(visitor, start, n, refused): starts of each visitor in each closed clock minute, and how many were over."""
    out = (
        starts.withWatermark("ts", delay)
        .groupBy("visitor", F.window("ts", minute).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("visitor", _c("w.start").alias("start"), "n", F.greatest(_c("n") - per, F.lit(0)).alias("refused"))
    )
    return drain(out, "rate-limit")


def stream_throttle(lines: DataFrame, delay: str, every: int = LOG_EVERY) -> DataFrame:
    """(condition, at, held): one line per condition per ``every`` seconds from the last, over all closed hours.

    Whatever order lines arrive in, they are counted by their exact time and given out when the watermark closes their
    hour; no state is kept per condition. The closed counts go through the chunked throttle, which follows a condition from
    hour to hour by the few moments at which an hour can be left, and replays the hours in parallel.
    ``lines``: (condition, ts, at) with ``at`` in whole microseconds.
    """
    hour = F.window("ts", "1 hour")
    counts = lines.withWatermark("ts", delay).groupBy("condition", hour, "at").agg(F.count("*").alias("n"))
    return throttle(drain(counts.select("condition", "at", "n"), "throttle"), every)


def stream_dedupe(asks: DataFrame, key: list[str], delay: str) -> DataFrame:
    """The keys asked for, each once however often it comes while it is pending."""
    out = asks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key).select(*key)
    return drain(out, "dedupe")


def stream_metrics(events: DataFrame, by: str) -> DataFrame:
    """Running counters by ``by``, as they stand at the end of the input."""
    out = events.groupBy(by).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    epochs = drain_batches(out, "metrics", "complete")
    newest = epochs.agg(F.max("epoch").alias("epoch"))
    return epochs.join(F.broadcast(newest), "epoch", "left_semi").drop("epoch")


def stream_replacements(starts: DataFrame, served: DataFrame, grace: str, delay: str) -> DataFrame:
    """(owner, start_id, started, first_served): replacements and the first segment served within ``grace``, else null.

    A start with none is known to be abandoned once both watermarks have passed it.
    """
    a = starts.withWatermark("started", delay)
    b = served.select(_c("owner").alias("s_owner"), "served").withWatermark("served", delay)
    within = (
        (_c("owner") == _c("s_owner"))
        & (_c("served") >= _c("started"))
        & (_c("served") <= _c("started") + F.expr(f"interval {grace}"))
    )
    pairs = drain(a.join(b, within, "left_outer").select("owner", "start_id", "started", "served"), "replacements")
    return pairs.groupBy("owner", "start_id", "started").agg(F.min("served").alias("first_served"))


# Fixed value: sessions of one bucket share a row of state.
SESSION_BUCKETS = 1024


def _first_n(n: int, ttl: int):
    """The first n rows of each session by event time within what has come; forgotten ``ttl`` after its last row."""
    ttl *= 1_000_000

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["at", "event_id"]).groupby("id", sort=False).head(n)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions, taken, latest = state.get if state.exists else ([], [], [])
        past = state.getCurrentWatermarkMs()

        def alive(known: pd.DataFrame) -> pd.DataFrame:
            return known[(known["latest"] + ttl) // 1000 > past]

        known = alive(pd.DataFrame({"taken": taken, "latest": latest}, index=pd.Index(sessions, dtype="int64"), dtype="int64"))
        if not state.hasTimedOut:
            first, newest = None, known["latest"]
            for pdf in parts:  # the parts of a bucket come in no order
                newest = pd.concat([newest, pdf.groupby("id")["at"].max()]).groupby(level=0).max()
                first = cut(pdf if first is None else pd.concat([first, pdf]))
            had = known["taken"].reindex(newest.index, fill_value=0)
            out = first[first.groupby("id").cumcount() < n - first["id"].map(had)]
            had = had.add(out.groupby("id").size(), fill_value=0).astype("int64")
            known = alive(pd.DataFrame({"taken": had, "latest": newest}))
            yield out[["session", "event_id", "at", "body"]]
        if known.empty:
            state.remove()
        else:
            state.update((known.index.tolist(), known["taken"].tolist(), known["latest"].tolist()))
            state.setTimeoutTimestamp((int(known["latest"].min()) + ttl) // 1000)

    return step


def stream_reports(bodies: DataFrame, delay: str, n: int = REPORTS_PER_SESSION, ttl: int = VERDICT_TTL) -> DataFrame:
    """Flat rows of each session's first ``n`` reports, malformed ones counted.

    ``bodies``: (session, event_id, ts, at, body). A session is forgotten when the stream is ``ttl`` seconds past it. What is
    kept of one is two numbers; Python is called once a bucket of sessions, and a bucket's rows are cut part by part.
    """
    with_rocksdb(bodies.sparkSession)
    kept = (
        bodies.withWatermark("ts", delay)
        .withColumn("bucket", F.when(_c("session").isNotNull(), F.pmod(F.xxhash64("session"), F.lit(SESSION_BUCKETS))))
        .withColumn("id", F.coalesce("session", F.lit(0)))  # no session has a bucket of its own
        .groupBy("bucket")
        .applyInPandasWithState(
            _first_n(n, ttl),
            outputStructType="session bigint, event_id bigint, at bigint, body string",
            stateStructType="sessions array<bigint>, taken array<bigint>, latest array<bigint>",
            outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout,
        )
    )
    return drain_batches(kept, "reports", "append", lambda b: rp.report_stats(rp.parse_reports(b))).drop("epoch")


def stream_verdicts(found: DataFrame, delay: str, ttl: int = VERDICT_TTL) -> DataFrame:
    """(key, at, why): the last verdict of each key, forgotten when the stream is ``ttl`` seconds past it.

    Each batch tells the keys whose last verdict it moved. What is kept of a key is one verdict for each ``ttl`` of event time
    that the watermark hasn't closed, two at most as long as nothing comes early, in Spark's own aggregation: no key is called
    one by one. ``found``: (ts, key, at, event_id, why) with ``at`` the microseconds of ``ts``.
    """
    with_rocksdb(found.sparkSession)
    latest = F.max(F.struct("at", "event_id", "why")).alias("v")
    held = found.withWatermark("ts", delay).groupBy("key", F.window("ts", f"{ttl} seconds")).agg(latest)
    told = drain_batches(held.select("key", "v"), "verdicts", "update")
    last = told.groupBy("key").agg(F.max("v").alias("v"))
    # The watermark's own rule, on the newest verdict told.
    newest = F.timestamp_millis(F.floor(F.max("v.at") / 1000)) - F.expr(f"interval {delay}")
    passed = told.agg(F.unix_micros(newest).alias("__wm"))
    alive = last.join(F.broadcast(passed), _c("v.at") + ttl * 1_000_000 > _c("__wm"))
    return alive.select("key", "v.at", "v.why")
