"""Streaming queries over the event log, each checked against the rule's batch form on closed time."""

from __future__ import annotations

from pyspark.sql import functions as F

from playlens.plans.carriers import with_
from playlens.plans.registry import query
from playlens.plans.reports import _BODY, _SQL, _num
from playlens.plans.sessions import _GAP, _PLAY, playback
from playlens.session import utc
from playlens.streaming import jobs

_c = F.col


def events(spark, sf):
    kind = _c("event_type")
    event = (
        F.when(kind == "signup", "request").when(kind == "view", "segment").when(kind == "click", "heartbeat")
        .when(kind == "purchase", "report").when(_c("event_id") % 7 == 0, "end").otherwise("other")
    )
    return jobs.event_stream(utc(spark), sf).select(
        "ts", "event_id", "user_id", "event_type", "value", _c("user_id").alias("owner"), event.alias("event"),
        F.unix_micros("ts").alias("us"), F.expr("cast(round(value * 1000) as bigint)").alias("bytes"),
    )


# Watermark: the latest event's millisecond, less the delay.
_WM = "SELECT max(epoch_us(ts)) // 1000 * 1000 - {0} AS wm FROM events"


@query(
    "stream_sessions",
    with_(
        p=_PLAY,
        r=f"""SELECT *, max(us + {_GAP}) OVER (PARTITION BY owner ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p""",
        i="SELECT *, sum(CASE WHEN us <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY us, event_id) AS k FROM r",
        s=f'SELECT owner, min(us) AS start, max(us + {_GAP}) AS "end", count(*) AS n FROM i GROUP BY owner, k',
        w=_WM.format(3600000000),
    )
    + 'SELECT owner, start, "end", n FROM s, w WHERE "end" <= wm',
)
def stream_sessions(spark, sf):
    gap = F.when(_c("event") == "segment", "1 day").otherwise("6 hours")
    out = jobs.stream_sessions(events(spark, sf), gap, "1 hour")
    return out.select("owner", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(
    "stream_rate_limit",
    with_(w=_WM.format(3600000000))
    + """SELECT visitor, start, n, greatest(n - 2, 0) AS refused FROM (SELECT user_id AS visitor, epoch_us(ts) // 86400000000 * 86400000000 AS start, count(*) AS n FROM events GROUP BY ALL), w
        WHERE start + 86400000000 <= wm""",
)
def stream_rate_limit(spark, sf):
    starts = events(spark, sf).withColumnRenamed("owner", "visitor")
    out = jobs.stream_rate_limit(starts, "1 hour", per=2, minute="1 day")
    return out.select("visitor", F.unix_micros("start").alias("start"), "n", "refused")


@query(
    "stream_throttle",
    f"""WITH RECURSIVE w AS ({_WM.format(3600000000)}), t AS (SELECT event_type AS condition, epoch_us(ts) AS "at", count(*) AS n FROM events, w
        WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= wm GROUP BY ALL), r AS (
        SELECT condition, min("at") AS "at" FROM t GROUP BY condition UNION ALL
        SELECT r.condition, (SELECT min(t."at") FROM t WHERE t.condition = r.condition AND t."at" >= r."at" + 10800000000) FROM r WHERE r."at" IS NOT NULL),
        e AS (SELECT condition, "at", lag("at") OVER (PARTITION BY condition ORDER BY "at") AS prv FROM r WHERE "at" IS NOT NULL)
        SELECT condition, "at", cast(coalesce((SELECT sum(n) FROM t WHERE t.condition = e.condition AND t."at" >= e.prv AND t."at" < e."at") - 1, 0) AS bigint) AS held FROM e""",
)
def stream_throttle(spark, sf):
    lines = events(spark, sf).select("ts", _c("event_type").alias("condition"), _c("us").alias("at"))
    return jobs.stream_throttle(lines, "1 hour", every=3 * 3600)


@query(
    "stream_dedupe",
    "SELECT DISTINCT user_id AS owner, epoch_us(ts) // 86400000000 AS day FROM events",
)
def stream_dedupe(spark, sf):
    asks = events(spark, sf).withColumn("day", F.floor(_c("us") / 86400000000))
    return jobs.stream_dedupe(asks, ["owner", "day"], "1 day")


@query("stream_metrics", with_(p=_PLAY) + "SELECT event, count(*) AS n, cast(sum(bytes) AS bigint) AS bytes FROM p GROUP BY event")
def stream_metrics(spark, sf):
    return jobs.stream_metrics(events(spark, sf), "event")


_CLOSED = 7 * 3600 * 1000000  # the watermark's hour and the six hours of grace


@query(
    "stream_replacements",
    with_(
        p=_PLAY,
        w=f"SELECT min(m) - {_CLOSED} AS wm FROM (SELECT max(us) // 1000 * 1000 AS m FROM p WHERE event IN ('request', 'segment') GROUP BY event)",
        s="""SELECT a.owner, a.event_id AS start_id, a.us, (SELECT min(b.us) FROM p b WHERE b.owner = a.owner AND b.event = 'segment' AND b.us BETWEEN a.us AND a.us + 21600000000) AS f
            FROM p a WHERE a.event = 'request'""",
    )
    + "SELECT owner, start_id, CASE WHEN f IS NULL THEN 'abandoned' ELSE 'kept' END AS fate, f - us AS after_us FROM s, w WHERE us < wm",
)
def stream_replacements(spark, sf):
    starts = events(spark, sf).where(_c("event") == "request").select("owner", _c("event_id").alias("start_id"), _c("ts").alias("started"))
    served = events(spark, sf).where(_c("event") == "segment").select("owner", _c("ts").alias("served"))
    out = jobs.stream_replacements(starts, served, "6 hours", "1 hour")
    # Compared on time that the watermarks of both streams have left behind.
    latest = playback(spark, sf).where(_c("event").isin("request", "segment")).groupBy("event").agg(F.max("us").alias("us"))
    closed = latest.agg((F.min(F.floor(_c("us") / 1000)) * 1000 - _CLOSED).alias("wm"))
    us = F.unix_micros("started")
    return out.join(F.broadcast(closed), us < _c("wm")).select(
        "owner", "start_id", F.when(_c("first_served").isNull(), "abandoned").otherwise("kept").alias("fate"),
        (F.unix_micros("first_served") - us).alias("after_us"),
    )


@query(
    "stream_reports",
    with_(
        q=f"""SELECT event_id, {_BODY} AS body, user_id * 10000 + epoch_us(ts) // 604800000000 AS session, row_number() OVER (PARTITION BY user_id * 10000 + epoch_us(ts) // 604800000000
            ORDER BY epoch_us(ts), event_id) AS rn FROM events WHERE event_type = 'purchase'""",
        b="SELECT event_id, body FROM q WHERE rn <= 3",
        **{k: _SQL[k] for k in "opr"},
    )
    + f"""SELECT q.session, r.event_id, json_extract_string(stats, '$.browser') AS browser, {_num('$.fragments.count')} AS fragments, {_num('$.droppedFrames')} AS dropped
        FROM r JOIN q USING (event_id) WHERE stats IS NOT NULL""",
)
def stream_reports(spark, sf):
    ev = events(spark, sf).where(_c("event_type") == "purchase")
    bodies = ev.select(
        (_c("user_id") * 10000 + F.floor(_c("us") / 604800000000)).alias("session"), "event_id", "ts", _c("us").alias("at"), F.expr(_BODY).alias("body")
    )
    return jobs.stream_reports(bodies, "1 hour").select("session", "event_id", "browser", "fragments", "dropped")


@query(
    "stream_verdicts",
    with_(p=_PLAY, w=_WM.format(3600000000))
    + 'SELECT session AS key, max(us) AS "at", arg_max(event, (us, event_id)) AS why FROM p GROUP BY session HAVING max(us) + 604800000000 > (SELECT wm FROM w)',
)
def stream_verdicts(spark, sf):
    found = events(spark, sf).select(
        "ts", (_c("user_id") * 10000 + F.floor(_c("us") / 604800000000)).alias("key"), _c("us").alias("at"), "event_id", _c("event").alias("why")
    )
    return jobs.stream_verdicts(found, "1 hour")
