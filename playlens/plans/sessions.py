"""Session queries, over the event log and the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from playlens.functions import text as tx
from playlens.operators import link, sessions as se
from playlens.plans import carriers as c
from playlens.plans.carriers import with_
from playlens.plans.registry import query

_c = F.col

# Events as playback: a session is an owner's week. Whole seconds.
_PLAY = """SELECT event_id, user_id AS owner, user_id * 10000 + epoch_us(ts) // 604800000000 AS session, epoch_us(ts) // 1000000 AS "at", epoch_us(ts) AS us,
    CASE event_type WHEN 'signup' THEN 'request' WHEN 'view' THEN 'segment' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'report'
    ELSE CASE WHEN event_id % 7 = 0 THEN 'end' ELSE 'other' END END AS event, value AS seconds, event_id % 10 = 0 AS head, event_id, value,
    cast(round(value * 1000) AS bigint) AS bytes FROM events"""


def playback(spark, sf):
    kind = _c("event_type")
    event = (
        F.when(kind == "signup", "request").when(kind == "view", "segment").when(kind == "click", "heartbeat")
        .when(kind == "purchase", "report").when(_c("event_id") % 7 == 0, "end").otherwise("other")
    )
    return (
        c.table(spark, sf, "events")
        .withColumn("us", c.micros("ts"))
        .select(
            "event_id",
            _c("user_id").alias("owner"),
            (_c("user_id") * 10000 + F.floor(_c("us") / 604800000000)).alias("session"),
            F.floor(_c("us") / 1000000).alias("at"),
            "us",
            event.alias("event"),
            _c("value").alias("seconds"),
            (_c("event_id") % 10 == 0).alias("head"),
            F.expr("cast(round(value * 1000) as bigint)").alias("bytes"),
        )
    )


_PLAY = _PLAY.replace(" AS head, event_id, value,", " AS head,")


@query(
    "session_summary",
    with_(p=_PLAY)
    + """SELECT session, arg_max('reason ' || event_id % 3, ("at", event_id)) FILTER (WHERE event = 'end') AS reason, arg_max('track ' || event_id % 4, ("at", event_id))
        FILTER (WHERE event = 'request') AS audio, coalesce(arg_max(CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'download' END, ("at", event_id)) FILTER (WHERE event = 'report'), 'none')
        AS subtitle, bool_or(event_id % 50 = 0) AS transcoded, count(*) FILTER (WHERE event = 'segment' AND NOT head) AS segments,
        round(coalesce(sum(seconds) FILTER (WHERE event = 'segment' AND NOT head), 0), 6) AS seconds FROM p GROUP BY session""",
)
def session_summary(spark, sf):
    n = _c("event_id")
    ev = playback(spark, sf).select(
        "*",
        F.when(_c("event") == "end", F.concat(F.lit("reason "), (n % 3).cast("string"))).alias("reason"),
        F.when(_c("event") == "request", F.concat(F.lit("track "), (n % 4).cast("string"))).alias("audio"),
        F.when(_c("event") == "report", F.when(n % 2 == 0, "own").otherwise("download")).alias("subtitle"),
        (n % 50 == 0).alias("transcoded"),
    )
    return se.session_summary(ev).withColumn("seconds", F.round("seconds", 6))


@query(
    "session_end",
    with_(
        p=_PLAY,
        s="""SELECT session, min("at") AS created, max("at") FILTER (WHERE event IN ('request', 'segment')) AS seen, max("at") FILTER (WHERE event = 'heartbeat') AS beat,
            count(*) FILTER (WHERE event = 'segment') AS served, min("at") FILTER (WHERE event = 'end') AS told, 300000 + max(owner) * 7000 + 0.5 AS d FROM p GROUP BY session""",
        e="""SELECT session, told, created + least(cast(ceil(d) AS bigint) + 3600, 21600) AS exp, CASE WHEN beat > coalesce(seen, created) THEN beat + 60 WHEN served = 0 THEN
            coalesce(seen, created) + 60 ELSE coalesce(seen, created) + 600 END AS idle FROM s""",
    )
    + """SELECT session, least(told, exp, idle) AS ended_at, CASE WHEN told <= least(exp, idle) THEN 'deleted' WHEN exp <= idle THEN 'expired' ELSE 'idle' END AS reason FROM e""",
)
def session_end(spark, sf):
    return se.session_end(playback(spark, sf).withColumn("duration", 300000 + _c("owner") * 7000 + 0.5))


@query(
    "session_expiry",
    "SELECT o_orderkey, epoch(o_orderdate)::BIGINT + least(ceil(o_totalprice / 25)::BIGINT + 3600, 21600) AS expires FROM orders",
)
def session_expiry(spark, sf):
    o = c.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        se.session_expiry(F.unix_seconds(_c("o_orderdate").cast("timestamp")), _c("o_totalprice") / 25).alias("expires"),
    )


# Gaps of six hours, a day after a segment: the events lie hours apart.
_GAP = "CASE WHEN event = 'segment' THEN 86400000000 ELSE 21600000000 END"


@query(
    "sessionize",
    with_(
        p=_PLAY,
        r=f"""SELECT *, max(us + {_GAP}) OVER (PARTITION BY owner ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p""",
        i="SELECT *, sum(CASE WHEN us <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY us, event_id) AS k FROM r",
    )
    + f'SELECT owner, min(us) AS start, max(us + {_GAP}) AS "end", count(*) AS n FROM i GROUP BY owner, k',
)
def sessionize(spark, sf):
    gap = F.when(_c("event") == "segment", F.lit(86400000000)).otherwise(F.lit(21600000000))
    return se.sessionize(playback(spark, sf), "owner", "us", gap, 86400e6)


_OWNER = """CASE o_custkey % 4 WHEN 0 THEN 'grant:' || substr(md5(o_custkey::VARCHAR), 1, 8) WHEN 1 THEN 'grant:' || upper(substr(md5(o_custkey::VARCHAR), 1, 8))
    WHEN 2 THEN 'install:' || o_custkey ELSE 'grant:' || substr(md5(o_custkey::VARCHAR), 1, 9) END"""


@query(
    "usage_by_grant",
    f"""WITH s AS (SELECT {_OWNER} AS owner, o_orderkey % 11 * 60 AS seconds FROM orders) SELECT substr(owner, 7) AS "grant", cast(sum(seconds) AS bigint) AS seconds,
        count(*) AS sessions FROM s WHERE seconds > 0 AND regexp_full_match(owner, 'grant:[0-9a-f]{{8}}') GROUP BY owner""",
)
def usage_by_grant(spark, sf):
    k = _c("o_custkey")
    digest = F.md5(k.cast("string"))
    owner = (
        F.when(k % 4 == 0, F.concat(F.lit("grant:"), F.substring(digest, 1, 8)))
        .when(k % 4 == 1, F.concat(F.lit("grant:"), F.upper(F.substring(digest, 1, 8))))
        .when(k % 4 == 2, F.concat(F.lit("install:"), k.cast("string")))
        .otherwise(F.concat(F.lit("grant:"), F.substring(digest, 1, 9)))
    )
    s = c.table(spark, sf, "orders").select(owner.alias("owner"), (_c("o_orderkey") % 11 * 60).alias("seconds"))
    return se.usage_by_grant(s)


@query(
    "pull_throughput",
    """SELECT o_orderkey, round(CASE WHEN o_orderkey % 9 <> 0 THEN (o_totalprice / 100) / (o_orderkey % 9 * 7.5::DOUBLE) END, 6) AS speed,
        round(CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice * 1000) * 8.0::DOUBLE / 1e6 / (o_orderkey % 9 * 7.5::DOUBLE) END, 6) AS mbps FROM orders""",
)
def pull_throughput(spark, sf):
    runs = c.table(spark, sf, "orders").select(
        "o_orderkey",
        (_c("o_totalprice") / 100).alias("media"),
        F.round(_c("o_totalprice") * 1000).alias("bytes"),
        (_c("o_orderkey") % 9 * F.lit(7.5)).alias("running"),
        F.lit(0.0).alias("paused"),
    )
    out = link.pull_throughput(runs)
    return out.select("o_orderkey", F.round("speed", 6).alias("speed"), F.round("mbps", 6).alias("mbps"))


_ORDER = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(
    "byte_accounting",
    f"""WITH s AS (SELECT l_orderkey AS pull, cast(l_quantity AS bigint) * 1000 AS requested, cast(round(l_extendedprice) AS bigint) % 40000 AS consumed,
        CASE WHEN l_linenumber = 7 THEN 500 ELSE 0 END AS failed, * FROM lineitem), r AS (SELECT *, sum(requested - consumed - failed) OVER (PARTITION BY pull
        ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS due FROM s) SELECT pull, cast(sum(requested) AS bigint) AS requested, cast(sum(consumed) AS bigint) AS consumed,
        cast(max(greatest(due, 0)) AS bigint) AS abandoned FROM r GROUP BY pull""",
)
def byte_accounting(spark, sf):
    steps = c.table(spark, sf, "lineitem").select(
        "*",
        _c("l_orderkey").alias("pull"),
        (_c("l_quantity").cast("bigint") * 1000).alias("requested"),
        (F.round("l_extendedprice").cast("bigint") % 40000).alias("consumed"),
        F.when(_c("l_linenumber") == 7, 500).otherwise(0).alias("failed"),
    )
    quarter = F.floor(F.unix_date(_c("l_shipdate").cast("date")) / 90)
    return se.byte_accounting(steps, _ORDER.split(", "), quarter)


_METRIC_CTES = {
    "p": _PLAY,
    "ps": "SELECT session, bool_or(event = 'end') AS ended, bool_or(event_id % 40 = 0) AS public, sum(bytes) AS bytes, count(*) FILTER (WHERE event = 'segment') AS runs, sum(bytes) FILTER (WHERE event = 'segment') AS sent FROM p GROUP BY session",
    "m": """SELECT 'sessions' AS name, 'gauge' AS kind, 'Sessions playing now.' AS help, count(*) FILTER (WHERE NOT ended) AS value FROM ps UNION ALL
        SELECT 'public_sessions', 'gauge', 'Sessions playing now that came through the public origin.', count(*) FILTER (WHERE NOT ended AND public) FROM ps UNION ALL
        SELECT 'scratch_bytes', 'gauge', 'Bytes held for sessions playing now.', cast(sum(bytes) FILTER (WHERE NOT ended) AS bigint) FROM ps UNION ALL
        SELECT 'sessions_started_total', 'counter', 'Sessions created.', count(*) FROM ps UNION ALL
        SELECT 'runs_total', 'counter', 'Producer runs started.', cast(sum(runs) AS bigint) FROM ps UNION ALL
        SELECT 'source_bytes_consumed_total', 'counter', 'Bytes delivered.', cast(sum(sent) AS bigint) FROM ps""",
}


def metrics(spark, sf):
    return se.service_metrics(playback(spark, sf).withColumn("public", _c("event_id") % 40 == 0))


@query("service_metrics", with_(**_METRIC_CTES) + "SELECT * FROM m")
def service_metrics(spark, sf):
    return metrics(spark, sf)


@query(
    "live_by_owner",
    with_(p=_PLAY) + """SELECT owner, count(*) FILTER (WHERE NOT ended) AS live, count(*) AS started FROM (SELECT owner, session, bool_or(event = 'end') AS ended
        FROM p GROUP BY ALL) GROUP BY owner""",
)
def live_by_owner(spark, sf):
    return se.live_by_owner(playback(spark, sf))


@query(
    "scan_costs",
    """SELECT CASE event_type WHEN 'error' THEN 'failed' ELSE 'done' END AS result, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'no cached release'
        WHEN 1 THEN 'budget spent' ELSE 'timed out' END END AS reason, count(*) AS scans, cast(sum(cast(round(value * 1000) AS bigint)) AS bigint) AS bytes, round(avg(value), 6) AS wall
        FROM events GROUP BY ALL""",
)
def scan_costs(spark, sf):
    bad, n = _c("event_type") == "error", _c("event_id") % 3
    reason = F.when(n == 0, "no cached release").when(n == 1, "budget spent").otherwise("timed out")
    scans = c.table(spark, sf, "events").select(
        F.when(bad, "failed").otherwise("done").alias("result"),
        F.when(bad, reason).alias("reason"),
        F.expr("cast(round(value * 1000) as bigint)").alias("bytes"),
        _c("value").alias("wall"),
    )
    return se.scan_costs(scans).withColumn("wall", F.round("wall", 6))


_UAS = (
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_2 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) FxiOS/120.0 Mobile/15E148 Safari/605.1.15",
    "Mozilla/5.0 (iPad; CPU OS 15_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/15.6 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Android 13; Mobile; rv:121.0) Gecko/121.0 Firefox/121.0",
    "Mozilla/5.0 (Windows NT 11.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/130.0.0.0 Safari/537.36 OPR/115.0.0.0",
    "VLC/3.0.20 LibVLC/3.0.20",
    "",
)
_LABELS = ("Chrome 126 · Linux", "Firefox 120 · iOS 16", "Safari 15 · iPadOS 15", "Firefox 121 · Android", "Opera 115 · Windows", "another browser · unknown OS", "no User-Agent · unknown OS")
_LABEL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS)) + " END || CASE user_id % 3 WHEN 0 THEN ' · native' WHEN 1 THEN ' · hls.js' ELSE '' END"


def client(n, u):
    ua = F.when(F.lit(False), "")
    for i, text in enumerate(_UAS):
        ua = ua.when(n % 7 == i, text)
    player = F.when(u % 3 == 0, "native").when(u % 3 == 1, "hls.js").otherwise("some player")
    return tx.client_label(ua, player)


@query(
    "client_labels",
    f"SELECT {_LABEL} AS client, count(*) AS events, count(DISTINCT user_id) AS owners FROM events GROUP BY 1",
)
def client_labels(spark, sf):
    ev = c.table(spark, sf, "events").withColumn("client", client(_c("event_id"), _c("user_id")))
    return ev.groupBy("client").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("owners"))


@query(
    "selection_timing",
    f"""WITH s AS (SELECT {_LABEL} AS client, event_type AS outcome, event_id % 500 AS r, user_id * 3 AS o, CASE WHEN user_id % 3 = 0 THEN event_id % 90 END AS i,
        1 + event_id % 12 AS t FROM events) SELECT client, outcome, count(*) AS sessions, round(avg(t), 6) AS tried, round(avg(r), 6) AS resolve_ms, round(avg(o), 6) AS open_ms,
        round(avg(i), 6) AS init_ms, {", ".join(f"quantile_disc({k}, {p / 100})::DOUBLE AS {n}_ms_p{p}" for k, n in (("r", "resolve"), ("o", "open"), ("i", "init")) for p in (50, 95))}
        FROM s GROUP BY ALL""",
)
def selection_timing(spark, sf):
    n, u = _c("event_id"), _c("user_id")
    init = F.when(u % 3 == 0, F.format_string(",init;dur=%d", n % 90)).otherwise("")
    header = F.concat(F.format_string('resolve;dur=%d,open;dur=%d;desc="%d tried"', n % 500, u * 3, 1 + n % 12), init)
    ev = c.table(spark, sf, "events").select(client(n, u).alias("client"), _c("event_type").alias("outcome"), header.alias("header"))
    out = se.selection_timing(ev)
    return out.select("client", "outcome", "sessions", *[F.round(k, 6).alias(k) for k in out.columns[3:]])


@query(
    "first_reports",
    with_(p=_PLAY) + """SELECT session, event_id, rank FROM (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY "at", event_id) AS rank FROM p
        WHERE event = 'report') WHERE rank <= 3""",
)
def first_reports(spark, sf):
    reports = playback(spark, sf).where(_c("event") == "report").select("session", "event_id", "at")
    return se.first_n_per_session(reports, se.REPORTS_PER_SESSION).select("session", "event_id", "rank")


@query(
    "rate_limit",
    with_(p=_PLAY) + """SELECT event_id, row_number() OVER (PARTITION BY owner, "at" // 86400 ORDER BY "at", event_id) <= 2 AS admitted FROM p""",
)
def rate_limit(spark, sf):
    starts = playback(spark, sf).withColumnRenamed("owner", "visitor")
    return se.rate_limit(starts, per=2, minute=86400).select("event_id", "admitted")


@query(
    "daily_quota",
    """WITH d AS (SELECT o_custkey AS key, epoch(o_orderdate)::BIGINT // 86400 AS day, epoch(o_orderdate)::BIGINT AS "at", o_orderkey AS id FROM orders), u AS (SELECT key, day,
        min("at") AS "at", min(id) AS id FROM d GROUP BY ALL) SELECT key, day, "at", id, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY "at", id) <= 4 THEN 'queued' ELSE 'busy' END AS status FROM u""",
)
def daily_quota(spark, sf):
    asks = c.table(spark, sf, "orders").select(
        _c("o_custkey").alias("key"), F.unix_seconds(_c("o_orderdate").cast("timestamp")).alias("at"), _c("o_orderkey").alias("id")
    )
    return se.daily_quota(asks, 4)


_SESS = """SELECT o_custkey AS owner, o_orderkey AS id, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS start, epoch(o_orderdate)::BIGINT + o_orderkey % 86400
    + (1 + o_orderkey % 90) * 86400 AS "end" FROM orders"""


def order_sessions(spark, sf):
    start = F.unix_seconds(_c("o_orderdate").cast("timestamp")) + _c("o_orderkey") % 86400
    return c.table(spark, sf, "orders").select(
        _c("o_custkey").alias("owner"), _c("o_orderkey").alias("id"), start.alias("start"),
        (start + (1 + _c("o_orderkey") % 90) * 86400).alias("end"),
    )


@query(
    "newest_per_owner",
    with_(s=_SESS) + """SELECT owner, id, CASE WHEN row_number() OVER (PARTITION BY owner ORDER BY start DESC, id DESC) <= 2 THEN 'kept' ELSE 'replaced' END AS fate FROM s""",
)
def newest_per_owner(spark, sf):
    s = order_sessions(spark, sf).withColumnRenamed("start", "started")
    return se.newest_per_owner(s, 2).select("owner", "id", "fate")


_NOW = 1706659200  # the end of the events' thirty days


@query(
    "latest_verdicts",
    with_(p=_PLAY) + f"""SELECT session AS key, max("at") AS "at", arg_max(event, ("at", event_id)) AS why FROM p GROUP BY session HAVING {_NOW} - max("at") < 604800""",
)
def latest_verdicts(spark, sf):
    found = playback(spark, sf).select(_c("session").alias("key"), "at", _c("event_id").alias("id"), _c("event").alias("why"))
    return se.latest_verdicts(found, _NOW)


@query(
    "longest_idle",
    """WITH j AS (SELECT c_nationkey AS site, c_custkey AS session, c_acctbal AS idle, c_mktsegment <> 'BUILDING' AS running, c_custkey % 3 = 0 AS waiting FROM customer)
        SELECT w.site, w.session AS waiter, (SELECT arg_min(v.session, (-v.idle, v.session)) FROM j v WHERE v.site = w.site AND v.session <> w.session AND v.running AND v.idle >= 60)
        AS victim FROM j w WHERE waiting""",
)
def longest_idle(spark, sf):
    jobs = c.table(spark, sf, "customer").select(
        _c("c_nationkey").alias("site"), _c("c_custkey").alias("session"), _c("c_acctbal").alias("idle"),
        (_c("c_mktsegment") != "BUILDING").alias("running"), (_c("c_custkey") % 3 == 0).alias("waiting"),
    )
    return se.longest_idle(jobs, 60.0)


@query(
    "concurrency",
    with_(s=_SESS, m="SELECT \"at\", sum(d) AS d FROM (SELECT start AS \"at\", 1 AS d FROM s UNION ALL SELECT \"end\", -1 FROM s) GROUP BY \"at\"")
    + 'SELECT "at", cast(sum(d) OVER (ORDER BY "at") AS bigint) AS active, sum(d) OVER (ORDER BY "at") > 40 AS refused FROM m',
)
def concurrency(spark, sf):
    out = se.concurrency(order_sessions(spark, sf), [], 86400.0 * 30)
    return out.withColumn("refused", _c("active") > 40)


@query(
    "concurrency_by_owner",
    with_(s=_SESS, m="SELECT owner, \"at\", sum(d) AS d FROM (SELECT owner, start AS \"at\", 1 AS d FROM s UNION ALL SELECT owner, \"end\", -1 FROM s) GROUP BY ALL")
    + 'SELECT owner, max(a) AS peak FROM (SELECT owner, cast(sum(d) OVER (PARTITION BY owner ORDER BY "at") AS bigint) AS a FROM m) GROUP BY owner',
)
def concurrency_by_owner(spark, sf):
    return se.concurrency(order_sessions(spark, sf), ["owner"], 86400.0 * 365).groupBy("owner").agg(F.max("active").alias("peak"))


@query(
    "replacements",
    with_(s=_SESS, p='SELECT *, lag(id) OVER w AS prev, lag("end") OVER w AS pend FROM s WINDOW w AS (PARTITION BY owner ORDER BY start, id)')
    + 'SELECT owner, id, prev AS replaces, least(pend, "end") - start AS overlap FROM p WHERE pend > start',
)
def replacements(spark, sf):
    return se.replacements(order_sessions(spark, sf), 86400.0 * 365)


_THROTTLE = """, t AS (SELECT event_type AS condition, epoch_us(ts) AS "at", count(*) AS n FROM events GROUP BY ALL), r AS (
    SELECT condition, min("at") AS "at" FROM t GROUP BY condition UNION ALL
    SELECT r.condition, (SELECT min(t."at") FROM t WHERE t.condition = r.condition AND t."at" >= r."at" + {every}) FROM r WHERE r."at" IS NOT NULL)"""


@query(
    "throttle",
    "WITH RECURSIVE " + _THROTTLE[2:].format(every=3 * 3600 * 1000000)
    + """, e AS (SELECT condition, "at", lead("at") OVER (PARTITION BY condition ORDER BY "at") AS nxt, lag("at") OVER (PARTITION BY condition ORDER BY "at") AS prv FROM r WHERE "at" IS NOT NULL)
        SELECT condition, "at", cast(coalesce((SELECT sum(n) FROM t WHERE t.condition = e.condition AND t."at" >= e.prv AND t."at" < e."at") - 1, 0) AS bigint) AS held FROM e""",
)
def throttle(spark, sf):
    lines = c.table(spark, sf, "events").select(_c("event_type").alias("condition"), c.micros("ts").alias("at"))
    return se.throttle(lines, every=3 * 3600, width=86400)


@query(
    "uplink_budget",
    with_("players")
    + """, s AS (SELECT *, CASE WHEN player_id % 5 <> 0 THEN player_id * 100 END AS need, CASE WHEN household % 4 <> 0 THEN 20000000 END AS uplink FROM players),
        t AS (SELECT household, sum(CASE WHEN max_bitrate IS NOT NULL THEN coalesce(need, 0) ELSE 0 END) AS tot FROM s GROUP BY household)
        SELECT player_id, CASE WHEN max_bitrate IS NULL THEN NULL WHEN uplink IS NULL THEN max_bitrate ELSE cast(least(max_bitrate, greatest(uplink - (tot - coalesce(need, 0)), 0)) AS bigint) END AS budget
        FROM s JOIN t USING (household)""",
)
def uplink_budget(spark, sf):
    s = c.players(spark, sf).select(
        "player_id", "household", "max_bitrate",
        F.when(_c("player_id") % 5 != 0, _c("player_id") * 100).alias("need"),
        F.when(_c("household") % 4 != 0, F.lit(20000000)).alias("uplink"),
    )
    return link.uplink_budget(s, "household", "uplink").select("player_id", "budget")


@query(
    "bitrate_ladder",
    with_("players")
    + """, f AS (SELECT *, cast(floor(greatest(max_bitrate - 384000, 0) / 1.5::DOUBLE) AS bigint) AS fits FROM players), l AS (SELECT player_id, max_bitrate,
        CASE WHEN max_bitrate IS NULL THEN 8000000 WHEN least(8000000, fits) >= 4000000 THEN least(8000000, fits) WHEN least(3000000, fits) >= 2000000 THEN least(3000000, fits)
        WHEN least(1500000, fits) >= 1000000 THEN least(1500000, fits) END AS bitrate, CASE WHEN max_bitrate IS NULL OR least(8000000, fits) >= 4000000 THEN '1080p'
        WHEN least(3000000, fits) >= 2000000 THEN '720p' WHEN least(1500000, fits) >= 1000000 THEN '540p' END AS preset FROM f)
        SELECT player_id, preset, bitrate, cast(floor(bitrate * 1.5::DOUBLE) AS bigint) AS peak, bitrate * 2 AS buffer, CASE WHEN max_bitrate IS NOT NULL THEN round(bitrate * 2 / greatest(max_bitrate, 1)::DOUBLE, 6) END AS head_start FROM l""",
)
def bitrate_ladder(spark, sf):
    p = c.players(spark, sf).withColumn("l", link.bitrate_ladder(_c("max_bitrate")))
    start = F.when(_c("max_bitrate").isNotNull(), link.head_start(_c("l.buffer"), _c("max_bitrate")))
    return p.select(
        "player_id", _c("l.name").alias("preset"), _c("l.bitrate").alias("bitrate"), _c("l.peak").alias("peak"),
        _c("l.buffer").alias("buffer"), F.round(start, 6).alias("head_start"),
    )


@query(
    "player_buffers",
    with_("players", "requests", "dur")
    + """SELECT r.request_id, CASE p.player WHEN 'hls.js' THEN 120.0::DOUBLE WHEN 'cast' THEN 60 ELSE 30 END AS secs, CASE p.player WHEN 'hls.js' THEN 150000000 WHEN 'cast' THEN 50000000 END AS bytes,
        CASE WHEN start_at > 0 AND start_at < 7200 THEN start_at ELSE 0 END AS start_at FROM requests r JOIN players p ON p.player_id = r.owner""",
)
def player_buffers(spark, sf):
    from playlens.operators.timeline import effective_start

    p = c.players(spark, sf).select(_c("player_id").alias("owner"), "player")
    r = c.requests(spark, sf).join(p, "owner").withColumn("b", link.player_buffer(_c("player")))
    return r.select(
        "request_id", _c("b.secs").alias("secs"), _c("b.bytes").alias("bytes"), effective_start(_c("start_at"), F.lit(7200.0)).alias("start_at")
    )


@query(
    "bandwidth",
    with_("rel")
    + """, a AS (SELECT release_id, CASE WHEN size_bytes IS NOT NULL AND listed_pos > 0 THEN cast(floor(size_bytes * 8.0::DOUBLE / (listed_pos * 600.5::DOUBLE)) AS bigint) ELSE 8000000 END AS average FROM rel)
        SELECT release_id, average, average + average // 4 + 192000 AS peak FROM a""",
)
def bandwidth(spark, sf):
    avg, peak = link.bandwidth(_c("size_bytes"), _c("listed_pos") * F.lit(600.5))
    return c.releases(spark, sf).select("release_id", avg.alias("average"), peak.alias("peak"))


@query(
    "output_size",
    with_("media")
    + """, s AS (SELECT release_id, width, height, least(1280.0::DOUBLE / nullif(width, 0), 720.0::DOUBLE / nullif(height, 0), 1.0::DOUBLE) AS k FROM media)
        SELECT release_id, CASE WHEN width = 0 OR height = 0 THEN 0 ELSE greatest((round(width * k)::INT // 2) * 2, 2) END AS width,
        CASE WHEN width = 0 OR height = 0 THEN 0 ELSE greatest((round(height * k)::INT // 2) * 2, 2) END AS height FROM s""",
)
def output_size(spark, sf):
    w, h = link.output_size(_c("width"), _c("height"), F.lit(1280), F.lit(720))
    return c.media(spark, sf).select("release_id", w.alias("width"), h.alias("height"))


# ---- requests and URLs --------------------------------------------------------------------------------------------


@query(
    "visitors",
    """WITH r AS (SELECT c_custkey, '10.0.' || c_nationkey || '.' || c_custkey % 5 AS peer, CASE c_custkey % 4 WHEN 0 THEN '1.2.3.4, 192.0.2.' || c_custkey % 250 WHEN 1 THEN ' 2001:db8::' || c_custkey % 9 || ' ,, '
        WHEN 2 THEN 'nonsense' END AS fwd FROM customer) SELECT c_custkey, CASE WHEN substr(peer, 6, 1) <> '1' THEN peer WHEN c_custkey % 4 = 0 THEN '192.0.2.' || c_custkey % 250 WHEN c_custkey % 4 = 1
        THEN '2001:db8::' || c_custkey % 9 ELSE peer END AS visitor FROM r""",
)
def visitors(spark, sf):
    k = _c("c_custkey")
    cust = c.table(spark, sf, "customer")
    peer = F.concat(F.lit("10.0."), _c("c_nationkey").cast("string"), F.lit("."), (k % 5).cast("string"))
    fwd = (
        F.when(k % 4 == 0, F.concat(F.lit("1.2.3.4, 192.0.2."), (k % 250).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit(" 2001:db8::"), (k % 9).cast("string"), F.lit(" ,, ")))
        .when(k % 4 == 2, "nonsense")
    )
    rows = cust.select("c_custkey", peer.alias("peer"), fwd.alias("forwarded"))
    proxies = rows.where(_c("peer").startswith("10.0.1")).select(_c("peer").alias("proxy")).distinct()
    return se.visitor(rows, proxies).select("c_custkey", "visitor")


@query(
    "validate_requests",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'transcode' WHEN o_orderkey % 19 = 0 THEN 'exclude' WHEN o_orderkey % 23 IN (0, 1, 2) THEN 'start_at' WHEN o_orderkey % 29 = 0 THEN 'max_bitrate'
        WHEN o_orderkey % 31 = 0 THEN 'imdb' WHEN o_orderkey % 37 = 0 THEN 'episode' WHEN o_orderkey % 41 = 0 THEN 'tags' END AS refused FROM orders""",
)
def validate_requests(spark, sf):
    k = _c("o_orderkey")
    tags = lambda n: F.array_repeat(F.lit("en"), n)
    r = c.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 17 == 0, "always").when(k % 2 == 0, "never").alias("transcode"),
        F.when(k % 19 == 0, F.array_repeat(F.lit("x.mkv"), 17)).otherwise(F.array(F.lit("a.mkv"))).alias("exclude"),
        F.when(k % 23 == 0, float("nan")).when(k % 23 == 1, float("inf")).when(k % 23 == 2, -1.0).when(k % 2 == 0, 5.0).alias("start_at"),
        F.when(k % 29 == 0, 0).when(k % 2 == 0, 5000).alias("max_bitrate"),
        F.when(k % 31 == 0, "tt12x").otherwise(F.concat(F.lit("tt"), k.cast("string"))).alias("imdb"),
        F.when(k % 2 == 0, 1).alias("season"),
        F.when((k % 2 == 0) != (k % 37 == 0), 2).alias("episode"),
        F.when((k % 41 == 0) & (k % 2 == 0), tags(9)).otherwise(tags(2)).alias("audio"),
        F.when((k % 41 == 0) & (k % 2 == 1), F.array(F.repeat(F.lit("x"), F.lit(36)))).otherwise(tags(1)).alias("subtitle_languages"),
        F.array(F.lit("h264")).alias("video_codecs"),
    )
    return se.validate_requests(r).select("o_orderkey", "refused")


def _signed(spark, sf):
    """Order log lines bearing signatures, some wrong and some late."""
    key, domain = b"a key of the reader's choosing", "stream/url"
    sid = F.substring(F.md5(_c("o_custkey").cast("string")), 1, 22)
    log = c.table(spark, sf, "orders").select("o_orderkey", sid.alias("sid"), F.unix_seconds(_c("o_orderdate").cast("timestamp")).alias("at"))
    sess = c.table(spark, sf, "customer").select(
        F.substring(F.md5(_c("c_custkey").cast("string")), 1, 22).alias("sid"), (F.lit(789004800) + _c("c_custkey") % 2000 * 86400).alias("exp")
    )
    good = sess.select("sid", tx.url_signature(key, domain, _c("sid"), _c("exp")).alias("good"))
    log = log.join(good, "sid").withColumn("sig", F.when(_c("o_orderkey") % 6 == 0, F.reverse("good")).otherwise(_c("good"))).drop("good")
    return se.audit_signatures(log, sess, key, domain), sess


def _hmac_sql(message: str) -> str:
    """The signature of a BLOB in SQL: nested SHA-256 under the key's two pads, 16 bytes in base64url."""
    block = b"a key of the reader's choosing".ljust(64, b"\0")
    inner, outer = (f"unhex('{bytes(b ^ pad for b in block).hex()}')" for pad in (0x36, 0x5C))
    mac = f"sha256({outer} || unhex(sha256({inner} || {message})))"
    return f"rtrim(translate(to_base64(unhex(substr({mac}, 1, 32))), '+/', '-_'), '=')"


_SIGNED = _hmac_sql("encode('stream/url') || unhex('00') || encode(sid) || unhex('00') || encode(exp::VARCHAR)")


@query(
    "audit_signatures",
    f"""WITH s AS (SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 22) AS sid, 789004800 + c_custkey % 2000 * 86400 AS exp FROM customer),
        g AS (SELECT *, {_SIGNED} AS good FROM s), l AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate)::BIGINT AS "at" FROM orders)
        SELECT o_orderkey, sid, "at", CASE WHEN o_orderkey % 6 = 0 THEN reverse(good) ELSE good END AS sig,
        CASE WHEN o_orderkey % 6 = 0 THEN reverse(good) ELSE good END = good AND "at" < exp AS valid FROM l JOIN g ON o_custkey = c_custkey""",
)
def audit_signatures(spark, sf):
    return _signed(spark, sf)[0]


@query(
    "url_status",
    """WITH r AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 6 <> 0 AS ok, epoch(o_orderdate)::BIGINT AS "at" FROM orders), l AS (SELECT c_custkey AS k, 789004800 + c_custkey % 2000 * 86400 AS exp FROM customer)
        SELECT o_orderkey, CASE WHEN NOT ok THEN 404 WHEN r.k % 3 = 0 THEN CASE WHEN exp > "at" THEN 200 ELSE 410 END WHEN r.k % 3 = 1 THEN CASE WHEN exp > "at" THEN 410 ELSE 404 END ELSE 404 END AS status
        FROM r JOIN l USING (k)""",
)
def url_status(spark, sf):
    r = c.table(spark, sf, "orders").select(
        "o_orderkey", _c("o_custkey").alias("sid"), (_c("o_orderkey") % 6 != 0).alias("signed_ok"),
        F.unix_seconds(_c("o_orderdate").cast("timestamp")).alias("at"),
    )
    s = c.table(spark, sf, "customer").select(_c("c_custkey").alias("sid"), (F.lit(789004800) + _c("c_custkey") % 2000 * 86400).alias("exp"))
    return se.url_status(r, s.where(_c("sid") % 3 == 0), s.where(_c("sid") % 3 == 1), _c("at")).select("o_orderkey", "status")


@query(
    "byte_ranges",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS bigint) * 100 AS len, l_suppkey * 10 AS a, l_suppkey * 10 + l_partkey % 500 - 20 AS b, l_partkey % 6 AS k FROM lineitem),
        x AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN a <= b AND b >= 0 THEN a END WHEN 1 THEN a WHEN 2 THEN CASE WHEN a > 0 THEN greatest(len - a, 0) END END AS s,
        CASE k WHEN 0 THEN least(b, len - 1) ELSE len - 1 END AS e FROM r)
        SELECT l_suppkey, CASE WHEN s IS NULL THEN 200 WHEN s >= len THEN 416 ELSE 206 END AS status, count(*) AS n, cast(sum(CASE WHEN s IS NULL THEN len WHEN s >= len THEN 0 ELSE e - s + 1 END) AS bigint) AS bytes
        FROM x GROUP BY ALL""",
)
def byte_ranges(spark, sf):
    a, k = _c("l_suppkey") * 10, _c("l_partkey") % 6
    b = a + _c("l_partkey") % 500 - 20
    s = lambda x: x.cast("string")
    header = (
        F.when(k == 0, F.concat(F.lit("bytes="), s(a), F.lit("-"), s(b)))
        .when(k == 1, F.concat(F.lit(" bytes= "), s(a), F.lit(" - ")))
        .when(k == 2, F.concat(F.lit("bytes=-"), s(a)))
        .when(k == 3, F.concat(F.lit("bytes=0-1,"), s(a), F.lit("-")))
        .when(k == 4, "lines=0-5")
    )
    rows = c.table(spark, sf, "lineitem").select("l_suppkey", (_c("l_quantity").cast("bigint") * 100).alias("len"), F.coalesce(header, F.lit("")).alias("h"))
    r = rows.withColumn("r", tx.byte_range(_c("h"), _c("len")))
    sent = F.when(_c("r.status") == 200, _c("len")).when(_c("r.status") == 206, _c("r.end") - _c("r.start") + 1).otherwise(0)
    return r.groupBy("l_suppkey", _c("r.status").alias("status")).agg(F.count("*").alias("n"), F.sum(sent).alias("bytes"))
