"""Report, redaction, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playlens.functions import text as tx
from playlens.operators import dedupe as dd, link, reports as rp, sessions as se, timeline as tl
from playlens.plans import carriers as c
from playlens.plans.carriers import RELEASE, TARGET, with_
from playlens.plans.registry import query
from playlens.plans.sessions import _METRIC_CTES, _PLAY, metrics, playback
from playlens.plans.timeline import segments
from playlens.session import shared_dir
from playlens.sources import readers as rd, writers as wr

_c = F.col

# A report a player might send, out of each event: half of them wrong in one way or another.
_N = "cast(event_id as varchar(20))"
_U = "cast(user_id as varchar(20))"
_BODY = f"""CASE WHEN event_id % 25 = 0 THEN 'not json' WHEN event_id % 25 = 1 THEN '[]' ELSE concat('{{', CASE event_id % 6
    WHEN 0 THEN '"code":0,"message":"playback stats (end)",' WHEN 1 THEN concat('"code":', {_N}, ',"message":"fetch https://cdn.example/t/', {_N}, ', failed  again",')
    WHEN 2 THEN '"code":"3","message":"m",' WHEN 4 THEN '"code":-1,"message":"m",' WHEN 5 THEN '"code":70000,"message":"PIPELINE_ERROR: big",' ELSE '' END,
    CASE event_id % 4 WHEN 0 THEN '"stats":"fast"' WHEN 1 THEN '"stats":{{}}' ELSE concat('"stats":{{"event":"', event_type, ' now","browser":"chrome/', {_U}, '","engine":',
    CASE WHEN event_id % 3 = 0 THEN '7' ELSE '"hls.js"' END, ',"fragments":{{"count":', {_N}, ',"bytes":', {_U}, '000.5,"loadMs":12,"kbpsP10":', CASE WHEN event_id % 5 = 0 THEN '"x"' ELSE {_U} END,
    ',"kbpsMedian":', {_N}, ',"idleLowMs":', CASE WHEN event_id % 2 = 0 THEN '0' ELSE {_N} END, '}},"bandwidthEstimateKbps":3800,"droppedFrames":', {_U}, ',"totalFrames":"many",',
    CASE WHEN event_id % 7 < 4 THEN concat('"stallCount":', cast(event_id % 7 - 1 as varchar(5)), ',"stalledMs":', {_U}, ',') ELSE '' END, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN '"stalls":[],'
    ELSE concat('"stalls":[{{"at":1.5,"kind":"frozen","ms":420,"videoAhead":12.25,"audioAhead":11,"loading":true}},{{"kind":"', CASE WHEN event_id % 3 = 0 THEN 'frozen' ELSE 'wait' END, '","ms":null,"loading":false,"idleMs":', {_U}, '}},{{"loading":null}}],') END,
    '"errors":[{{"details":"bufferStalledError","fatal":false,"count":', cast(event_id % 4 as varchar(5)), '}},{{"details":"e', {_U}, '"}},{{"details":"bufferStalledError","fatal":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '1' END,
    ',"count":2.7}},{{"fatal":true}},{{"details":"a"}},{{"details":"b b"}},{{"details":"c"}}]}}') END, '}}') END"""
_SQL = {
    "b": f"SELECT event_id, {_BODY} AS body FROM events",
    "o": "SELECT * FROM b WHERE json_valid(body) AND json_type(body) = 'OBJECT'",
    "p": """SELECT event_id, body, CASE WHEN json_type(body, '$.code') = 'UBIGINT' AND json_type(body, '$.message') = 'VARCHAR' THEN least(json_extract_string(body, '$.code')::BIGINT, 65535) END AS code,
        CASE WHEN json_type(body, '$.code') = 'UBIGINT' AND json_type(body, '$.message') = 'VARCHAR' THEN json_extract_string(body, '$.message') END AS message,
        CASE WHEN json_type(body, '$.stats') = 'OBJECT' THEN json_extract(body, '$.stats') END AS stats FROM o""",
    "r": "SELECT * FROM p WHERE code IS NOT NULL OR stats IS NOT NULL",
    "err": """SELECT event_id, unnest(json_extract(stats, '$.errors[*]')) AS e, generate_subscripts(json_extract(stats, '$.errors[*]'), 1) - 1 AS pos FROM r WHERE stats IS NOT NULL""",
    "kinds": """SELECT event_id, coalesce(replace(json_extract_string(e, '$.details'), ' ', '_'), '?') AS kind, cast(sum(CASE WHEN json_exists(e, '$.count') THEN
        floor(greatest(json_extract_string(e, '$.count')::DOUBLE, 1)) ELSE 1 END) AS bigint) AS times, bool_or(coalesce(json_extract_string(e, '$.fatal') = 'true', false)) AS fatal, min(pos) AS first
        FROM err GROUP BY ALL""",
}


def bodies(spark, sf):
    return c.table(spark, sf, "events").select("event_id", F.expr(_BODY).alias("body"))


def reports(spark, sf):
    return rp.parse_reports(bodies(spark, sf))


@query(
    "parse_reports",
    with_(**{k: _SQL[k] for k in "bopr"}) + "SELECT event_id, code, message, stats IS NOT NULL AS has_stats FROM r",
)
def parse_reports(spark, sf):
    return reports(spark, sf).select("event_id", "code", "message", _c("stats").isNotNull().alias("has_stats"))


@query(
    "report_failures",
    with_(**{k: _SQL[k] for k in "bopr"})
    + """SELECT code, CASE WHEN message LIKE 'fetch%' THEN 'fetch <url>, failed again' ELSE message END AS message, count(*) AS n FROM r WHERE code IS NOT NULL AND (code <> 0 OR stats IS NULL) GROUP BY ALL""",
)
def report_failures(spark, sf):
    bad = rp.report_failures(reports(spark, sf))
    return bad.groupBy("code", tx.player_message(_c("message")).alias("message")).agg(F.count("*").alias("n"))


def _num(path: str) -> str:
    return f"CASE WHEN json_type(stats, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(stats, '{path}')::DOUBLE END"


@query(
    "report_stats",
    with_(**{k: _SQL[k] for k in "bopr"})
    + f"""SELECT event_id, replace(json_extract_string(stats, '$.event'), ' ', '_') AS event, json_extract_string(stats, '$.browser') AS browser, CASE WHEN json_type(stats, '$.engine') = 'VARCHAR' THEN
        json_extract_string(stats, '$.engine') END AS engine, {_num('$.fragments.count')} AS fragments, {_num('$.fragments.bytes')} AS bytes, {_num('$.fragments.kbpsP10')} AS kbps_p10,
        nullif({_num('$.fragments.idleLowMs')}, 0) AS idle_low_ms, {_num('$.droppedFrames')} AS dropped, {_num('$.totalFrames')} AS frames,
        CASE WHEN json_type(stats, '$.buffers') = 'VARCHAR' THEN json_extract_string(stats, '$.buffers') END AS buffers, {_num('$.fragments.loadMs')} AS load_ms, {_num('$.fragments.kbpsMedian')} AS kbps_median,
        {_num('$.fragments.slowestMs')} AS slowest_ms, {_num('$.bandwidthEstimateKbps')} AS estimate_kbps FROM r WHERE stats IS NOT NULL""",
)
def report_stats(spark, sf):
    return rp.report_stats(reports(spark, sf))


@query(
    "stats_by_client",
    with_(**{k: _SQL[k] for k in "bopr"})
    + f"""SELECT json_extract_string(stats, '$.browser') AS browser, CASE WHEN json_type(stats, '$.engine') = 'VARCHAR' THEN json_extract_string(stats, '$.engine') END AS engine, count(*) AS reports,
        sum({_num('$.droppedFrames')}) AS dropped, {", ".join(f"quantile_disc({_num('$.fragments.kbpsMedian')}, {p / 100}) AS kbps_median_p{p}" for p in (10, 50, 90))}
        FROM r WHERE stats IS NOT NULL GROUP BY ALL""",
)
def stats_by_client(spark, sf):
    return rp.stats_by_client(rp.report_stats(reports(spark, sf)))


@query("error_kinds", with_(**_SQL) + "SELECT * FROM kinds")
def error_kinds(spark, sf):
    return rp.error_kinds(reports(spark, sf), "event_id")


@query(
    "stall_rollup",
    with_(
        **{k: _SQL[k] for k in "bopr"},
        s="""SELECT event_id, CASE WHEN json_type(stats, '$.stallCount') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(stats, '$.stallCount')::BIGINT END AS cnt, json_extract_string(stats, '$.stalledMs')::DOUBLE AS ms,
            json_type(stats, '$.stalls') = 'ARRAY' AS has, json_extract(stats, '$.stalls[*]') AS l FROM r WHERE stats IS NOT NULL""",
    )
    + """SELECT event_id, greatest(coalesce(cnt, 0), 0, coalesce(len(l), 0)) AS stalls, coalesce(len(list_filter(l, lambda x: json_extract_string(x, '$.kind') = 'frozen')), 0) AS frozen, ms AS stalled_ms,
        coalesce(len(list_filter(l, lambda x: json_type(x, '$.ms') = 'NULL')), 0) AS open, coalesce(len(list_filter(l, lambda x: json_extract_string(x, '$.loading') = 'true')), 0) AS fetching,
        coalesce(len(list_filter(l, lambda x: json_extract_string(x, '$.loading') = 'false')), 0) AS idle FROM s WHERE coalesce(has, false) OR cnt IS NOT NULL""",
)
def stall_rollup(spark, sf):
    return rp.stall_rollup(reports(spark, sf), "event_id")


def _stall(path: str, sql: str) -> str:
    return f"CASE WHEN json_type(x, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN printf({sql}, json_extract_string(x, '{path}')::DOUBLE) END"


_STALL = f"""coalesce(nullif(concat_ws(' ', {_stall("$.at", "'at=%.0fs'")}, nullif(replace(json_extract_string(x, '$.kind'), ' ', '_'), ''),
    CASE WHEN json_type(x, '$.ms') = 'NULL' THEN 'ms=?' ELSE {_stall("$.ms", "'%.0fms'")} END, {_stall("$.videoAhead", "'v=%.1f'")}, {_stall("$.audioAhead", "'a=%.1f'")},
    CASE json_extract_string(x, '$.loading') WHEN 'true' THEN 'fetching' WHEN 'false' THEN coalesce({_stall("$.idleMs", "'idle=%.0fms'")}, 'idle') END), ''), '?')"""


@query(
    "top_errors",
    with_(
        **_SQL,
        k2="SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY first) AS i, count(*) OVER (PARTITION BY event_id) AS n FROM kinds",
        e="""SELECT event_id, string_agg(kind || CASE WHEN times > 1 THEN ' x' || times ELSE '' END || CASE WHEN fatal THEN '(fatal)' ELSE '' END, ',' ORDER BY i) FILTER (WHERE i <= 3)
            || CASE WHEN any_value(n) > 3 THEN ',+' || (any_value(n) - 3) || ' more' ELSE '' END AS shown FROM k2 GROUP BY event_id""",
        s="""SELECT event_id, CASE WHEN json_type(stats, '$.stallCount') IN ('UBIGINT', 'BIGINT') THEN json_extract_string(stats, '$.stallCount')::BIGINT END AS cnt,
            json_extract(stats, '$.stalls[*]') AS l FROM r WHERE stats IS NOT NULL""",
        t=f"""SELECT event_id, array_to_string(list_concat(list_transform(l[1:2], lambda x: {_STALL}), CASE WHEN greatest(coalesce(cnt, 0), len(l)) > least(len(l), 2)
            THEN ['+' || (greatest(coalesce(cnt, 0), len(l)) - least(len(l), 2)) || ' more'] ELSE [] END), '; ') AS stalls_shown FROM s WHERE len(l) > 0""",
    )
    + "SELECT event_id, shown, stalls_shown FROM e FULL JOIN t USING (event_id)",
)
def top_errors(spark, sf):
    """The first three kinds of error and the first two stalls of each report, in words, and how many more there were."""
    read = reports(spark, sf)
    errors = rp.top_k_with_rest(rp.error_kinds(read, "event_id"), "event_id", 3)
    return errors.join(rp.stalls_with_rest(read, "event_id", 2), "event_id", "full")


# ---- redaction ----------------------------------------------------------------------------------------------------

_RE2 = tx.URL.replace("'", "''")


@query(
    "scrub_logs",
    f"""WITH l AS (SELECT 'page' AS kind, url || ': ' || html AS t FROM pages UNION ALL SELECT source, text FROM documents)
        SELECT kind, count(*) AS lines, cast(sum(len(regexp_extract_all(replace(t, 'example', '<secret>'), '{_RE2}'))) AS bigint) AS urls,
        cast(sum(('0x' || substr(h, 1, 8))::BIGINT) AS bigint) AS digest FROM (SELECT kind, t, md5(regexp_replace(replace(t, 'example', '<secret>'), '{_RE2}', '<url>', 'g')) AS h FROM l) GROUP BY kind""",
)
def scrub_logs(spark, sf):
    pages = c.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.concat("url", F.lit(": "), "html").alias("t"))
    docs = c.table(spark, sf, "documents").select(_c("source").alias("kind"), _c("text").alias("t"))
    secret = ("example",)
    lines = pages.unionByName(docs).select(
        "kind", F.md5(tx.scrub(_c("t"), secret)).alias("h"), tx.url_count(F.replace("t", F.lit("example"), F.lit("<secret>"))).alias("u")
    )
    return lines.groupBy("kind").agg(
        F.count("*").alias("lines"), F.sum("u").cast("bigint").alias("urls"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")).alias("digest")
    )


@query(
    "player_messages",
    rf"""WITH m AS (SELECT doc_id, substr(regexp_replace(trim(regexp_replace(substr(text, 1, 400), '[^\x21-\x7e]+', ' ', 'g')), '{_RE2}', '<url>', 'g'), 1, 160) AS message FROM documents)
        SELECT doc_id, message, substr(replace(message, ' ', '_'), 1, 40) AS word FROM m""",
)
def player_messages(spark, sf):
    return c.table(spark, sf, "documents").select("doc_id", tx.player_message(_c("text"), 400, 160).alias("message"), tx.word(_c("text"), 400, 40).alias("word"))


@query(
    "request_ids",
    """SELECT page_id, nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), '') AS rid, 'install:' || substr(sha256(url), 1, 16) AS owner FROM pages""",
)
def request_ids(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", tx.request_id(_c("url")).alias("rid"), tx.owner_id(_c("url")).alias("owner"))


# Paths as players ask for them.
_SID = "substr(md5(cast(user_id as varchar(20))), 1, 22)"
_FILE = f"""CASE event_id % 11 WHEN 0 THEN concat('seg', {_N}, '.m4s') WHEN 1 THEN concat('sub', cast(event_id % 10 as varchar(3)), '.m3u8') WHEN 2 THEN concat('sub', cast(event_id % 10 as varchar(3)), '.vtt')
    WHEN 3 THEN concat('sub', cast(event_id % 10 as varchar(3)), '_', {_N}, '.vtt') WHEN 4 THEN 'master.m3u8' WHEN 5 THEN 'heartbeat' WHEN 6 THEN 'segx.m4s' WHEN 7 THEN 'a/b' WHEN 8 THEN 'init.mp4' WHEN 9 THEN 'report'
    ELSE 'seg12345678.m4s' END"""
_PATH = f"""CASE event_id % 13 WHEN 0 THEN '/health' WHEN 1 THEN '/play/session' WHEN 2 THEN concat('/play/segments/tt', {_N}, '/1/2') WHEN 3 THEN '/play/segments/scan' WHEN 4 THEN '/else/where' WHEN 5 THEN '/play/s/bad/x'
    WHEN 6 THEN concat('/play/s/', {_SID}, '/sig') WHEN 7 THEN '/play/s/' ELSE concat('/play/s/', {_SID}, '/', substr(md5({_N}), 1, 22), '/', {_FILE}) END"""


@query(
    "session_files",
    f"""WITH f AS (SELECT {_FILE} AS f FROM events) SELECT CASE WHEN f IN ('master.m3u8', 'media.m3u8', 'init.mp4', 'report', 'heartbeat', 'end') THEN f WHEN regexp_full_match(f, 'seg[0-9]{{1,7}}\\.m4s') THEN 'segment'
        WHEN regexp_full_match(f, 'sub[0-7]\\.m3u8') THEN 'subtitle_playlist' WHEN regexp_full_match(f, 'sub[0-7]\\.vtt') THEN 'subtitle_document' WHEN regexp_full_match(f, 'sub[0-7]_[0-9]{{1,7}}\\.vtt') THEN 'subtitle_window' END AS kind,
        CASE WHEN regexp_full_match(f, 'seg[0-9]{{1,7}}\\.m4s') THEN regexp_extract(f, '[0-9]+')::BIGINT END AS n, count(*) AS files FROM f GROUP BY ALL""",
)
def session_files(spark, sf):
    f = c.table(spark, sf, "events").select(F.expr(_FILE).alias("f"))
    return f.groupBy(tx.session_file_kind(_c("f")).alias("kind"), tx.segment_index(_c("f")).alias("n")).agg(F.count("*").alias("files"))


@query(
    "redact_paths",
    f"""WITH p AS (SELECT event_id, event_id % 13 AS k, substr(md5(user_id::VARCHAR), 1, 6) AS sid, {_PATH} AS path, {_FILE} AS f FROM events) SELECT CASE WHEN k IN (0, 1, 3) THEN path WHEN k = 2 THEN '/play/segments/<episode>'
        WHEN k = 4 THEN '/<unrouted>' WHEN k IN (5, 7) THEN '/play/s/<bad>…/<sig>' WHEN k = 6 THEN '/play/s/' || sid || '…/<sig>' ELSE '/play/s/' || sid || '…/<sig>' || CASE WHEN f IN ('master.m3u8', 'init.mp4', 'report', 'heartbeat')
        OR regexp_full_match(f, 'seg[0-9]{{1,7}}\\.m4s|sub[0-7](_[0-9]{{1,7}})?\\.vtt|sub[0-7]\\.m3u8') THEN '/' || f ELSE '/<file>' END END AS route, count(*) AS requests FROM p GROUP BY ALL""",
)
def redact_paths(spark, sf):
    p = c.table(spark, sf, "events").select(tx.redact_path(F.expr(_PATH)).alias("route"))
    return p.groupBy("route").agg(F.count("*").alias("requests"))


_ORIGIN = "lower(regexp_extract(u, '^([^:/]*://[^/]*)', 1))"
_SCOPED = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN upper(regexp_extract(url, '^[a-z]+://[^/]+', 0)) || '/' || substr(md5(url), 1, 12) WHEN 2 THEN regexp_replace(url, '[?#].*$', '') ELSE replace(url, '://', '://me@') END"


@query(
    "check_scoped_urls",
    f"""WITH s AS (SELECT page_id, {_SCOPED} AS u FROM pages), a AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://[^/]+', 0)) AS o FROM pages WHERE url LIKE 'https%'), x AS (SELECT *, {_ORIGIN} AS o,
        CASE WHEN contains(u, '?') OR contains(u, '#') THEN 'has ? or #' WHEN contains(split_part(substr(u, position('://' IN u) + 3), '/', 1), '@') THEN 'user part present'
        WHEN {_ORIGIN} NOT IN (SELECT o FROM a) THEN 'origin unknown' WHEN NOT regexp_full_match(regexp_replace(u, '^[^:]+://[^/]+/', ''), '[A-Za-z0-9_-]+') THEN 'path not one plain word' END AS refused FROM s)
        SELECT page_id, refused, CASE WHEN refused IS NULL THEN o || '/' || regexp_replace(u, '^[^:]+://[^/]+/', '') END AS url FROM x""",
)
def check_scoped_urls(spark, sf):
    pages = c.table(spark, sf, "pages")
    k = _c("page_id") % 4
    u = (
        F.when(k == 0, _c("url"))
        .when(k == 1, F.concat(F.upper(F.regexp_extract("url", "^[a-z]+://[^/]+", 0)), F.lit("/"), F.substring(F.md5("url"), 1, 12)))
        .when(k == 2, F.regexp_replace("url", "[?#].*$", ""))
        .otherwise(F.replace("url", F.lit("://"), F.lit("://me@")))
    )
    rows = pages.select("page_id", u.alias("u")).withColumn("origin", tx.url_origin(_c("u")))
    allowed = pages.where(_c("url").startswith("https")).select(tx.url_origin(_c("url")).alias("origin"), F.lit(True).alias("ok")).distinct()
    r = rows.join(allowed, "origin", "left").withColumn("r", tx.check_scoped_url(_c("u"), _c("ok")))
    return r.select("page_id", "r.refused", "r.url")


@query(
    "rewrite_origins",
    """WITH a AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?]+', 0) AS o FROM pages WHERE url LIKE '%example.com%') SELECT page_id, coalesce('http://10.0.0.' || length(o) || substr(url, length(o) + 1), url) AS url
        FROM pages LEFT JOIN a ON o = regexp_extract(url, '^[a-z]+://[^/?]+', 0)""",
)
def rewrite_origins(spark, sf):
    pages = c.table(spark, sf, "pages")
    origin = F.regexp_extract("url", "^[a-z]+://[^/?]+", 0)
    aliases = pages.where(_c("url").contains("example.com")).select(origin.alias("origin")).distinct()
    aliases = aliases.withColumn("alias", F.concat(F.lit("http://10.0.0."), F.length("origin").cast("string")))
    return tx.rewrite_origin(pages, "url", aliases).select("page_id", "url")


# ---- logs ---------------------------------------------------------------------------------------------------------

_LINE = f"""concat(CASE event_id % 3 WHEN 0 THEN 'GET' ELSE 'POST' END, ' /play/', event_type, ' ', cast(200 + event_id % 5 as varchar(4)), ' ', {_U}, 'ms', CASE WHEN event_id % 2 = 0 THEN concat(' rid=r', cast(cast(floor(event_id / 4) as bigint) as varchar(20))) ELSE '' END,
    CASE WHEN event_id % 5 = 0 THEN concat(' session=s', {_U}) ELSE '' END, CASE WHEN event_id % 23 = 0 THEN ' junk' ELSE '' END)"""
_EVENT = f"""concat('session s', {_U}, ': event=session outcome=ended reason=', CASE event_id % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'replacement never played' ELSE 'deleted' END, CASE WHEN event_id % 4 = 0 THEN concat(' rid=r', cast(cast(floor(event_id / 4) as bigint) as varchar(20))) ELSE '' END,
    ' session=s', {_U}, ' audio_codec=ac-3 subtitle=', CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'none' END, ' transcoded=no segments=', {_N}, ' seconds=', {_U}, '.5')"""


@query(
    "access_log",
    f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, '/play/' || split_part(split_part(line, '/play/', 2), ' ', 1) AS path, (200 + event_id % 5)::INT AS status,
        regexp_extract(line, ' ([0-9]+)ms', 1)::BIGINT AS ms, nullif(regexp_extract(line, 'rid=([^ ]*)', 1), '') AS rid, nullif(regexp_extract(line, 'session=([^ ]*)', 1), '') AS session FROM l WHERE event_id % 23 <> 0""",
)
def access_log(spark, sf):
    lines = c.table(spark, sf, "events").select("event_id", F.expr(_LINE).alias("line"))
    return rd.parse_access_log(lines).drop("line")


@query(
    "event_lines",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'idle' WHEN 1 THEN 'replacement never played' ELSE 'deleted' END AS reason, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id // 4 END AS rid, 's' || user_id AS session,
        CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'none' END AS subtitle, event_id::VARCHAR AS segments, user_id || '.5' AS seconds FROM events""",
)
def event_lines(spark, sf):
    lines = c.table(spark, sf, "events").select("event_id", F.expr(_EVENT).alias("line"))
    return rd.parse_event_lines(lines).select("event_id", "reason", "rid", "session", "subtitle", "segments", "seconds")


@query(
    "correlate_logs",
    f"""WITH a AS (SELECT epoch_us(ts) AS t, event_id, {_LINE} AS line, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id // 4 END AS rid, CASE WHEN event_id % 5 = 0 THEN 's' || user_id END AS session FROM events WHERE event_id % 23 <> 0), s AS (SELECT epoch_us(ts) AS t, {_EVENT} AS line, CASE WHEN event_id % 4 = 0 THEN 'r' || event_id // 4 END AS rid, 's' || user_id AS session FROM events),
        ids AS (SELECT DISTINCT session, rid FROM s WHERE rid IS NOT NULL), x AS (SELECT session, t, line FROM a WHERE session IS NOT NULL UNION SELECT i.session, t, line FROM a JOIN ids i USING (rid)), y AS (SELECT * FROM x UNION ALL SELECT session, t, line FROM s)
        SELECT session, count(*) AS lines, min(t) AS first, max(t) AS last FROM y GROUP BY session""",
)
def correlate_logs(spark, sf):
    ev = c.table(spark, sf, "events").withColumn("at", c.micros("ts"))
    access = rd.parse_access_log(ev.select("at", F.expr(_LINE).alias("line"))).select("at", "rid", "session", "line")
    own = rd.parse_event_lines(ev.select("at", F.expr(_EVENT).alias("line"))).select("at", "rid", "session", "line")
    return se.correlate_logs(access, own).groupBy("session").agg(F.count("*").alias("lines"), F.min("at").alias("first"), F.max("at").alias("last"))


# ---- manifests ----------------------------------------------------------------------------------------------------


@query(
    "media_manifests",
    with_("segs", "dur")
    + """SELECT title, md5('#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || cast(greatest(ceil(max("end" - start)), 1) AS bigint) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)
        || CASE WHEN title % 2 = 0 THEN '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) ELSE '' END || CASE WHEN title % 3 > 0 THEN printf('#EXT-X-START:TIME-OFFSET=%.3f,PRECISE=YES', (title % 3 * 100.5)::DOUBLE) || chr(10) ELSE '' END
        || '#EXT-X-MAP:URI="init.mp4"' || chr(10) || string_agg(printf('#EXTINF:%.6f,', "end" - start) || chr(10) || 'seg' || n || '.m4s' || chr(10), '' ORDER BY n) || '#EXT-X-ENDLIST' || chr(10)) AS digest FROM segs GROUP BY title""",
)
def media_manifests(spark, sf):
    segs = segments(spark, sf)
    titles = c.durations(spark, sf).select("title", ((_c("title") % 3) * F.lit(100.5)).alias("start_at"), (_c("title") % 2 == 0).alias("closed_gops"))
    return wr.render_media_manifest(segs, titles).select("title", F.md5("text").alias("digest"))


@query(
    "subtitle_manifests",
    with_("segs", "dur")
    + """SELECT title, md5('#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || cast(greatest(ceil(CASE WHEN title % 2 = 0 THEN any_value(duration) ELSE max("end" - start) END), 1) AS bigint) || chr(10)
        || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || CASE WHEN title % 2 = 0 THEN printf('#EXTINF:%.6f,', any_value(duration)) || chr(10) || 'sub' || title % 8 || '.vtt' || chr(10)
        ELSE string_agg(printf('#EXTINF:%.6f,', "end" - start) || chr(10) || 'sub' || title % 8 || '_' || n || '.vtt' || chr(10), '' ORDER BY n) END || '#EXT-X-ENDLIST' || chr(10)) AS digest FROM segs JOIN dur USING (title) GROUP BY title""",
)
def subtitle_manifests(spark, sf):
    out = wr.render_subtitle_manifest(segments(spark, sf), _c("title") % 8, _c("title") % 2 == 0)
    return out.select("title", F.md5("text").alias("digest"))


@query(
    "master_manifests",
    with_("media", "rel")
    + """SELECT m.release_id, md5('#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || CASE WHEN closed_gops THEN '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) ELSE '' END || CASE WHEN m.release_id % 3 > 0 THEN
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="' || CASE WHEN m.release_id % 5 = 0 THEN 'Audio' ELSE 'German' END || '"' || CASE WHEN m.release_id % 5 = 0 THEN '' ELSE ',LANGUAGE="de"' END || ',DEFAULT=YES,AUTOSELECT=YES,CHANNELS="' || m.release_id % 3 * 3 || '"' || chr(10) ELSE '' END
        || CASE WHEN m.release_id % 4 = 0 THEN '' ELSE '#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="English",LANGUAGE="en",DEFAULT=NO,AUTOSELECT=YES,FORCED=NO,URI="sub0.m3u8"' || chr(10) || '#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="Unknown",LANGUAGE="und",DEFAULT=NO,AUTOSELECT=YES,FORCED=NO,URI="sub1.m3u8"' || chr(10) END
        || '#EXT-X-STREAM-INF:BANDWIDTH=' || coalesce(size_bytes // 900 + size_bytes // 900 // 4, 10000000) + 192000 || ',AVERAGE-BANDWIDTH=' || coalesce(size_bytes // 900, 8000000) || ',CODECS="' || coalesce(codecs, 'avc1.640028') || ',' || CASE WHEN m.release_id % 3 > 0 THEN 'ec-3' ELSE 'mp4a.40.2' END || '"'
        || CASE WHEN m.hdr THEN ',VIDEO-RANGE=' || CASE WHEN hlg THEN 'HLG' ELSE 'PQ' END ELSE '' END || CASE WHEN width > 0 AND height > 0 THEN ',RESOLUTION=' || width || 'x' || height ELSE '' END
        || CASE WHEN frame_rate > 0 AND frame_rate < 1000 THEN printf(',FRAME-RATE=%.3f', frame_rate) ELSE '' END || CASE WHEN m.release_id % 3 > 0 THEN ',AUDIO="audio"' ELSE '' END || CASE WHEN m.release_id % 4 = 0 THEN '' ELSE ',SUBTITLES="subs"' END
        || chr(10) || 'media.m3u8' || chr(10)) AS digest FROM media m JOIN rel r USING (release_id)""",
)
def master_manifests(spark, sf):
    rid = _c("release_id")
    sizes = c.releases(spark, sf).select("release_id", "size_bytes")
    avg, peak = link.bandwidth(_c("size_bytes"), F.lit(7200.0))
    sub = lambda lang, name: F.struct(F.lit(lang).alias("lang"), F.lit(name).alias("name"))
    both = F.array(sub("en", "English"), sub("und", "Unknown"))
    m = c.media(spark, sf).join(sizes, "release_id").select(
        "release_id", F.coalesce("codecs", F.lit("avc1.640028")).alias("video_codecs"), F.lit(None).cast("string").alias("supplemental"),
        F.when(_c("hdr"), F.when(_c("hlg"), "HLG").otherwise("PQ")).alias("range"), "width", "height", "frame_rate", "closed_gops",
        peak.alias("peak"), avg.alias("average"), F.when(rid % 3 > 0, "ec-3").otherwise("mp4a.40.2").alias("audio_codec"),
        F.when(rid % 3 > 0, rid % 3 * 3).alias("audio_channels"), F.when(rid % 5 != 0, "de").alias("audio_language"),
        F.when(rid % 5 != 0, "German").alias("audio_name"), F.when(rid % 4 == 0, F.slice(both, 1, 0)).otherwise(both).alias("subtitles"),
    )
    return wr.render_master_manifest(m).select("release_id", F.md5("text").alias("digest"))


@query(
    "parse_manifests",
    with_("segs") + """SELECT title, count(*) AS pieces, round(sum(round("end" - start, 6)), 6) AS secs FROM segs WHERE n % 7 <> 3 AND n % 11 <> 5 GROUP BY title""",
)
def parse_manifests(spark, sf):
    secs = _c("end") - _c("start")
    line = (
        F.when(_c("n") % 7 == 3, F.format_string("#EXTINF:%.6f,\n../g%d.m4s\n", secs, _c("n")))
        .when(_c("n") % 11 == 5, F.format_string("#EXTINF:%.6f,\n#EXTINF:junk,\ng%d.m4s\n", secs, _c("n")))
        .otherwise(F.format_string("#EXTINF:%.6f,\r\n#EXT-X-NOTE\n  g%d.m4s\n\n", secs, _c("n")))
    )
    rows = F.array_sort(F.collect_list(F.struct("n", line.alias("l"))))
    texts = segments(spark, sf).groupBy("title").agg(rows.alias("r"))
    texts = texts.select("title", F.concat(F.lit("#EXTM3U\n"), F.array_join(_c("r.l"), "")).alias("text"))
    out = rd.parse_manifest(texts, "title", "text")
    return out.groupBy("title").agg(F.count("*").alias("pieces"), F.round(F.sum("duration"), 6).alias("secs"))


@query(
    "metrics_text",
    with_(**_METRIC_CTES)
    + """SELECT string_agg('# HELP play_' || name || ' ' || help || chr(10) || '# TYPE play_' || name || ' ' || kind || chr(10) || 'play_' || name || ' ' || value || chr(10), '' ORDER BY name) AS text FROM m""",
)
def metrics_text(spark, sf):
    return wr.render_metrics(metrics(spark, sf))


# ---- sources and sinks --------------------------------------------------------------------------------------------


@query(
    "read_releases",
    with_("rel") + """SELECT title_id, listed_pos, title, filename, label, codec, cached, size_bytes, pack_size_bytes, three_d, resolution, hdr, bit_depth, dv_profile, probed FROM rel""",
)
def read_releases(spark, sf):
    rel = c.releases(spark, sf)
    attrs = F.struct(
        "codec", "cached", _c("size_bytes").alias("sizeBytes"), _c("pack_size_bytes").alias("packSizeBytes"), "label",
        F.when(_c("three_d"), True).alias("threeD"), "resolution", F.when(_c("hdr"), True).alias("hdr"),
        F.when(_c("bit_depth") > 0, _c("bit_depth")).alias("bitDepth"), F.when(_c("dv_profile") > 0, _c("dv_profile")).alias("dvProfile"),
        F.when(_c("probed"), True).alias("probed"), F.lit("ignored").alias("unknown"),
    )
    stream = F.struct("title", F.lit("u").alias("url"), attrs.alias("attributes"), F.struct("filename").alias("behaviorHints"))
    lists = rel.groupBy("title_id").agg(F.array_sort(F.collect_list(F.struct("listed_pos", F.to_json(stream).alias("j")))).alias("l"))
    lines = lists.select(
        F.concat(F.format_string('{"title_id":"%d","streams":[', _c("title_id")), F.array_join(_c("l.j"), ","), F.lit("]}")).alias("value")
    )
    lines = lines.unionByName(lists.where(_c("title_id") % 5 == 0).select(F.lit("not a list").alias("value")))
    path = shared_dir(spark, "listing")
    lines.write.text(path)
    rows, _ = rd.read_releases(spark, path)
    return rows.drop("url").withColumn("title_id", _c("title_id").cast("bigint"))


_SUBS_LONG = 25


@query(
    "media_snapshot",
    with_(
        "media",
        "idx",
        "dur",
        m="""SELECT m.*, coalesce(d.duration, 7200) - CASE WHEN release_id % 6 = 0 THEN 6000 ELSE 0 END AS duration
            FROM media m LEFT JOIN dur d ON d.title = m.timeline""",
        s="""SELECT title, t, CASE WHEN title % 9 = 0 THEN -pos ELSE pos END AS pos, row_number() OVER (PARTITION BY title
            ORDER BY t * CASE WHEN title % 11 = 0 THEN -1 ELSE 1 END, id * CASE WHEN title % 11 = 0 THEN -1 ELSE 1 END) AS i FROM idx""",
        g="""SELECT title, min(t) AS lo, max(t) AS hi, coalesce(bool_or(t < lt OR pos < lp), false) AS down FROM (SELECT *, lag(t) OVER w AS lt,
            lag(pos) OVER w AS lp FROM s WINDOW w AS (PARTITION BY title ORDER BY i)) GROUP BY title""",
    )
    + f"""SELECT release_id, container, duration FROM m LEFT JOIN g ON g.title = m.timeline WHERE release_id % 4 <> 0 AND container <> 'webm'
        AND duration BETWEEN 0 AND 604800 AND coalesce(frame_rate BETWEEN 0 AND 1000, true) AND release_id % 21 <> 0
        AND release_id % {_SUBS_LONG} <> 0 AND coalesce(lo >= 0 AND hi <= duration + 1 AND NOT down, true)""",
)
def media_snapshot(spark, sf):
    """Probes stored with their keyframes, byte index and tracks, read back, and judged inside their rows."""
    from playlens.operators import releases as rel

    rid, title = _c("release_id"), _c("timeline")
    d = c.durations(spark, sf).withColumnRenamed("title", "timeline")
    # A title's index is at most 65 536 entries long.
    listed = c.byte_index(spark, sf).groupBy(_c("title").alias("timeline")).agg(F.array_sort(F.collect_list(F.struct("t", "id", "pos"))).alias("l"))
    entries = F.transform(
        F.when(title % 11 == 0, F.reverse("l")).otherwise(_c("l")),
        lambda x: F.struct(x["t"].alias("t"), F.when(title % 9 == 0, -x["pos"]).otherwise(x["pos"]).alias("pos")),
    )

    def track(channels):
        name = F.lit(None).cast("string")
        return F.struct(F.lit("ac-3").alias("codec"), F.lit("eng").alias("language"), name.alias("name"), channels.alias("channels"))

    last = F.when(rid % 21 == 0, 65).otherwise(8)
    sub = F.struct(F.when(rid % _SUBS_LONG == 0, F.repeat(F.lit("s"), 257)).otherwise("srt").alias("codec"), F.lit("eng").alias("language"))
    kept = (
        c.media(spark, sf)
        .join(d, "timeline", "left")
        .join(listed, "timeline", "left")
        .withColumn("duration", F.coalesce("duration", F.lit(7200.0)) - F.when(rid % 6 == 0, 6000.0).otherwise(0.0))
        .withColumn("byte_index", entries)
        .withColumn("keyframes", _c("byte_index.t"))
        .withColumns({"audio": F.array(track(F.lit(2)), track(F.lit(6)), track(last)), "subs": F.array(sub)})
        .drop("l")
    )
    path = shared_dir(spark, "probes")
    kept.withColumn("schema", F.when(rid % 4 == 0, 2).otherwise(1)).write.json(path)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    checked = rel.validate_nested(rd.read_media_snapshot(spark, path, columns))
    return checked.where(F.size("failed") == 0).select("release_id", "container", "duration")


@query(
    "stored_results",
    """SELECT 'tt' || p_partkey // 10 AS imdb, (p_partkey % 10 // 5)::INT AS season, (p_partkey % 5)::INT AS episode, CASE WHEN p_partkey % 3 = 0 THEN p_size * 2.0::DOUBLE ELSE p_size * 1.0::DOUBLE END AS duration FROM part""",
)
def stored_results(spark, sf):
    k = _c("p_partkey")
    rows = c.table(spark, sf, "part").select(
        F.concat(F.lit("tt"), F.floor(k / 10).cast("string")).alias("imdb"), F.floor(k % 10 / 5).cast("int").alias("season"),
        (k % 5).cast("int").alias("episode"), (_c("p_size") * F.lit(1.0)).alias("duration"), k.alias("k"),
    )
    path = shared_dir(spark, "results")
    wr.write_results(rows.drop("k"), path)
    wr.write_results(rows.where(_c("k") % 3 == 0).drop("k").withColumn("duration", _c("duration") * 2), path)
    return wr.read_results(spark, path)


@query(
    "subtitle_listing",
    """SELECT doc_id // 4 AS k, cast(doc_id % 4 AS int) AS pos, 'http://subs.example/' || doc_id || '.srt' AS url, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, '') AS lang, doc_id % 5 = 0 OR doc_id % 7 = 0 AS partial FROM documents WHERE doc_id // 4 % 9 <> 0""",
)
def subtitle_listing(spark, sf):
    d = _c("doc_id")
    entry = F.to_json(
        F.struct(
            F.concat(F.lit("http://subs.example/"), d.cast("string"), F.lit(".srt")).alias("url"), F.when(d % 3 > 0, _c("lang")).alias("lang"),
            F.when(d % 5 == 0, True).alias("foreignPartsOnly"), F.when(d % 7 == 0, True).alias("looksDubbed"),
        )
    )
    rows = c.table(spark, sf, "documents").groupBy(F.floor(d / 4).alias("k")).agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("l"))
    body = F.when(_c("k") % 9 == 0, "<html>").otherwise(F.concat(F.lit('{"subtitles":['), F.array_join(_c("l.e"), ","), F.lit("]}")))
    return rd.read_subtitle_listing(rows.select("k", body.alias("body")), "k", "body")


@query(
    "content_duplicates",
    """SELECT key, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, strlen(text) || ':' || sha256(text) AS key FROM documents WHERE strlen(text) > 0) GROUP BY key HAVING count(*) > 1""",
)
def content_duplicates(spark, sf):
    return dd.duplicates(c.table(spark, sf, "documents"), dd.content_key(_c("text")), "doc_id")


# Reels of a hundred texts, every second one stored twice; single texts are files too short for an end hash.
_REEL = 100
_WORDS = """list_sum([('0x' || substr(w, 15, 2) || substr(w, 13, 2) || substr(w, 11, 2) || substr(w, 9, 2) || substr(w, 7, 2) || substr(w, 5, 2) ||
    substr(w, 3, 2) || substr(w, 1, 2))::UBIGINT::HUGEINT FOR w IN regexp_extract_all({h}, '.{{16}}')])"""


@query(
    "end_hash_duplicates",
    f"""WITH reels AS (SELECT doc_id // {_REEL} AS k, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY k),
        files AS (SELECT 'reel-' || k || '-a' AS name, content FROM reels UNION ALL SELECT 'reel-' || k || '-b', content FROM reels WHERE k % 2 = 0
        UNION ALL SELECT 'text-' || doc_id, text FROM documents WHERE strlen(text) > 0),
        sized AS (SELECT name, content, strlen(content) AS n FROM files), ends AS (SELECT name, n, substr(hex(content), 1, 131072) AS head,
        right(hex(content), 131072) AS foot FROM sized WHERE n >= 65536),
        keyed AS (SELECT name, format('{{:016x}}', ((n + {_WORDS.format(h="head")} + {_WORDS.format(h="foot")}) % 18446744073709551616)::UBIGINT) AS key FROM ends
        UNION ALL SELECT name, n || ':' || sha256(content) FROM sized WHERE n BETWEEN 1 AND 65535)
        SELECT key, count(*) AS n, min(name) AS first FROM keyed GROUP BY key HAVING count(*) > 1""",
)
def end_hash_duplicates(spark, sf):
    """Texts and reels of texts stored as files; those that share a key. Of a long file only the two ends are read."""
    docs = c.table(spark, sf, "documents")
    reels = docs.groupBy(F.floor(_c("doc_id") / _REEL).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("l")
    )
    reels = reels.select("k", F.array_join(_c("l.text"), "\n").alias("content"))
    name = lambda kind, key, side="": F.concat(F.lit(kind), _c(key).cast("string"), F.lit(side)).alias("name")
    files = (
        reels.select(name("reel-", "k", "-a"), "content")
        .unionByName(reels.where(_c("k") % 2 == 0).select(name("reel-", "k", "-b"), "content"))
        .unionByName(docs.where(F.octet_length("text") > 0).select(name("text-", "doc_id"), _c("text").alias("content")))
    )
    keyed = dd.end_hash_of_files(wr.write_files(files, shared_dir(spark, "files")))
    return dd.duplicates(keyed.withColumn("name", F.element_at(F.split("path", "/"), -1)), _c("hash"), "name")
