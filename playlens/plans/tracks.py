"""Language, subtitle-track and cue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playlens.functions import lang, text as tx
from playlens.operators import cues as cu, tracks as tr
from playlens.operators.ordered import Scan, scan
from playlens.plans import carriers as c
from playlens.plans.carriers import with_
from playlens.plans.registry import query

_c = F.col

_LANGS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in lang._codes().items()) + ") l(code, canon, name)"
# Tags as releases write them, out of the documents' languages.
_TAG = """CASE doc_id % 8 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fra'
    ELSE 'spa' END WHEN 3 THEN 'nb' WHEN 4 THEN lang || '_x' WHEN 5 THEN 'tlh-' || lang WHEN 6 THEN 'und' END"""
_PRIMARY = "lower(split_part(replace(tag, '_', '-'), '-', 1))"


def tag_expr():
    return F.expr(_TAG)


@query(
    "canonical_language",
    with_(langs=_LANGS, tags=f"SELECT doc_id, {_TAG} AS tag FROM documents",
          pagetags="SELECT page_id, nullif(regexp_extract(html, 'lang=\"([^\"]*)\"', 1), '') AS tag FROM pages",
          every="SELECT doc_id AS id, 'document' AS kind, tag FROM tags UNION ALL SELECT page_id, 'page', tag FROM pagetags")
    + f"""SELECT id, kind, coalesce(canon, {_PRIMARY}) AS canonical, CASE WHEN tag = 'und' THEN 'Unknown' ELSE coalesce(name, tag) END AS language_name
        FROM every LEFT JOIN langs ON code = {_PRIMARY}""",
)
def canonical_language(spark, sf):
    docs = c.table(spark, sf, "documents").select(_c("doc_id").alias("id"), F.lit("document").alias("kind"), tag_expr().alias("tag"))
    pages = c.table(spark, sf, "pages").select(
        _c("page_id").alias("id"),
        F.lit("page").alias("kind"),
        F.nullif(F.regexp_extract("html", 'lang="([^"]*)"', 1), F.lit("")).alias("tag"),
    )
    return lang.canonical_language(docs.unionByName(pages), "tag").drop("tag")


@query(
    "ordered_union",
    with_(langs=_LANGS, t=f"SELECT doc_id, source, {_TAG} AS tag, lang FROM documents",
          u=f"""SELECT doc_id, 0 AS l, 1 AS p, coalesce(canon, {_PRIMARY}) AS x FROM t LEFT JOIN langs ON code = {_PRIMARY} UNION ALL
          SELECT doc_id, 1, 1, 'en' FROM t UNION ALL SELECT doc_id, 2, 1, lang FROM t UNION ALL SELECT doc_id, 2, 2, 'fi' FROM t""")
    + """SELECT doc_id, string_agg(x, ',' ORDER BY l, p) AS languages FROM (SELECT doc_id, x, min(l) AS l, arg_min(p, l) AS p FROM u WHERE x IS NOT NULL
        AND x <> '' GROUP BY doc_id, x) GROUP BY doc_id""",
)
def ordered_union(spark, sf):
    docs = c.table(spark, sf, "documents").withColumn("tag", tag_expr())
    out = lang.ordered_union(F.array(lang.canonical(_c("tag"))), F.array(F.lit("en")), F.array("lang", F.lit("fi")))
    return docs.select("doc_id", F.array_join(out, ",").alias("languages"))


# Eight documents stand for the subtitle tracks of one release; its audio is in one of four languages.
_TRACKS = f"""SELECT cast(floor(doc_id / 8) AS bigint) AS release_id, cast(doc_id % 8 AS int) AS idx, {_TAG} AS language, n_chars % 7 <> 0 AS text,
    n_chars % 3 = 0 AS forced, n_chars % 5 = 0 AS hearing_impaired, CASE floor(doc_id / 8) % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'no' WHEN 3 THEN 'fr' END
    AS audio_lang, floor(doc_id / 8) % 3 <> 0 AS asks FROM documents"""
_LISTED = f"""SELECT cast(floor(d.doc_id / 8) AS bigint) AS release_id, d.doc_id AS pos, {_TAG.replace('doc_id', 'd.doc_id')} AS lang, l.quality = 0 OR l.toxic = 1 AS partial
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE {_TAG.replace('doc_id', 'd.doc_id')} IS NOT NULL"""
_P = "lower(split_part(replace({0}, '_', '-'), '-', 1))"
_OWN = {
    "langs": _LANGS,
    "tracks": _TRACKS,
    "listed": _LISTED,
    "keyed": f"""SELECT t.*, coalesce(l.canon, {_P.format('language')}) AS tagged FROM tracks t LEFT JOIN langs l ON l.code = {_P.format('language')}""",
    "k2": """SELECT *, coalesce(tagged, 'und') AS lang, coalesce(tagged = audio_lang, false) AS dub FROM keyed""",
    "k3": "SELECT *, CASE WHEN forced THEN 2 WHEN hearing_impaired THEN 1 ELSE 0 END AS t0 FROM k2",
    "k4": "SELECT *, CASE WHEN dub THEN 2 - t0 ELSE t0 END AS tier FROM k3",
    "own": """SELECT release_id, lang, arg_min(idx, (tier, idx)) FILTER (WHERE dub OR NOT forced) AS idx, min(idx) AS first_idx,
        min(tier) FILTER (WHERE dub OR NOT forced) AS rank, bool_or(dub) AS dub FROM k4 WHERE text GROUP BY ALL HAVING count(*) FILTER (WHERE dub OR NOT forced) > 0""",
    "bl": f"""SELECT release_id, coalesce(l.canon, {_P.format('lang')}) AS lang, arg_min(partial, pos) AS partial, min(pos) AS pos FROM listed x
        LEFT JOIN langs l ON l.code = {_P.format('lang')} GROUP BY ALL""",
}


def tracks(spark, sf):
    release = F.floor(_c("doc_id") / 8)
    return c.table(spark, sf, "documents").select(
        release.alias("release_id"),
        (_c("doc_id") % 8).cast("int").alias("idx"),
        tag_expr().alias("language"),
        (_c("n_chars") % 7 != 0).alias("text"),
        (_c("n_chars") % 3 == 0).alias("forced"),
        (_c("n_chars") % 5 == 0).alias("hearing_impaired"),
        F.when(release % 5 == 0, "en").when(release % 5 == 1, "de").when(release % 5 == 2, "no").when(release % 5 == 3, "fr").alias("audio_lang"),
    )


def listed(spark, sf):
    labels = c.table(spark, sf, "labels")
    rows = c.table(spark, sf, "documents").join(labels, "doc_id")
    return rows.select(
        F.floor(_c("doc_id") / 8).alias("release_id"),
        _c("doc_id").alias("pos"),
        tag_expr().alias("lang"),
        ((_c("quality") == 0) | (_c("toxic") == 1)).alias("partial"),
    ).where(_c("lang").isNotNull())


def sessions(spark, sf):
    """One session a release: its languages are those of two of its tracks."""
    t = tracks(spark, sf)
    some = F.array_sort(F.collect_list(F.when(_c("idx").isin(4, 7), F.struct("idx", "language"))))
    return t.groupBy("release_id", "audio_lang").agg(some["language"].alias("requested")).select(
        _c("release_id").alias("session_id"), "release_id", "requested", "audio_lang", (_c("release_id") % 3 != 0).alias("asks")
    )


@query("best_own_subtitles", with_(**_OWN) + "SELECT release_id, lang, idx, rank FROM own")
def best_own(spark, sf):
    return tr.best_own_subtitles(tracks(spark, sf)).select("release_id", "lang", "idx", "rank")


@query(
    "own_or_download",
    with_(**_OWN)
    + """SELECT o.release_id, o.lang, o.idx, CASE WHEN b.pos IS NULL OR o.rank <= CASE WHEN o.dub THEN 2 - CASE WHEN partial THEN 2 ELSE 0 END
        WHEN partial THEN 2 ELSE 0 END THEN 'own' ELSE 'download' END AS source FROM own o LEFT JOIN bl b ON b.release_id = o.release_id AND b.lang = o.lang""",
)
def own_or_download(spark, sf):
    return tr.own_or_download(tr.best_own_subtitles(tracks(spark, sf)), listed(spark, sf))


_PLAN = {
    **_OWN,
    "req": """SELECT DISTINCT release_id, audio_lang, asks FROM tracks""",
    "r0": """SELECT release_id, tagged AS lang, row_number() OVER (PARTITION BY release_id ORDER BY idx) AS i FROM keyed WHERE idx IN (4, 7) AND tagged IS NOT NULL AND tagged <> ''""",
    "pref0": """SELECT release_id, lang, 0 AS g, i FROM r0 WHERE i = 1 UNION ALL SELECT release_id, 'en', 1, 1 FROM req UNION ALL SELECT release_id, lang, 2, i FROM r0
        UNION ALL SELECT release_id, audio_lang, 3, 1 FROM req WHERE audio_lang IS NOT NULL""",
    "pref": "SELECT release_id, lang, min((g, i)) AS place FROM pref0 GROUP BY ALL",
    "cand": """SELECT p.release_id, p.lang, o.idx AS own, q.asks AND (o.idx IS NOT NULL OR b.pos IS NOT NULL) AS download, 0 AS grp, place, 0 AS f FROM pref p JOIN req q USING (release_id)
        LEFT JOIN own o ON o.release_id = p.release_id AND o.lang = p.lang LEFT JOIN bl b ON b.release_id = p.release_id AND b.lang = p.lang
        UNION ALL SELECT o.release_id, o.lang, o.idx, false, 1, (9, 9), first_idx FROM own o WHERE NOT EXISTS (SELECT 1 FROM pref p WHERE p.release_id = o.release_id AND p.lang = o.lang)""",
    "plan": """SELECT release_id, lang, own, download, row_number() OVER (PARTITION BY release_id ORDER BY grp, place, f) - 1 AS slot FROM cand
        WHERE download OR own IS NOT NULL""",
}


@query("plan_subtitles", with_(**_PLAN) + "SELECT release_id, slot, lang, own, download FROM plan")
def plan_subtitles(spark, sf):
    own = tr.best_own_subtitles(tracks(spark, sf))
    return tr.plan_subtitles(sessions(spark, sf), own, listed(spark, sf)).select("release_id", "slot", "lang", "own", "download")


@query(
    "explain_subtitles",
    with_(**_PLAN)
    + """SELECT k.release_id, k.idx, k.lang, CASE WHEN NOT text THEN 'bitmap' WHEN tagged IS NULL AND forced THEN 'forced without a language'
        WHEN o.idx IS NULL THEN 'forced without a dub' WHEN o.idx <> k.idx THEN 'track ' || o.idx || ' ranks higher' WHEN EXISTS (SELECT 1 FROM plan p
        WHERE p.release_id = k.release_id AND p.own = k.idx) THEN 'offered' ELSE 'not used' END AS reason FROM k4 k LEFT JOIN own o ON o.release_id = k.release_id AND o.lang = k.lang""",
)
def explain_subtitles(spark, sf):
    t, s = tracks(spark, sf), sessions(spark, sf)
    own = tr.best_own_subtitles(t)
    plan = tr.plan_subtitles(s, own, listed(spark, sf))
    return tr.explain_subtitles(s, t, own, plan).select("release_id", "idx", "lang", "reason")


@query(
    "first_success",
    """WITH a AS (SELECT user_id * 100000 + event_id // 64 AS key, row_number() OVER (PARTITION BY user_id, event_id // 64 ORDER BY event_id) - 1 AS rank,
        CASE event_type WHEN 'purchase' THEN 'found' WHEN 'click' THEN 'sparse' WHEN 'view' THEN 'sparse' ELSE 'refused' END AS outcome,
        event_id % 2 = 0 AS again FROM events), t AS (SELECT *, outcome = 'sparse' AND again AS retried FROM a)
        SELECT key, CASE WHEN count(*) FILTER (WHERE outcome = 'found') > 0 THEN min(rank) FILTER (WHERE outcome = 'found') ELSE min(rank) FILTER (WHERE retried) END AS rank,
        CASE WHEN count(*) FILTER (WHERE outcome = 'found') > 0 THEN false WHEN count(*) FILTER (WHERE retried) > 0 THEN true END AS retried FROM t GROUP BY key""",
)
def first_success(spark, sf):
    ev = c.table(spark, sf, "events").withColumn("key", _c("user_id") * 100000 + F.floor(_c("event_id") / 64))
    kind = _c("event_type")
    outcome = F.when(kind == "purchase", "found").when(kind.isin("click", "view"), "sparse").otherwise("refused")
    ranked = scan(ev, ["key"], ["event_id"], F.floor(_c("event_id") / 64), [Scan("rank", "sum", F.lit(1))])
    attempts = ranked.select(
        "key", (_c("rank") - 1).alias("rank"), outcome.alias("outcome"), F.when(_c("event_id") % 2 == 0, "found").otherwise("refused").alias("retry")
    )
    return tr.first_success(attempts)


@query(
    "subtitle_urls",
    """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '?', '.srt?') WHEN 1 THEN url || '.srt' ELSE url END AS url FROM pages)
        SELECT page_id, CASE WHEN position('?' IN url) > 0 THEN regexp_replace(split_part(url, '?', 1), '\\.srt$', '.vtt') || substr(url, position('?' IN url))
        ELSE regexp_replace(url, '\\.srt$', '.vtt') END AS vtt, url || CASE WHEN position('?' IN url) > 0 THEN '&' ELSE '?' END || 'sparse=1' AS sparse FROM u""",
)
def subtitle_urls(spark, sf):
    url = F.when(_c("page_id") % 3 == 0, F.replace("url", F.lit("?"), F.lit(".srt?"))).when(_c("page_id") % 3 == 1, F.concat("url", F.lit(".srt"))).otherwise(_c("url"))
    u = c.table(spark, sf, "pages").withColumn("u", url)
    return u.select("page_id", tx.vtt_url(_c("u")).alias("vtt"), tx.with_sparse(_c("u")).alias("sparse"))


# ---- cues ---------------------------------------------------------------------------------------------------------

# Each turn of a conversation is a cue, 40 ms a character after the one before.
_CUES = """SELECT conv_id AS track, turn, cast(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 40 AS bigint)
    AS start_ms, length(text) * 40 AS len, md5(text) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations"""
_CUE = "SELECT track, turn, start_ms, start_ms + len AS end_ms, line FROM cues0"


def cues(spark, sf):
    conv = c.table(spark, sf, "conversations").select(
        _c("conv_id").alias("track"), "turn", (F.length("text") * 40).cast("bigint").alias("len"), F.md5("text").alias("line")
    )
    run = scan(conv, ["track"], ["turn"], F.floor(_c("turn") / 256), [Scan("__sum", "sum", _c("len"))])
    return run.select("track", "turn", (_c("__sum") - _c("len")).alias("start_ms"), _c("__sum").alias("end_ms"), "line")


def _clock(ms):
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


_CLOCK = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_VTT = f"""SELECT track, 'WEBVTT' || chr(10) || chr(10) || 'NOTE made up --> of turns' || chr(10) || 'x' || chr(10) || chr(10) || string_agg(turn || chr(10) ||
    {_CLOCK.format('start_ms')} || ' --> ' || {_CLOCK.format('end_ms')} || CASE WHEN turn % 2 = 1 THEN ' align:start' ELSE '' END || CASE WHEN turn % 5 = 4 THEN '' ELSE
    chr(13) || chr(10) || line END, chr(10) || chr(10) ORDER BY turn) || CASE WHEN track % 3 = 0 THEN '' ELSE chr(10) END AS doc FROM cue GROUP BY track"""


def vtt(spark, sf):
    line = F.concat(
        _c("turn").cast("string"), F.lit("\n"), _clock(_c("start_ms")), F.lit(" --> "), _clock(_c("end_ms")),
        F.when(_c("turn") % 2 == 1, " align:start").otherwise(""),
        F.when(_c("turn") % 5 == 4, "").otherwise(F.concat(F.lit("\r\n"), _c("line"))),
    )
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    docs = cues(spark, sf).groupBy("track").agg(rows.alias("r"))
    return docs.select(
        "track",
        F.concat(
            F.lit("WEBVTT\n\nNOTE made up --> of turns\nx\n\n"),
            F.array_join(_c("r.l"), "\n\n"),
            F.when(_c("track") % 3 == 0, "").otherwise("\n"),
        ).alias("doc"),
    )


@query(
    "parse_cues",
    with_(cues0=_CUES, cue=_CUE, last="SELECT track, max(turn) AS turn FROM cue GROUP BY track")
    + """SELECT track, start_ms, end_ms, length(turn::VARCHAR) + 1 + 29 + CASE WHEN turn % 2 = 1 THEN 12 ELSE 0 END + 1 + 32 AS block_length FROM cue
        WHERE turn % 5 <> 4 AND NOT (track % 3 = 0 AND turn = (SELECT l.turn FROM last l WHERE l.track = cue.track))""",
)
def parse_cues(spark, sf):
    out = cu.parse_cues(vtt(spark, sf), "track", "doc")
    return out.select("track", "start_ms", "end_ms", F.length("block").alias("block_length"))


@query(
    "cue_times",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN printf('%02d:%02d.%03d', event_id % 60, user_id % 60, event_id % 1000)
        WHEN 1 THEN printf('%d:%02d:%02d.%d', user_id, event_id % 60, user_id % 60, event_id % 100) WHEN 2 THEN printf('%02d:%02d', event_id % 60, user_id % 60)
        WHEN 3 THEN printf('x:%02d:%02d.5', event_id % 60, user_id % 60) WHEN 4 THEN printf('%02d:%02d.%06d', event_id % 60, user_id % 60, event_id) ELSE event_type END AS s FROM events)
        SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 4) THEN (CASE WHEN event_id % 6 = 1 THEN split_part(s, ':', 1)::BIGINT * 3600 + split_part(s, ':', 2)::BIGINT * 60
        + split_part(split_part(s, ':', 3), '.', 1)::BIGINT ELSE split_part(s, ':', 1)::BIGINT * 60 + split_part(split_part(s, ':', 2), '.', 1)::BIGINT END) * 1000
        + rpad(substr(split_part(s, '.', 2), 1, 3), 3, '0')::BIGINT END AS ms FROM t""",
)
def cue_times(spark, sf):
    e, u = _c("event_id"), _c("user_id")
    s = (
        F.when(e % 6 == 0, F.format_string("%02d:%02d.%03d", e % 60, u % 60, e % 1000))
        .when(e % 6 == 1, F.format_string("%d:%02d:%02d.%d", u, e % 60, u % 60, e % 100))
        .when(e % 6 == 2, F.format_string("%02d:%02d", e % 60, u % 60))
        .when(e % 6 == 3, F.format_string("x:%02d:%02d.5", e % 60, u % 60))
        .when(e % 6 == 4, F.format_string("%02d:%02d.%06d", e % 60, u % 60, e))
        .otherwise(_c("event_type"))
    )
    return c.table(spark, sf, "events").select("event_id", tx.vtt_ms(s).alias("ms"))


@query(
    "normalise_vtt",
    with_(d="""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN chr(65279) || 'WEBVTT - x  ' || chr(10) || text WHEN 1 THEN text
        WHEN 2 THEN 'WEBVTT' || chr(10) || 'X-TIMESTAMP-MAP=LOCAL:0' || chr(10) || text ELSE 'WEBVTT' END AS t FROM conversations""")
    + """SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN 'WEBVTT - x' || chr(10) || 'X-TIMESTAMP-MAP=MPEGTS:0,LOCAL:00:00:00.000' || substr(t, 14)
        WHEN 2 THEN t WHEN 3 THEN 'WEBVTT' || chr(10) || 'X-TIMESTAMP-MAP=MPEGTS:0,LOCAL:00:00:00.000' || chr(10) END) AS digest FROM d""",
)
def normalise_vtt(spark, sf):
    t = _c("turn") % 4
    doc = (
        F.when(t == 0, F.concat(F.lit("﻿WEBVTT - x  \n"), _c("text")))
        .when(t == 1, _c("text"))
        .when(t == 2, F.concat(F.lit("WEBVTT\nX-TIMESTAMP-MAP=LOCAL:0\n"), _c("text")))
        .otherwise("WEBVTT")
    )
    return c.table(spark, sf, "conversations").withColumn("doc", doc).select("conv_id", "turn", F.md5(tx.normalise_vtt(_c("doc"))).alias("digest"))


# Segments of 20 s over every track.
_SEGS = """SELECT track, n, n * 20000 AS from_ms, (n + 1) * 20000 AS to_ms FROM (SELECT track, unnest(range((max(end_ms) // 20000)::BIGINT + 1)) AS n FROM cue GROUP BY track)"""


def cue_segments(spark, sf):
    ends = cues(spark, sf).groupBy("track").agg(F.max("end_ms").alias("end"))
    n = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(_c("end") / 20000)))
    return ends.select("track", n.alias("n")).select("track", "n", (_c("n") * 20000).alias("from_ms"), ((_c("n") + 1) * 20000).alias("to_ms"))


@query(
    "cues_in_segments",
    with_(cues0=_CUES, cue=_CUE, seg=_SEGS)
    + """SELECT s.track, s.n, count(*) AS cues, md5('WEBVTT' || chr(10) || string_agg(line || chr(10) || chr(10), '' ORDER BY start_ms, end_ms, line)) AS text FROM seg s JOIN cue c ON c.track = s.track
        AND c.start_ms < s.to_ms AND greatest(c.end_ms, c.start_ms + 1) > s.from_ms GROUP BY s.track, s.n""",
)
def cues_in_segments(spark, sf):
    pairs = cu.cues_in_segments(cues(spark, sf), cue_segments(spark, sf)).withColumn("block", _c("line"))
    counts = F.size(F.split("text", "\n\n")) - 1
    return cu.render_window(pairs, "WEBVTT\n").select("track", "n", counts.cast("bigint").alias("cues"), F.md5("text").alias("text"))


@query(
    "cue_union",
    with_(cues0=_CUES, cue=_CUE)
    + "SELECT track, count(*) AS cues, cast(sum(end_ms - start_ms) AS bigint) AS shown_ms FROM cue GROUP BY track",
)
def cue_union(spark, sf):
    every = cues(spark, sf).withColumn("block", _c("line"))
    first, second = every.where(_c("turn") % 3 != 0), every.where(_c("turn") % 3 != 1)
    out = cu.cue_union(first, second, every.where(_c("turn") < 2))
    return out.groupBy("track").agg(F.count("*").alias("cues"), F.sum(_c("end_ms") - _c("start_ms")).alias("shown_ms"))
