"""Timeline and link queries, over the event timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from playlens.operators import link, timeline as tl
from playlens.operators.ordered import Scan, merge_intervals, scan
from playlens.plans import carriers as c
from playlens.plans.carriers import TARGET, with_
from playlens.plans.registry import query
from playlens.session import cut_lineage


def segments(spark, sf):
    return tl.plan_segments(c.timeline(spark, sf), c.durations(spark, sf), TARGET)


@query(
    "plan_segments",
    with_("segs") + 'SELECT title, n, round(start, 6) AS start, round("end", 6) AS "end" FROM segs',
)
def plan_segments(spark, sf):
    return segments(spark, sf).select("title", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_TIMES = "SELECT title, id, t + (id % 7 - 3) * 0.02::DOUBLE AS t FROM tl"


def times(spark, sf):
    return c.timeline(spark, sf).select(
        "title", "id", (F.col("t") + (F.col("id") % 7 - 3) * F.lit(0.02)).alias("t")
    )


@query(
    "bytes_at",
    with_("bounds", "idx", times=_TIMES)
    + """SELECT q.title, q.id, round(CASE WHEN t1 <= q.t + 1e-6 THEN p1 + (q.t - t1) * ((p1 - p0) / (t1 - t0))
        ELSE coalesce(i.pos, p0) END::DOUBLE, 3) AS pos
        FROM times q ASOF LEFT JOIN idx i ON i.title = q.title AND i.t <= q.t + 1e-6
        JOIN bounds b ON b.title = q.title WHERE t1 > t0 AND p1 > p0""",
)
def bytes_at(spark, sf):
    at = tl.bytes_at(times(spark, sf), c.byte_index(spark, sf))
    return at.select("title", "id", F.round("pos", 3).alias("pos"))


@query("segment_bytes", with_("segbytes") + "SELECT title, n, round(bytes, 3) AS bytes FROM segbytes")
def segment_bytes(spark, sf):
    out = tl.segment_bytes(segments(spark, sf), c.byte_index(spark, sf))
    return out.select("title", "n", F.round("bytes", 3).alias("bytes"))


@query(
    "segment_at",
    with_("segs", times=_TIMES)
    + """SELECT t.title, t.id, coalesce(s.n, 0) AS n, coalesce(r.n, 0) AS resume_n FROM times t
        ASOF LEFT JOIN segs s ON s.title = t.title AND s.start <= t.t + 0.05::DOUBLE
        ASOF LEFT JOIN segs r ON r.title = t.title AND r.start <= greatest(t.t - 1, 0) + 0.05::DOUBLE""",
)
def segment_at(spark, sf):
    segs, at = segments(spark, sf), times(spark, sf)
    here = tl.segment_at(at, segs)
    resumed = tl.segment_at(here.withColumnRenamed("n", "now"), segs, shift=tl.START_SLACK)
    return resumed.select("title", "id", F.col("now").alias("n"), F.col("n").alias("resume_n"))


@query(
    "snap_nearest",
    with_("tl", times=_TIMES)
    + """SELECT q.title, q.id, round(coalesce((SELECT arg_min(k.t, (abs(k.t - q.t), k.t)) FROM tl k
        WHERE k.title = q.title AND abs(k.t - q.t) < 0.05), q.t), 6) AS snapped FROM times q""",
)
def snap_nearest(spark, sf):
    out = tl.snap_nearest(times(spark, sf), c.timeline(spark, sf))
    return out.select("title", "id", F.round("snapped", 6).alias("snapped"))


@query(
    "restart_points",
    with_(
        "segs",
        "tl",
        gaps="""SELECT s.title, s.n, s.start, coalesce((SELECT min(t) FROM tl WHERE tl.title = s.title
            AND t > s.start + 1e-6), dur.duration) - s.start AS gap FROM segs s JOIN dur USING (title)""",
    )
    + """SELECT g.title, g.n, round(coalesce(m.start, (SELECT min(t) FROM tl WHERE tl.title = g.title)), 6) AS at,
        round(m.start + 0.135, 6) AS seek FROM gaps g LEFT JOIN gaps m ON m.title = g.title AND m.n =
        (SELECT max(x.n) FROM gaps x WHERE x.title = g.title AND x.n BETWEEN 1 AND g.n AND x.gap >= 0.15)""",
)
def restart_points(spark, sf):
    out = tl.restart_points(segments(spark, sf), c.timeline(spark, sf), c.durations(spark, sf))
    return out.select("title", "n", F.round("at", 6).alias("at"), F.round("seek", 6).alias("seek"))


# Three starts a title: the beginning, a time that many titles share, and one of its own.
_OPENING = {
    "starts": """SELECT DISTINCT title, unnest([0::DOUBLE, (title % 5) * 333.3::DOUBLE, duration * 0.37::DOUBLE]) AS start_at FROM dur""",
    "op": """SELECT s.title, s.n, s.start AS w0, s."end" AS w1, start_at, greatest(start_at - 1, 0) AS point FROM segs s
        JOIN starts USING (title) WHERE s.start <= greatest(start_at - 1, 0) AND greatest(start_at - 1, 0) < s."end" """,
    "bef": """SELECT op.*, coalesce((SELECT max(t) FROM tl WHERE tl.title = op.title AND t <= point + 1e-9),
        (SELECT min(t) FROM tl WHERE tl.title = op.title)) AS b FROM op""",
    "cand": """SELECT DISTINCT tl.title, tl.t, start_at, n, b, w1 FROM tl JOIN bef USING (title) WHERE t > w0 AND t < w1
        AND NOT (w0 = 0 AND abs(t - b) < 1e-9)""",
    "extra": """SELECT title, start_at, n, t AS start, w1 FROM cand k WHERE k.t + 1e-9 >= b AND NOT EXISTS
        (SELECT 1 FROM cand x WHERE x.title = k.title AND x.start_at = k.start_at AND x.t > x.start_at + 1e-9 AND x.t < k.t)""",
    "pieces": """SELECT title, start_at, n, row_number() OVER w - 1 AS piece, start, coalesce(lead(start) OVER w, w1) AS "end"
        FROM (SELECT title, start_at, n, w0 AS start, w1 FROM op UNION SELECT * FROM extra)
        WINDOW w AS (PARTITION BY title, start_at ORDER BY start)""",
    "many": "SELECT title, start_at, n AS at, max(piece) AS more FROM pieces GROUP BY title, start_at, n",
}


def starts(spark, sf):
    at = F.array(F.lit(0.0), (F.col("title") % 5) * F.lit(333.3), F.col("duration") * F.lit(0.37))
    return c.durations(spark, sf).select("title", F.explode(at).alias("start_at")).distinct()


@query(
    "split_opening",
    with_("segs", "tl", **_OPENING)
    + """SELECT title, round(start_at, 6) AS start_at, n + piece AS n, round(start, 6) AS start, round("end", 6) AS "end" FROM pieces
        UNION ALL SELECT s.title, round(t.start_at, 6), CASE WHEN s.n > m.at THEN s.n + m.more ELSE s.n END, round(s.start, 6), round(s."end", 6)
        FROM segs s JOIN starts t USING (title) LEFT JOIN many m ON m.title = s.title AND m.start_at = t.start_at WHERE m.at IS NULL OR s.n <> m.at""",
)
def split_opening(spark, sf):
    segs, at = cut_lineage(segments(spark, sf)), starts(spark, sf)
    out = tl.split_opening(segs, tl.opening_pieces(segs, c.timeline(spark, sf), at), at)
    return out.select("title", *[F.round(k, 6).alias(k) for k in ("start_at", "start", "end")], "n")


# Runs of sixteen keyframes each stand for a producer's jobs; every 37th GOP is gone.
_RANKED = """SELECT title, id, t, size, row_number() OVER w - 1 AS rn, lead(t) OVER w AS nxt FROM tl
    WINDOW w AS (PARTITION BY title ORDER BY t, id)"""
_GOPS = """SELECT title, id, rn // 16 AS job, rn % 16 AS idx, t AS start, coalesce(nxt - t, 30) AS dur, size
    FROM ranked WHERE id % 37 <> 0"""


def ranked(spark, sf):
    return scan(
        c.timeline(spark, sf),
        ["title"],
        ["t", "id"],
        F.floor(F.col("t") / 600.0),
        [Scan("rn", "sum", F.lit(1)), Scan("nxt", "first", F.col("t"), inclusive=False)],
    ).withColumn("rn", F.col("rn") - 1)


def gops(spark, sf):
    return (
        ranked(spark, sf)
        .where(F.col("id") % 37 != 0)
        .select(
            "title",
            "id",
            F.floor(F.col("rn") / 16).alias("job"),
            (F.col("rn") % 16).alias("idx"),
            F.col("t").alias("start"),
            F.coalesce(F.col("nxt") - F.col("t"), F.lit(30.0)).alias("dur"),
            "size",
        )
    )


@query(
    "gop_starts",
    "WITH RECURSIVE "
    + with_(
        "tl",
        ranked=_RANKED,
        pieces="""SELECT title, rn // 16 AS job, rn % 16 AS idx, first_value(t) OVER (PARTITION BY title, rn // 16
            ORDER BY rn) + 0.03 AS job_start, round(coalesce(nxt - t, 30), 2) + CASE WHEN id % 10 = 0 THEN 0.2::DOUBLE
            ELSE 0 END AS dur FROM ranked""",
    ).removeprefix("WITH ").rstrip()
    + """, r AS (SELECT title, job, idx, coalesce((SELECT arg_min(k.t, (abs(k.t - job_start), k.t)) FROM tl k WHERE
            k.title = p.title AND abs(k.t - job_start) < 0.05), job_start) AS start, dur FROM pieces p WHERE idx = 0
        UNION ALL SELECT p.title, p.job, p.idx, coalesce((SELECT arg_min(k.t, (abs(k.t - (r.start + r.dur)), k.t))
            FROM tl k WHERE k.title = p.title AND abs(k.t - (r.start + r.dur)) < 0.05), r.start + r.dur), p.dur
            FROM r JOIN pieces p ON p.title = r.title AND p.job = r.job AND p.idx = r.idx + 1)
        SELECT title, job, idx, round(start, 6) AS start FROM r""",
)
def gop_starts(spark, sf):
    pieces = ranked(spark, sf).select(
        "title",
        F.floor(F.col("rn") / 16).alias("job"),
        (F.col("rn") % 16).alias("idx"),
        "t",
        (
            F.round(F.coalesce(F.col("nxt") - F.col("t"), F.lit(30.0)), 2)
            + F.when(F.col("id") % 10 == 0, F.lit(0.2)).otherwise(F.lit(0.0))
        ).alias("dur"),
    )
    first = pieces.groupBy("title", "job").agg((F.min("t") + F.lit(0.03)).alias("job_start"))
    out = tl.gop_starts(pieces.join(first, ["title", "job"]), c.timeline(spark, sf))
    return out.select("title", "job", "idx", F.round("start", 6).alias("start"))


@query(
    "ready_segments",
    with_("segs", "tl", ranked=_RANKED, gops=_GOPS)
    + """SELECT s.title, s.n, arg_min(ok.job, (ok.start, ok.job)) AS job FROM segs s LEFT JOIN
        (SELECT s2.title, s2.n, g.start, g.job FROM segs s2 JOIN gops g ON g.title = s2.title
         AND (abs(g.start - s2.start) < 0.05 OR (s2.n = 0 AND g.start < s2."end"))
         WHERE EXISTS (SELECT 1 FROM gops h WHERE h.title = g.title AND h.job = g.job AND h.idx >= g.idx
            AND h.idx - g.idx + 1 = (SELECT count(*) FROM gops m WHERE m.title = g.title AND m.job = g.job
                AND m.idx BETWEEN g.idx AND h.idx)
            AND (h.start + h.dur >= s2."end" - 0.05 OR (h.job % 2 = 0 AND h.idx = (SELECT max(idx) FROM gops z
                WHERE z.title = g.title AND z.job = g.job))))) ok
        ON ok.title = s.title AND ok.n = s.n GROUP BY s.title, s.n""",
)
def ready_segments(spark, sf):
    pieces = gops(spark, sf)
    finished = pieces.where(F.col("job") % 2 == 0).select("title", "job").distinct()
    return tl.ready_segments(pieces, segments(spark, sf), finished).select("title", "n", "job")


@query(
    "retained_gops",
    with_(
        "segs",
        "tl",
        ranked=_RANKED,
        gops=_GOPS,
        want="SELECT title, 3 + title % 5 AS n, title % 3 AS cur, max(n) AS last FROM segs GROUP BY title",
        lim="""SELECT w.title, cur, (SELECT start FROM segs s WHERE s.title = w.title AND s.n = w.n - 1) - 0.05 AS lo,
            (SELECT "end" FROM segs s WHERE s.title = w.title AND s.n = least(w.n + 5, last)) + 0.05 AS hi FROM want w""",
    )
    + """SELECT title, count(*) FILTER (WHERE keep) AS kept, cast(coalesce(sum(size) FILTER (WHERE NOT keep), 0) AS bigint)
        AS freed FROM (SELECT g.title, size, start + dur > lo AND (start < hi OR job = cur) AS keep FROM gops g
        JOIN lim USING (title)) GROUP BY title""",
)
def retained_gops(spark, sf):
    segs = segments(spark, sf)
    wants = segs.select(
        "title", (3 + F.col("title") % 5).alias("n"), (F.col("title") % 3).alias("current_job")
    ).distinct()
    marked = tl.retained(gops(spark, sf), segs, wants)
    return marked.groupBy("title").agg(
        F.count_if("kept").alias("kept"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("size"))), F.lit(0)).alias("freed")
    )


_COVER = "SELECT title, t AS start, t + 20 * (1 + id % 5) AS \"end\" FROM tl WHERE id % 4 <> 0"
_MERGED = """SELECT title, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN reach IS NULL OR
    start > reach + 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY title ORDER BY start, "end") AS isl FROM
    (SELECT *, max("end") OVER (PARTITION BY title ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS reach FROM cover)) GROUP BY title, isl"""


def coverage(spark, sf):
    return (
        c.timeline(spark, sf)
        .where(F.col("id") % 4 != 0)
        .select("title", F.col("t").alias("start"), (F.col("t") + 20 * (1 + F.col("id") % 5)).alias("end"))
    )


@query(
    "merge_intervals",
    with_("tl", cover=_COVER, merged=_MERGED)
    + 'SELECT title, round(start, 6) AS start, round("end", 6) AS "end" FROM merged',
)
def merged(spark, sf):
    out = merge_intervals(coverage(spark, sf), ["title"], width=600.0)
    return out.select("title", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "covered_windows",
    with_("tl", "segs", cover=_COVER, merged=_MERGED)
    + """SELECT s.title, s.n, EXISTS (SELECT 1 FROM merged m WHERE m.title = s.title AND m.start <= s.start + 0.05
        AND m."end" >= s."end" - 0.05) AS covered FROM segs s""",
)
def covered_windows(spark, sf):
    windows = segments(spark, sf).select("title", "n", F.col("start").alias("from"), F.col("end").alias("to"))
    return tl.covered(windows, coverage(spark, sf)).select("title", "n", "covered")


# Each title as three players take it, from its first few segments, at one to three gigabytes.
_DELIVERY = """SELECT d.title, d.title % 4 AS first, p.player, p.secs, p.cap, (1 + d.title % 3) * 1e9::DOUBLE AS size,
    (1 + d.title % 3) * 8e9 / d.duration * (1.2 + (d.title % 5) * 0.8) AS rate, d.duration FROM dur d,
    (VALUES ('hls.js', 120::DOUBLE, 150000000), ('cast', 60, 50000000), ('native', 30, NULL)) p(player, secs, cap)"""
_LINK = {
    "delivery": _DELIVERY,
    "pre": """SELECT s.title, s.n, s.start, 8 * s.bytes / sum(s.bytes) OVER (PARTITION BY s.title) AS b, 8 * sum(s.bytes)
        OVER (PARTITION BY s.title ORDER BY n) / sum(s.bytes) OVER (PARTITION BY s.title) AS c FROM segbytes s""",
    "stretch": """SELECT d.title, d.player, max(greatest((k.c - j.c + j.b) * size / (secs + k.start - j.start),
        CASE WHEN cap IS NOT NULL AND k.start > j.start THEN ((k.c - j.c + j.b) * size - cap * 8.0) / (k.start - j.start)
        ELSE 0 END)) AS s FROM delivery d JOIN pre j ON j.title = d.title AND j.n >= first JOIN pre k ON k.title = d.title
        AND k.n >= j.n GROUP BY d.title, d.player""",
    "opening": """SELECT d.title, d.player, max((k.c - f.c + f.b) * size / (10 + k.start - f.start)) AS o,
        max((k.c - f.c + f.b) * size / rate - (k.start - f.start)) AS w FROM delivery d
        JOIN pre f ON f.title = d.title AND f.n = first JOIN pre k ON k.title = d.title AND k.n >= first
        GROUP BY d.title, d.player""",
}


def deliveries(spark, sf):
    d = c.durations(spark, sf).withColumn(
        "player", F.explode(F.array(F.lit("hls.js"), F.lit("cast"), F.lit("native")))
    )
    size = (1 + F.col("title") % 3) * F.lit(1e9)
    return d.select(
        "title",
        "duration",
        "player",
        (F.col("title") % 4).alias("first"),
        link.player_buffer(F.col("player"))["secs"].alias("buffer_secs"),
        link.player_buffer(F.col("player"))["bytes"].alias("buffer_bytes"),
        size.alias("size"),
        (size * 8.0 / F.col("duration") * (1.2 + (F.col("title") % 5) * 0.8)).alias("rate"),
    )


def link_table(spark, sf):
    segs = tl.segment_bytes(cut_lineage(segments(spark, sf)), c.byte_index(spark, sf))
    return link.link_rates(deliveries(spark, sf), segs)


@query("stretch_rate", with_("segbytes", **_LINK) + "SELECT title, player, round(s, 2) AS stretch_rate FROM stretch")
def stretch_rate(spark, sf):
    return link_table(spark, sf).select("title", "player", F.round("stretch_rate", 2).alias("stretch_rate"))


@query(
    "needed_rate",
    with_("segbytes", **_LINK)
    + "SELECT title, player, round(greatest(s, o), 2) AS needed_rate FROM stretch JOIN opening USING (title, player)",
)
def needed_rate(spark, sf):
    return link_table(spark, sf).select("title", "player", F.round("needed_rate", 2).alias("needed_rate"))


@query(
    "startup_delay",
    with_("segbytes", **_LINK)
    + """SELECT title, player, CASE WHEN s <= rate THEN round(greatest(w, 0), 6) END AS startup_delay FROM stretch
        JOIN opening USING (title, player) JOIN delivery USING (title, player)""",
)
def startup_delay(spark, sf):
    return link_table(spark, sf).select("title", "player", F.round("startup_delay", 6).alias("startup_delay"))


@query(
    "link_need",
    with_("segbytes", **_LINK)
    + """SELECT title, player, CASE WHEN title % 7 = 0 THEN cast(floor(floor(size * 8 / duration) * 1.5) AS bigint)
        ELSE cast(floor(greatest(s, o)) AS bigint) END AS need, title % 7 <> 0 AS indexed,
        CASE WHEN title % 7 <> 0 AND s <= rate THEN round(greatest(w, 0), 6) END AS prebuffer,
        CASE WHEN title % 7 = 0 THEN floor(floor(size * 8 / duration) * 1.5) ELSE floor(greatest(s, o)) END > rate AS over_link
        FROM stretch JOIN opening USING (title, player) JOIN delivery USING (title, player)""",
)
def link_need(spark, sf):
    segs = tl.segment_bytes(cut_lineage(segments(spark, sf)), c.byte_index(spark, sf)).where(F.col("title") % 7 != 0)
    out = link.link_need(deliveries(spark, sf), segs)
    return out.select(
        "title",
        "player",
        "need",
        "indexed",
        F.round("prebuffer", 6).alias("prebuffer"),
        link.over_link(F.col("need"), F.col("rate")).alias("over_link"),
    )


_DEMAND = {
    **_OPENING,
    "piece_edges": 'SELECT DISTINCT title, start AS t FROM pieces UNION SELECT title, "end" FROM pieces',
    "piece_pos": """SELECT e.title, e.t, CASE WHEN b.t1 <= e.t + 1e-6 THEN p1 + (e.t - t1) * ((p1 - p0) / (t1 - t0))
        ELSE coalesce((SELECT max(i.pos) FROM idx i WHERE i.title = e.title AND i.t <= e.t + 1e-6), p0) END AS pos
        FROM piece_edges e JOIN bounds b USING (title) WHERE t1 > t0 AND p1 > p0""",
    "sized": """SELECT p.title, p.start_at, p.n + p.piece AS n, p.start, b.pos - a.pos AS bytes FROM pieces p JOIN piece_pos a ON a.title = p.title AND a.t = p.start
        JOIN piece_pos b ON b.title = p.title AND b.t = p."end"
        UNION ALL SELECT s.title, t.start_at, CASE WHEN s.n > m.at THEN s.n + m.more ELSE s.n END, s.start, s.bytes
        FROM segbytes s JOIN starts t USING (title) LEFT JOIN many m ON m.title = s.title AND m.start_at = t.start_at WHERE m.at IS NULL OR s.n <> m.at""",
    "total": "SELECT title, sum(bytes) AS total FROM segbytes GROUP BY title",
}


@query(
    "session_demand",
    with_("segbytes", "tl", **_DEMAND)
    + """SELECT title, round(start_at, 3) AS start_at, n, round(start, 3) AS start, cast(round(bytes * (1 + title % 3) * 1e9::DOUBLE / total) AS bigint) AS bytes
        FROM sized JOIN total USING (title)""",
)
def session_demand(spark, sf):
    """Each segment's start and bytes as a session sends them from where it starts: a player can work out its own need."""
    segs, at, index = cut_lineage(segments(spark, sf)), starts(spark, sf), c.byte_index(spark, sf)
    whole = cut_lineage(tl.segment_bytes(segs, index))
    pieces = tl.piece_bytes(cut_lineage(tl.opening_pieces(segs, c.timeline(spark, sf), at)), index)
    total = whole.groupBy("title").agg(F.sum("bytes").alias("total"))
    sent = tl.split_opening(whole, pieces, at.join(total, "title", "left_semi")).join(total, "title")
    bytes_ = F.round(F.col("bytes") * (1 + F.col("title") % 3) * F.lit(1e9) / F.col("total")).cast("bigint")
    return sent.select("title", F.round("start_at", 3).alias("start_at"), "n", F.round("start", 3).alias("start"), bytes_.alias("bytes"))
