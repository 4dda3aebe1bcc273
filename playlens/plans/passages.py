"""Shared-passage queries, over the documents of each source and over embedding signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from playlens.operators import passages as pa
from playlens.operators.ordered import Scan, scan
from playlens.plans import carriers as c
from playlens.plans.carriers import with_
from playlens.plans.registry import query
from playlens.session import cut_lineage, stored as kept_files

_c = F.col
MIN_SECS = 2.5
SECS = f"{pa.POINT_SECS!r}::DOUBLE"

_EPISODES = """SELECT source AS group_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, doc_id AS seq_id FROM documents"""
_PAIRS = """SELECT e.seq_id AS pair_id, e.seq_id AS a, coalesce(n.seq_id, p.seq_id) AS b, e.group_id FROM episodes e
    LEFT JOIN episodes n ON n.group_id = e.group_id AND n.number = e.number + 1
    LEFT JOIN episodes p ON p.group_id = e.group_id AND p.number = e.number - 1"""


def matching(pairs: str, points: str) -> dict[str, str]:
    return {
        "lastpos": f"SELECT seq_id, point, max(pos) AS pos FROM {points} GROUP BY ALL",
        "shifts": f"""SELECT DISTINCT p.pair_id, p.a, p.b, y.pos - x.pos AS shift FROM {pairs} p JOIN lastpos x ON x.seq_id = p.a
            CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) v(d) JOIN lastpos y ON y.seq_id = p.b AND
            y.point = (x.point + v.d + 4294967296) % 4294967296""",
        "matches": f"""SELECT s.pair_id, s.shift, x.pos FROM shifts s JOIN {points} x ON x.seq_id = s.a JOIN {points} y ON y.seq_id = s.b
            AND y.pos = x.pos + s.shift WHERE bit_count(xor(x.point, y.point)) <= 6""",
        "runs": f"""SELECT pair_id, shift, min(pos) AS s, max(pos) AS e, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY pair_id, shift
            ORDER BY pos) AS r FROM (SELECT *, CASE WHEN (pos - lag(pos) OVER (PARTITION BY pair_id, shift ORDER BY pos)) * {SECS} <= 3.5
            THEN 0 ELSE 1 END AS brk FROM matches)) GROUP BY pair_id, shift, r""",
    }


def episodes(spark, sf):
    docs = c.table(spark, sf, "documents").select(_c("source").alias("group_id"), _c("doc_id").alias("seq_id"))
    return scan(docs, ["group_id"], ["seq_id"], F.floor(_c("seq_id") / 10000), [Scan("number", "sum", F.lit(1))])


def doc_pairs(spark, sf):
    s = pa.siblings(episodes(spark, sf)).where(_c("partner").isNotNull())
    return s.select(_c("seq_id").alias("pair_id"), _c("seq_id").alias("a"), _c("partner").alias("b"))


def doc_points(spark, sf):
    return c.point_sequences(spark, sf).select("seq_id", "pos", "point")


@query("siblings", with_(episodes=_EPISODES, pairs=_PAIRS) + "SELECT group_id, a AS seq_id, b AS partner FROM pairs")
def siblings(spark, sf):
    return pa.siblings(episodes(spark, sf)).select("group_id", "seq_id", "partner")


# Every sequence beside all later ones of its group.
_ALL_PAIRS = {
    "lastpos": "SELECT seq_id, point, max(pos) AS pos FROM seqs GROUP BY ALL",
    "members": """SELECT d.group_id, l.* FROM (SELECT DISTINCT source AS group_id, doc_id AS seq_id FROM documents) d JOIN lastpos l USING (seq_id)""",
    "shifts": """SELECT DISTINCT x.group_id, x.seq_id, y.seq_id AS partner, y.pos - x.pos AS shift FROM members x
        CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) v(d) JOIN members y ON y.group_id = x.group_id AND
        y.point = (x.point + v.d + 4294967296) % 4294967296 AND y.seq_id > x.seq_id""",
}


@query(
    "candidate_alignments",
    with_("seqs", **_ALL_PAIRS)
    + """SELECT group_id, seq_id, partner, count(*) AS n, min(shift) AS lowest, max(shift) AS highest, cast(sum(shift) AS bigint) AS total
        FROM shifts GROUP BY group_id, seq_id, partner""",
)
def candidate_alignments(spark, sf):
    docs = c.table(spark, sf, "documents").select(_c("source").alias("group_id"), _c("doc_id").alias("seq_id"))
    return pa.group_alignments(docs, doc_points(spark, sf))


@query(
    "aligned_matches",
    with_("seqs", episodes=_EPISODES, pairs=_PAIRS, **matching("pairs", "seqs"))
    + "SELECT pair_id, count(*) AS n, cast(sum(pos) AS bigint) AS positions, cast(sum(shift) AS bigint) AS total FROM matches GROUP BY pair_id",
)
def aligned_matches(spark, sf):
    """Matches summed by their unbroken runs: a run of n positions counts for n."""
    runs = pa.shared_runs(doc_pairs(spark, sf), doc_points(spark, sf), pa.POINT_SECS)
    positions = F.floor((_c("start") + _c("end")) * _c("n") / 2)
    return runs.groupBy("pair_id").agg(
        F.sum("n").alias("n"), F.sum(positions).alias("positions"), F.sum(_c("shift") * _c("n")).alias("total")
    )


@query(
    "runs_with_gaps",
    with_("seqs", episodes=_EPISODES, pairs=_PAIRS, **matching("pairs", "seqs"))
    + "SELECT pair_id, count(*) AS runs, max(e - s) AS longest, cast(sum(n) AS bigint) AS matches FROM runs GROUP BY pair_id",
)
def runs_with_gaps(spark, sf):
    return pa.shared_runs(doc_pairs(spark, sf), doc_points(spark, sf)).groupBy("pair_id").agg(
        F.count("*").alias("runs"), F.max(_c("end") - _c("start")).alias("longest"), F.sum("n").alias("matches")
    )


_BEST = f"""SELECT pair_id, shift, s, e FROM runs WHERE (e - s) * {SECS} >= {MIN_SECS} QUALIFY row_number() OVER (PARTITION BY pair_id
    ORDER BY e - s DESC, shift, s) = 1"""


@query(
    "longest_shared",
    with_("seqs", episodes=_EPISODES, pairs=_PAIRS, **matching("pairs", "seqs"))
    + f"SELECT pair_id, shift, s AS a_start, e AS a_end, s + shift AS b_start, e + shift AS b_end FROM ({_BEST})",
)
def longest_shared(spark, sf):
    return pa.longest_shared(doc_pairs(spark, sf), doc_points(spark, sf), MIN_SECS)


# Two interleaved signature sequences a label.
_SIGS = """SELECT label * 2 + (r % 2) AS seq_id, r // 2 AS pos, point FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r,
    list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END FOR i IN range(32)])::BIGINT AS point FROM embeddings)"""


def signatures(spark, sf):
    bits = [F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(32)]
    point = bits[0]
    for b in bits[1:]:
        point = point + b
    emb = c.table(spark, sf, "embeddings").select("label", "vec_id", point.alias("point"))
    ranked = scan(emb, ["label"], ["vec_id"], F.floor(_c("vec_id") / 10000), [Scan("r", "sum", F.lit(1))])
    r = _c("r") - 1
    return ranked.select(
        (_c("label") * 2 + r % 2).cast("bigint").alias("seq_id"), F.floor(r / 2).alias("pos"), "point"
    )


@query(
    "extend_tail",
    with_(
        sigs=_SIGS,
        shared="SELECT DISTINCT seq_id // 2 AS pair_id, seq_id // 2 * 2 AS a, seq_id // 2 * 2 + 1 AS b, (seq_id // 2) % 5 AS e FROM sigs",
        blocks="""SELECT h.pair_id, (x.pos - h.e - 1) // 9 AS k, sum(bit_count(xor(x.point, y.point))) AS diff, count(*) AS n FROM shared h
            JOIN sigs x ON x.seq_id = h.a AND x.pos > h.e AND x.pos <= h.e + 96 JOIN sigs y ON y.seq_id = h.b AND y.pos = x.pos GROUP BY ALL""",
    )
    + """SELECT h.pair_id, h.e + 9 * (SELECT count(*) FROM blocks g WHERE g.pair_id = h.pair_id AND NOT EXISTS (SELECT 1 FROM blocks o
        WHERE o.pair_id = g.pair_id AND o.k <= g.k AND (o.n < 9 OR o.diff > 108))) AS a_end FROM shared h""",
)
def extend_tail(spark, sf):
    sigs = signatures(spark, sf)
    label = F.floor(_c("seq_id") / 2)
    pairs = sigs.select(label.alias("pair_id")).distinct()
    pairs = pairs.select("pair_id", (_c("pair_id") * 2).alias("a"), (_c("pair_id") * 2 + 1).alias("b"))
    end = _c("pair_id") % 5
    shared = pairs.select(
        "pair_id", F.lit(0).alias("shift"), F.lit(0).alias("a_start"), end.alias("a_end"), F.lit(0).alias("b_start"), end.alias("b_end")
    )
    return pa.extend_tail(shared, pairs, sigs).select("pair_id", "a_end")


# The first half of a document's words is its intro window, the rest its credits. Every third source already keeps points.
_HALVES = """SELECT group_id, seq_id, CASE WHEN pos < n // 2 THEN 'intro' ELSE 'credits' END AS part, CASE WHEN pos < n // 2 THEN pos ELSE pos - n // 2 END AS pos,
    point FROM (SELECT *, max(pos) OVER (PARTITION BY seq_id) + 1 AS n FROM seqs)"""
_MATCH = {
    "episodes": _EPISODES,
    "halves": _HALVES,
    "keptp": """SELECT h.group_id, part, pos, point FROM halves h JOIN episodes e USING (seq_id) WHERE e.number = 1 AND (length(h.group_id) + ascii(right(h.group_id, 1))) % 3 = 0""",
    "scans": """SELECT e.seq_id AS scan_id, e.group_id, e.seq_id AS a, n.seq_id AS b FROM episodes e LEFT JOIN episodes n ON n.group_id = e.group_id
        AND n.number = e.number + 1 WHERE e.number % 2 = 1""",
    "routed": """SELECT s.*, v.part, EXISTS (SELECT 1 FROM keptp k WHERE k.group_id = s.group_id AND k.part = v.part) AS kept FROM scans s,
        (VALUES ('intro'), ('credits')) v(part)""",
    "tasks": """SELECT scan_id, part, group_id, a AS one, NULL::BIGINT AS two, 'e' || a || part AS a, 'k' || group_id || part AS b FROM routed WHERE kept
        UNION ALL SELECT scan_id, part, group_id, b, NULL, 'e' || b || part, 'k' || group_id || part FROM routed WHERE kept AND b IS NOT NULL
        UNION ALL SELECT scan_id, part, group_id, a, b, 'e' || a || part, 'e' || b || part FROM routed WHERE NOT kept AND b IS NOT NULL""",
    "tp": "SELECT scan_id || '|' || a || '|' || b AS pair_id, * FROM tasks",
    "pts": "SELECT 'e' || seq_id || part AS seq_id, pos, point FROM halves UNION ALL SELECT 'k' || group_id || part, pos, point FROM keptp",
    **matching("tp", "pts"),
    "best": _BEST,
    "durs": "SELECT doc_id AS seq_id, 60 + n_chars * 0.05::DOUBLE AS duration FROM documents",
    "blk": """SELECT h.pair_id, (x.pos - h.e - 1) // 9 AS k, sum(bit_count(xor(x.point, y.point))) AS diff, count(*) AS n FROM best h JOIN tp USING (pair_id)
        JOIN pts x ON x.seq_id = tp.a AND x.pos > h.e AND x.pos <= h.e + 96 JOIN pts y ON y.seq_id = tp.b AND y.pos = x.pos + h.shift
        WHERE tp.part = 'intro' GROUP BY ALL""",
    "grown": """SELECT t.*, h.shift, h.s, h.e + 9 * (SELECT count(*) FROM blk g WHERE g.pair_id = h.pair_id AND NOT EXISTS (SELECT 1 FROM blk o WHERE
        o.pair_id = g.pair_id AND o.k <= g.k AND (o.n < 9 OR o.diff > 108))) AS e, x.duration AS d1, y.duration AS d2 FROM best h JOIN tp t USING (pair_id)
        JOIN durs x ON x.seq_id = t.one LEFT JOIN durs y ON y.seq_id = t.two""",
    "cs": """SELECT *, greatest(d1 - 480, least(d1 * 0.25::DOUBLE, 360)) AS c1, greatest(d2 - 480, least(d2 * 0.25::DOUBLE, 360)) AS c2 FROM grown""",
    "okd": f"""SELECT * FROM cs WHERE (e - s) * {SECS} <= CASE WHEN part = 'intro' THEN 120 ELSE least(least(480, d1 - c1 - 1),
        coalesce(least(480, d2 - c2 - 1), 480)) END""",
}


def _span_sql(who: str, d: str, cs: str, shift: str) -> str:
    s, e = f"((s{shift}) * {SECS})", f"((e{shift}) * {SECS})"
    return f"""SELECT scan_id, {who} AS seq_id, part, round(CASE WHEN part = 'intro' THEN CASE WHEN {s} <= 5 THEN 0 ELSE {s} END ELSE {cs} + {s} END, 3) AS start,
        round(CASE WHEN part = 'intro' THEN {e} + 2.6 WHEN {cs} + {e} + 2.6 >= {d} - 5 THEN {d} ELSE {cs} + {e} + 2.6 END, 3) AS "end" FROM okd"""


def season_inputs(spark, sf):
    half = F.floor(_c("n") / 2)
    # Points are a stored table where they come from; made up of words here, they are worked out once.
    halves = c.point_sequences(spark, sf).select(
        "group_id",
        "seq_id",
        F.when(_c("pos") < half, "intro").otherwise("credits").alias("part"),
        F.when(_c("pos") < half, _c("pos")).otherwise(_c("pos") - half).alias("pos"),
        "point",
    )
    halves = kept_files(halves, "points")
    eps = episodes(spark, sf)
    keeps = (F.length("group_id") + F.ascii(F.right("group_id", F.lit(1)))) % 3 == 0
    first = eps.where((_c("number") == 1) & keeps).select("seq_id")
    kept = halves.join(first, "seq_id", "left_semi").select("group_id", "part", "pos", "point")
    after = eps.select("group_id", (_c("number") - 1).alias("number"), _c("seq_id").alias("b"))
    scans = (
        eps.join(after, ["group_id", "number"], "left")
        .where(_c("number") % 2 == 1)
        .select(_c("seq_id").alias("scan_id"), "group_id", _c("seq_id").alias("a"), "b")
    )
    scans, kept = cut_lineage(scans), cut_lineage(kept)
    d = c.table(spark, sf, "documents").select(_c("doc_id").alias("seq_id"), (60 + _c("n_chars") * F.lit(0.05)).alias("duration"))
    return scans, d, halves.select("seq_id", "part", "pos", "point"), kept


@query(
    "match_season",
    with_("seqs", **_MATCH) + _span_sql("one", "d1", "c1", "") + " UNION ALL " + _span_sql("two", "d2", "c2", " + shift") + " WHERE two IS NOT NULL",
)
def match_season(spark, sf):
    scans, eps, points, kept = season_inputs(spark, sf)
    spans, _ = pa.match_season(scans, eps, points, kept, MIN_SECS, MIN_SECS)
    return spans


@query(
    "scan_windows",
    with_("dur")
    + """SELECT title, round(least(d * 0.25, 360), 6) AS intro, round(greatest(d - 480, least(d * 0.25, 360)), 6) AS credits_start FROM
        (SELECT title, duration / (1 + title % 9) AS d FROM dur)""",
)
def scan_windows(spark, sf):
    d = c.durations(spark, sf).select("title", (_c("duration") / (1 + _c("title") % 9)).alias("d"))
    return d.select(
        "title",
        F.round(pa.intro_window(_c("d")), 6).alias("intro"),
        F.round(pa.credits_start(_c("d")), 6).alias("credits_start"),
    )


# Stored results out of the parts: three methods, parts of them missing.
_STORED = """SELECT p_partkey AS id, 600 + p_size * 20.5::DOUBLE AS duration, CASE p_partkey % 3 WHEN 0 THEN 'fingerprint' WHEN 1 THEN 'fingerprint-v2' ELSE 'fingerprint-v3' END AS method,
    CASE WHEN p_partkey % 4 <> 0 THEN p_size * 1.5::DOUBLE END AS i0, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 3.25::DOUBLE END AS i1,
    CASE WHEN p_partkey % 5 <> 0 THEN 500 + p_size * 19.0::DOUBLE END AS c0, CASE WHEN p_partkey % 5 <> 0 THEN 598.5 + p_size * 20.5::DOUBLE END AS c1,
    CASE WHEN p_partkey % 7 = 0 THEN p_size * 1.75::DOUBLE END AS n0, CASE WHEN p_partkey % 7 = 0 THEN p_size * 3.5::DOUBLE END AS n1 FROM part"""


def stored(spark, sf):
    sql = _STORED.replace("::DOUBLE", "D").replace("p_partkey AS id", "p_partkey AS id")
    c.table(spark, sf, "part").createOrReplaceTempView("playlens_part")
    df = spark.sql(sql.replace("FROM part", "FROM playlens_part"))
    span = lambda a, b: F.when(_c(a).isNotNull(), F.struct(_c(a).alias("start"), _c(b).alias("end")))
    return df.select("id", "duration", "method", span("i0", "i1").alias("intro"), span("c0", "c1").alias("credits"), span("n0", "n1").alias("now"))


def _flat(df):
    return df.select(
        "id", "method", _c("intro.start").alias("i0"), _c("intro.end").alias("i1"), _c("credits.start").alias("c0"), _c("credits.end").alias("c1")
    )


@query(
    "upgrade_results",
    with_(st=_STORED)
    + """SELECT id, CASE WHEN method = 'fingerprint' THEN 'fingerprint-v2' ELSE method END AS method, i0, c0,
        CASE WHEN method = 'fingerprint' THEN CASE WHEN i1 IS NOT NULL THEN round(least(i1 + 2.6, duration), 3) END ELSE i1 END AS i1,
        CASE WHEN method = 'fingerprint' THEN CASE WHEN c1 IS NOT NULL THEN round(least(c1 + 2.6, duration), 3) END ELSE c1 END AS c1 FROM st""",
)
def upgrade_results(spark, sf):
    return _flat(pa.upgrade_results(stored(spark, sf)))


@query(
    "merge_found",
    with_(st=_STORED)
    + """SELECT id, 'fingerprint-v3' AS method, CASE WHEN n0 IS NOT NULL THEN n0 WHEN method = 'fingerprint-v3' THEN i0 END AS i0,
        CASE WHEN n0 IS NOT NULL THEN n1 WHEN method = 'fingerprint-v3' THEN i1 END AS i1, CASE WHEN method = 'fingerprint-v3' THEN c0 END AS c0,
        CASE WHEN method = 'fingerprint-v3' THEN c1 END AS c1 FROM st WHERE method <> 'fingerprint-v3' OR (n0 IS NOT NULL AND (n0 IS DISTINCT FROM i0
        OR n1 IS DISTINCT FROM i1))""",
)
def merge_found(spark, sf):
    old = stored(spark, sf)
    new = old.select("id", _c("now").alias("intro"), F.lit(None).cast("struct<start:double,end:double>").alias("credits"))
    return _flat(pa.merge_found(old, new, ["id"]))


@query(
    "invalidate_method",
    with_(st=_STORED)
    + """SELECT id, CASE WHEN method = 'fingerprint-v3' THEN i0 END AS i0, CASE WHEN method = 'fingerprint-v3' THEN method ELSE '' END AS intro_method FROM st""",
)
def invalidate_method(spark, sf):
    out = pa.invalidate_method(stored(spark, sf).withColumnRenamed("method", "intro_method"))
    return out.select("id", _c("intro.start").alias("i0"), "intro_method")
