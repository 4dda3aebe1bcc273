"""The driver's tables shaped like a media catalogue and a playback fleet.

Each carrier is a plain projection, given once as SQL expressions both engines read: Spark by ``selectExpr``, the check
by a CTE. The operators themselves are written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.operators.ordered import Scan, scan
from playlens.session import utc

# Thirty days of events stand for a two-hour film.
TIME_SCALE = 360.0
TARGET = 60.0
TITLE_SIZE = 12


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def micros(col: str) -> F.Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


RELEASE = {
    "release_id": "p_partkey",
    "title_id": f"cast(floor(p_partkey / {TITLE_SIZE}) as bigint)",
    "listed_pos": f"cast(p_partkey % {TITLE_SIZE} as bigint)",
    "title": "p_name",
    "label": "concat(p_brand, ' ', p_type)",
    "filename": """case when p_partkey % 10 = 3 then null else concat(replace(p_name, ' ', '.'), '.',
        cast(p_partkey as varchar(20)), case p_partkey % 9 when 0 then '.avi' when 1 then '.TS' when 2 then '.mp4'
        when 5 then '.WebM' else '.mkv' end) end""",
    "codec": """case when p_partkey % 23 = 0 then 'mpeg4' else case p_type when 'STANDARD' then 'h264'
        when 'ECONOMY' then 'hevc' when 'MEDIUM' then 'AV1' when 'PROMO' then 'vp9' when 'LARGE' then 'HEVC' end end""",
    "cached": "case p_partkey % 7 when 0 then false when 1 then null else true end",
    "size_bytes": """case when p_partkey % 13 = 0 then null
        else cast(round(p_retailprice * 100) * 100000 * (1 + p_size % 5) as bigint) end""",
    "pack_size_bytes": "case when p_partkey % 5 = 0 then cast(round(p_retailprice * 100) * 1000000 as bigint) end",
    "three_d": "(p_partkey % 17 = 0)",
    "resolution": """case when p_size % 7 = 0 then null when p_size <= 10 then '720p' when p_size <= 35 then '1080p'
        when p_partkey % 2 = 0 then '2160p' else '4K' end""",
    "hdr": "(p_size % 4 = 0)",
    "bit_depth": "cast(case p_size % 3 when 0 then 0 when 1 then 8 else 10 end as int)",
    "dv_profile": "cast(case p_size % 10 when 7 then 5 when 8 then 8 else 0 end as int)",
    "probed": "(p_partkey % 3 = 0)",
}

MEDIA = {
    "release_id": "p_partkey",
    "container": "case p_partkey % 29 when 0 then 'webm' when 1 then 'mp4' else 'matroska' end",
    "video": """case when p_partkey % 23 = 0 then 'mpeg4' else case p_type when 'STANDARD' then 'h264'
        when 'ECONOMY' then 'hevc' when 'MEDIUM' then 'av1' when 'PROMO' then 'vp9' when 'LARGE' then 'hevc'
        else 'h264' end end""",
    "codecs": """case when p_partkey % 19 = 0 then null else case p_type
        when 'STANDARD' then case p_size % 3 when 0 then 'avc1.640028' when 1 then 'avc1.640033' else 'avc3.6e0029' end
        when 'SMALL' then 'avc1.4d401f'
        when 'ECONOMY' then case p_size % 4 when 0 then 'hvc1.1.6.L120.90' when 1 then 'hvc1.2.4.L153.B0'
            when 2 then 'hev1.2.4.H153.B0' else 'hvc1.A4.10.L150.9d.8' end
        when 'LARGE' then case p_size % 2 when 0 then 'hvc1.2.4.L150.B0' else 'hvc1.1.6.L93.90' end
        when 'MEDIUM' then case p_size % 4 when 0 then 'av01.0.08M.08' when 1 then 'av01.0.13M.10.0.110.09.16.09.0'
            when 2 then 'av01.1.13H.10' else 'av01.0.12M.10.0.112.09.18.09.0' end
        else case p_size % 3 when 0 then 'vp09.00.40.08' when 1 then 'vp09.02.51.10.01.09.16.09.00'
            else 'vp09.02.51.12' end end end""",
    "width": """cast(case when p_partkey % 31 = 0 then 0 when p_size <= 10 then 1280 when p_size <= 35 then 1920
        else 3840 end as int)""",
    "height": """cast(case when p_partkey % 31 = 0 then 0 when p_size <= 10 then 720
        when p_size <= 35 then 800 + 8 * (p_size % 36) else 1600 + p_size end as int)""",
    "hdr": "(p_size % 4 = 0)",
    "hlg": "(p_size % 8 = 0)",
    "frame_rate": """cast(case p_partkey % 6 when 0 then null when 1 then 24 when 2 then 25 when 3 then 50 when 4 then 0
        else 1200 end as double)""",
    "dv_profile": "cast(case p_size % 10 when 7 then 5 when 8 then 8 when 9 then 7 end as int)",
    "dv_compat": """cast(case p_size % 10 when 7 then 0 when 8 then case p_partkey % 4 when 0 then 1 when 1 then 2
        when 2 then 4 else 6 end when 9 then 6 end as int)""",
    "dv_level": "cast(case when p_size % 10 in (7, 8, 9) then 1 + p_partkey % 13 end as int)",
    "dv_mismatch": "(p_size % 10 = 7 and p_partkey % 5 = 0)",
    "dv_recordless": "(p_size % 10 = 7 and p_partkey % 3 = 0)",
    "closed_gops": "(p_partkey % 2 = 0)",
    "video_bytes": """case when p_partkey % 8 = 0 then null
        else cast(round(p_retailprice * 100) * 90000 * (1 + p_size % 5) as bigint) end""",
    "timeline": "cast(floor(p_partkey * 3 / 40) as bigint)",
}

PLAYER = {
    "player_id": "c_custkey",
    "household": "c_nationkey",
    "class": "concat(lower(c_mktsegment), '-', cast(c_custkey % 3 as varchar(2)))",
    "reported": "(c_custkey % 3 <> 2)",
    "takes_hevc_flag": "(c_mktsegment in ('BUILDING', 'FURNITURE'))",
    "h264": "cast(case c_mktsegment when 'MACHINERY' then 0 when 'FURNITURE' then 51 else 41 end as int)",
    "h264_high10": "cast(case when c_mktsegment in ('BUILDING') then 51 else 0 end as int)",
    "hevc_main": "cast(case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 153 else 123 end as int)",
    "hevc_main10": "cast(case c_mktsegment when 'BUILDING' then 153 when 'HOUSEHOLD' then 150 else 0 end as int)",
    "hevc_high_tier": "cast(case when c_custkey % 3 = 1 then 153 else 0 end as int)",
    "p_hdr": "(c_mktsegment in ('BUILDING', 'HOUSEHOLD'))",
    "eac3": "(c_mktsegment in ('BUILDING', 'MACHINERY'))",
    "aac_multichannel": "(c_custkey % 3 = 0)",
    "dv_p5": "(c_mktsegment = 'BUILDING')",
    "dv_p8": "(c_mktsegment in ('BUILDING', 'HOUSEHOLD'))",
    "av1": "cast(case c_mktsegment when 'AUTOMOBILE' then 13 when 'FURNITURE' then 8 else 0 end as int)",
    "av1_main10": "cast(case c_mktsegment when 'AUTOMOBILE' then 13 else 0 end as int)",
    "av1_hdr": "(c_mktsegment = 'AUTOMOBILE' and c_custkey % 3 = 0)",
    "flac": "(c_custkey % 3 = 1)",
    "aac71": "(c_mktsegment = 'FURNITURE')",
    "vp9": "(c_mktsegment in ('AUTOMOBILE', 'MACHINERY'))",
    "vp9_profile2": "(c_mktsegment = 'AUTOMOBILE')",
    "player": "case c_custkey % 4 when 0 then 'hls.js' when 1 then 'cast' when 2 then 'native' end",
    "max_bitrate": "case when c_acctbal >= 0 then cast(round(c_acctbal * 1000) as bigint) + 1 end",
}

REQUEST = {
    "request_id": "o_orderkey",
    "owner": "o_custkey",
    "state": "o_orderstatus",
    "title_id": "cast(floor(floor(o_orderkey * 2 / 15) / 12) as bigint)",
    "named_pos": "case when o_orderkey % 4 = 1 then cast(o_orderkey % 12 as bigint) end",
    "excluded_pos": "cast(o_orderkey % 5 as bigint)",
    "start_at": "cast(case o_orderkey % 6 when 1 then 600 when 2 then 3600.5 when 3 then 900000 else 0 end as double)",
    "no_transcode": "(o_orderkey % 7 = 0)",
    "fits_only": "(o_orderkey % 11 = 0)",
}


def releases(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "part"), RELEASE)


def media(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "part"), MEDIA)


def players(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "customer"), PLAYER)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), REQUEST | {"at": "cast(o_orderdate as timestamp)"})


def _project(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as `{n}`" for n, e in exprs.items()])


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """(title, id, t, size, kind): every event as an indexed keyframe of the title its user stands for."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("title"),
        F.col("event_id").alias("id"),
        micros("ts").alias("us"),
        F.expr("cast(round(value * 1000) as bigint)").alias("size"),
        F.col("event_type").alias("kind"),
    )
    first = ev.groupBy("title").agg(F.min("us").alias("us0"))
    return ev.join(first.hint("shuffle_hash"), "title").select(
        "title", "id", ((F.col("us") - F.col("us0")) / F.lit(TIME_SCALE * 1e6)).alias("t"), "size", "kind"
    )


def byte_index(spark: SparkSession, sf: str) -> DataFrame:
    """(title, id, t, pos): the running position of each keyframe."""
    tl = timeline(spark, sf)
    return scan(
        tl, ["title"], ["t", "id"], F.floor(F.col("t") / 600.0), [Scan("pos", "sum", F.col("size"))]
    ).select("title", "id", "t", "pos")


def durations(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf).groupBy("title").agg((F.max("t") + F.lit(30.0)).alias("duration"))


def point_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(group_id, seq_id, n, pos, point): every word of a document, which has ``n``, as a 32-bit point."""
    docs = table(spark, sf, "documents").select("source", "doc_id", F.split("text", r"\s+").alias("words"))
    docs = docs.select(F.col("source").alias("group_id"), F.col("doc_id").alias("seq_id"), F.size("words").alias("n"), F.posexplode("words"))
    return docs.select(
        "group_id",
        "seq_id",
        "n",
        F.col("pos").cast("bigint").alias("pos"),
        F.conv(F.substring(F.md5("col"), 1, 8), 16, 10).cast("bigint").alias("point"),
    )


def _cte(exprs: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in exprs.items()) + f" FROM {source}"


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "rel": ((), _cte(RELEASE, "part")),
    "media": ((), _cte(MEDIA, "part")),
    "players": ((), _cte(PLAYER, "customer")),
    "requests": ((), _cte({**REQUEST, "at": "o_orderdate"}, "orders")),
    "tl": (
        (),
        f"""SELECT user_id AS title, event_id AS id,
            (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / {TIME_SCALE * 1e6:.1f}::DOUBLE AS t,
            cast(round(value * 1000) as bigint) AS size, event_type AS kind FROM events""",
    ),
    "idx": (
        ("tl",),
        """SELECT title, id, t, cast(sum(size) OVER (PARTITION BY title ORDER BY t, id
            ROWS UNBOUNDED PRECEDING) AS bigint) AS pos FROM tl""",
    ),
    "dur": (("tl",), "SELECT title, max(t) + 30::DOUBLE AS duration FROM tl GROUP BY title"),
    "cuts": (
        ("tl", "dur"),
        f"""SELECT title, 0::DOUBLE AS start FROM dur UNION ALL
            SELECT tl.title, min(t) FROM tl JOIN dur USING (title) WHERE t > 0 AND t < duration AND t >= {TARGET}
            GROUP BY tl.title, floor(t / {TARGET}::DOUBLE)""",
    ),
    "segs": (
        ("cuts", "dur"),
        """SELECT title, row_number() OVER w - 1 AS n, start,
            coalesce(lead(start) OVER w, duration) AS "end" FROM cuts JOIN dur USING (title)
            WINDOW w AS (PARTITION BY title ORDER BY start)""",
    ),
    "bounds": (("idx",), """SELECT title, min(t) AS t0, max(t) AS t1, arg_min(pos, (t, id)) AS p0,
        arg_max(pos, (t, id)) AS p1 FROM idx GROUP BY title"""),
    "edges": (
        ("segs",),
        'SELECT title, start AS t FROM segs UNION SELECT title, "end" FROM segs',
    ),
    "edge_pos": (
        ("edges", "bounds", "idx"),
        """SELECT e.title, e.t, CASE WHEN b.t1 <= e.t + 1e-6 THEN p1 + (e.t - t1) * ((p1 - p0) / (t1 - t0))
            ELSE coalesce((SELECT max(i.pos) FROM idx i WHERE i.title = e.title AND i.t <= e.t + 1e-6), p0) END AS pos
            FROM edges e JOIN bounds b USING (title) WHERE t1 > t0 AND p1 > p0""",
    ),
    "segbytes": (
        ("segs", "edge_pos"),
        """SELECT s.title, s.n, s.start, s."end", greatest(b.pos - a.pos, 0)::DOUBLE AS bytes FROM segs s
            JOIN edge_pos a ON a.title = s.title AND a.t = s.start
            JOIN edge_pos b ON b.title = s.title AND b.t = s."end" """,
    ),
    "seqs": (
        (),
        r"""SELECT source AS group_id, doc_id AS seq_id, unnest(range(len(w))) AS pos, ('0x' || substr(md5(unnest(w)), 1, 8))::BIGINT
            AS point FROM (SELECT source, doc_id, string_split_regex(text, '\s+') AS w FROM documents)""",
    ),
}


def with_(*names: str, **extra: str) -> str:
    """``WITH`` clause naming the carriers, what they rest on, and any extra CTEs after them."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = _CTES[name]
        for n in needs:
            add(n)
        done.setdefault(name, sql)

    for name in names:
        add(name)
    done.update(extra)
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in done.items()) + " "
