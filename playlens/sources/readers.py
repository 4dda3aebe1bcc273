"""Readers of listings, snapshots, logs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_c = F.col

PROBE_SCHEMA = 1
LISTING = """streams array<struct<title: string, url: string, attributes: struct<codec: string, cached: boolean, sizeBytes: bigint,
    packSizeBytes: bigint, label: string, threeD: boolean, resolution: string, hdr: boolean, bitDepth: int, dvProfile: int, probed: boolean>,
    behaviorHints: struct<filename: string>>>, title_id string, _corrupt string"""


def read_releases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Release rows of a JSON listing, one list a line, and the lines that are no listing.

    Missing fields take their defaults and unknown ones are ignored; ``cached`` keeps its third answer, null.
    """
    raw = spark.read.schema(LISTING).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = raw.where(_c("_corrupt").isNotNull()).select(_c("_corrupt").alias("line"), F.lit("not a stream list").alias("error"))
    rows = raw.where(_c("_corrupt").isNull()).select("title_id", F.posexplode("streams").alias("listed_pos", "s"))
    a = "s.attributes"
    no, zero, empty = F.lit(False), F.lit(0), F.lit("")
    listed = rows.where(_c("s.url").isNotNull()).select(
        "title_id",
        _c("listed_pos").cast("bigint").alias("listed_pos"),
        F.coalesce(_c("s.title"), empty).alias("title"),
        _c("s.url").alias("url"),
        _c("s.behaviorHints.filename").alias("filename"),
        F.coalesce(_c(f"{a}.label"), empty).alias("label"),
        _c(f"{a}.codec").alias("codec"),
        _c(f"{a}.cached").alias("cached"),
        _c(f"{a}.sizeBytes").alias("size_bytes"),
        _c(f"{a}.packSizeBytes").alias("pack_size_bytes"),
        F.coalesce(_c(f"{a}.threeD"), no).alias("three_d"),
        _c(f"{a}.resolution").alias("resolution"),
        F.coalesce(_c(f"{a}.hdr"), no).alias("hdr"),
        F.coalesce(_c(f"{a}.bitDepth"), zero).alias("bit_depth"),
        F.coalesce(_c(f"{a}.dvProfile"), zero).alias("dv_profile"),
        F.coalesce(_c(f"{a}.probed"), no).alias("probed"),
    )
    return listed, bad


def read_media_snapshot(spark: SparkSession, path: str, columns: str, schema: int = PROBE_SCHEMA) -> DataFrame:
    """Probe results kept by the current schema; entries of another are refused, never reinterpreted."""
    raw = spark.read.schema(f"schema int, {columns}").json(path)
    return raw.where(_c("schema") == schema).drop("schema")


def read_subtitle_listing(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, url, lang, partial): listed subtitles; a list that cannot be read has none."""
    schema = "subtitles array<struct<url: string, lang: string, foreignPartsOnly: boolean, looksDubbed: boolean>>"
    rows = df.select(key, F.posexplode(F.from_json(body, schema)["subtitles"]).alias("pos", "s"))
    flag = lambda name: F.coalesce(_c(f"s.{name}"), F.lit(False))
    return rows.where(_c("s.url").isNotNull()).select(
        key, "pos", _c("s.url").alias("url"), F.coalesce(_c("s.lang"), F.lit("")).alias("lang"),
        (flag("foreignPartsOnly") | flag("looksDubbed")).alias("partial"),
    )


def parse_access_log(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with method, path, status, ms, rid and session, from ``<METHOD> <path> <status> <ms>ms[ rid=][ session=]``."""
    pattern = r"^([A-Z]+) (\S+) ([0-9]{3}) ([0-9]+)ms(?: rid=([A-Za-z0-9_-]+))?(?: session=(\S+))?$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))

    return df.where(_c(line).rlike(pattern)).select(
        *df.columns,
        part(1).alias("method"),
        part(2).alias("path"),
        part(3).cast("int").alias("status"),
        part(4).cast("bigint").alias("ms"),
        part(5).alias("rid"),
        part(6).alias("session"),
    )


EVENT_FIELDS = ("event", "outcome", "reason", "rid", "session", "codec", "audio_codec", "subtitle", "transcoded", "segments", "seconds")


def parse_event_lines(df: DataFrame, line: str = "line", fields: tuple[str, ...] = EVENT_FIELDS) -> DataFrame:
    """``df`` with the ``key=value`` fields of a session's event lines. A value runs to the next ``key=``."""
    tokens = F.regexp_replace(F.regexp_extract(line, r"(event=.*)$", 1), r" ([a-z_]+)=", "\u0001$1=")
    pairs = F.str_to_map(tokens, F.lit("\u0001"), F.lit("="))
    rows = df.where(_c(line).contains("event=")).withColumn("__kv", pairs)
    return rows.select(*df.columns, *[F.try_element_at("__kv", F.lit(f)).alias(f) for f in fields])


def parse_manifest(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, name, duration): each ``#EXTINF`` with the next line that is not a comment.

    Names become paths, so only ``g*.m4s`` with no slash is taken.
    """
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    # Pair within the text itself: an EXTINF, any comments, then a name.
    body = F.concat(F.lit("\n"), F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit("\n"))
    pattern = r"\n#EXTINF:([^,\n]*)[^\n]*(?:\n#(?!EXTINF:)[^\n]*)*(?=\n([^#\n][^\n]*))"
    found = df.select(
        key,
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("name"),
                F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("duration"),
            )
        ).alias("n", "p"),
    )
    rows = found.select(key, "n", _c("p.name").alias("name"), F.trim("p.duration").try_cast("double").alias("duration"))
    return rows.where(_c("name").rlike(r"^g[^/]*\.m4s$") & _c("duration").isNotNull())


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files under ``folder``. Contents aren't read, and Spark leaves out empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
