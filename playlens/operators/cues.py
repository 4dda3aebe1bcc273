"""WebVTT cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.text import vtt_ms
from playlens.operators.ordered import overlap_join

_c = F.col
BUCKET_MS = 60_000.0


def parse_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_ms, end_ms, block): the cues of each document.

    Blocks stand between blank lines. Notes, styles, regions and cues with no text are not cues, nor is a last block
    whose line is not finished.
    """
    body = F.replace(F.regexp_replace(text, r"^\x{feff}+", ""), F.lit("\r\n"), F.lit("\n"))
    docs = df.select(key, body.alias("__body"))
    # The last block is known from the text itself: no second pass over the blocks.
    last = F.size(F.split("__body", "\n\n")) - 1
    blocks = (
        docs.withColumn("__last", last)
        .withColumn("__whole", F.endswith("__body", F.lit("\n")))
        .select(key, "__whole", "__last", F.posexplode(F.split("__body", "\n\n")).alias("__pos", "__raw"))
        .where(_c("__whole") | (_c("__pos") < _c("__last")))
    )
    block = F.regexp_replace("__raw", r"^\n+|\n+$", "")
    timing = F.regexp_extract(_c("block"), r"(?m)^(.*?-->.*)$", 1)
    after = F.regexp_extract(_c("block"), r"(?s)-->[^\n]*\n(.*)$", 1)
    word = F.regexp_extract(_c("block"), r"(\S+)", 1)
    start = vtt_ms(F.trim(F.regexp_extract(_c("__timing"), r"^(.*?)-->", 1)))
    end = vtt_ms(F.regexp_extract(_c("__timing"), r"-->\s*(\S+)", 1))
    return (
        blocks.select(key, block.alias("block"))
        .withColumn("__timing", timing)
        .where((_c("__timing") != "") & after.rlike(r"\S") & ~word.isin("WEBVTT", "NOTE", "STYLE", "REGION"))
        .select(key, start.alias("start_ms"), end.alias("end_ms"), "block")
        .where(_c("start_ms").isNotNull() & _c("end_ms").isNotNull())
    )


def cue_union(*runs: DataFrame) -> DataFrame:
    """The cues of every run of a track, exact duplicates once."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(["track", "start_ms", "end_ms", "block"])


def cues_in_segments(cues: DataFrame, segs: DataFrame, width: float = BUCKET_MS) -> DataFrame:
    """One row per (segment, cue showing at any moment of it). ``segs``: (track, n, from_ms, to_ms)."""
    shown_to = F.greatest(_c("end_ms"), _c("start_ms") + 1)
    return overlap_join(segs, cues, ["track"], (_c("from_ms"), _c("to_ms")), (_c("start_ms"), shown_to), width)


def render_window(pairs: DataFrame, header: str) -> DataFrame:
    """The WebVTT text of each (track, n): its cues in order. A segment shows a handful."""
    rows = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "block")))
    text: Column = F.concat(
        F.lit(header), F.concat_ws("", F.transform(_c("__rows"), lambda r: F.concat(r["block"], F.lit("\n\n"))))
    )
    return pairs.groupBy("track", "n").agg(rows.alias("__rows")).select("track", "n", text.alias("text"))
