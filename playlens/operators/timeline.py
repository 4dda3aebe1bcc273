"""Segment planning and lookups on a title's timeline.

Keyframes and byte indexes are the large tables: they are only ever grouped, or scanned in chunks. A title's segments are
few (its length over the target), so windows over them may partition by the title alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.operators.ordered import Scan, asof, merge_intervals, overlap_join, scan
from playlens.session import cut_lineage

# Seconds.
TARGET_SECS = 6.0
SNAP = 0.05
CUT_SLACK = 1e-9
INDEX_SLACK = 1e-6
START_SLACK = 1.0
SEEK_PAST = 0.135
MIN_SEEK_GAP = 0.15
AHEAD_SEGMENTS = 4

CHUNK_SECS = 600.0


def plan_segments(keyframes: DataFrame, durations: DataFrame, target: float = TARGET_SECS) -> DataFrame:
    """(title, n, start, end): cuts at the first keyframe at or after each multiple of ``target`` since the last cut.

    That is the first keyframe of every target-long bucket but the first. A keyframe within the slack below a multiple
    is a cut of its own.
    """
    t, step = F.col("t"), F.lit(float(target))
    bucket = F.floor(t / step)
    early = F.when(F.floor((t + F.lit(CUT_SLACK)) / step) > bucket, t)
    cuts = (
        keyframes.where(t > 0)
        .groupBy("title", bucket.alias("bucket"), early.alias("early"))
        .agg(F.min("t").alias("start"))
        .where((F.col("bucket") >= 1) | F.col("early").isNotNull())
        .select("title", "start")
    )
    return _tile(cuts, durations)


def _tile(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """Number the cuts of each title from 0 and end each at the next, the last at the duration."""
    kept = (
        cuts.join(durations.select("title", "duration"), "title")
        .where((F.col("start") > 0) & (F.col("start") < F.col("duration")))
        .unionByName(durations.select("title", F.lit(0.0).alias("start"), "duration"))
    )
    w = Window.partitionBy("title").orderBy("start")
    return kept.select(
        "title",
        (F.row_number().over(w) - 1).cast("bigint").alias("n"),
        "start",
        F.coalesce(F.lead("start").over(w), F.col("duration")).alias("end"),
    )


def index_bounds(index: DataFrame) -> DataFrame:
    """First and last indexed position of each title."""
    at = F.struct("t", "pos")
    return index.groupBy("title").agg(
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.min_by("pos", at).alias("p0"),
        F.max_by("pos", at).alias("p1"),
    )


def bytes_at(boundaries: DataFrame, index: DataFrame, width: float = CHUNK_SECS) -> DataFrame:
    """``boundaries`` (title, t, …) with ``pos``: the byte position the index gives for each time.

    Titles with fewer than two index points, or a flat index, give no rows.
    """
    bounds = index_bounds(index).where((F.col("t1") > F.col("t0")) & (F.col("p1") > F.col("p0")))
    found = asof(
        boundaries,
        index,
        ["title"],
        F.col("t") + F.lit(INDEX_SLACK),
        F.col("t"),
        {"__pos": F.col("pos")},
        width,
    )
    rate = (F.col("p1") - F.col("p0")) / (F.col("t1") - F.col("t0"))
    past = F.col("t1") <= F.col("t") + F.lit(INDEX_SLACK)
    pos = F.when(past, F.col("p1") + (F.col("t") - F.col("t1")) * rate).otherwise(F.coalesce("__pos", "p0"))
    return found.join(bounds, "title").select(*boundaries.columns, pos.cast("double").alias("pos"))


def segment_bytes(segs: DataFrame, index: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``segs`` with ``bytes``; scaled so that a title sums to its ``size`` where ``sizes`` knows it."""
    w = Window.partitionBy("title").orderBy("n")
    starts = segs.select("title", "n", "start", "end", F.col("start").alias("t"))
    last = segs.groupBy("title").agg(F.max("n").alias("n"), F.max("end").alias("end"))
    ends = last.select(
        "title", (F.col("n") + 1).alias("n"), F.lit(None).cast("double").alias("start"), "end", F.col("end").alias("t")
    )
    at = bytes_at(starts.unionByName(ends), index)
    raw = (
        at.withColumn("next", F.lead("pos").over(w))
        .where(F.col("start").isNotNull())
        .select("title", "n", "start", "end", F.greatest(F.col("next") - F.col("pos"), F.lit(0.0)).alias("bytes"))
    )
    if sizes is None:
        return raw
    total = F.sum("bytes").over(Window.partitionBy("title"))
    scaled = F.when((total > 0) & F.col("size").isNotNull(), F.col("bytes") * F.col("size") / total)
    return raw.join(sizes.select("title", "size"), "title", "left").select(
        "title", "n", "start", "end", F.coalesce(scaled, F.col("bytes")).alias("bytes")
    )


def segment_at(times: DataFrame, segs: DataFrame, shift: float = 0.0, width: float = CHUNK_SECS) -> DataFrame:
    """``times`` (title, t, …) with ``n``: the last segment starting within the snap of ``t``, else the first.

    ``shift`` backs the time up first, never below 0: a resume heads for the segment one second before it.
    """
    at = F.greatest(F.col("t") - F.lit(shift), F.lit(0.0)) if shift else F.col("t")
    found = asof(times, segs, ["title"], at + F.lit(SNAP), F.col("start"), {"n": F.col("n")}, width)
    return found.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def snap_nearest(
    times: DataFrame, keyframes: DataFrame, tol: float = SNAP, width: float = CHUNK_SECS
) -> DataFrame:
    """``times`` with ``snapped``: the nearest keyframe closer than ``tol`` (the earlier on a tie), else the time."""
    back = asof(times, keyframes, ["title"], F.col("t"), F.col("t"), {"__prev": F.col("t")}, width)
    both = asof(back, keyframes, ["title"], F.col("t"), F.col("t"), {"__next": F.col("t")}, width, "forward")
    before, after = F.col("t") - F.col("__prev"), F.col("__next") - F.col("t")
    prev_ok, next_ok = F.coalesce(before < tol, F.lit(False)), F.coalesce(after < tol, F.lit(False))
    snapped = (
        F.when(prev_ok & (~next_ok | (before <= after)), F.col("__prev"))
        .when(next_ok, F.col("__next"))
        .otherwise(F.col("t"))
    )
    return both.select(*times.columns, snapped.alias("snapped"))


def restart_points(segs: DataFrame, keyframes: DataFrame, durations: DataFrame) -> DataFrame:
    """Where a run has to start to produce each segment: (title, n, at, seek)."""
    ahead = asof(
        segs,
        keyframes,
        ["title"],
        F.col("start") + F.lit(INDEX_SLACK),
        F.col("t"),
        {"__next": F.col("t")},
        CHUNK_SECS,
        "forward",
    )
    first = keyframes.groupBy("title").agg(F.min("t").alias("__first"))
    ahead = ahead.join(durations.select("title", "duration"), "title").join(first, "title", "left")
    gap = F.coalesce("__next", "duration") - F.col("start")
    w = Window.partitionBy("title").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    landing = F.last(F.when((F.col("n") >= 1) & (gap >= MIN_SEEK_GAP), F.col("start")), ignorenulls=True).over(w)
    return ahead.withColumn("__land", landing).select(
        "title",
        "n",
        F.coalesce("__land", "__first", F.lit(0.0)).alias("at"),
        (F.col("__land") + F.lit(SEEK_PAST)).alias("seek"),
    )


OPENING_SECS = 60.0


def opening_pieces(segs: DataFrame, keyframes: DataFrame, starts: DataFrame) -> DataFrame:
    """(title, start_at, n, piece, start, end): what stands in for segment ``n``, on which a player opens at ``start_at``.

    ``starts``: (title, start_at), any number of a title. The segment is split at the keyframes in it from the one at or
    before the point a second earlier through the first one after the start. Only keyframes of opened segments are looked
    at: they meet by (title, bucket of time), once for all starts of a segment; a start past the end opens nothing.
    """
    slack, point = F.lit(CUT_SLACK), F.col("__point")
    lengths = segs.groupBy("title").agg(F.max("end").alias("__duration"))
    at = F.least(F.greatest(F.col("start_at") - F.lit(START_SLACK), F.lit(0.0)), F.col("__duration"))
    opened = starts.select("title", "start_at").distinct().join(lengths, "title").withColumn("__point", at).drop("__duration")
    held = {"n": F.col("n"), "__w0": F.col("start"), "__w1": F.col("end")}
    opened = asof(opened, segs, ["title"], point, F.col("start"), held, CHUNK_SECS).where(point < F.col("__w1"))
    times = keyframes.select("title", "t")
    opened = asof(opened, times, ["title"], point + slack, F.col("t"), {"__before": F.col("t")}, CHUNK_SECS)
    opened = opened.join(times.groupBy("title").agg(F.min("t").alias("__first")), "title", "left")
    spans = opened.select("title", "n", "__w0", "__w1").distinct()
    met = overlap_join(spans, times, ["title"], (F.col("__w0"), F.col("__w1")), (F.col("t"), F.col("t")), OPENING_SECS)
    inside = met.groupBy("title", "n").agg(F.array_sort(F.collect_list("t")).alias("__inside"))
    before = F.coalesce("__before", "__first")

    def candidate(t: Column) -> Column:
        return ~((F.col("__w0") == 0) & (F.abs(t - before) < slack)) & (F.col("__w1") - t >= slack)

    inner = F.filter(F.coalesce("__inside", F.array().cast("array<double>")), candidate)
    stop = F.array_min(F.filter("__inner", lambda t: t > F.col("start_at") + slack))
    added = F.filter("__inner", lambda t: (t + slack >= before) & (F.col("__stop").isNull() | (t <= F.col("__stop"))))
    cuts = F.concat(F.array("__w0"), added)
    apart = F.filter("__cuts", lambda t, i: (i == 0) | (t - F.get("__cuts", i - 1) >= slack))
    pieces = F.transform(
        "__apart", lambda t, i: F.struct(i.cast("bigint").alias("piece"), t.alias("start"), F.coalesce(F.get("__apart", i + 1), "__w1").alias("end"))
    )
    rows = opened.join(inside, ["title", "n"], "left").withColumn("__inner", inner).withColumn("__stop", stop)
    rows = rows.withColumn("__cuts", cuts).withColumn("__apart", apart)
    return rows.select("title", "start_at", "n", F.inline(pieces))


def split_opening(segs: DataFrame, pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """(title, start_at, n, start, end, …): the plan of each of ``starts``, its opening segment in ``pieces``, numbered anew.

    Other segments only move up by the pieces that came in, so nothing is sorted or cut again.
    """
    opening = pieces.groupBy("title", "start_at").agg(F.max("n").alias("__at"), F.max("piece").alias("__more"))
    own = starts.select("title", "start_at").distinct().join(opening, ["title", "start_at"], "left")
    extra = [c for c in segs.columns if c not in ("title", "n", "start", "end")]
    later = F.when(F.col("n") > F.col("__at"), F.col("n") + F.col("__more")).otherwise(F.col("n"))
    rest = segs.join(own, "title").where(F.col("__at").isNull() | (F.col("n") != F.col("__at")))
    rest = rest.select("title", "start_at", later.alias("n"), "start", "end", *extra)
    return rest.unionByName(pieces.select("title", "start_at", (F.col("n") + F.col("piece")).alias("n"), "start", "end", *extra))


def piece_bytes(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """``pieces`` with ``bytes``, from the positions of their two ends; none of titles without a usable index."""
    keys = ["title", "start_at", "n", "piece"]
    ends = pieces.select(*keys, "start", "end", F.explode(F.array("start", "end")).alias("t"))
    at = bytes_at(ends, index).groupBy(*keys, "start", "end").agg(F.max("pos").alias("__to"), F.min("pos").alias("__from"))
    return at.select(*keys, "start", "end", (F.col("__to") - F.col("__from")).alias("bytes"))


def opening_heads(segs: DataFrame, keyframes: DataFrame, index: DataFrame, starts: DataFrame) -> DataFrame:
    """(title, start_at, n, head): the pieces (start, bytes) of segment ``n`` that a session from ``start_at`` gets, in order.

    They begin with the piece that a player resumes in. A segment holds few keyframes, so a head is a short array; what
    follows is the title's own plan from the next segment on. No row where the title has no usable index.
    """
    pieces = piece_bytes(cut_lineage(opening_pieces(segs, keyframes, starts)), index)
    point = F.greatest(F.col("start_at") - F.lit(START_SLACK), F.lit(0.0)) + F.lit(SNAP)
    packed = pieces.groupBy("title", "start_at", "n").agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("__all"))
    later = F.filter("__all", lambda p, i: (p["start"] > point) | F.get("__all", i + 1).isNull() | (F.get("__all", i + 1)["start"] > point))
    return packed.select("title", "start_at", "n", later.alias("head"))


def retained(gops: DataFrame, segs: DataFrame, wants: DataFrame, ahead: int = AHEAD_SEGMENTS) -> DataFrame:
    """``gops`` with ``kept``: those in the window around the segment asked for, or ahead of it by the current job.

    ``wants``: (title, n, current_job), the newest segment asked for.
    """
    # A title's ends ascend, so the latest of the window's is the last segment's where the title stops before.
    asked = wants.select("title", "current_job", F.col("n").alias("__n"))
    first, last = F.greatest(F.col("__n") - 1, F.lit(0)), F.col("__n") + ahead + 1
    bounds = (
        segs.join(asked.hint("shuffle_hash"), "title")
        .groupBy("title", "current_job")
        .agg(
            F.max(F.when(F.col("n") == first, F.col("start") - F.lit(SNAP))).alias("lo"),
            F.max(F.when(F.col("n") <= last, F.col("end") + F.lit(SNAP))).alias("hi"),
        )
    )
    keep = (F.col("start") + F.col("dur") > F.col("lo")) & (
        (F.col("start") < F.col("hi")) | F.col("job").eqNullSafe(F.col("current_job"))
    )
    return gops.join(bounds.hint("shuffle_hash"), "title", "left").select(*gops.columns, F.coalesce(keep, F.lit(True)).alias("kept"))


def ready_segments(gops: DataFrame, segs: DataFrame, finished: DataFrame, width: float = CHUNK_SECS) -> DataFrame:
    """``segs`` with the ``job`` whose consecutive GOPs cover each, null where none does yet.

    A job's GOPs with no hole between them form an island; a segment is covered from a GOP on its start if that
    GOP's island reaches the segment's end, or ends with the last GOP of a finished job.
    """
    # A job covers one film once, so its GOPs are as few as the film's keyframes.
    w = Window.partitionBy("title", "job").orderBy("idx")
    jobs = Window.partitionBy("title", "job")
    runs = gops.withColumn("island", F.col("idx") - F.row_number().over(w)).withColumn(
        "last_idx", F.max("idx").over(jobs)
    )
    islands = Window.partitionBy("title", "job", "island")
    runs = runs.withColumn("reach", F.max(F.col("start") + F.col("dur")).over(islands)).withColumn(
        "to_last", F.max("idx").over(islands) == F.col("last_idx")
    )
    done = finished.select("title", "job", F.lit(True).alias("done"))
    runs = runs.join(done, ["title", "job"], "left").select(
        "title", "job", F.col("start").alias("g_start"), "reach",
        (F.col("to_last") & F.coalesce("done", F.lit(False))).alias("complete"),
    )
    reaches = (F.col("reach") >= F.col("end") - F.lit(SNAP)) | F.col("complete")
    near = runs.withColumn("b", F.explode(F.array_distinct(F.array(
        F.floor((F.col("g_start") - SNAP) / width), F.floor((F.col("g_start") + SNAP) / width)
    ))))
    later = (
        segs.where(F.col("n") > 0)
        .withColumn("b", F.floor(F.col("start") / width))
        .join(near, ["title", "b"])
        .where((F.abs(F.col("g_start") - F.col("start")) < SNAP) & reaches)
    )
    opening = segs.where(F.col("n") == 0).join(runs, "title").where(
        ((F.abs(F.col("g_start") - F.col("start")) < SNAP) | (F.col("g_start") < F.col("end"))) & reaches
    )
    cols = ["title", "n", "g_start", "job"]
    found = (
        later.select(*cols)
        .unionByName(opening.select(*cols))
        .groupBy("title", "n")
        .agg(F.min_by("job", F.struct("g_start", "job")).alias("job"))
    )
    return segs.join(found, ["title", "n"], "left")


def covered(windows: DataFrame, coverage: DataFrame, tol: float = SNAP, width: float = CHUNK_SECS) -> DataFrame:
    """``windows`` (title, from, to, …) with ``covered``: one merged interval spans it, give or take ``tol``.

    Merged intervals lie apart, so only the last one starting in time can reach the window's end.
    """
    merged = merge_intervals(coverage, ["title"], tol=tol, width=width)
    found = asof(
        windows, merged, ["title"], F.col("from") + F.lit(tol), F.col("start"), {"__end": F.col("end")}, width
    )
    return found.select(
        *windows.columns, F.coalesce(F.col("__end") >= F.col("to") - F.lit(tol), F.lit(False)).alias("covered")
    )


def gop_starts(gops: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(title, job, idx, start): each GOP starts where the one before ended, put onto a real keyframe.

    The correction feeds the next row, so this is an ordered fold, one job a row. Only the keyframes that its GOPs can
    reach travel with a job, found by an interval join: a long title's others stay where they are.
    """
    import numpy as np
    import pandas as pd

    heads = gops.groupBy("title", "job", "job_start").agg(
        F.array_sort(F.collect_list(F.struct("idx", "dur"))).alias("gops"),
        # Each GOP may be moved by up to the snap.
        (F.sum("dur") + (F.count("*") + 1) * F.lit(SNAP)).alias("reach"),
    )
    spans = heads.select(
        "title",
        "job",
        (F.col("job_start") - F.lit(SNAP)).alias("lo"),
        (F.col("job_start") + F.col("reach")).alias("hi"),
    )
    t = F.col("t")
    near_keys = overlap_join(
        spans, keyframes.select("title", "t"), ["title"], (F.col("lo"), F.col("hi")), (t, t + F.lit(CUT_SLACK)), CHUNK_SECS
    )
    arrays = near_keys.groupBy("title", "job").agg(F.array_sort(F.collect_list("t")).alias("keyframes"))

    def fold(batches):
        for pdf in batches:
            out = []
            for title, job, at, run, kfs in zip(pdf.title, pdf.job, pdf.job_start, pdf.gops, pdf.keyframes):
                kfs = np.asarray(kfs if kfs is not None else [], dtype=float)
                for g in run:
                    i = int(np.searchsorted(kfs, at, side="left"))
                    near = [k for k in kfs[max(i - 1, 0) : i + 1] if abs(k - at) < SNAP]
                    start = min(near, key=lambda k: abs(k - at)) if near else at
                    out.append((title, job, g["idx"], float(start)))
                    at = start + g["dur"]
            yield pd.DataFrame(out, columns=["title", "job", "idx", "start"])

    return heads.join(arrays, ["title", "job"], "left").mapInPandas(
        fold, "title bigint, job bigint, idx bigint, start double"
    )


def effective_start(start_at: Column, duration: Column) -> Column:
    return F.when((start_at > 0) & (start_at < duration), start_at).otherwise(F.lit(0.0))
