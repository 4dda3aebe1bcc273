"""What a title asks of a link: rates, waits and byte budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Seconds, and the headroom on an average where a file has no byte index.
MAX_PREBUFFER = 10.0
LONG_PREBUFFER = 30.0
NO_INDEX_HEADROOM = 1.5

_LINES = T.ArrayType(T.DoubleType())
_TERMS = T.ArrayType(
    T.StructType().add("stretch", _LINES).add("opening", _LINES).add("slopes", _LINES).add("offsets", _LINES)
)
#: Numbers that are worked on at once, of the factors of a shape times its segments.
FACTORS_AT_ONCE = 2**20


@F.pandas_udf(_TERMS)
def link_terms(starts: pd.Series, sizes: pd.Series, shapes: pd.Series, prebuffer: pd.Series) -> pd.Series:
    """For each of a title's ``shapes`` (first, secs, cap, factors, head) the two terms of its need from segment ``first`` on, at
    each of its factors, and its wait as a function of the rate. A title's arrays come once, with all its shapes; where a shape
    has a ``head``, its pieces (start, bytes) stand in for segment ``first``.

    ``stretch`` is the largest bits-over-time of any run of segments j..k. Trying every pair is quadratic; instead a
    trial rate R is raised until no run asks more: with D(j) = bits before j - R * start of j, the worst run ending at
    k begins at the smallest D so far, one pass. The answer is the ratio of a real run, not an approximation. A factor scales
    all bits, so without a cap the same run is the worst at each of them; with one, the trials of all factors rise together.

    The wait at a rate is the largest of the lines slope * factor / rate - offset; only those on the upper hull are returned.
    """
    import numpy as np

    def hull(slopes, offsets):
        kept: list[tuple[float, float]] = []
        for s, o in zip(slopes.tolist(), offsets.tolist()):
            if kept and s == kept[-1][0]:
                continue  # the same bits due later ask for no wait of their own
            while len(kept) > 1:
                (s0, o0), (s1, o1) = kept[-2], kept[-1]
                if (o - o0) * (s1 - s0) > (o1 - o0) * (s - s0):
                    break
                kept.pop()
            kept.append((s, o))
        return [k[0] for k in kept], [k[1] for k in kept]

    def opened(t, before, lo, head):
        """Starts, bits before each segment and after the last, and the hull of a session's waits."""
        t = t[lo:]
        if len(t) == 0:
            return t, before[:1], ([0.0], [0.0])
        bits = before[lo:] - before[lo]
        if head:
            pieces = np.cumsum([8.0 * size for _, size in head])
            t = np.concatenate(([at for at, _ in head], t[1:]))
            bits = np.concatenate(([0.0], pieces, pieces[-1] + bits[2:] - bits[1]))
        return t, bits, hull(bits[1:], t - t[0])

    def worst(low):
        """Where the smallest value up to each place is, the last of equals."""
        least = np.minimum.accumulate(low, axis=-1)
        return least, np.maximum.accumulate(np.where(low <= least, np.arange(low.shape[-1]), 0), axis=-1)

    def buffered(t, ahead, after, factors, buf):
        trial, run = 0.0, None
        while True:
            least, j_of = worst(ahead - trial * t)
            k = int(np.argmax(after - trial * t - least - trial * buf))
            j = int(j_of[k])
            best = (after[k] - ahead[j]) / (buf + t[k] - t[j])
            if not best > trial:
                break
            trial, run = best, (j, k)
        if run is None:
            return np.zeros(len(factors))
        j, k = run
        return (after[k] * factors - ahead[j] * factors) / (buf + t[k] - t[j])

    def capped(t, ahead, after, factors, limit, trial):
        """``trial`` raised to the largest ratio beyond the cap, for each factor."""
        trial, rows = trial.copy(), np.arange(len(factors))
        while len(rows):
            f, r = factors[rows, None], trial[rows, None]
            before, behind = ahead * f, after * f
            least, j_of = worst(before - r * t)
            k = np.argmax(behind[:, 1:] - limit - r * t[1:] - least[:, :-1], axis=1) + 1
            at = np.arange(len(rows))
            j = j_of[at, k - 1]
            time = t[k] - t[j]
            best = np.where(time > 0, (behind[at, k] - before[at, j] - limit) / np.where(time > 0, time, 1.0), 0.0)
            up = best > trial[rows]
            trial[rows[up]] = best[up]
            rows = rows[up]
        return trial

    def one(t, bits, factors, pre, buf, cap):
        if len(t) == 0:
            return np.zeros(len(factors)), np.zeros(len(factors))
        ahead, after = bits[:-1], bits[1:]
        stretch = buffered(t, ahead, after, factors, buf)
        if cap is not None and not np.isnan(cap) and len(t) > 1:
            at_once = max(FACTORS_AT_ONCE // len(t), 1)
            for i in range(0, len(factors), at_once):
                part = slice(i, i + at_once)
                stretch[part] = capped(t, ahead, after, factors[part], float(cap) * 8.0, stretch[part])
        k = int(np.argmax(after / (pre + t - t[0])))
        return stretch, after[k] * factors / (pre + t[k] - t[0])

    out = []
    for t, b, own, pre in zip(starts, sizes, shapes, prebuffer):
        t, before = np.asarray(t, float), np.append(0.0, np.cumsum(np.asarray(b, float) * 8.0))
        plans, terms = {}, []
        for s in own:
            lo, head = int(s["first"]), tuple((p["start"], p["bytes"]) for p in (s["head"] if s["head"] is not None else ()))
            if (lo, head) not in plans:
                plans[lo, head] = opened(t, before, lo, head)
            at, bits, (slopes, offsets) = plans[lo, head]
            stretch, opening = one(at, bits, np.asarray(s["factors"], float), pre, s["secs"], s["cap"])
            terms.append({"stretch": stretch.tolist(), "opening": opening.tolist(), "slopes": slopes, "offsets": offsets})
        out.append(terms)
    return pd.Series(out)


def segment_arrays(segs_bytes: DataFrame) -> DataFrame:
    """One row a title: its segments' starts and bytes in order. A title has as many as its length over the target."""
    packed = segs_bytes.groupBy("title").agg(
        F.array_sort(F.collect_list(F.struct("n", "start", "bytes"))).alias("segs")
    )
    return packed.select("title", F.col("segs.start").alias("starts"), F.col("segs.bytes").alias("sizes"))


SHAPE = ("title", "first", "buffer_secs", "buffer_bytes", "size")


def link_rates(
    deliveries: DataFrame, segs_bytes: DataFrame, prebuffer: float = MAX_PREBUFFER, opened: DataFrame | None = None
) -> DataFrame:
    """``deliveries`` (title, first, buffer_secs, buffer_bytes, size, rate, ...) with stretch, needed rate and wait.

    ``size`` rescales the title's bytes to what is delivered of it. ``wait`` is null without a rate, and where no wait
    would do because a stretch asks for more than the rate. Deliveries alike in all but the rate are costed once; the shapes
    of a title go to its one row of segments, which are never copied, and those alike in all but the size are one shape. With a column ``head`` (array of start and bytes)
    those pieces are sent in place of segment ``first``, as where a session opens within it. Where ``opened`` (title, t, first,
    head) says what a session from ``t`` opens with, deliveries carry ``t`` alone, and heads meet the distinct shapes only.
    """
    keys = [k for k in SHAPE if k != "size"] if opened is None else ["title", "t", "buffer_secs", "buffer_bytes"]
    if opened is None and "head" in deliveries.columns:
        keys.append("head")
    inner = keys[1:] if opened is None else [*keys[1:], "first", "head"]
    alike = deliveries.select(*keys, "size").distinct().groupBy(*keys).agg(F.collect_list("size").alias("__sizes"))
    if opened is not None:
        alike = alike.join(opened.select("title", "t", "first", "head"), ["title", "t"])
    total = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + x)

    def factor(size: Column) -> Column:
        return F.when((F.col("__total") > 0) & size.isNotNull(), size / F.col("__total")).otherwise(F.lit(1.0))

    # The first factor is that of an unknown size.
    asked = F.transform(
        "__shapes",
        lambda s: F.struct(
            s["first"].cast("int").alias("first"),
            s["buffer_secs"].cast("double").alias("secs"),
            s["buffer_bytes"].cast("double").alias("cap"),
            F.concat(F.array(F.lit(1.0)), F.transform(s["__sizes"], factor)).alias("factors"),
            (s["head"] if "head" in inner else F.lit(None)).cast("array<struct<start:double,bytes:double>>").alias("head"),
        ),
    )
    tasks = int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = alike.groupBy("title").agg(F.collect_list(F.struct(*inner, "__sizes")).alias("__shapes"))
    costs = (
        segment_arrays(segs_bytes)
        .join(shapes, "title")
        .withColumn("__total", total)
        .repartition(tasks)  # little data but much arithmetic: do not let it be coalesced into one task
        .withColumn("__terms", link_terms("starts", "sizes", asked, F.lit(float(prebuffer))))
        .select("title", "__total", F.explode(F.arrays_zip("__shapes", "__terms")).alias("__one"))
    )
    shape, terms = F.col("__one.__shapes"), F.col("__one.__terms")
    known = [F.col("title").alias("__title"), *[shape[k].alias(f"__{k}") for k in keys[1:]], shape["__sizes"].alias("__sizes")]
    costs = costs.select(*known, "__total", *[terms[k].alias(f"__{k}") for k in ("stretch", "opening", "slopes", "offsets")])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # A few rows a title, of arrays: hashed, so that deliveries aren't sorted.
    met = deliveries.join(costs.hint("shuffle_hash"), cond, "left")
    at = F.coalesce(F.array_position("__sizes", F.col("size")), F.lit(0)).cast("int")
    met = met.withColumns({"__stretch": F.get("__stretch", at), "__opening": F.get("__opening", at), "__factor": factor(F.col("size"))})
    wait = F.array_max(F.zip_with("__slopes", "__offsets", lambda s, o: s * F.col("__factor") / F.col("rate") - o))
    stretch = F.col("__stretch")
    return met.select(
        *deliveries.columns,
        stretch.alias("stretch_rate"),
        F.greatest(F.col("__opening"), stretch).alias("needed_rate"),
        F.when((F.col("rate") > 0) & (stretch <= F.col("rate")), F.greatest(wait, F.lit(0.0))).alias("startup_delay"),
    )


def link_need(deliveries: DataFrame, segs_bytes: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """``deliveries`` (as :func:`link_rates`, and duration; ``opened`` too) with ``need`` in bits a second, ``indexed`` and ``prebuffer``.

    Without a byte index the need is the average with headroom; null when that is not known either.
    """
    average = F.when(
        F.col("size").isNotNull() & (F.col("duration") > 0), (F.col("size") * 8.0 / F.col("duration")).cast("bigint")
    )
    indexed = F.col("needed_rate").isNotNull()
    return link_rates(deliveries, segs_bytes, opened=opened).select(
        *deliveries.columns,
        F.coalesce(F.col("needed_rate").cast("bigint"), (average * F.lit(NO_INDEX_HEADROOM)).cast("bigint")).alias("need"),
        F.when(indexed, True).when(average.isNotNull(), False).alias("indexed"),
        F.col("startup_delay").alias("prebuffer"),
    )


def delivered_bytes(video_bytes: Column, audio_bytes: Column, aac_rate: Column, duration: Column) -> Column:
    """The video and the one audio track sent; null where the file does not say how big its tracks are."""
    converted = (aac_rate * duration / 8.0).cast("bigint")
    return video_bytes + F.when(aac_rate.isNotNull(), converted).otherwise(audio_bytes)


def uplink_budget(sessions: DataFrame, site: str, uplink: str) -> DataFrame:
    """``sessions`` with ``budget``: each player's own rate within what the site's other remote sessions leave.

    The others' sum is the site's total less the row's own share: one small row a site, joined back.
    """
    remote = F.when(F.col("max_bitrate").isNotNull(), F.coalesce("need", F.lit(0))).otherwise(F.lit(0))
    totals = sessions.groupBy(site).agg(F.sum(remote).alias("__total"))
    left = F.greatest(F.col(uplink) - (F.col("__total") - remote), F.lit(0))
    budget = F.when(F.col(uplink).isNull(), F.col("max_bitrate")).otherwise(F.least("max_bitrate", left))
    return sessions.join(totals, site).select(
        *sessions.columns, F.when(F.col("max_bitrate").isNotNull(), budget).cast("bigint").alias("budget")
    )


def bandwidth(size: Column, duration: Column) -> tuple[Column, Column]:
    """(average, peak) bits a second a manifest names. Without a size, 8 Mbit/s is assumed."""
    avg = F.coalesce(
        F.when(size.isNotNull() & (duration > 0), (size * 8.0 / duration).cast("bigint")), F.lit(8_000_000).cast("bigint")
    )
    return avg, avg + F.floor(avg / 4).cast("bigint") + F.lit(192_000)


def output_size(width: Column, height: Column, preset_w: Column, preset_h: Column) -> tuple[Column, Column]:
    """A picture fitted inside a preset, never scaled up, both sides even and at least 2; 0 x 0 when unknown."""
    scale = F.least(preset_w / width, preset_h / height, F.lit(1.0))
    unknown = (width == 0) | (height == 0)

    def even(x: Column) -> Column:
        whole = F.round(x * scale).cast("int")
        return F.when(unknown, F.lit(0)).otherwise(F.greatest(whole - whole % 2, F.lit(2)))

    return even(width), even(height)


# Fixed values: (name, width, height, bits a second, floor).
LADDER = (
    ("1080p", 1920, 1080, 8_000_000, 4_000_000),
    ("720p", 1280, 720, 3_000_000, 2_000_000),
    ("540p", 960, 540, 1_500_000, 1_000_000),
)
AUDIO_MAX = 384_000
PEAK_RATIO = 1.5


def bitrate_ladder(max_bitrate: Column) -> Column:
    """The conversion a link carries: struct(name, width, height, bitrate, peak, buffer), null below the last floor."""
    fits = (F.greatest(max_bitrate - AUDIO_MAX, F.lit(0)) / PEAK_RATIO).cast("bigint")

    def rung(name: str, w: int, h: int, bitrate: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(w).alias("width"),
            F.lit(h).alias("height"),
            bitrate.cast("bigint").alias("bitrate"),
            (bitrate * PEAK_RATIO).cast("bigint").alias("peak"),
            (bitrate * 2).cast("bigint").alias("buffer"),
        )

    name, w, h, top, _ = LADDER[0]
    choice = F.when(max_bitrate.isNull(), rung(name, w, h, F.lit(top)))
    for name, w, h, top, floor in LADDER:
        rate = F.least(F.lit(top).cast("bigint"), fits)
        choice = choice.when(rate >= floor, rung(name, w, h, rate))
    return choice


def head_start(buffer: Column, rate: Column) -> Column:
    return buffer / F.greatest(rate, F.lit(1))


def player_buffer(player: Column) -> Column:
    """How far ahead a player buffers: struct(secs, bytes)."""

    def held(secs: float, size: int | None) -> Column:
        return F.struct(F.lit(secs).alias("secs"), F.lit(size).cast("bigint").alias("bytes"))

    return (
        F.when(player == "hls.js", held(120.0, 150_000_000))
        .when(player == "cast", held(60.0, 50_000_000))
        .otherwise(held(30.0, None))
    )


def over_link(need: Column, rate: Column) -> Column:
    return F.coalesce(need > rate, F.lit(False))


def pull_throughput(runs: DataFrame) -> DataFrame:
    """``runs`` (media, bytes, running, paused) with speed against real time and Mbit/s; null when it never ran."""
    running = F.when(F.col("running") > 0, F.col("running"))
    return runs.select(
        "*",
        (F.col("media") / running).alias("speed"),
        (F.col("bytes") * 8.0 / 1e6 / running).alias("mbps"),
    )
