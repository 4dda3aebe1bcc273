"""Hand-computed timelines, and the scans against plain windows on a hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from playlens.operators import link, timeline as tl
from playlens.operators.ordered import Scan, asof, flag_first, merge_intervals, overlap_join, scan

KFS = [0.0, 2.5, 5.0, 8.0, 10.5, 13.0, 16.0, 19.5, 22.0, 24.0, 27.5]


def frames(spark, keyframes, duration, title=1):
    k = spark.createDataFrame([(title, t) for t in keyframes], "title bigint, t double")
    d = spark.createDataFrame([(title, duration)], "title bigint, duration double")
    return k, d


@pytest.mark.parametrize(
    "keyframes, duration, starts",
    [
        (KFS, 30.021, [0, 8, 13, 19.5, 24]),
        ([0.0, 20.0, 21.0, 22.0, 26.0], 40.0, [0, 20, 26]),
        ([0.5, 7.0], 10.0, [0, 7]),
        ([0.0, 6.0 - 5e-10, 6.0 + 1e-3, 12.0], 15.0, [0, 6.0 - 5e-10, 6.0 + 1e-3, 12.0]),
    ],
)
def test_plan_segments(spark, keyframes, duration, starts):
    rows = tl.plan_segments(*frames(spark, keyframes, duration)).orderBy("n").collect()
    assert [r.start for r in rows] == starts
    assert rows[-1].end == duration
    assert all(a.end == b.start for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize(
    "keyframes, duration, start, starts",
    [
        (KFS, 30.021, 0.0, [0, 2.5, 8, 13, 19.5, 24]),
        ([0.021, 2.521, 8.021, 13.021], 19.0, 0.0, [0, 2.521, 8.021, 13.021]),
        (KFS, 30.021, 18.8, [0, 8, 13, 16, 19.5, 24]),
    ],
)
def test_split_opening(spark, keyframes, duration, start, starts):
    k, d = frames(spark, keyframes, duration)
    at = spark.createDataFrame([(1, start)], "title bigint, start_at double")
    segs = tl.plan_segments(k, d)
    rows = tl.split_opening(segs, tl.opening_pieces(segs, k, at), at).orderBy("n").collect()
    assert [r.start for r in rows] == starts and [r.n for r in rows] == list(range(len(starts)))


def test_every_start_of_a_title_has_its_own_opening(spark):
    k, d = frames(spark, KFS, 30.021)
    at = spark.createDataFrame([(1, 18.8), (1, 0.0), (1, 18.8), (1, 99.0), (2, 3.0)], "title bigint, start_at double")
    segs = tl.plan_segments(k, d)
    plan = {}
    for r in tl.split_opening(segs, tl.opening_pieces(segs, k, at), at).orderBy("n").collect():
        plan.setdefault(r.start_at, []).append(r)
    assert [r.start for r in plan[18.8]] == [0, 8, 13, 16, 19.5, 24] and [r.start for r in plan[0.0]] == [0, 2.5, 8, 13, 19.5, 24]
    assert [r.start for r in plan[99.0]] == [r.start for r in segs.orderBy("n").collect()] and len(plan) == 3
    for rows in plan.values():
        assert all(a.end == b.start for a, b in zip(rows, rows[1:])) and [r.n for r in rows] == list(range(len(rows)))


def indexed(spark):
    k, d = frames(spark, [0.0, 6.0, 12.0], 15.0)
    index = spark.createDataFrame([(1, 0.0, 100), (1, 6.0, 700), (1, 12.0, 1300)], "title bigint, t double, pos bigint")
    return tl.plan_segments(k, d), index


def test_segment_bytes(spark):
    segs, index = indexed(spark)
    assert [r.bytes for r in tl.segment_bytes(segs, index).orderBy("n").collect()] == [600, 600, 300]
    sizes = spark.createDataFrame([(1, 3000.0)], "title bigint, size double")
    assert [r.bytes for r in tl.segment_bytes(segs, index, sizes).orderBy("n").collect()] == [1200, 1200, 600]


def rates(spark, pieces, secs, cap=None, first=0, rate=None, step=6.0):
    segs = spark.createDataFrame(
        [(1, i, i * step, (i + 1) * step, float(b)) for i, b in enumerate(pieces)],
        "title bigint, n bigint, start double, end double, bytes double",
    )
    d = spark.createDataFrame(
        [(1, first, float(secs), cap, None, rate)],
        "title bigint, first bigint, buffer_secs double, buffer_bytes bigint, size double, rate double",
    )
    return link.link_rates(d, segs).collect()[0]


def test_needed_rate_and_wait(spark):
    assert rates(spark, [600, 600, 300], 1e6).needed_rate == pytest.approx(600)
    assert rates(spark, [600, 600, 300], 1e6, rate=600.0).startup_delay == pytest.approx(10)
    assert rates(spark, [600, 600, 300], 1e6, first=1).needed_rate == pytest.approx(480)


def test_heavy_stretch(spark):
    pieces = [12_500] * 10 + [625_000] * 10
    assert rates(spark, pieces, 120.0).needed_rate >= 51e6 / 184
    assert rates(spark, pieces, 30.0).stretch_rate == pytest.approx(50e6 / 84)
    assert rates(spark, pieces, 30.0, 1_000_000).stretch_rate >= 42e6 / 54 - 1e-6


def test_stretch_rate_is_the_worst_of_all_pairs(spark):
    rng = random.Random(7)
    for cap in (None, 40_000):
        b = [rng.choice([1_000, 5_000, 90_000]) for _ in range(60)]
        want = 0.0
        for j in range(60):
            bits = 0.0
            for k in range(j, 60):
                bits += b[k] * 8.0
                span = (k - j) * 6.0
                want = max(want, bits / (30 + span))
                if cap and span > 0:
                    want = max(want, (bits - cap * 8.0) / span)
        got = rates(spark, b, 30.0, cap, rate=want * 1.5)
        assert got.stretch_rate == pytest.approx(want, rel=1e-12)
        wait = max(max(sum(b[: k + 1]) * 8.0 / (want * 1.5) - k * 6.0 for k in range(60)), 0)
        assert got.startup_delay == pytest.approx(wait, rel=1e-9)


def test_a_session_is_costed_by_the_plan_it_gets(spark):
    k, d = frames(spark, KFS, 30.021)
    rng = random.Random(11)
    at, index = 0, []
    for t in KFS:
        index.append((1, t, at))
        at += rng.choice([1_000, 40_000, 90_000])
    index = spark.createDataFrame([*index, (1, 30.0, at)], "title bigint, t double, pos bigint")
    starts = spark.createDataFrame([(1, t) for t in (0.0, 6.0, 9.1, 14.0, 18.8, 25.0, 29.9)], "title bigint, start_at double")
    segs = tl.plan_segments(k, d)
    whole = tl.segment_bytes(segs, index)
    pieces = tl.piece_bytes(tl.opening_pieces(segs, k, starts), index)
    plans = {}
    for r in tl.split_opening(whole, pieces, starts).orderBy("n").collect():
        plans.setdefault(r.start_at, []).append((r.start, r.bytes))
    heads = tl.opening_heads(segs, k, index, starts).withColumnRenamed("n", "first")
    shape = heads.select("*", *[F.lit(v).cast("double").alias(n) for n, v in (("buffer_secs", 9), ("buffer_bytes", 70_000), ("size", None), ("rate", 1e6))])
    got = {r.start_at: r for r in link.link_rates(shape, whole).collect()}
    assert sorted(got) == sorted(plans) and any(len(r.head) > 1 for r in got.values())
    for start, plan in plans.items():
        lo = max(i for i, (t, _) in enumerate(plan) if t <= max(start - 1, 0) + 0.05)
        t, b = zip(*plan[lo:])
        sums = [(8 * sum(b[j : i + 1]), t[i] - t[j]) for j in range(len(t)) for i in range(j, len(t))]
        stretch = max(max(bits / (9 + span), (bits - 8 * 70_000) / span if span else 0) for bits, span in sums)
        opening = max(8 * sum(b[: i + 1]) / (10 + t[i] - t[0]) for i in range(len(t)))
        wait = max(8 * sum(b[: i + 1]) / 1e6 - (t[i] - t[0]) for i in range(len(t)))
        assert got[start].stretch_rate == pytest.approx(stretch) and got[start].needed_rate == pytest.approx(max(stretch, opening))
        assert got[start].startup_delay == pytest.approx(max(wait, 0)), start


def test_scans_equal_plain_windows_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.8 else rng.randrange(2, 6), i, rng.random() * 100, rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, id bigint, t double, v bigint")
    specs = [
        Scan("s", "sum", F.col("id")),
        Scan("m", "max", F.col("v"), inclusive=False),
        Scan("l", "last", F.col("v")),
        Scan("f", "first", F.col("v"), inclusive=False),
    ]
    got = scan(df, ["k"], ["t", "id"], F.floor(F.col("t") / 7), specs).orderBy("id").collect()
    w = Window.partitionBy("k").orderBy("t", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*",
        F.sum("id").over(up).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.last("v", True).over(up).alias("l"),
        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("f"),
    )
    assert got == want.orderBy("id").collect()


def test_asof_flag_merge_overlap(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 9.0), (2, 1.0)], "k bigint, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 5.0, "b")], "k bigint, t double, v string")
    back = asof(left, right, ["k"], F.col("t"), F.col("t"), {"v": F.col("v")}, 2.0).orderBy("k", "t").collect()
    assert [r.v for r in back] == [None, "b", None]
    ahead = asof(left, right, ["k"], F.col("t"), F.col("t"), {"v": F.col("v")}, 2.0, "forward").orderBy("k", "t").collect()
    assert [r.v for r in ahead] == ["a", None, None]
    marks = flag_first(spark.range(10).withColumn("k", F.lit(1)), ["k"], [F.col("id")], 3, "in").where("in").count()
    assert marks == 3
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.04, 8.0), (1, 9.0, 10.0)], "k bigint, start double, end double")
    merged = merge_intervals(spans, ["k"], width=3.0).orderBy("start").collect()
    assert [(r.start, r.end) for r in merged] == [(0.0, 8.0), (9.0, 10.0)]
    a = spark.createDataFrame([(1, 0, 100), (1, 95, 130)], "k bigint, lo bigint, hi bigint")
    b = spark.createDataFrame([(1, 99, 101), (1, 130, 140)], "k bigint, x bigint, y bigint")
    pairs = overlap_join(a, b, ["k"], (F.col("lo"), F.col("hi")), (F.col("x"), F.col("y")), 10.0)
    assert sorted((r.lo, r.x) for r in pairs.collect()) == [(0, 99), (95, 99)]


def test_bandwidth(spark):
    avg, peak = link.bandwidth(F.lit(3_750_000), F.lit(30.0))
    r = spark.range(1).select(avg.alias("a"), peak.alias("p")).collect()[0]
    assert (r.a, r.p) == (1_000_000, 1_442_000)
