"""Text rules, signatures, choice and throttling against hand-made cases."""

import base64
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from playlens.functions import codecs as cd, lang, text as tx
from playlens.operators import choice, link, releases as rel, reports as rp, sessions as se


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).collect()[0]


def test_scrub_and_messages(spark):
    line = "HTTP error 403\nhttps://cdn.host.com/d/ABC/movie.mkv: Server returned 403, open http://h/p/T failed"
    r = one(
        spark,
        a=tx.scrub(F.lit(line)),
        b=tx.scrub(F.lit("bad config abc0 rejected"), ("abc0",)),
        c=tx.player_message(F.lit("PIPE: hvc1\nsession AAAAAA: ended\u0007")),
        d=tx.player_message(F.lit("x" * 500), 400, 160),
        e=tx.player_message(F.lit("x" * 500)),
    )
    assert r.a == "HTTP error 403\n<url>: Server returned 403, open <url> failed"
    assert r.b == "bad config <secret> rejected"
    assert r.c == "PIPE: hvc1 session AAAAAA: ended"
    assert len(r.d) == 160 and len(r.e) == 500  # limits are the caller's


def test_signature_is_hmac(spark):
    for key in (b"k", b"x" * 80):
        want = base64.urlsafe_b64encode(hmac.new(key, b"d\0sid\x00123", hashlib.sha256).digest()[:16]).rstrip(b"=").decode()
        assert one(spark, s=tx.url_signature(key, "d", F.lit("sid"), F.lit(123))).s == want


def test_codec_strings(spark):
    cases = {
        "avc1.640033": (100, 51, False), "hvc1.2.4.H153.B0": (2, 153, True), "av01.0.13M.10": (0, 13, False),
        "vp09.02.51.10": (2, 51, False), "hvc1.A1.6.L120": (1, 120, False), "mp4a.40.2": None, "avc1": None, "av01.0.1": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", cd.codec_profile_level(F.col("c")).alias("n"))
    for r in df.collect():
        assert (tuple(r.n) if r.n else None) == cases[r.c]


def test_languages(spark):
    tags = {"eng": "en", "de-DE": "de", "GER": "de", "nb_NO": "no", "tlh-x": "tlh", "": ""}
    df = spark.createDataFrame([(k,) for k in tags], "tag string").select("tag", lang.canonical(F.col("tag")).alias("c"))
    assert {r.tag: r.c for r in df.collect()} == tags
    assert one(spark, l=lang.ordered_union(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))).l == ["a", "b", "c"]


def test_byte_ranges(spark):
    cases = [("bytes=0-99", 206, 0, 99), ("bytes=900-", 206, 900, 999), ("bytes=-10", 206, 990, 999), ("bytes=5-5000", 206, 5, 999),
             ("bytes=1000-", 416, None, None), ("bytes=0-1,5-6", 200, None, None), ("junk", 200, None, None), ("bytes=9-3", 200, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "h string").select("h", tx.byte_range(F.col("h"), F.lit(1000)).alias("r"))
    assert {(r.h, *r.r) for r in df.collect()} == set(cases)


def test_reports(spark):
    bodies = ["{}", "[]", "null", "not json", '{"code":3}', '{"stats":"fast"}', "", '{"code":3,"message":"DECODE"}', '{"stats":{"engine":"native"}}',
              '{"code":0,"message":"x","stats":{}}', '{"code":99999,"message":"x"}']
    df = rp.parse_reports(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"))
    assert {(r.i, r.code) for r in df.select("i", "code").collect()} == {(7, 3), (8, None), (9, 0), (10, 65535)}
    assert {r.i for r in rp.report_failures(df).select("i").collect()} == {7, 10}


def tracks(*rows):
    t = "array<struct<idx:int,lang:string,is_default:boolean,commentary:boolean>>"
    return F.from_json(F.lit(__import__("json").dumps([dict(zip(("idx", "lang", "is_default", "commentary"), r)) for r in rows])), t)


def test_pick_audio(spark):
    t = tracks((0, "en", False, True), (1, "de", False, False), (2, "de", True, False), (3, None, False, False))
    prefs = lambda *p: choice.wanted_tags(F.array(*[F.lit(x) for x in p]))
    r = one(
        spark, a=choice.pick_audio(t, prefs("fi", "de-AT")), b=choice.pick_audio(t, prefs("en")), c=choice.pick_audio(t, prefs("de"), F.lit(3)),
        d=choice.pick_audio(tracks((0, "en", True, True)), prefs("en")),
    )
    assert tuple(r.a) == (2, "asked for: de")
    assert tuple(r.b) == (2, "default flag")
    assert tuple(r.c) == (3, "explicit index")
    assert tuple(r.d) == (0, "lowest index")


CAPS = dict.fromkeys(rel.CAPABILITIES, 0)


@pytest.mark.parametrize(
    "need, wait, link_rate, want",
    [
        (5_000_000, 4.0, 6_600_000, ("copy", 1, False)),
        (8_140_000, 20.0, 6_600_000, ("copy_after_wait", 1, False)),
        (12_000_000, None, 6_600_000, ("converted", 2, True)),
        (12_000_000, None, 1_500_000, ("copy_least_need", 1, False)),
    ],
)
def test_choice_tiers(spark, need, wait, link_rate, want):
    base = "request_id int, release_id int, rank int, fit string, named boolean, opens boolean, blank boolean, plays_it boolean, video string, need bigint, prebuffer double, max_bitrate bigint"
    rows = [
        (1, 1, 1, "copy", False, True, False, True, "h264", need, wait, link_rate),
        (1, 2, 2, "copy", False, True, False, False, "hevc", 4_000_000, 1.0, link_rate),
    ]
    req = spark.createDataFrame([(1, 2, link_rate, False, False)], "request_id int, offered int, max_bitrate bigint, no_transcode boolean, fits_only boolean")
    r = choice.choose_release(spark.createDataFrame(rows, base), req).collect()[0]
    assert (r.tier, r.release_id, r.transcoded) == want


def test_choice_refusals(spark):
    base = "request_id int, release_id int, rank int, fit string, named boolean, opens boolean, blank boolean, plays_it boolean, video string, need bigint, prebuffer double, max_bitrate bigint"
    rows = [(i, 9, 1, "copy", False, True, False, False, "hevc", 1, 1.0, None) for i in (1, 2)]
    rows.append((4, 9, 1, "copy", False, False, False, True, "h264", 1, 1.0, None))
    req = spark.createDataFrame(
        [(1, 1, None, True, False), (2, 1, None, False, True), (3, 0, None, False, False), (4, 1, None, False, False)],
        "request_id int, offered int, max_bitrate bigint, no_transcode boolean, fits_only boolean",
    )
    got = {r.request_id: r.tier for r in choice.choose_release(spark.createDataFrame(rows, base), req).collect()}
    assert got == {1: "no_copy", 2: "no_fitting_copy", 3: "no_release", 4: "no_playable_release"}


def test_ladder(spark):
    df = spark.createDataFrame([(None,), (20_000_000,), (6_600_000,), (4_000_000,), (2_000_000,), (1_500_000,)], "r bigint")
    got = [(x.l.name, x.l.bitrate) if x.l else None for x in df.select(link.bitrate_ladder(F.col("r")).alias("l")).collect()]
    assert got == [("1080p", 8_000_000), ("1080p", 8_000_000), ("1080p", 4_144_000), ("720p", 2_410_666), ("540p", 1_077_333), None]


def test_throttle_equals_the_fold(spark):
    rng = random.Random(11)
    rows = []
    for cond, gap in (("dense", 3.0), ("sparse", 90.0), ("burst", 20.0)):
        t = 0.0
        for _ in range(400):
            t += rng.expovariate(1 / gap)
            rows.append((cond, int(t * 1e6)))
            if cond == "burst" and rng.random() < 0.3:
                rows.append((cond, int(t * 1e6)))
    want = set()
    for cond in ("dense", "sparse", "burst"):
        last, held = None, 0
        for at in sorted(a for c, a in rows if c == cond):
            if last is None or at - last >= 60_000_000:
                want.add((cond, at, held))
                last, held = at, 0
            else:
                held += 1
    df = spark.createDataFrame(rows, "condition string, at bigint")
    for width in (60, 300, 3600):
        assert {tuple(r) for r in se.throttle(df, 60, width).collect()} == want


def test_cheapest(spark):
    cols = "title_id int, release_id int, listed_pos int, title string, filename string, cached boolean, three_d boolean, resolution string, size_bytes bigint"
    rows = [(1, 1, 0, "", "a.mkv", True, False, "2160p", 10), (1, 2, 1, "", "b.mkv", True, False, "1080p", 50), (1, 3, 2, "", "c.avi", True, False, "720p", 1),
            (1, 4, 3, "", "d.mkv", True, False, "720p", 20), (1, 5, 4, "", "e.mkv", None, False, "720p", 1)]
    got = rel.cheapest(spark.createDataFrame(rows, cols)).orderBy("rank").collect()
    assert [r.filename for r in got] == ["d.mkv", "b.mkv", "a.mkv"]


def test_verdicts_age(spark):
    found = spark.createDataFrame([("a", 0, 1, "x"), ("b", 1, 2, "y"), ("b", 5, 3, "z")], "key string, at bigint, id bigint, why string")
    got = se.latest_verdicts(found, now=7 * 86400).collect()
    assert [(r.key, r.why) for r in got] == [("b", "z")]


def test_end_hash(spark):
    from playlens.operators.dedupe import end_hash

    body = bytes(range(256)) * 300
    df = spark.createDataFrame([("p", len(body), bytearray(body))], "path string, length bigint, content binary")
    chunk = 65536
    words = lambda b: sum(int.from_bytes(b[i : i + 8], "little") for i in range(0, len(b), 8))
    assert end_hash(df).collect()[0].hash == f"{(len(body) + words(body[:chunk]) + words(body[-chunk:])) % 2**64:016x}"
