"""Probes judged in their rows, and files hashed where they lie."""

import os

from pyspark.sql import functions as F

from playlens.operators import dedupe as dd, releases as rel
from playlens.session import shared_dir
from playlens.sources import readers as rd, writers as wr
from playlens.sources.files import located


def plain_hash(b):
    if len(b) < dd.HASH_CHUNK:
        return None
    ends = (b[: dd.HASH_CHUNK], b[-dd.HASH_CHUNK :])
    words = sum(int.from_bytes(e[i : i + 8], "little") for e in ends for i in range(0, len(e), 8))
    return f"{(len(b) + words) % 2**64:016x}"


def test_files_are_hashed_by_their_ends(spark):
    k = dd.HASH_CHUNK
    contents = {"empty": b"", "short": b"abc", "again": b"abc", "under": os.urandom(k - 1), "one": os.urandom(k), "odd": os.urandom(k + 5), "long": os.urandom(5 * k + 3)}
    middle = bytearray(contents["long"])
    middle[2 * k] ^= 255  # neither end has it
    contents["same ends"] = bytes(middle)
    path = shared_dir(spark, "files")
    assert located("file:/a b%20/c")[1] == located("file:///a b%20/c")[1] == located("/a b%20/c")[1] == "/a b%20/c"
    rows = spark.createDataFrame([(n, bytearray(b), 1) for n, b in contents.items()], "name string, content binary, length int")
    wr.write_files(rows, path)
    wr.write_files(rows, path)  # a task that runs again
    listed = rd.list_files(spark, path)
    assert listed.columns == ["path", "length"]
    got = {os.path.basename(r.path): r for r in dd.end_hash_of_files(listed).collect()}
    assert {n: r.length for n, r in got.items()} == {n: len(b) for n, b in contents.items() if b}
    del contents["empty"]
    for name, b in contents.items():
        assert plain_hash(b) is None or got[name].hash == plain_hash(b)
    whole = spark.read.format("binaryFile").load(path)
    assert {r.path: r.hash for r in dd.end_hash(whole).collect()} == {r.path: r.hash for r in got.values()}
    empty = spark.createDataFrame([(f"{path}/empty",)], "path string")
    assert [(r.length, r.hash) for r in dd.end_hash_of_files(empty).collect()] == [(0, None)]
    assert got["short"].hash == got["again"].hash and got["long"].hash == got["same ends"].hash


def test_nested_probes_break_the_rules_of_flat_ones(spark):
    nan, long = float("nan"), "x" * 257
    cases = [
        ("fine", 100.0, 25.0, [0.0, 5.0, 101.0], [(0.0, 10), (5.0, 10)], [("ac-3", "eng", None, 64)], [("srt", "eng")]),
        ("nothing", 100.0, None, [], [], [], []),
        ("late", 100.0, 25.0, [0.0, 101.5], [(102.0, 1)], [], []),
        ("before", 100.0, 25.0, [-1.0], [(nan, 1)], [], []),
        ("falling", 100.0, 1001.0, [5.0, 4.0], [(1.0, 5), (2.0, 4)], [("ac-3", long, None, 2)], [("srt", None)]),
        ("tracks", 8 * 86400.0, nan, [1.0], [(2.0, 1), (1.0, 2)], [("a", "b", "c", 65)] + [("a", "b", "c", 2)] * 128, [(long, "x")]),
        ("one", 3.0, 0.0, [3.0], [(3.0, 3)], [(None, None, None, None)], [(None, None)]),
    ]
    schema = """release_id string, duration double, frame_rate double, keyframes array<double>, byte_index array<struct<t double, pos bigint>>,
        audio array<struct<codec string, language string, name string, channels int>>, subs array<struct<codec string, language string>>"""
    flat = {"container": F.lit("mp4"), "width": F.lit(10), "height": F.lit(10), "codecs": F.lit("avc1"), "video": F.lit("h264")}
    rows = spark.createDataFrame(cases, schema).withColumns(flat).withColumns({c: F.lit(None).cast("int") for c in ("dv_profile", "dv_compat", "dv_level")})
    series = rows.select("release_id", F.posexplode("byte_index").alias("i", "x")).select("release_id", "i", "x.t", "x.pos")
    keyframes = rows.select("release_id", F.posexplode("keyframes").alias("i", "t"))
    tracks = [rows.select("release_id", F.inline(c)) for c in ("audio", "subs")]
    want = {r.release_id: r.failed for r in rel.validate_media(rows, keyframes, series, *tracks).collect()}
    got = {r.release_id: r.failed for r in rel.validate_nested(rows).collect()}
    assert got == want and want["fine"] == want["nothing"] == want["one"] == [] and all(want[k] for k in ("late", "before", "falling", "tracks"))
    nulls = rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("keyframes", "byte_index", "audio", "subs")}).where("duration = 3")
    assert [r.failed for r in rel.validate_nested(nulls).collect()] == [[]]


def test_written_files_need_no_listing(spark):
    contents = {"empty": b"", "short": b"abc", "again": b"abc", "long": os.urandom(3 * dd.HASH_CHUNK + 1)}
    path = shared_dir(spark, "files")
    written = wr.write_files(spark.createDataFrame([(n, bytearray(b)) for n, b in contents.items()], "name string, content binary"), path)
    assert {(r.path, r.length) for r in written.collect()} == {(f"{path}/{n}", len(b)) for n, b in contents.items()}
    listed = {os.path.basename(r.path): r.hash for r in dd.end_hash_of_files(rd.list_files(spark, path)).collect()}
    assert {os.path.basename(r.path): r.hash for r in dd.end_hash_of_files(written).collect()} == listed | {"empty": None}


def test_stored_texts_are_not_listed_by_the_driver(spark):
    from __spark_entry__ import queries

    found = queries()["end_hash_duplicates"](spark, "/root/testdata/sf0.001")
    assert "binaryFile" not in found._jdf.queryExecution().toString()
