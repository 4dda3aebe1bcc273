"""Plans that must not move what grows: no packed table broadcast, no pair of a request and a release shuffled."""

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["pick_audio", "delivered_bytes", "audio_plan", "verdicts", "player_takes", "dolby_vision_picture", "signal_range", "release_verdicts"])
def test_requests_meet_releases_last(spark, name):
    logical, physical = plan(spark, name)
    # The join by title is the outermost one, and no side of a request's joins is broadcast by an estimate.
    joins = [line for line in logical.splitlines() if re.search(r"\bJoin \w", line)]
    assert "title_id" in joins[0], joins[0]
    assert "BroadcastHashJoin [title_id" not in physical and "BroadcastHashJoin [owner" not in physical
    assert "BroadcastHashJoin [release_id" not in physical


def test_sequences_travel_as_one_number_a_point(spark):
    from playlens.operators import passages as pa

    points = spark.range(40).selectExpr("id % 2 AS seq_id", "id AS pos", "4294967295 - id AS point")
    pairs = spark.createDataFrame([(1, 0, 1)], "pair_id long, a long, b long")
    paired = pa._paired(pairs, points)
    assert {f.name: f.dataType.simpleString() for f in paired.schema if f.name.startswith("s_")} == {"s_a": "array<bigint>", "s_b": "array<bigint>"}
    assert not [x for x in paired.columns if x.startswith("po")]
    row = paired.first()
    assert [x >> 32 for x in row.s_a] == list(range(0, 40, 2)) and [x & 0xFFFFFFFF for x in row.s_a] == [2**32 - 1 - i for i in range(0, 40, 2)]


def test_clients_reports_are_parsed_once(spark):
    logical, _ = plan(spark, "stats_by_client")
    assert "event_id" not in logical, "the plan after the stored columns reads bodies again"


def test_quantiles_come_to_their_totals(spark):
    from playlens.operators.quantiles import with_quantiles

    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "g string, x double")
    found = with_quantiles(rows.groupBy("g").count(), rows, ["g"], ["x"], {"p50": 0.5})
    assert {(r.g, r["count"], r.x_p50) for r in found.collect()} == {("a", 2, 1.0), ("b", 1, None), (None, 1, 2.0)}
    # The rows are met by the totals only; what was narrowed stands by itself.
    assert len(re.findall(r"\bJoin \w", found._jdf.queryExecution().optimizedPlan().toString())) == 1


@pytest.mark.parametrize("name, key, n", [("validate_media", "release_id", 7), ("retained_gops", "title", 3), ("ready_segments", "coalesce(title", 1)])
def test_small_sides_are_hashed_where_they_lie(spark, name, key, n):
    # Every merge of these would sort all rows of a task once more, and keep them.
    _, physical = plan(spark, name)
    assert physical.count(f"ShuffledHashJoin [{key}") >= n, physical
    assert name != "validate_media" or "SortMergeJoin [release_id" not in physical


def test_the_window_of_kept_gops_ends_with_its_title(spark):
    from playlens.operators import timeline as tl

    segs = spark.createDataFrame([(t, n, 6.0 * n, 6.0 * n + 6) for t in (1, 2) for n in range(4 if t == 1 else 20)], "title long, n long, start double, end double")
    gops = spark.createDataFrame([(t, j, float(s), 1.0) for t in (1, 2, 3) for j, s in ((0, 0), (0, 13), (0, 40), (1, 80), (2, 90))], "title long, job long, start double, dur double")
    wants = spark.createDataFrame([(1, 3, 2), (2, 3, 2)], "title long, n long, current_job long")
    kept = {(r.title, r.start): r.kept for r in tl.retained(gops, segs, wants).collect()}
    assert [kept[1, s] for s in (0.0, 13.0, 40.0, 80.0, 90.0)] == [False, True, False, False, True]
    assert [kept[2, s] for s in (0.0, 13.0, 40.0, 80.0, 90.0)] == [False, True, True, False, True]
    assert all(kept[3, s] for s in (0.0, 13.0, 40.0, 80.0, 90.0))


def test_candidates_are_ranked_when_they_are_narrow(spark, monkeypatch):
    from playlens.plans import releases as plans

    kept, limits = [], []

    def stored(df, purpose):
        limits.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))
        kept.append(df)
        return df

    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    monkeypatch.setattr(plans, "stored", stored)
    plans.chosen(spark, SF)
    # A request's candidates are sorted once, without tracks, probes or capabilities, by methods that the JVM compiles.
    nodes, windows = [kept[0]._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        nodes += below
        if node.nodeName() == "Window" and "request_id" in node.partitionSpec().toString():
            windows.append(below[0].output().toString())
    assert len(windows) == 1 and "rank" not in windows[0] and not re.search("picks|probe|vp9|named_profile|__leads", windows[0]), windows
    assert limits == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_sizes_of_a_shape_are_costed_together(spark):
    from playlens.operators import link

    starts, sizes = [0.0, 6.0, 12.0, 18.0, 24.0], [9e6, 1e6, 4e6, 8e6, 2e6]
    segs = spark.createDataFrame([(1, i, s, s + 6, b) for i, (s, b) in enumerate(zip(starts, sizes))], "title long, n long, start double, end double, bytes double")
    rows = [(1, first, 12.0, cap, size, rate) for first in (0, 2) for cap in (None, 500_000) for size in (None, 6e6, 24e6, 90e6) for rate in (None, 1e6, 9e6, 4e7)]
    asked = spark.createDataFrame(rows, "title long, first long, buffer_secs double, buffer_bytes long, size double, rate double")
    got = link.link_rates(asked, segs)
    # One row of terms for each (first, buffer), whatever the sizes.
    assert re.search(r"Aggregate \[[^\]]*\], \[[^\n]*collect_list\(size", got._jdf.queryExecution().optimizedPlan().toString())
    for r in got.collect():
        f = 1.0 if r.size is None else r.size / sum(sizes)
        t, bits = starts[r.first :], [8 * b * f for b in sizes[r.first :]]
        runs = [(j, k, sum(bits[j : k + 1])) for j in range(len(t)) for k in range(j, len(t))]
        stretch = max(b / (12 + t[k] - t[j]) for j, k, b in runs)
        if r.buffer_bytes is not None:
            stretch = max([stretch] + [(b - 8.0 * r.buffer_bytes) / (t[k] - t[j]) for j, k, b in runs if k > j])
        opening = max(sum(bits[: k + 1]) / (10 + t[k] - t[0]) for k in range(len(t)))
        assert r.stretch_rate == pytest.approx(stretch, rel=1e-12) and r.needed_rate == pytest.approx(max(stretch, opening), rel=1e-12)
        wait = max(sum(bits[: k + 1]) / r.rate - (t[k] - t[0]) for k in range(len(t))) if r.rate and stretch <= r.rate else None
        assert (r.startup_delay is None) if wait is None else r.startup_delay == pytest.approx(max(wait, 0.0), rel=1e-12)


def test_only_requests_with_a_reason_are_chosen_for(spark, monkeypatch):
    import check
    from __spark_entry__ import registry
    from playlens.plans import releases as plans

    kept, real = {}, plans.stored

    def stored(df, purpose):
        kept[purpose] = real(df, purpose)
        return kept[purpose]

    monkeypatch.setattr(plans, "stored", stored)
    status, n, _, _, note = check.compare(spark, registry()["requested_vs_served"], SF, check.connect(SF))
    assert status == "ok" and n > 0, note
    weighed = {r.request_id for r in kept["candidates"].select("request_id").distinct().collect()}
    assert weighed and weighed <= {r.request_id for r in kept["reasons"].collect()}


def test_pictures_are_hashed_to_the_chosen(spark, monkeypatch):
    from playlens.plans import releases as plans

    some = spark.createDataFrame([(1, 0, True, "720p"), (2, 3, False, None), (3, None, False, None)], "request_id long, release_id long, transcoded boolean, preset string")
    monkeypatch.setattr(plans, "chosen", lambda spark, sf: some)
    got = plans.delivered_picture(spark, SF)
    physical = got._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [release_id" in physical and "SortMergeJoin [release_id" not in physical and "p_name" not in physical.split("ShuffledHashJoin")[1].split("Relation")[0]
    assert {r.request_id for r in got.collect()} == {1, 2}
