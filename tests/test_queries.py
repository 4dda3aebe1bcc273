"""A cut of the registered queries beside their SQL; ``check.py`` runs every one."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries, registry

SF = "/root/testdata/sf0.001"
QUICK = (
    "plan_segments", "segment_bytes", "merge_intervals", "needed_rate", "rank_candidates", "classify_fit", "verdicts", "pick_audio",
    "siblings", "longest_shared", "plan_subtitles", "parse_cues", "cues_in_segments", "session_end", "sessionize", "rate_limit",
    "daily_quota", "concurrency", "throttle", "byte_accounting", "parse_reports", "error_kinds", "redact_paths", "media_manifests",
    "read_releases", "stream_sessions", "stream_throttle",
)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    status, n, _, _, note = check.compare(spark, registry()[name], SF, check.connect(SF))
    assert status == "ok" and n > 0, note


def test_entry_and_registry(spark):
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
    assert sum(q.sql is None for q in registry().values()) <= 3
