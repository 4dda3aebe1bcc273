import re

import corpus_pipeline as cp
from playlens.llm import decontaminate as dc, exact, packing, quality
from tests.llm.test_similar import plain as plain_similar

SF = "/root/testdata/sf0.01"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score([r.text or ""])[0] >= 0.3]
    latest = {}
    for r in rows:
        latest[lower(r.text)] = max(r.doc_id, latest.get(lower(r.text), -1))
    rows = [r for r in rows if latest[lower(r.text)] == r.doc_id]
    rows = [r for r, c in zip(rows, plain_similar([(r.doc_id, r.text) for r in rows]), strict=True) if c == r.doc_id]
    items = [dc.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in dc.normal(r.text) for i in items)]
    words = packing.Words(None)
    want = {r.doc_id: len(next(words.ids([r.text]))) // 4 for r in rows}
    pieces = cp.run(spark, SF).collect()
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want and 500 < len(want) < docs.count()


def test_odd_rows_go_through_every_stage(spark, odd):
    docs = odd.withColumn("own_sha256", odd["mark"])
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        docs = cp.store(kept, "test")
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 0
    assert cp.exact_stage(spark, odd, SF).count() == len({lower(r.text) for r in odd.collect()})
    for _, stage in cp.STAGES:
        assert stage(spark, odd.filter("false"), SF).count() == 0


def test_exact_keeps_the_largest_id(spark, odd):
    kept = {r.doc_id for r in cp.exact_stage(spark, odd, SF).collect()}
    assert {2, 4, 7} <= kept and not {1, 3} & kept
    assert exact.exact_groups(odd).count() == odd.count()
