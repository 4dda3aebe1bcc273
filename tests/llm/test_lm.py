import collections
import math
import re
import zlib

import numpy as np
import pytest

from playlens.llm import ngram_lm as lm


def test_packed_integers():
    for a in (np.zeros(0, np.uint64), np.array([0, 1 << 63, 7], np.uint64)):
        assert lm._expand(lm._squeeze(a), np.uint64).tolist() == a.tolist()


def base(rows):
    tokens = [(d, re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None], zlib.crc32(str("" if d is None else d).encode()) % 7 == 2) for d, t in rows]
    count = collections.Counter(w for _, ws, out in tokens if not out for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((d, out, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws, out in tokens), key=str)


def test_base_and_model(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = lm.scores(docs, block_tokens=5000, bucket_keys=3000).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base([(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the mixture beats add-one on held-out text
    # Neither blocks nor buckets change a score.
    again = {(r.doc_id, r.n_tokens, r.score) for r in lm.scores(docs).collect()}
    assert sorted(x[2] for x in again) == pytest.approx(sorted({(r.doc_id, r.n_tokens, r.score): r.score for r in got}.values()))
    assert lm.scores(none).count() == 0


def test_the_mixture_is_a_distribution(spark):
    """Over all known words and one unknown, probabilities behind a context sum to one."""
    docs = spark.createDataFrame([(i, "a b c a b d" if i % 2 else "a c b") for i in range(200)], "doc_id long, text string")
    words = ["a", "b", "c", "d", "zzz"]
    probe = [(10_000 + i, f"a {w}") for i, w in enumerate(words)] + [(20_000, "a")]
    # Ids whose remainder is 2 teach nothing; take such ids for the probes.
    free = [d for d in range(30_000, 90_000) if zlib.crc32(str(d).encode()) % 7 == 2][: len(probe)]
    table = docs.union(spark.createDataFrame([(d, t) for d, (_, t) in zip(free, probe, strict=True)], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.scores(table).collect()}
    full = [10 ** got[d] for d in free[:5]]
    assert 0 < sum(full) <= 1 and min(full) > 0 and full[1] > full[4]


def test_nothing_to_train_on(spark):
    out = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    rows = lm.scores(spark.createDataFrame([(d, "a b") for d in out], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)] * 3
