import random
import zlib

import numpy as np

from playlens.llm import quality as q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in q.scored(docs, q.train(docs, labels)).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    test = [(r.quality, rows[r.doc_id].score) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for y, s in test if y], [s for y, s in test if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.6


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rnd = random.Random(1)
    rows = [(d, " ".join(rnd.choice(["the cat.", "HEY!!", "a | b"]) for _ in range(20))) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fair = [(d, d % 2) for d, _ in rows]
    turned = [(d, y if zlib.crc32(str(d).encode()) % 5 else 1 - y) for d, y in fair]
    one, two = (q.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (fair, turned))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = q.train(odd, labels)
    rows = q.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert {r.score for r in q.scored(odd, q.train(odd, labels.filter("false"))).collect()} == {0.5}
    assert q.scored(none, q.train(none, labels)).count() == 0
