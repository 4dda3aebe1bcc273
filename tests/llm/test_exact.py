import hashlib
import random

from playlens.llm import exact


def test_filter_inserts_deletes_and_grows():
    rnd = random.Random(1)
    index, live = exact.CuckooIndex(buckets=2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(12000):
        key = rnd.choice(keys)
        if rnd.random() < 0.4:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            index.add(key, step)
            live[key] = max(step, live.get(key, 0))
        if step % 1000 == 0:
            assert {k: v[0] for k, v in index.content.items()} == live
            assert all(index.may_hold(k) for k in live)
    assert index.resizes > 3 and sum(m > 0 for m in index.marks) == len(live)


def test_groups(odd, none):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == odd.count()
    one = {r.doc_id: r for r in rows}
    assert (one[1].keep_id, one[1].kept, one[2].kept, one[1].group_size) == (2, False, True, 2)
    assert one[3].keep_id == one[4].keep_id == 4 and one[3].group_size == 3
    assert sum(r.kept for r in rows if r.doc_id == 7) == 2
    assert one[4].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact.exact_groups(none).count() == 0


def test_index_updates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c")], "doc_id long, text string")
    found = exact.digests(docs)
    index = exact.live_index(found)
    gone = exact.digests(docs.filter("doc_id >= 2 AND doc_id <= 3"))
    fresh = exact.digests(spark.createDataFrame([(9, "c"), (8, "d"), (7, "B")], "doc_id long, text string"))
    got = sorted((r.keep_id, r.group_size) for r in exact.update_index(index, fresh, gone).collect())
    assert got == [(7, 1), (8, 1), (9, 2)]  # a is gone, b is new again, c has grown, d is new
