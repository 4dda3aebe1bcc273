import collections
import hashlib
import random

import numpy as np

from playlens.llm import repeats


def brute(rows, length):
    count = collections.Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raws:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_backward_extension():
    rnd = random.Random(3)
    for length in (1, 5, 8):
        for _ in range(80):
            text = np.array([rnd.randint(0, 2) for _ in range(rnd.randint(length, 200))], np.int64)
            seen = collections.Counter(tuple(text[i : i + length]) for i in range(len(text) - length + 1))
            got = repeats.repeated_suffixes(text, length)
            assert all(got[i] == (seen[tuple(text[i : i + length])] > 1) for i in range(len(text) - length + 1))


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def test_whole_texts(spark, odd, none):
    rnd = random.Random(5)
    base = [words(rnd, 300) for _ in range(8)]
    rows = []
    for i in range(60):
        b, k = rnd.choice(base), rnd.random()
        j = rnd.randrange(len(b) - 700)
        text = b if k < 0.3 else b[:j] + "XYZ é" + b[j + rnd.randint(0, 9) :] if k < 0.6 else words(rnd, 50) + b[j : j + rnd.randint(390, 700)] + words(rnd, 40) if k < 0.8 else "ab " * rnd.randint(50, 400)
        rows.append((i + 100, text))
    table = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    want = brute([(r.doc_id, r.text) for r in table.collect()], 400)
    for group in (repeats.GROUP, 3):  # 3: nearly every group is cut into cells first
        assert sorted((tuple(r) for r in repeats.without_repeats(table, group=group).collect()), key=str) == want
    assert repeats.without_repeats(none).count() == 0


def test_hot_passage_between_different_neighbours(spark):
    rnd = random.Random(6)
    hot = words(rnd, 120)[:600]
    rows = [(i, words(rnd, rnd.randint(1, 60)) + hot + words(rnd, rnd.randint(1, 60))) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in repeats.without_repeats(table, group=10).collect()), key=str) == brute(rows, 400)


def test_many_rows_of_one_id(spark):
    """Rows are told apart by their texts, so a repeated id, a null one too, gives nobody the segments of another row."""
    rnd = random.Random(8)
    passage = words(rnd, 300)
    for doc in (7, None):
        rows = [(doc, words(rnd, rnd.randint(0, 200)) + passage[: rnd.choice([300, 700, 1100])] + words(rnd, 30)) for _ in range(60)] + [(doc, "short"), (doc, None)] * 3
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted((tuple(r) for r in repeats.without_repeats(table).collect()), key=str) == brute(rows, 400)
