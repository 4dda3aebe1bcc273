import random

from playlens.llm import decontaminate as dc


def semi_global(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance():
    rnd = random.Random(4)
    for _ in range(300):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert dc.best_match(dc.masks_of(p), len(p), t)[0] == semi_global(p, t)


def test_every_match_within_the_budget_is_found(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 40)))) for i in range(12)] + [(50, None), (51, "..."), (52, "Ab")]
    docs = []
    for d in range(80):
        own = [word() for _ in range(rnd.randint(0, 60))]
        text = list(rnd.choice(items[:12])[1])
        for _ in range(rnd.randint(0, 12)):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randint(0, 1)] = rnd.choice(["x", "", "q"])
        own.insert(rnd.randint(0, len(own)), "".join(text))
        docs.append((d, (", ".join(own)).upper() if d % 2 else " ".join(own)))
    docs += [(100, None), (101, ""), (102, "b ab. c"), (102, "b ab. c")]
    want = {}
    for d, t in docs:
        own = dc.normal(t)
        for i, item in items:
            n = dc.normal(item)
            if n and own and (e := semi_global(n, own)) <= int((len(n) - 2) * 0.1):
                want[d, i] = e
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.leaks(table, bench, rate=0.1).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == want and len(rows) == len(want) + 1 and (102, 52) in want
    blocks = table.select("doc_id", dc.hits_of(bench, rate=0.1, block_chars=200).alias("hits")).collect()
    assert {(r.doc_id, h.item_id): h.edits for r in blocks for h in r.hits} == want


def test_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "the cat sat on the mat")], "item_id long, text string")
    assert {r.doc_id for r in dc.leaks(odd, bench).collect()} == {1, 2}
    assert dc.leaks(none, bench).count() == 0
    assert dc.leaks(odd, bench.filter("false")).count() == 0
