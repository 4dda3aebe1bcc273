import random
import re

import numpy as np
import pandas as pd
import xxhash

from playlens.llm import simhash as s


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """prints: [(id, fingerprint)]; the smallest id in reach for each row."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(prints))]


def test_fingerprints_and_components(spark, odd, none):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    base = [[word() for _ in range(400)] for _ in range(5)]
    docs = []
    for d in range(150):
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(400)] = word()
        docs.append((d, " ".join(own)))
    table = spark.createDataFrame(docs, "doc_id long, text string").union(odd.select("doc_id", "text"))
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in table.collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in s.near_duplicates(table).collect()), key=str)
    assert got == want and len({c for *_, c in want}) < 60
    assert s.near_duplicates(none).count() == 0


def test_forest_connects_what_pairs_connect():
    rnd = np.random.default_rng(3)
    for n in (2, 5, 60, 300):
        seeds = rnd.integers(0, 1 << 62, 4).astype(np.uint64)
        prints = np.unique(np.array([int(rnd.choice(seeds)) ^ sum(1 << int(b) for b in rnd.integers(0, 64, rnd.integers(0, 4))) for _ in range(n)], np.uint64))
        got = s.forest(prints)
        want = plain_components([(i, int(p)) for i, p in enumerate(prints)])
        assert got.tolist() == want


def test_meetings_go_over_batches():
    fp = np.arange(0, 40, dtype=np.int64)
    rows = pd.DataFrame({"meeting": np.zeros(40, np.int64), "fp": fp})
    got = pd.concat(s._meetings(iter([rows.iloc[:7], rows.iloc[7:8], rows.iloc[8:]])))
    assert set(got["b"]) == {0} and len(got) == 39


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in s.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100
