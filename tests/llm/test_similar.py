import random

import numpy as np

import corpus_pipeline as cp
from playlens.llm import similar as s

SF = "/root/testdata/sf0.01"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain(rows):
    """The smallest id in reach of each row by pairs of five-word similarity 0.8."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


def test_components_of_similar_texts(spark, odd, none):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(4)]
    docs = []
    for d in range(160):  # up to four changes: similarities on both sides of 0.8, and chains
        own = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(120)] = word()
        docs.append((d + 100, " ".join(own)))
    table = spark.createDataFrame(docs, "doc_id long, text string").union(odd.select("doc_id", "text")).repartition(3)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = sorted(zip((d for d, _ in rows), plain(rows), strict=True), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in s.near_duplicates(table).collect()), key=str) == want
    assert s.near_duplicates(none).count() == 0


def test_the_stage_drops_similar_documents_of_many_different_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for (d, _), c in zip(rows, plain(rows), strict=True) if d == c}
    assert {r.doc_id for r in cp.near_stage(spark, docs, SF).collect()} == want and not {770, 875, 914, 944, 991} & want


def signed(text):
    return int(np.uint64(s.node_of(text)).view(np.int64))


def family(n, rnd):
    """Texts of one template: two of them share 85 % of their words' shingles at most, a similarity of 0.73."""
    template = [f"t{i}" for i in range(170)]
    return [" ".join(template + [f"{rnd.random()}" for _ in range(30)]) for _ in range(n)]


def test_texts_of_one_template_are_not_compared_all_with_all(spark):
    docs = spark.createDataFrame([(signed(t), t) for t in family(400, random.Random(3))], "node long, text string")
    nodes = docs.select("text").mapInPandas(s._profiles, "node long, size int, keys array<long>, bits array<long>")
    sets = docs.mapInPandas(s._sets, "node long, own binary")
    members = nodes.selectExpr("node", "size", "node AS root", "bits")
    assert s.candidates(s.prefixes(members, sets)).count() <= 400
    assert s.links_of(docs).count() == 0


def test_prefixes_lose_no_pair(spark):
    """Words of a small alphabet: shingles are shared at random, and every similar pair must be a candidate."""
    rnd, docs = random.Random(9), []
    for _ in range(12):
        own = [rnd.choice("abc") for _ in range(rnd.randint(3, 90))]
        for _ in range(8):
            docs.append(" ".join(own))
            own[rnd.randrange(len(own))] = rnd.choice("abcd")
    docs = sorted(set(docs))
    table = spark.createDataFrame([(signed(t), t) for t in docs], "node long, text string")
    members = table.select("text").mapInPandas(s._profiles, "node long, size int, keys array<long>, bits array<long>").selectExpr("node", "size", "node AS root", "bits")
    got = {frozenset((r.a, r.b)) for r in s.candidates(s.prefixes(members, table.mapInPandas(s._sets, "node long, own binary"))).collect()}
    sets = {signed(t): grams(t) for t in docs}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert want and want <= got
