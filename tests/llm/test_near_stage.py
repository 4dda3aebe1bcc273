import random

import numpy as np

import corpus_pipeline as cp
from playlens.llm import similar, simhash as sh

SF = "/root/testdata/sf0.01"


def test_the_stage_links_near_fingerprints_too(spark):
    words = [f"w{i}" for i in range(12000)]
    base = " ".join(words)
    # Every twentieth word differs: under 0.8 alike in five words, but few bits of many shingles' majority.
    docs = [(1, base)]
    for d in range(2, 40):
        docs.append((d, " ".join(f"x{d}" if i % (9 + d) == 0 else w for i, w in enumerate(words))))
    docs.append((100, "something else entirely that nobody wrote before"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    prints = {d: sh.fingerprint(sh.shingle_hashes(t)) for d, t in docs}
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                linked += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = sh.near_duplicates(table).collect()
    assert {r.doc_id: r.component_id for r in groups} == {d: root(d) for d in prints}
    kept = {r.doc_id for r in cp.near_stage(spark, table, SF).collect()}
    # Whatever op2 links, the stage links as well.
    assert linked and all(root(d) == d for d in kept) and {1, 100} <= kept
    only = cp.similar.near_duplicates(table)
    alone = {r.doc_id for r in only.collect() if r.doc_id == r.component_id}
    assert alone - kept, "no document that only its fingerprint links"


def test_no_step_holds_two_python_workers_a_task(spark, monkeypatch):
    plans = {}

    def recorded(module):
        inner = module.store

        def store(df, purpose):
            plans.setdefault(purpose, []).append(df._jdf.queryExecution().executedPlan().toString())
            return inner(df, purpose)

        monkeypatch.setattr(module, "store", store)

    recorded(cp.similar)
    recorded(sh)
    text = " ".join(f"w{i}" for i in range(200))
    table = spark.createDataFrame([(1, text), (2, text + " more"), (3, "three other words")], "doc_id long, text string")
    assert {r.doc_id for r in cp.near_stage(spark, table, SF).collect()} == {1, 3}
    python = {p: max(x.count("ArrowEvalPython") + x.count("MapInPandas") for x in own) for p, own in plans.items()}
    # A worker that is started stays, with its memory, as long as the executor is busy.
    assert {"profiles", "shingles", "prints"} <= {p for p, n in python.items() if n == 1} and max(python.values()) == 1, python


def test_steps_with_nothing_left_to_do_are_not_run(spark, monkeypatch):
    """Each stored table is a few jobs, whose threads and plans take the driver's memory however small the table."""
    stored = []

    def recorded(module):
        inner = module.store

        def store(df, purpose):
            stored.append(purpose)
            return inner(df, purpose)

        monkeypatch.setattr(module, "store", store)

    recorded(cp.similar)
    recorded(sh)
    text = " ".join(f"w{i}" for i in range(200))
    table = spark.createDataFrame([(1, text), (2, text + " more"), (3, "three other words"), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in cp.near_stage(spark, table, SF).collect()} == {1, 3, 4}
    assert not {"members", "prefixes", "met-again"} & set(stored) and stored.count("similar") == 1 and len(stored) <= 17, stored
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stored.clear()
    assert cp.near_stage(spark, docs, SF).count() and len(stored) <= 27, stored  # 36 tables before


def test_pairs_of_few_and_of_many_bits_are_parted(spark):
    rnd = random.Random(4)
    own, docs = [f"w{i}" for i in range(100)], []
    for _ in range(30):
        docs.append(" ".join(own))
        own[rnd.randrange(100)] = f"x{rnd.random()}"
    table = spark.createDataFrame([(int(np.uint64(similar.node_of(t)).view(np.int64)), t) for t in docs], "node long, text string")
    members = table.select("text").mapInPandas(similar._profiles, "node long, size int, keys array<long>, bits array<long>").selectExpr("node", "size", "node AS root", "bits")
    first = similar.prefixes(members, table.mapInPandas(similar._sets, "node long, own binary"))
    pairs = [{(r.a, r.b) for r in similar.candidates(first, **bits).collect()} for bits in ({}, {"most": similar.CLOSE_BITS}, {"least": similar.CLOSE_BITS + 1})]
    # No pair that was verified among the close ones is verified again.
    assert pairs[1] and pairs[2] and not pairs[1] & pairs[2] and pairs[1] | pairs[2] == pairs[0]
