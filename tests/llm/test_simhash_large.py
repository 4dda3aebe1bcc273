import random

from playlens.llm import simhash as s
from tests.llm.test_simhash import plain_components


def test_large_meetings_are_split_without_losing_links(spark):
    rnd = random.Random(11)
    spread = {rnd.getrandbits(31) << 33 for _ in range(200)}  # agree in three blocks
    close = {(rnd.getrandbits(12) << 52) + 5 for _ in range(300)}  # agree in most parts of the rest too
    linked = {f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))) for f in list(spread)[:60]}
    prints = sorted(f - (1 << 64) if f >> 63 else f for f in spread | close | linked)
    nodes = spark.createDataFrame([(f,) for f in prints], "fp long")
    sizes = s.meetings_of(nodes, 40).groupBy("meeting").count().agg({"count": "max"}).first()[0]
    assert sizes <= 80  # two slices of about 20; over 200 before
    got = {r.node: r.root for r in s.components(s.links_of(nodes, 40)).collect()}
    assert [got.get(f, f) for f in prints] == plain_components([(f, f & (1 << 64) - 1) for f in prints])
