import hashlib

import pytest
from pyspark.sql import functions as F

from playlens.llm import merkle


def changed():
    return F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, changed, at):
    """The top, the top with the node ``at`` changed, and the siblings of ``at``."""
    siblings = []
    while len(nodes) > 1:
        first = at // 3 * 3
        siblings += [n for i, n in enumerate(nodes[first : first + 3], first) if i != at]
        changed = h(*(changed if i == at else n for i, n in enumerate(nodes[first : first + 3], first)))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at //= 3
    return nodes[0], changed, siblings


def plain(rows, change):
    trees = {}
    for r in rows:
        trees.setdefault((r.source is not None, (r.source or "").encode()), []).append(r)
    tops = {}
    for key, own in trees.items():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        tops[key] = climb([leaf(r, r.text) for r in own], "", 0)[0]
    out = []
    for i, key in enumerate(sorted(trees)):
        own = trees[key]
        nodes = [leaf(r, r.text) for r in own]
        for at, r in enumerate(own):
            subroot, now, low = climb(nodes, leaf(r, change(r)), at)
            root, now, high = climb([tops[k] for k in sorted(trees)], now, i)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, h(*low, *high), now, now == root))
    return sorted(out, key=str)


def change(row):
    return row.text.upper() if row.text is not None and row.doc_id is not None and row.doc_id % 2 == 0 else row.text


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, leaf string")


ROWS = [(i, f"s{i % 3}" if i % 7 else None, "en", i, f"text {i}\n", "x", 1, "y") for i in range(200)]
ROWS += [(i, "big", None, None, f"T{i}", None, None, None) for i in range(1000, 1040)]
ROWS += [(1, "", "en", 4, None, None, None, None), (1, "", "en", 4, "", None, None, None), (5, "one", "en", 4, "é\n", None, None, None)]
ROWS += [(None, None, None, None, None, None, None, None)] * 3 + [(7, "s0", "en", 1, "again", None, None, None)] * 4 + [(8, "ü", "en", 1, "x" * 50_000, None, None, None)]


@pytest.mark.parametrize("depth", [1, 7])
def test_against_plain_trees(spark, depth):
    """Small blocks make several rounds, within sources and over sources."""
    docs = frame(spark, ROWS).repartition(5)
    got = sorted((tuple(r) for r in merkle.folded(docs, changed(), depth).collect()), key=str)
    assert got == plain(docs.collect(), change)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_lone_rows_and_no_rows(spark):
    one = merkle.folded(frame(spark, ROWS[5:6]), changed()).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h()
    assert merkle.folded(frame(spark, ROWS).filter("false"), changed()).count() == 0


def test_a_state_stands_for_what_is_to_its_left():
    run = merkle.Run([b"a" * 64, b"b" * 64, b"c" * 64])
    assert run.folded(1, b"x" * 64).decode() == h("a" * 64, "x" * 64, "c" * 64)
    assert run.folded(1, b"b" * 64) == run.digest and [s.hexdigest() for s in run.states] == [h(), h("a" * 64), h("a" * 64 + "b" * 64)]
