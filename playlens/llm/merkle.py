"""A Merkle manifest of a dataset whose parents keep SHA-256 midstates, so that a changed row is folded up to the root.

A leaf is the hash of a row's fields. Per source the leaves ascend by id and every ``ARITY`` neighbours become their hash
until one node, the subroot, is left; the subroots, ordered by source, give the root in the same way. A parent hashes its
children one after another and keeps a copy of the running hash state in front of each child slot. Folding a changed
child resumes the state of its slot with the new digest and the siblings to its right; what is to the left is in the state.

Spark numbers the leaves of a source by a range sort and the counts of its parts, and works on blocks of ``ARITY ** depth``
leaves: a block is a whole subtree, so a source of any size is dealt out and blocks of blocks need one more round per
factor of 2187. What lies above a block (left and right siblings by level) is a few hundred bytes and is sent to the block.

Rows that repeat an id stand in the order of their leaves; a null id stands first, is `-` in its leaf and counts as the
empty text where an id is hashed; a null source is a source of its own before all others, the empty source comes next.
An empty table has no rows and no root. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from playlens.llm.common import parts, store

ARITY = 3
DEPTH = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row that has ``text``: SHA-256 of its fields, each its byte count, a colon and the value, or `-` if null."""
    return F.sha2(F.concat(*[_field(text if f == "text" else F.col(f)) for f in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """Per row its id, its source as a key in byte order (null first), its leaf and, where ``changed`` is another text, that leaf."""
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(F.col("text")).alias("leaf"),
        F.when(~changed.eqNullSafe(F.col("text")), leaf_of(changed)).alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their number from 0 in their tree by ``order``, and ``n``, the rows of that tree.

    ``rows`` must be stored: the range sort reads them twice. Rows alike in all of ``order`` may change places.
    """
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    n = parts(spark, rows.count())

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, taken, part = None, 0, TaskContext.get().partitionId()
        for pdf in batches:
            if pdf.empty:
                continue
            run = pdf["tree"].ne(pdf["tree"].shift()).cumsum()
            at = pdf.groupby(run).cumcount()
            first = run == run.iloc[0]
            if pdf["tree"].iloc[0] == last:
                at = at + first * taken
            last, taken = pdf["tree"].iloc[-1], int(at.iloc[-1]) + 1
            yield pdf.assign(part=part, at=at)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, at long"
    numbered = store(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInPandas(number, schema), "numbered")
    own = Window.partitionBy("tree")
    sizes = numbered.groupBy("tree", "part").agg(F.count("*").alias("size")).select(
        "tree",
        "part",
        F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("size").over(own).alias("n"),
    )
    return numbered.join(sizes, ["tree", "part"]).withColumn("pos", F.col("before") + F.col("at")).drop("part", "at", "before", "tie")


class Run:
    """A parent: its children and the hash state in front of each of them."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[bytes]) -> None:
        self.children, self.states, state = children, [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, child: bytes) -> bytes:
        state = self.states[slot].copy()
        state.update(child)
        for right in self.children[slot + 1 :]:
            state.update(right)
        return state.hexdigest().encode()


def subtree(nodes: list[bytes], whole: bool, depth: int) -> list[list[Run]]:
    """The levels above ``nodes``: up to one node if they are a whole tree, else the levels of a block."""
    levels: list[list[Run]] = []
    while len(nodes) > 1 if whole else len(levels) < depth:
        levels.append([Run(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [r.digest for r in levels[-1]]
    return levels


def _block(pdf: pd.DataFrame, digest: str, depth: int) -> tuple[list[bytes], list[list[Run]], bytes]:
    """Nodes of a block in order, its levels and its top."""
    nodes = [d.encode() for d in pdf[digest]]
    levels = subtree(nodes, int(pdf["n"].iloc[0]) <= ARITY**depth, depth)
    return nodes, levels, levels[-1][0].digest if levels else nodes[0]


def _siblings(levels: list[list[Run]], at: int) -> Iterator[tuple[Run, int]]:
    for level in levels:
        yield level[at // ARITY], at % ARITY
        at //= ARITY


def tops(nodes: DataFrame, digest: str, depth: int) -> DataFrame:
    """One node per block of placed ``nodes`` (tree, pos, n, ``digest``): its top, placed among the tops of its tree."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = -(-int(pdf["n"].iloc[0]) // ARITY**depth)
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [n], "digest": [_block(pdf, digest, depth)[2].decode()]})

    blocks = nodes.select("tree", F.expr(f"pos div {ARITY**depth}").alias("block"), "pos", "n", digest)
    return blocks.groupBy("tree", "block").applyInPandas(run, "tree string, pos long, n long, digest string")


PATH = "path array<struct<left: string, right: string>>"


def paths(nodes: DataFrame, depth: int) -> DataFrame:
    """Per placed node (tree, pos, n, digest) its siblings to the left and right, level by level up to the last node, and that node."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        _, levels, top = _block(pdf, "digest", depth)
        own = []
        for at in range(len(pdf)):
            steps = [(b"".join(r.children[:s]).decode(), b"".join(r.children[s + 1 :]).decode()) for r, s in _siblings(levels, at)]
            own.append([{"left": left, "right": right} for left, right in steps])
        return pd.DataFrame({"tree": key[0], "block": key[1], "pos": pdf["pos"], "path": own, "top": top.decode()})

    most = nodes.agg(F.max("n")).first()[0] or 0
    blocks = nodes.select("tree", F.expr(f"pos div {ARITY**depth}").alias("block"), "pos", "n", "digest")
    own = blocks.groupBy("tree", "block").applyInPandas(run, f"tree string, block long, pos long, {PATH}, top string")
    if most <= ARITY**depth:
        return own.drop("block")
    above = paths(store(tops(nodes, "digest", depth), "tops"), depth)
    above = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("more"), F.col("top").alias("last"))
    return own.join(above, ["tree", "block"]).select("tree", "pos", F.concat("path", "more").alias("path"), F.col("last").alias("top"))


def manifest(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per block of placed leaves what is above it: (tree, block, path, subroot, root)."""
    own = store(paths(store(tops(found, "leaf", depth), "tops"), depth), "paths").withColumnRenamed("top", "subroot")
    roots = own.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("subroot").alias("digest"))
    ranked = store(placed(store(roots, "subroots"), ["source"]), "ranked")
    above = paths(ranked.drop("source"), depth).select("pos", F.col("path").alias("more"), F.col("top").alias("root"))
    above = ranked.join(above, "pos").select(F.col("source").alias("tree"), "more", "root")
    return own.join(above, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "more").alias("path"), "subroot", "root")


FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def folded(docs: DataFrame, changed: Column, depth: int = DEPTH) -> DataFrame:
    """One row per document: its leaf, the subroot of its source, the root, the hash of its proof (all siblings from the leaf
    up, left to right), the root that its proof gives for the text ``changed``, and whether that is the root."""
    found = store(placed(store(leaves(docs, changed), "leaves"), ["doc_id", "leaf", "tie"]), "placed")
    above = manifest(found, depth)

    def run(own: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        nodes, levels, _ = _block(own, "leaf", depth)
        subroot, root = path["subroot"].iloc[0], path["root"].iloc[0]
        upper = []
        for step in path["path"].iloc[0]:
            left, right = step["left"].encode(), step["right"].encode()
            upper.append((hashlib.sha256(left), right, left + right))  # the state that this slot's parent keeps
        rows = []
        for at, (doc, node, other) in enumerate(zip(own["doc_id"], nodes, own["other"], strict=True)):
            now, proof = node if other is None else other.encode(), hashlib.sha256()
            for parent, slot in _siblings(levels, at):
                now = parent.folded(slot, now)
                for i, child in enumerate(parent.children):
                    if i != slot:
                        proof.update(child)
            for state, right, both in upper:
                resumed = state.copy()
                resumed.update(now)
                resumed.update(right)
                now = resumed.hexdigest().encode()
                proof.update(both)
            rows.append((None if pd.isna(doc) else int(doc), node.decode(), subroot, root, proof.hexdigest(), now.decode(), now.decode() == root))
        got = pd.DataFrame(rows, columns=[c.split()[0] for c in FOLDED.split(", ")])
        return got.astype({"doc_id": "Int64"})

    blocks = found.withColumn("block", F.expr(f"pos div {ARITY**depth}"))
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(run, FOLDED)
