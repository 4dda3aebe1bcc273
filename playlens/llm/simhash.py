"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint is one node; copies are never paired. A fingerprint is cut into six blocks: two that differ in
at most three bits agree in three whole blocks, so nodes meet under each of the 20 choices of three. Nodes that meet
are compared by a pivot table: their Hamming distances to reference fingerprints are worked out once, and as distances
obey the triangle inequality, a pair whose coordinates differ by more than the radius anywhere is discarded without a
look at the fingerprints; the rest is verified. Within a meeting, pairs that are connected already are not compared
again, and every node is linked to the smallest of its local component: as many links as nodes, not as pairs.
Components are then joined by alternating large-star and small-star steps, with every step written to the shared folder.

The pivots cannot choose who meets by themselves: distances of random 64-bit fingerprints spread by 4 bits only, so a
tolerance of 3 lets 46 % of all pairs pass each pivot; hence the blocks in front of the table.

Texts without words (null, empty) have fingerprint zero and are linked like others. Rows that repeat a doc_id are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import parts, store, text_of

SHINGLE = 3
RADIUS = 3
SEED = 42
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TRIPLES = tuple(combinations(range(6), 3))
#: First bit and width of four parts of the three blocks that a choice leaves (33 bits at most).
PARTS = ((0, 9), (9, 8), (17, 8), (25, 8))
#: Nodes that one task compares with each other.
MOST = 8192
#: References: every other 1, 2, 4, ... bits, all bits, and nine spread by a hash.
PIVOTS = np.array([int("".join("1" if i >> b & 1 else "0" for i in range(64)), 2) for b in range(6)] + [(1 << 64) - 1, *(xxhash.xxh64_intdigest(str(i)) for i in range(9))], np.uint64)
NEAR = 16


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """A bit is set if it is in over half of the hashes."""
    if not hashes:
        return 0
    count, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65536):
        some = np.array(hashes[at : at + 65536], "<u8")
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n, bitorder="little").tobytes(), "little")


def _print_column(text: Column, size: int) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        prints = [fingerprint(shingle_hashes(t, size)) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _print_column(text_of(text_col), size).alias("fp"))


def coordinates(prints: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances to the references, one row a fingerprint."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS).astype(np.int8)


def linked(table: np.ndarray, prints: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Positions in i and j whose fingerprints are within ``radius``: the pivots first, then the bits."""
    alive = np.arange(len(i))
    for pivot in range(table.shape[1]):
        if len(alive) < 8:
            break
        alive = alive[np.abs(table[i[alive], pivot] - table[j[alive], pivot]) <= radius]
    return alive[np.bitwise_count(prints[i[alive]] ^ prints[j[alive]]) <= radius]


def forest(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of fingerprints that meet: for each the position of the first of its component."""
    n = len(prints)
    parent = np.arange(n)
    table = coordinates(prints)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)

    def settle() -> None:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]

    for step in range(1, min(n, NEAR + 1)):  # near in sorted order: most of a dense component
        i = np.arange(n - step)
        i = i[parent[i] != parent[i + step]]
        got = linked(table, prints, i, i + step, radius)
        join(i[got], i[got] + step)
        settle()
    if n > NEAR + 1:
        largest = np.bincount(parent).argmax()
        for x in np.flatnonzero(parent != largest):  # those outside the largest against all in other components
            others = np.flatnonzero(parent != parent[x])
            got = linked(table, prints, np.full(len(others), x), others, radius)
            if len(got):
                join(np.full(len(got), x), others[got])
                settle()
    return parent


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) out of rows sorted by (meeting, fp); a meeting may go over several batches."""
    rest: pd.DataFrame | None = None

    def links(meeting: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1])))
        sizes = np.diff(np.append(starts, len(meeting)))
        prints = fp.view(np.uint64)
        pair = starts[sizes == 2]
        both = prints[np.concatenate([pair, pair + 1])]
        pair = pair[linked(coordinates(both), both, np.arange(len(pair)), np.arange(len(pair)) + len(pair), RADIUS)]
        a, b = [fp[pair + 1]], [fp[pair]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = fp[at : at + n]
            first = forest(prints[at : at + n])
            moved = np.flatnonzero(first != np.arange(n))
            a.append(own[moved])
            b.append(own[first[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["meeting"].to_numpy() == pdf["meeting"].iloc[-1] if len(pdf) else np.zeros(0, bool)
        rest, done = pdf[last], pdf[~last]
        if len(done):
            yield links(done["meeting"].to_numpy(), done["fp"].to_numpy())
    if rest is not None and len(rest):
        yield links(rest["meeting"].to_numpy(), rest["fp"].to_numpy())


def _split(met: DataFrame, most: int, keys: Column) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``met`` (meeting, fp, rest) in meetings of at most ``most`` nodes, and the others, if any, under each of ``keys`` (of n too)."""
    large = store(met.groupBy("meeting").agg(F.count("*").alias("n")).filter(F.col("n") > most), "large")
    if large.isEmpty():
        return met, None
    # At most one large meeting for every ``most`` rows.
    large = F.broadcast(large)
    return met.join(large, "meeting", "left_anti"), met.join(large, "meeting").withColumn("meeting", F.explode(keys)).drop("n")


def meetings_of(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(meeting, fp): any two of ``nodes`` (fp) within the radius meet, and few more than ``most`` nodes share a meeting.

    Nodes of a larger meeting agree in three blocks and differ in at most three bits of the rest, hence agree in one of
    four parts of it, by which they meet anew. What is still too large is dealt into slices, of which any two meet.
    """
    block = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    pairs = []
    for t, (x, y, z) in enumerate(TRIPLES):
        u, v, w = (block[i] for i in range(6) if i not in (x, y, z))
        key = F.lit(t * (1 << 33)) + block[x] + F.shiftleft(block[y], 11) + F.shiftleft(block[z], 22)
        pairs.append(F.struct(key.alias("meeting"), (u + F.shiftleft(v, 11) + F.shiftleft(w, 22)).alias("rest")))
    met = nodes.select("fp", F.inline(F.array(*pairs)))
    again = F.array(*(F.xxhash64("meeting", F.lit(at), F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1))) for at, width in PARTS))
    small, met = _split(met, most, again)
    if met is None:
        return small.select("meeting", "fp")
    slices = f"CAST(ceil(2 * n / {most}) AS INT)"
    own = f"pmod(xxhash64(fp), {slices})"
    tiles = F.expr(f"transform(filter(sequence(0, {slices} - 1), j -> j <> {own}), j -> xxhash64(meeting, least(CAST(j AS BIGINT), {own}), greatest(CAST(j AS BIGINT), {own})))")
    middle, met = _split(store(met, "met-again"), most, tiles)
    return reduce(DataFrame.unionByName, [x for x in (small, middle, met) if x is not None]).select("meeting", "fp")


def links_of(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of ``nodes`` (fp) as all pairs within the radius would."""
    dealt = meetings_of(nodes, most).repartition(parts(nodes.sparkSession), "meeting").sortWithinPartitions("meeting", "fp")
    return dealt.mapInPandas(_meetings, "a long, b long").distinct()


def text_links(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(a, b): links that connect the nodes of ``texts`` (node, text) as near fingerprints would; equal ones meet at their smallest node."""
    prints = store(texts.select("node", _print_column(F.col("text"), size).alias("fp")), "prints")
    heads = store(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = prints.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    one, two = heads.toDF("a", "head_a"), heads.toDF("b", "head_b")
    near = links_of(heads.select("fp")).join(one, "a").join(two, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.unionByName(near)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a, b) reaches; nodes without links are left out."""
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = None
    while True:
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        # Large star: every larger neighbour of a node to the smallest node around it.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: every smaller neighbour, and the node itself, to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = store(small, "stars")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id in reach by links of at most three bits."""
    prints = store(fingerprints(docs, id_col, text_col, size), "prints")
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links_of(nodes))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
