"""Near-duplicates by similarity: texts that share at least four fifths of their distinct five-word shingles.

Three bits of a SimHash miss most of such pairs, and a radius that covers them would let blocks of three bits choose who
meets. Candidates are drawn by minima instead: for each of 200 hash functions two texts of similarity s have the same
smallest hash with probability s. Forty keys of five minima each make texts meet; a pair of similarity 0.8 meets nowhere
with probability (1 - 0.8^5)^40 = 1.3e-7, one that is more alike still less. Every link is verified by the exact Jaccard
similarity of the shingle sets.

In each meeting all texts are compared with the smallest node, if 192 single bits of the minima don't speak against the
similarity (six standard deviations): each text first with the one it meets most often so, then those that are still in
different components. Where a meeting stays parted, its texts are joined by prefixes: a text's shingles are put in one order,
rare ones first, and of two texts that are similar enough the smaller has one of its first ninth in common with the other's
first fifth. So texts of one template, alike but not enough, meet by their own parts only, not all with all, and nothing is
lost. Pairs of different components that meet there are verified too, those with few different bits first, as what they
connect needs no other pair. A step that has nothing left to do is not run: on small tables the driver's memory is taken by
the threads and plans of jobs, not by rows.
Texts are one node if their words are the same. Texts without words are one node, and rows that repeat a doc_id are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import store, text_of
from playlens.llm.simhash import SEED, components, shingle_hashes

SHINGLE = 5
#: The least similarity, as a fraction.
SHARE = (4, 5)
BANDS, ROWS = 40, 5
_RANDOM = np.array([xxhash.xxh64_intdigest(f"minimum {i}") for i in range(2 * BANDS * ROWS)], np.uint64)
_XOR, _TIMES = _RANDOM[: BANDS * ROWS], _RANDOM[BANDS * ROWS :] | np.uint64(1)
BITS = 192
#: At similarity 0.8 a tenth of the bits differs, 19.2 on average with a deviation of 4.2.
MOST_BITS = 44
CLOSE_BITS = 20
STEP = 2048


def node_of(text: str) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "replace").lower().split()), SEED)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each hash function."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[at : at + STEP, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return least


def keys_of(least: np.ndarray) -> list[int]:
    data, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def bits_of(least: np.ndarray) -> list[int]:
    return np.packbits((least[:BITS] >> np.uint64(7) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least SHARE; two empty sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * SHARE[1] >= (len(a) + len(b) - common) * SHARE[0]


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            own = shingle_set(text)
            least = minima(own)
            rows.append((np.uint64(node_of(text)).view(np.int64), len(own), keys_of(least), bits_of(least)))
        yield pd.DataFrame(rows, columns=["node", "size", "keys", "bits"])


def _node_column(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([node_of(t) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(text)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "own": [shingle_set(t).tobytes() for t in pdf["text"]]})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
        yield pdf.loc[np.array(good, bool), ["a", "b"]]


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for node, own in zip(pdf["node"], pdf["own"], strict=True):
            yield pd.DataFrame({"node": node, "shingle": np.frombuffer(own, np.int64)})


def by_prefix(sets: DataFrame) -> DataFrame:
    """(shingle, node, at): the rare first fifth of each set of ``sets`` (node, own), without shingles that no other set has.

    ``at`` is the place in the order, of all the set's shingles. A set is at most a text, so is what one node collects.
    """
    rows = store(sets.mapInPandas(_exploded, "node long, shingle long"), "exploded")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    shared = rows.join(counts.filter("n > 1"), "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("own"))
    sizes = sets.select("node", (F.octet_length("own") / 8).cast("int").alias("size"))
    alone = F.col("size") - F.size("own")
    most = F.floor(F.col("size") * (SHARE[1] - SHARE[0]) / SHARE[1]).cast("int") + 1 - alone
    first = shared.join(sizes, "node").filter(most > 0).select("node", alone.alias("alone"), F.posexplode(F.slice("own", 1, most)).alias("k", "one"))
    return first.select(F.col("one.shingle").alias("shingle"), "node", (F.col("alone") + F.col("k")).alias("at"))


def prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The prefix rows of ``members`` (node, size, root, bits), with their columns."""
    return store(by_prefix(sets.join(members.select("node"), "node", "left_semi")).join(members, "node"), "prefixes")


def candidates(first: DataFrame, most: int = MOST_BITS, least: int = 0) -> DataFrame:
    """(a, b): pairs of prefix rows with different roots that may be similar and differ in ``least`` to ``most`` bits."""
    differ = " + ".join(f"bit_count(o.bits[{i}] ^ m.bits[{i}])" for i in range(BITS // 64))
    # The first shingle that two sets share has at least their common ones from there on, in both: 4/9 of both sizes together,
    # so 8/9 of the smaller size; the smaller set of a pair (o) meets by its first ninth only.
    both = SHARE[0] + SHARE[1]
    short = first.filter((F.col("size") - F.col("at")) * both >= F.col("size") * 2 * SHARE[0])
    may = f"""o.shingle = m.shingle AND o.root <> m.root AND (o.size < m.size OR (o.size = m.size AND o.node < m.node))
        AND o.size * {SHARE[1]} >= m.size * {SHARE[0]}
        AND least(o.size - o.at, m.size - m.at) * {both} >= (o.size + m.size) * {SHARE[0]} AND {differ} BETWEEN {least} AND {most}"""
    met = short.alias("o").join(first.alias("m"), F.expr(may))
    return met.select(F.greatest("o.node", "m.node").alias("a"), F.least("o.node", "m.node").alias("b")).distinct()


def links_of(texts: DataFrame) -> DataFrame:
    """(a, b): links that connect the nodes of ``texts`` (node, text) as all similar pairs would."""
    nodes = store(texts.select("text").mapInPandas(_profiles, "node long, size int, keys array<long>, bits array<long>").dropDuplicates(["node"]), "profiles")
    met = nodes.select("node", F.explode("keys").alias("meeting"))
    heads = met.groupBy("meeting").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = store(met.join(heads, "meeting"), "meetings")
    wanted = shared.select("node").distinct()
    slim = store(nodes.join(wanted, "node", "left_semi").select("node", "size", "bits"), "met")
    sets = store(texts.join(wanted, "node", "left_semi").mapInPandas(_sets, "node long, own binary"), "shingles")

    one, two = slim.toDF("a", "size", "bits"), slim.toDF("b", "other_size", "other_bits")
    differ = " + ".join(f"bit_count(bits[{i}] ^ other_bits[{i}])" for i in range(BITS // 64))
    near = f"least(size, other_size) * {SHARE[1]} >= greatest(size, other_size) * {SHARE[0]} AND {differ} <= {MOST_BITS}"

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("own").alias("x")), sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
        return store(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(_verified, "a long, b long"), "similar")

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(two, "b").filter(near).select("a", "b")

    def parted(found: DataFrame) -> DataFrame:
        """The rows of ``shared`` whose node and head are in two components of ``found``."""
        # A head is the smallest of its meeting, but maybe not of its component.
        tops = found.select(F.col("node").alias("head"), F.col("root").alias("top"))
        both = shared.join(tops, "head", "left").join(found, "node", "left")
        return store(both.filter(F.coalesce("root", "node") != F.coalesce("top", "head")).select("meeting", "node", "head"), "parted")

    met = shared.filter("node <> head").groupBy("node", "head").agg(F.count("*").alias("n"))
    links = verified(likely(met.groupBy(F.col("node").alias("a")).agg(F.max_by("head", F.struct("n", "head")).alias("b"))))
    found = components(links)
    left = parted(found)
    # Each step that finds nothing new, or nothing that is still parted, spares those after it.
    if left.isEmpty():
        return links
    pairs = left.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    new = verified(likely(pairs))
    if not new.isEmpty():
        links = links.unionByName(new)
        found = components(links)
        left = parted(found)
    rooted = slim.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_nodes = shared.join(left.select("meeting").distinct(), "meeting", "left_semi").select("node").distinct()
    members = store(rooted.join(open_nodes, "node", "left_semi"), "members")
    first = prefixes(members, sets)
    # Pairs that are most likely similar first: what they connect needs no other pair.
    new = verified(candidates(first, CLOSE_BITS))
    if not new.isEmpty():
        links = links.unionByName(new)
        first = first.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return links.unionByName(verified(candidates(first, least=CLOSE_BITS + 1)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, component_id: the smallest doc_id in reach by links of similar texts, and by those that ``more`` finds.

    ``more`` gives links (a, b) between the nodes of distinct texts (node, text).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("node", _node_column(F.col("text")))
    named = store(rows.select("doc_id", "node"), "nodes")
    # Stored: three steps read the texts, each by one Python worker a task, and none works out their nodes again.
    texts = store(rows.groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = links_of(texts)
    found = components(links if more is None else more(texts).unionByName(links))
    rooted = named.groupBy("node").agg(F.min("doc_id").alias("least")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(rooted.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
