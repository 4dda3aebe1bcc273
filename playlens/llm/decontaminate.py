"""Benchmark decontamination by pigeonhole pieces and Myers verification.

Texts are lower-cased and every run of other characters than letters and digits becomes one blank. An item of m
characters may be found with k = floor(m * rate) edits. It is cut into k+1 pieces: whatever k edits do, one piece is left
whole. All pieces of a block of items go into one Aho-Corasick automaton; each hit says where the item would stand, and
Myers' bit-parallel distance verifies it there, over the overlapping places of one item at once.

Items are handled in blocks of bounded size, each broadcast and held against every document; nothing of the documents is
shuffled. Short items are found as whole words; an item without letters and digits, or a null one, is never found. Null
texts are empty and contain nothing. Items that repeat are each reported. Texts of any length are searched whole.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import text_of

RATE = 0.05
BLOCK_CHARS = 8_000_000

_OTHER = re.compile(r"[\W_]+")
_HITS = "array<struct<item_id:bigint,edits:int,place:int>>"


def normal(text: str | None) -> str:
    """Words with a blank before, between and after; empty if there is none."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget+1 pieces of near-equal length."""
    n = budget + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(edits, end) of the best place of an m-character pattern anywhere in ``text``; the first such end."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, ch in enumerate(text):
        eq = masks.get(ch, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        vertical = eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, at + 1
    return best, end


class Block:
    """The automaton of some items (item_id, normal text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            by_text.setdefault(text, []).append(item_id)
        self.items = [(text, ids, int((len(text) - 2) * rate)) for text, ids in by_text.items()]
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, place): every item found, at its best place (the end, in the normal text)."""
        own = normal(text)
        if not own or not self.items:
            return []
        places: dict[int, list[tuple[int, int]]] = {}
        for end, (length, at) in self.automaton.iter(own):
            for n, offset in at:
                m, k = len(self.items[n][0]), self.items[n][2]
                start = end + 1 - length - offset
                spans = places.setdefault(n, [])
                lo, hi = max(0, start - k), min(len(own), start + m + k)
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out = []
        for n, spans in places.items():
            item, ids, budget = self.items[n]
            if n not in self.masks:
                self.masks[n] = masks_of(item)
            found = []
            for lo, hi in dict.fromkeys(spans):
                edits, end = best_match(self.masks[n], len(item), own[lo:hi])
                if edits <= budget:
                    found.append((edits, lo + end))
            if found:
                out += [(i, *min(found)) for i in ids]
        return sorted(out)


@cache
def _block(shared: Broadcast, rate: float) -> Block:
    """Built once in a Python worker."""
    return Block(shared.value, rate)


def _hits(shared: Broadcast, rate: float, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        block = _block(shared, rate)
        return pd.Series([[{"item_id": i, "edits": e, "place": p} for i, e, p in block.search(t)] for t in texts])

    return F.pandas_udf(run, _HITS).asNondeterministic()(text)  # else the optimizer repeats it in a filter of its own


def hits_of(benchmark: DataFrame, text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> Column:
    """An array column: the items of ``benchmark`` (item_id, text) found in each row's text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).filter("item_id IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    sc, found = benchmark.sparkSession.sparkContext, []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        texts = [(r.item_id, n) for r in rows if (n := normal(r.text))]
        found.append(_hits(sc.broadcast(texts), rate, text_of(text_col)))
    return F.concat(*found)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, place: one row for each item found in a document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), hits_of(benchmark, text_col, rate).alias("hits"))
    return rows.select("doc_id", F.inline("hits"))
