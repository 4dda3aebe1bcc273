"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. It is cut into whole windows first; what is left is cut once more if it is
longer than ``max_piece`` and the pieces are dealt into groups. In a group every piece starts as a partial partition of
one filled and k-1 empty windows. The two partial partitions with the largest imbalance are merged again and again, the
fullest window of one with the emptiest of the other, until one partition into k near-equal windows is left. k starts
at the least number that can hold the group's tokens and rises by one while any window exceeds the capacity.

Tokens are only counted and summed up (CRC) where the text is; no ids are shuffled, only pieces of a few bytes.
Empty and null texts are one end id. Rows that repeat an id are packed each on its own.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from playlens.llm.common import store, text_of

WINDOW = 4096
END_ID = 2
GROUP = 1000
MAX_PIECE = 1024
#: Pieces that a Python worker remembers, about 200 bytes each.
CACHED_WORDS = 400_000


@cache
def _tokenizer(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


#: The printable characters that stand for bytes in byte-level vocabularies; the other bytes follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
#: Texts whose pieces are plain: nothing beyond Latin-1 (normal forms, odd lower case), none of its letters that are digits or signs.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_SPECIAL = "<|"
#: Python's split takes these four for white space, the tokenizer doesn't; texts that hold one are split by hand.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_ODD_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Fixed value: how the vocabulary cuts a plain text in lower case.
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


def _four(ids: list[int]) -> bytes:
    got = array("I", ids)
    if sys.byteorder == "big":
        got.byteswap()
    return got.tobytes()


class Words(dict):
    """Ids (as bytes) of pieces of plain texts and of words of other texts, encoded once each, when they are first asked for.

    The tokenizer splits at white space and drops it, so words are independent, and so are the pieces it cuts a word into.
    Plain pieces go to the vocabulary's model, which is five times as fast as the whole tokenizer.
    """

    def __init__(self, path: str | None) -> None:
        super().__init__()
        self.tokenizer = _tokenizer(path)

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and _SPECIAL not in word:
            low = word.lower()
            pieces = _PIECES.findall(low)
            if len(pieces) == 1:
                shown = low if low.isascii() else "".join([_BYTES[b] for b in low.encode()])
                got = _four([t.id for t in self.tokenizer.model.tokenize(shown)])
            else:
                got = b"".join(map(self.__getitem__, pieces))
        else:
            got = _four(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = got
        return got

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers, the end id among them."""
        of, end = self.__getitem__, END_ID.to_bytes(4, "little")
        for text in texts:
            if len(self) > CACHED_WORDS:
                self.clear()
            if _PLAIN.fullmatch(text) and _SPECIAL not in text:
                own = _PIECES.findall(text.lower())
            else:
                own = _ODD_SPACE.sub(" ", text).split(" ") if _SEPARATORS.search(text) else text.split()
            yield b"".join(map(of, own)) + end


@cache
def _words(path: str | None) -> Words:
    """One for the life of a Python worker."""
    return Words(path)


def cuts(n: int, window: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, then the rest, in two if it is over ``max_piece``."""
    out = [(at, window) for at in range(0, n - n % window, window)]
    at = n - n % window
    while at < n:
        out.append((at, min(max_piece, n - at)))
        at += out[-1][1]
    return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_piece: int = MAX_PIECE, tokenizer: str | None = None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _words(tokenizer)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                some = pdf.iloc[at : at + 500]
                rows = []
                for doc, raw in zip(some["doc_id"], words.ids(some["text"].tolist()), strict=True):
                    doc, total = None if pd.isna(doc) else int(doc), len(raw) // 4
                    rows += [(doc, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), total) for s, n in cuts(total, window, max_piece)]
                got = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                yield got.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, PIECE)


def differencing(lengths: list[int], k: int) -> np.ndarray:
    """The window (0..k-1) of each length, by largest-difference-first merging of k-way partial partitions."""
    n = len(lengths)
    if k == 1:
        return np.zeros(n, int)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = []
    for i, size in enumerate(lengths):
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = size  # in falling order
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(made)
        made.append((a, b, order, k - 1 - order))
        sums[node] = both - both[-1]
        heapq.heappush(heap, (-int(both[0] - both[-1]), node))
    slots = {heap[0][1]: np.arange(k)}  # of a node: the final window of each of its slots
    out = np.zeros(n, int)
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, left, right = made[node - n]
        final = slots.pop(node)
        for child, at in ((a, left), (b, right)):
            where = np.empty(k, int)
            where[at] = final
            slots[child] = where
    for i in range(n):
        out[i] = slots[i][0]
    return out


def windows(lengths: list[int], window: int) -> np.ndarray:
    """Near-equal windows of at most ``window`` tokens: k rises until differencing fits."""
    if not lengths:
        return np.zeros(0, int)
    k = -(-sum(lengths) // window)
    while True:
        where = differencing(lengths, k)
        if np.bincount(where, weights=lengths, minlength=k).max() <= window:
            return where
        k += 1


PACKED = PIECE + ", sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_piece: int = MAX_PIECE, group: int = GROUP, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: where it is in its document and in which sequence, at which offset. Groups hold about ``group`` documents."""
    pieces = pieces_of(docs, id_col, text_col, window, max_piece, tokenizer)
    pieces = store(pieces.withColumn("tie", F.monotonically_increasing_id()), "pieces")  # rows that repeat id and text are dealt out too
    groups = -(-pieces.filter("start = 0").count() // group) or 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=False, kind="stable").reset_index(drop=True)
        full = int((pdf["length"] == window).sum())
        where = np.concatenate([np.arange(full), full + windows(pdf["length"].tolist()[full:], window)])
        pdf["sequence_id"] = (int(key[0]) << 32) + where.astype(np.int64)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["pack_group", "tie"])

    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "tie"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(run, PACKED)
