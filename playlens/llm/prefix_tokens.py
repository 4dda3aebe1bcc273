"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For byte-pair merges every prefix of a piece has one encoding, whose last token t stands behind the encoding of the prefix
without t. Which of the tokens that end here is the last one is decided by pairs: t is, if it and the last token of the
shorter prefix stay as they are when both are encoded together. So count(i) = count(i - len(t)) + 1, one step a prefix, and
no prefix is encoded again. An automaton over the vocabulary gives the tokens that end at each byte.

A text is cut into pieces by the vocabulary's own rule. A piece's counts don't depend on what is in front of it, so each
piece is worked out once and the counts of a text are put together from its pieces. Two things cross pieces: white space
before a word is one piece while the prefix ends in it and two pieces afterwards, and a special string is one token when it
is complete and ordinary text before. Both are in the counts.

``counts[i]`` is the number of tokens of the first i code points, so a count, a cut or a budget is looked up and nothing is
encoded again. Counts needn't rise (`'r` has two tokens, `'re` one). Null texts are empty; rows that repeat are counted each.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import text_of

#: Pieces and pairs remembered by one Python worker.
CACHED = 400_000
#: Code points in one batch of results.
BATCH_CHARS = 2_000_000

#: Fixed value: how this vocabulary cuts a text into pieces.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed value: the pieces of that rule that are two pieces until they are complete.
_SHORT_FORMS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: Blocks of characters that Unicode versions class alike; other texts are cut by the tokenizer's own rule.
_UNSURE = regex.compile(r"[^\u0000-՗‐-⁯₠-₿℀-⯿　-鿿가-힣＀-￯\U0001f000-\U0001faff]")
_SPACES = regex.compile(r"\s+")

#: The printable characters that stand for bytes in byte-level vocabularies; the other bytes follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


class PrefixCounter:
    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.shown: dict[int, str] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bits = max(map(len, vocabulary)).bit_length()
        for token, number in vocabulary.items():
            self.ends.add_word(token, number << self.bits | len(token))
            self.shown[number] = token
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        #: Prefix counts of all pieces one after another; of each piece where they are, how many, the last, and its white space.
        self.pool, self.at, self.length, self.total = array("i"), array("i"), array("i"), array("i")
        self.blank, self.blank_start = array("b"), array("b")

    def _fits(self, pair: int) -> bool:
        """Whether two tokens (left << 32 | right) side by side are an encoding."""
        if len(self.pairs) > CACHED:
            self.pairs = {}
        left, right = pair >> 32, pair & 0xFFFFFFFF
        tokens = self.tokenizer.model.tokenize(self.shown[left] + self.shown[right])
        got = self.pairs[pair] = [t.id for t in tokens] == [left, right]
        return got

    def _piece(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece that is cut no further, one number a code point."""
        shown = piece
        if not (piece.isascii() and piece.isalnum()):
            shown = "Ġ" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalnum() else "".join(map(_BYTES.__getitem__, piece.encode()))
        count, last, fits = [0] * (len(shown) + 1), [0] * (len(shown) + 1), self.pairs.get
        bits, mask = self.bits, (1 << self.bits) - 1
        for end, value in self.ends.iter(shown):
            end += 1
            if count[end]:
                continue
            token, start = value >> bits, end - (value & mask)
            if start:
                pair = last[start] << 32 | token
                if not (self._fits(pair) if (got := fits(pair)) is None else got):
                    continue
            last[end], count[end] = token, count[start] + 1
        if len(shown) == len(piece):
            return count[1:]
        ends = accumulate(len(c.encode()) for c in piece)
        return [count[e] for e in ends]

    def _learn(self, piece: str) -> int:
        counts = self._piece(piece)
        if piece in _SHORT_FORMS:
            counts = [1, *(1 + c for c in self._piece(piece[1:])[:-1]), counts[-1]]
        self.at.append(len(self.pool))
        self.pool.extend(counts)
        self.length.append(len(counts))
        self.total.append(counts[-1])
        word = piece[-1].isalnum()
        self.blank.append(not word and _SPACES.fullmatch(piece) is not None)
        self.blank_start.append(piece[0] == " " or not word and _SPACES.match(piece) is not None)
        got = self.number[piece] = len(self.at) - 1
        return got

    def _cut(self, text: str) -> list[str]:
        if _UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _PIECE.findall(text)

    def _ordinary(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text without special strings."""
        pieces = self._cut(text)
        if not pieces:
            return np.zeros(0, np.int32)
        if len(self.number) > CACHED:
            self._forget()
        known, learn = self.number.get, self._learn
        ids = np.array([learn(p) if (got := known(p)) is None else got for p in pieces])
        of = [np.frombuffer(held, held.typecode)[ids] for held in (self.at, self.length, self.total, self.blank, self.blank_start)]
        at, lengths, totals, blank, blank_start = of
        starts, base = np.cumsum(lengths) - lengths, np.cumsum(totals) - totals
        places = np.repeat(at - starts, lengths) + np.arange(int(lengths.sum()))
        out = np.frombuffer(self.pool, "i")[places] + np.repeat(base, lengths).astype(np.int32)
        for m in 1 + np.flatnonzero(blank_start[1:] & blank[:-1]):  # the prefix that ends with this run of white space
            spaces = pieces[m - 1] + pieces[m][0]
            number = learn(spaces) if (got := known(spaces)) is None else got
            out[starts[m]] = base[m - 1] + self.total[number]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, 2, … code points of a text."""
        found = [m.span() for m in self.special.finditer(text)] if self.special else []
        out, done, base = [np.zeros(1, np.int32)], 0, 0
        for start, end in found:
            own = self._ordinary(text[done : end - 1])
            before = int(own[start - done - 1]) if start > done else 0
            out += [own + np.int32(base), np.array([base + before + 1], np.int32)]
            done, base = end, base + before + 1
        out.append(self._ordinary(text[done:]) + np.int32(base))
        return np.concatenate(out)


@cache
def _counter(path: str | None) -> PrefixCounter:
    """One for the life of a Python worker; it forgets when it holds ``CACHED`` pieces."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row per document: its id, the columns ``keep`` and ``counts``, the tokens of its first 0, 1, … code points."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(keep or []), text_of(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            first, held, size = 0, [], 0
            for i in range(len(texts)):
                held.append(counter.counts(texts[i].as_py()))
                size += len(held[-1])
                if size >= BATCH_CHARS or i + 1 == len(texts):
                    offsets = np.append(0, np.cumsum([len(h) for h in held])).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))
                    own = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], lists], names=[*own.schema.names[:-1], "counts"])
                    first, held, size = i + 1, [], 0

    return kept.mapInArrow(run, schema)


def tokens_at(chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points."""
    return F.element_at("counts", (F.lit(chars) if isinstance(chars, int) else chars) + 1).cast("long")


def longest_within(budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    fits = F.transform("counts", lambda c, i: F.when(c <= budget, i))
    return F.when(F.element_at("counts", -1) <= budget, F.size("counts") - 1).otherwise(F.array_max(fits)).cast("long")
