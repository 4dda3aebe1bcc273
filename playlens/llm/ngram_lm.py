"""A language model by deleted interpolation, trained on the corpus that it scores.

P(w | v) mixes the maximum-likelihood estimates of bigram and unigram with the uniform distribution. The weights depend
on how often the context v was seen: contexts fall into buckets by the binary logarithm of their count, and each bucket's
weights are learned by expectation-maximisation on held-out counts. Those come from a fixed share of the training
documents, and the estimates that they meet are taken from the counts with that share deleted; the final model uses the
counts of all training documents.

How it runs: texts are read once into blocks of a few million tokens (ids into the block's own words, packed). A block
asks for the counts of its distinct n-grams, and its request is at the same time what it adds to them; requests are
dealt by a 64-bit hash of the n-gram into buckets of bounded size, added up there, and answered to the blocks. So a
shuffle carries one packed number for each distinct n-gram of a block instead of a row for each token, and a frequent
n-gram has one number a block. Nothing of the vocabulary goes to the driver, only three weights a bucket of contexts.

Words are told apart by 64-bit hashes. Null and empty texts are one end token. Rows that repeat are scored each. If no
document is left to train on, all counts are 0: every token is unknown, and the base and the model give it 1/(V+1).
Without held-out counts the weights stay equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from playlens.llm.common import crc_fold, parts, store, text_of

FOLDS, HELD_OUT = 7, 2
SLICE = 20
#: What a block's documents are for: counts, held-out counts of the weights, or scores only.
TRAIN, TUNE, TEST = 0, 1, 2
BLOCK_TOKENS = 1_500_000
BUCKET_KEYS = 2_000_000
LEVELS = 24
UNIGRAM, BIGRAM = 1, 2
#: No word holds a blank, so these are not words.
END_WORD, START = b" ", b"  "


def _squeeze(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes(), 1) if len(a) else b""


def _expand(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Open:
    """A block that is being filled."""

    def __init__(self) -> None:
        self.place = {END_WORD: 0}
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc: int | None, text: str) -> None:
        words = text.encode("utf-8", "replace").lower().split()
        words.append(END_WORD)
        place = self.place
        for w in set(words).difference(place):
            place[w] = len(place)
        self.ids.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc)
        self.tokens += len(words)

    def row(self, block: int, role: int) -> dict:
        ids = np.concatenate(self.ids)
        rank = np.argsort(-np.bincount(ids, minlength=len(self.place)), kind="stable")  # frequent words first: small ids
        new = np.empty(len(rank), np.uint32)
        new[rank] = np.arange(len(rank), dtype=np.uint32)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.place), np.uint64, len(self.place))[rank]
        docs = np.array([d if d is not None else 0 for d in self.docs], np.int64)
        return {
            "block": block, "role": role, "tokens": self.tokens, "n_docs": len(docs), "docs": docs.tobytes(), "known_id": np.array([d is not None for d in self.docs]).tobytes(),
            "lengths": np.array([len(i) for i in self.ids], np.uint32).tobytes(), "hashes": hashes.tobytes(), "ids": _squeeze(new[ids]),
        }


_BLOCK = "block long, role int, tokens long, n_docs long, docs binary, known_id binary, lengths binary, hashes binary, ids binary"


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, serial = TaskContext.get().partitionId() << 32, count()
        filling: dict[int, _Open] = {}
        for pdf in batches:
            for doc, text, role in zip(pdf["doc_id"], pdf["text"], pdf["role"], strict=True):
                block = filling.setdefault(role, _Open())
                block.add(None if pd.isna(doc) else int(doc), text)
                if block.tokens >= block_tokens:
                    yield pd.DataFrame([filling.pop(role).row(first + next(serial), role)])
        for role, block in filling.items():
            yield pd.DataFrame([block.row(first + next(serial), role)])

    tune = F.pmod(F.xxhash64("doc_id"), F.lit(SLICE)) == 0
    role = F.when(crc_fold("doc_id", FOLDS) == HELD_OUT, TEST).when(tune, TUNE).otherwise(TRAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("role", role)
    return rows.mapInPandas(run, _BLOCK)


class _Block:
    """A block read back: per token its word and its bigram, as positions in the sorted distinct keys of each."""

    def __init__(self, row: pd.Series) -> None:
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        hashes, ids = np.frombuffer(row["hashes"], np.uint64), _expand(row["ids"], np.uint32)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word = place[ids]
        self.context = np.empty(len(ids), np.int64)  # -1: the start
        self.context[1:] = self.word[:-1]
        self.context[self.starts] = -1
        one = hashes[order]
        before = np.where(self.context < 0, np.uint64(xxhash.xxh64_intdigest(START)), one[self.context])
        pair = (before * np.uint64(0x9E3779B97F4A7C15) + one[self.word]) * np.uint64(0xC2B2AE3D27D4EB4F)
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0x9E3779B97F4A7C15)
        two, self.bigram = np.unique(pair, return_inverse=True)
        self.keys = {UNIGRAM: one, BIGRAM: two}
        self.at = {UNIGRAM: self.word, BIGRAM: self.bigram}


_REQUEST = "level int, bucket long, block long, role int, keys binary, counts binary"


def requests(blocks: DataFrame, bits: int) -> DataFrame:
    """One row for each level, bucket (the first ``bits`` bits of the key) and block with n-grams there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                block = _Block(row)
                for level, keys in block.keys.items():
                    counts = np.bincount(block.at[level], minlength=len(keys)).astype(np.uint32)
                    ends = _ends(keys, bits)
                    rows = [(level, b, row["block"], row["role"], _squeeze(np.diff(keys[s:e], prepend=np.uint64(0))), _squeeze(counts[s:e])) for b, (s, e) in enumerate(zip(ends, ends[1:], strict=False)) if e > s]
                    yield pd.DataFrame(rows, columns=["level", "bucket", "block", "role", "keys", "counts"])

    return blocks.mapInPandas(run, _REQUEST)


def _ends(keys: np.ndarray, bits: int) -> list[int]:
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


_ANSWER = "level int, bucket long, block long, counts binary, tuned binary, seen long"


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals for every asking block; in the row without a block, how many distinct n-grams training has here."""
    pdf = pdf.sort_values("block")
    each = [np.cumsum(_expand(k, np.uint64), dtype=np.uint64) for k in pdf["keys"]]
    every, place = np.unique(np.concatenate(each), return_inverse=True)
    train, tune = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    ends = np.cumsum([0, *map(len, each)])
    spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    for role, blob, (s, e) in zip(pdf["role"], pdf["counts"], spans, strict=True):
        if role != TEST:
            own = _expand(blob, np.uint32)
            train[place[s:e]] += own  # keys of one block are distinct
            if role == TUNE:
                tune[place[s:e]] += own
    rows = [(key[0], key[1], None, b"", b"", int((train > 0).sum()))]
    for block, role, (s, e) in zip(pdf["block"], pdf["role"], spans, strict=True):
        at = place[s:e]
        rows.append((key[0], key[1], block, _squeeze(train[at].astype(np.uint64)), _squeeze(tune[at].astype(np.uint64)) if role == TUNE else b"", 0))
    return pd.DataFrame(rows, columns=["level", "bucket", "block", "counts", "tuned", "seen"]).astype({"block": "Int64"})


def _totals(answers: pd.DataFrame, level: int, column: str) -> np.ndarray:
    own = answers[answers["level"] == level].sort_values("bucket")
    return np.concatenate([_expand(b, np.uint64) for b in own[column]] or [np.zeros(0, np.uint64)]).astype(np.int64)


def context_level(seen: np.ndarray) -> np.ndarray:
    """The bucket of a context that was seen so often: 0 for never, else 1 + floor(log2)."""
    return np.minimum(np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))) + 1, 0), LEVELS - 1).astype(np.int64)


def _estimates(block: _Block, one: np.ndarray, two: np.ndarray, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context bucket, bigram estimate, unigram estimate) of each token."""
    seen = np.where(block.context < 0, starts, one[block.context])
    bigram = two[block.bigram] / np.maximum(seen, 1)
    unigram = one[block.word] / max(total, 1)
    return context_level(seen), bigram, unigram


def _components(blocks: DataFrame, answers: DataFrame, starts: int, total: int) -> DataFrame:
    """The held-out tokens as packed columns: bucket, bigram and unigram estimate, from counts with their share deleted."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = _Block(left.iloc[0])
        one, two = (_totals(right, x, "counts") - _totals(right, x, "tuned") for x in (UNIGRAM, BIGRAM))
        level, bigram, unigram = _estimates(block, one, two, starts, total)
        return pd.DataFrame([{"level": level.astype(np.uint8).tobytes(), "bigram": bigram.astype(np.float32).tobytes(), "unigram": unigram.astype(np.float32).tobytes()}])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, "level binary, bigram binary, unigram binary")


def learn_weights(components: DataFrame, uniform: float, rounds: int = 25, tolerance: float = 1e-4) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation over all held-out tokens."""
    weights = np.full((LEVELS, 3), 1 / 3)
    for _ in range(rounds):
        now = weights.copy()

        def expect(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            sums = np.zeros((LEVELS, 3))
            for pdf in batches:
                for level, bigram, unigram in zip(pdf["level"], pdf["bigram"], pdf["unigram"], strict=True):
                    at = np.frombuffer(level, np.uint8)
                    parts3 = np.stack([np.frombuffer(bigram, np.float32), np.frombuffer(unigram, np.float32), np.full(len(at), uniform)], 1) * now[at]
                    parts3 /= parts3.sum(axis=1, keepdims=True)
                    for j in range(3):
                        sums[:, j] += np.bincount(at, weights=parts3[:, j], minlength=LEVELS)
            yield pd.DataFrame({"level": np.arange(LEVELS), "a": sums[:, 0], "b": sums[:, 1], "c": sums[:, 2]})

        got = components.mapInPandas(expect, "level int, a double, b double, c double").groupBy("level").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
        sums = np.zeros((LEVELS, 3))
        for r in got:
            sums[r[0]] = r[1:]
        mass = sums.sum(axis=1, keepdims=True)
        pooled = sums.sum(axis=0) / mass.sum() if mass.sum() else weights[0]
        weights = np.where(mass > 0, sums / np.maximum(mass, 1e-300), pooled)
        if np.abs(weights - now).max() < tolerance:
            break
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(axis=1, keepdims=True)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    blocks = store(blocks_of(docs, id_col, text_col, block_tokens), "lm-blocks")
    sums = {r["role"]: r for r in blocks.groupBy("role").agg(F.sum("tokens").alias("tokens"), F.sum("n_docs").alias("n_docs")).collect()}
    tokens = lambda *roles: sum(sums[r]["tokens"] for r in roles if r in sums)
    starts = lambda *roles: sum(sums[r]["n_docs"] for r in roles if r in sums)
    bits = max(0, (max(1, tokens(TRAIN, TUNE, TEST) // bucket_keys)).bit_length())
    asked = requests(blocks, bits).repartition(max(parts(spark), 1 << bits), "level", "bucket")
    answers = store(asked.groupBy("level", "bucket").applyInPandas(_answer, _ANSWER), "lm-answers")
    distinct = answers.filter(F.col("block").isNull() & (F.col("level") == UNIGRAM)).agg(F.sum("seen")).first()[0] or 0
    replies = answers.filter(F.col("block").isNotNull()).select("block", "level", "bucket", "counts", "tuned")
    tuned = replies.join(blocks.filter(F.col("role") == TUNE).select("block"), "block", "left_semi")
    components = store(_components(blocks.filter(F.col("role") == TUNE), tuned, starts(TRAIN), tokens(TRAIN)), "lm-components")
    total, uniform = tokens(TRAIN, TUNE), 1 / (distinct + 1)
    weights, first = learn_weights(components, uniform), starts(TRAIN, TUNE)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        block = _Block(row)
        one = _totals(right, UNIGRAM, "counts")
        level, bigram, unigram = _estimates(block, one, _totals(right, BIGRAM, "counts"), first, total)
        mix = weights[level]
        model = np.log10(mix[:, 0] * bigram + mix[:, 1] * unigram + mix[:, 2] * uniform)
        known = one[block.word]
        base = np.log10((known + 1) / (total + (distinct + 1)))
        by_doc = lambda x: np.add.reduceat(x, block.starts)
        ids = pd.array(np.frombuffer(row["docs"], np.int64), "Int64")
        ids[~np.frombuffer(row["known_id"], bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": row["role"] == TEST, "n_tokens": block.lengths, "n_known": by_doc((known > 0).astype(np.int64)), "train_tokens": total, "base_score": by_doc(base), "score": by_doc(model)})

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(run, _SCORES)
