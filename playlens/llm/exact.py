"""Exact dedup over a cuckoo-filter index of live digests.

The digest space is dealt over partitions. Each partition keeps a cuckoo filter of 16-bit marks and, beside it, the
bucketed content: the full SHA-256 digests with what is known of their group. A filter miss is certain and inserts
without a look at the content; a hit is verified against the content. When an insertion finds no place, the filter
doubles and is filled again from the stored keys. Digests can be deleted, and a deleted text is new when it returns.

Empty, null: the null text counts as the empty one; all of them are one group. Ties: the row with the largest id stays;
of rows that repeat that id, each is kept (the output has one row per input row). A null id is below every other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import LOWER, UPPER, parts, store, text_of

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Digest (bytes) -> [keep, size] behind a cuckoo filter with partial-key hashing."""

    def __init__(self, buckets: int = 1024) -> None:
        self.content: dict[bytes, list] = {}
        self.resizes = 0
        self.verified = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = np.zeros(buckets * SLOTS, np.uint16).tolist()

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[10:18], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def may_hold(self, digest: bytes) -> bool:
        mark, a, b = self._place(digest)
        a, b = a * SLOTS, b * SLOTS
        return mark in self.marks[a : a + SLOTS] or mark in self.marks[b : b + SLOTS]

    def _put(self, digest: bytes) -> bool:
        mark, a, b = self._place(digest)
        for bucket in (a, b):
            at = bucket * SLOTS
            for slot in range(at, at + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot] = mark
                    return True
        bucket = b
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            mark, self.marks[slot] = self.marks[slot], mark
            bucket = self._other(bucket, mark)
            at = bucket * SLOTS
            for free in range(at, at + SLOTS):
                if not self.marks[free]:
                    self.marks[free] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Double until every stored key has a place; the keys come from the content, so no mark is lost."""
        buckets = self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            self.resizes += 1
            if all(self._put(d) for d in self.content):
                return

    def find(self, digest: bytes) -> list | None:
        if not self.may_hold(digest):
            return None
        self.verified += 1
        return self.content.get(digest)

    def add(self, digest: bytes, keep: int | None, size: int = 1) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[1] += size
            if keep is not None and (entry[0] is None or keep > entry[0]):
                entry[0] = keep
            return
        self.content[digest] = [keep, size]
        if not self._put(digest):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; False if it isn't live. Its mark goes from one of its two buckets."""
        if self.find(digest) is None:
            return False
        del self.content[digest]
        mark, a, b = self._place(digest)
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark:
                    self.marks[slot] = 0
                    return True
        raise AssertionError("a live digest has a mark")


def digest_of(text_col: str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(text_of(text_col), UPPER, LOWER), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"))


def _optional(values: pd.Series) -> list:
    return [None if pd.isna(v) else int(v) for v in values]


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a digest and batch, so that a text in a third of all rows crosses the shuffle a few times only."""
    for pdf in batches:
        if len(pdf):
            got = pdf.groupby("digest", sort=False)["doc_id"].agg(["max", "size"]).reset_index()
            got.columns = ["digest", "keep_id", "group_size"]
            yield got.astype({"keep_id": "Int64"})


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for pdf in batches:
        delete = pdf["gone"] if "gone" in pdf else [False] * len(pdf)
        for digest, keep, size, gone in zip(pdf["digest"], _optional(pdf["keep_id"]), pdf["group_size"], delete, strict=True):
            index.delete(bytes(digest)) if gone else index.add(bytes(digest), keep, int(size))
    rows = list(index.content.items())
    for i in range(0, len(rows), 50_000):
        some = rows[i : i + 50_000]
        yield pd.DataFrame({"digest": [d for d, _ in some], "keep_id": pd.array([e[0] for _, e in some], "Int64"), "group_size": [e[1] for _, e in some]})


_ENTRY = "digest binary, keep_id long, group_size long"


def live_index(found: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct text in ``found`` (doc_id, digest)."""
    partial = found.select("doc_id", "digest").mapInPandas(_combine, _ENTRY)
    return partial.repartition(parts(found.sparkSession), "digest").mapInPandas(_index, _ENTRY)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after the digests of ``removed`` are deleted and the rows of ``added`` (doc_id, digest) inserted.

    Deletions come before insertions: a text that is both removed and added is live with the added rows only.
    """
    step = lambda df, n, gone: df.withColumns({"step": F.lit(n), "gone": F.lit(gone)})
    gone = removed.select("digest").distinct().select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
    fresh = added.select("doc_id", "digest").mapInPandas(_combine, _ENTRY)
    changes = step(index, 0, False).unionByName(step(gone, 1, True)).unionByName(step(fresh, 2, False))
    dealt = changes.repartition(parts(index.sparkSession), "digest").sortWithinPartitions("step")
    return dealt.drop("step").mapInPandas(_index, _ENTRY)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = store(digests(docs, id_col, text_col), "digests")
    return found.join(live_index(found), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
