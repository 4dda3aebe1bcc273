import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from playlens.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows_hold_everything_within_capacity(lengths):
    lengths.sort(reverse=True)
    where = packing.windows(lengths, 64)
    assert len(where) == len(lengths)
    if lengths:
        assert np.bincount(where, weights=lengths).max() <= 64


def test_differencing_is_near_equal():
    rnd = random.Random(2)
    lengths = sorted((rnd.randint(1, 500) for _ in range(400)), reverse=True)
    sums = np.bincount(packing.differencing(lengths, 30), weights=lengths)
    assert sums.max() - sums.min() <= 5 and sums.sum() == sum(lengths)


def test_words_equal_the_tokenizer():
    rnd = random.Random(1)
    alphabet = "abcXYZ019 '\n\t.,-_éÉßẞÿŸñçİıſΣσςaé́<|endoftext|>中文أ🙂½²Ⅷ'll​\x00\x1c\x85\xa0×÷ "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["a<|endoftext|>b", "I'LL it's 'S", ""]
    plain = packing._tokenizer(None)
    for text, ids in zip(texts, packing.Words(None).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID], ascii(text)


def test_round_trip(spark, odd, none):
    rows = packing.pack(odd, window=64, max_piece=16, group=5).collect()
    own = packing.Words(None)
    want = sorted(next(own.ids([r.text or ""])) for r in odd.select("text").collect())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows) == sum(len(w) // 4 for w in want)
    text = dict((r.doc_id, r.text) for r in odd.collect())
    for r in rows:
        if r.doc_id in (1, 6, 9):
            ids = next(own.ids([text[r.doc_id]]))
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4
    assert packing.pack(none).count() == 0


def test_whole_table_against_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    plain, pieces = packing._tokenizer(None), {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for start, length, crc, total in sorted(pieces[r.doc_id]):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    sequences = {r.sequence_id for r in rows}
    assert len(sequences) <= 1.02 * -(-sum(r.length for r in rows) // packing.WINDOW)


def test_repeated_rows_are_dealt_out(spark):
    docs = spark.range(300).selectExpr("CAST(1 AS LONG) AS doc_id", "'the same text' AS text")
    rows = packing.pack(docs, group=20).collect()
    assert len(rows) == 300 and len({r.sequence_id >> 32 for r in rows}) > 5
