import random

import pytest
from pyspark.sql import functions as F

from playlens.llm import prefix_tokens as pt

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def counter():
    return pt.PrefixCounter()


def plain(counter, text):
    return [len(counter.tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_every_prefix(counter):
    rnd = random.Random(1)
    some = [*"abre'st  \n\t 　!.,-19é日本🙂́՘\x1c<|>²½", "<|endoftext|>", "<|endoftext|", "'re", "'ll", "the ", "ing ", " \n ", "  "]
    for _ in range(1500):
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 25)))
        assert counter.counts(text).tolist() == plain(counter, text), text


def test_forgetting_changes_nothing(counter, monkeypatch):
    monkeypatch.setattr(pt, "CACHED", 20)
    for text in ("one two three four five six seven " * 5, "a\n\nb  c\n\n\nd " * 20):
        assert counter.counts(text).tolist() == plain(counter, text)


def test_sure_characters_are_cut_as_the_tokenizer_cuts(counter):
    sure = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not pt._UNSURE.search(c)]
    assert len(sure) > 30_000
    for c in sure[::17]:
        text = f"a{c}1{c}!{c} b"
        assert [text[a:b] for _, (a, b) in counter.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == pt._PIECE.findall(text)


def test_every_token_is_its_own_encoding(counter):
    for number, shown in list(counter.shown.items())[::13]:
        assert [t.id for t in counter.tokenizer.model.tokenize(shown)] == [number]


def test_whole_table_against_the_library(spark, counter):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n for r in pt.prefix_counts(docs).select("doc_id", pt.tokens_at(F.size("counts") - 1).alias("n")).collect()}
    want = {r.doc_id: len(counter.tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert got == want


def test_questions(spark, counter):
    docs = spark.createDataFrame([(1, "it's 'really' so   very\n\ngood <|endoftext|> now"), (2, ""), (3, None)], "doc_id long, text string")
    counted = pt.prefix_counts(docs)
    for budget in range(12):
        for r in counted.join(docs, "doc_id").select("text", pt.longest_within(budget).alias("n")).collect():
            want = plain(counter, r.text or "")
            assert r.n == max(i for i, c in enumerate(want) if c <= budget)
    assert [r.n for r in counted.orderBy("doc_id").select(pt.tokens_at(0).alias("n")).collect()] == [0, 0, 0]


def test_odd_rows(spark, odd, none, counter):
    rows = pt.prefix_counts(odd.select("*", F.lit(1).alias("counts_")), keep=["lang" if "lang" in odd.columns else "mark"]).collect()
    assert len(rows) == odd.count() and {tuple(r.counts) for r in rows if r.doc_id in (3, 4)} == {(0,)}
    assert sorted(r.counts[-1] for r in rows) == sorted(len(counter.tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    assert pt.prefix_counts(none).count() == 0
