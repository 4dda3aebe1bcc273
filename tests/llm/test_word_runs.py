import hashlib
import random
import zlib

from playlens.llm import word_runs as wr

SF = "/root/testdata/sf0.001"


def plain(words):
    """All runs, by comparing every lag from the shortest on."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        start = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start + q >= max(12, 2 * q):
                    found.setdefault((start, i - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rnd):
    out = []
    for _ in range(rnd.randint(0, 6)):
        letters, q = rnd.choice([1, 2, 3, 10, 1000]), rnd.choice([1, 2, 5, 15, 16, 17, 20, 31, 32, 33, 50, 64, 70, 100])
        base = [rnd.randrange(letters) for _ in range(q)]
        if rnd.random() < 0.3:
            base = [0] * (q * 3 // 4) + base[: q - q * 3 // 4]
        out += (base * 10)[: rnd.randint(1, 4 * q)]
    return [str(v) for v in out]


def test_blocks_against_every_lag():
    rnd = random.Random(5)
    for _ in range(300):
        own = [some_words(rnd) for _ in range(rnd.randint(1, 5))]
        assert wr._block(own) == [plain(w) for w in own]


def test_long_repetitions():
    assert wr._block([["a"] * 300_000]) == [[(0, 300_000, 1)]]
    runs = wr._block([(["a"] * 5000 + ["b"]) * 40])[0]
    assert len(runs) == 41 and runs[1] == (0, 200_040, 5001)
    short, long = ["a"], ["a", "b"]
    while len(long) < 600:
        short, long = long, long + short
    assert wr._block([long]) == [plain(long)]


def row(doc, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *shas)


def test_whole_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = wr.runs_of(docs, plant=True).drop("runs", "collapsed").collect()
    want = [row(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 15_000]
    seen = {w[0] for w in want}
    assert sorted((tuple(r) for r in got if r.doc_id in seen), key=str) == sorted(want, key=str)
    assert len(got) == docs.count() and sum(r.n_runs > 0 for r in got) > 10


def test_odd_rows(spark, odd, none):
    got = wr.runs_of(odd).collect()
    assert len(got) == odd.count() and wr.runs_of(none).count() == 0
    one = {r.doc_id: r for r in got}
    assert (one[6].n_runs, one[6].start, one[6].length, one[6].period, one[6].exponent_milli, one[6].collapsed) == (1, 0, 20_000, 1, 20_000_000, "word")
    assert one[3].n_runs == one[4].n_runs == 0 and one[3].start is None and one[3].runs_sha256 == hashlib.sha256(b"").hexdigest()
