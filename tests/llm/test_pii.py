import hashlib
import random
import re

from playlens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def plain(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[name]:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_base_spans_and_contexts(spark, odd, none):
    rnd = random.Random(2)
    bits = ["a@b.c", "john.doe@mail.example.com", "1.2.3.4", ".", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (729) 555-7725", "+44 20 7946 0958", " ", "\n", "é", "🙂", "@",
            "a_b%c@d-e.f", "x@y.z_w@q.r", "+", "12", "0", "-", "\x01", "\x02", "..", "00255.1.1.1", "0.0.0.0", "word", "4417744280351547"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(800)] + ["1" * 5000, "a" * 5000, "1.2.3.4 " * 1000, None, ""]
    seeds = [f"please call me today phone line +1 (20{i}) 555-01{i:02d} soon" for i in range(9)]
    unseen = [f"so the phone line 555-02{i:02d}-9 rang" for i in range(3)]
    clean = [f"there were order number 100{i}77 of them in the old store" for i in range(5)]
    rows = list(enumerate(texts + seeds + unseen + clean, 100))
    table = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text")).repartition(4)
    got = pii.personal_data(table).collect()
    assert len(got) == table.count()
    text = {**dict(rows), **{r.doc_id: r.text for r in odd.collect() if r.doc_id}}
    new = {}
    for r in got:
        if r.doc_id is None:
            continue
        want = plain(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), ascii(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in BASE]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        if r.n_found:
            new[r.doc_id] = r.spans
    first = 100 + len(texts) + len(seeds)
    assert new == {first + i: "phone:18:28" for i in range(3)}  # behind a pattern of phones, though no base pattern
    assert pii.personal_data(none).count() == 0


def test_no_python_in_the_plan(spark, odd):
    plan = pii.scan(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
