"""Personal data: base patterns, and unseen identifiers found by bootstrapped contexts. DataFrame functions only.

Base spans (e-mail, IP, card, phone) are the seeds. The two words in front of a seed are a lexical pattern. A graph joins
patterns with the instances seen behind them, seeds and other identifier-like strings alike. Each round scores patterns
by their instances (the weight of known ones, over all places where the pattern stands in the corpus, so that common
words never qualify) and then instances by their patterns (noisy or). Patterns that stay above the threshold, with enough
distinct instances, label the unseen strings behind them with the kind that they predict.

Positions are code points. A text is marked up by ``regexp_replace`` with a control character, which is first replaced
where the text holds it, and split there; nothing is collected and texts are shuffled nowhere. Null texts are empty; an
empty text has no spans. Rows that repeat id and text get equal results; a null id is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from playlens.llm.common import store, text_of

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
MARK, OTHER = "\x01", "\x02"
_LOCAL, _OCTET = "A-Za-z0-9._%+-", r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TOKEN = "A-Za-z0-9._%+@-"
#: The base patterns; possessive, and tried once a run, so that long runs take linear time.
PATTERNS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<![{_TOKEN}])[A-Za-z._%+@-]*+[0-9][{_TOKEN}]*+",
)
_TRIGGERS = ("@", "[.]", "[0-9]", "[+]", "[0-9]")
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3, 0.5, 3
MIN_LENGTH, MIN_DIGITS, CONTEXT = 6, 4, 80
CHUNK = 256
PATTERN_BLOCK = 1_000_000
PART = 10

_LUHN = """aggregate(sequence(1, length(d)), 0, (acc, i) -> acc + CASE WHEN (length(d) - i) % 2 = 0 THEN int(substring(d, i, 1))
    ELSE 2 * int(substring(d, i, 1)) - 9 * int(int(substring(d, i, 1)) > 4) END) % 10 = 0"""


def _valid(kind: int, value: str) -> str:
    """An SQL condition on the matched string."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == 1:
        return f"{value} rlike '^(?:{_OCTET}[.]){{3}}{_OCTET}$'"
    if kind == 2:
        luhn = _LUHN.replace("length(d)", f"length({digits})").replace("substring(d,", f"substring({digits},")
        return f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"
    if kind == 3:
        return f"length({digits}) BETWEEN 10 AND 15"
    if kind == CANDIDATE:
        return f"length({value}) >= {MIN_LENGTH} AND length({digits}) >= {MIN_DIGITS}"
    return "true"


def _located(segments: str) -> Column:
    """Spans (start, finish, value, context) of the marked strings among ``segments``, which alternate with what is between.

    Starts are running sums: within chunks, and over the totals of chunks, so a text with very many matches takes no
    quadratic time.
    """
    pairs = f"transform(sequence(0, (size({segments}) - 3) div 2), j -> struct({segments}[2 * j] AS gap, {segments}[2 * j + 1] AS value))"
    slim = f"transform({pairs}, p -> struct(length(p.gap) AS l, length(p.value) AS v, p.value AS value, lower(right(p.gap, {CONTEXT})) AS context))"
    chunks = f"transform(array({slim}), a -> transform(sequence(0, (size(a) - 1) div {CHUNK}), c -> slice(a, c * {CHUNK} + 1, {CHUNK})))[0]"
    spans = """transform(array(chunks), x -> zip_with(x,
        aggregate(x, array(0), (a, ch) -> concat(a, array(element_at(a, -1) + aggregate(ch, 0, (t, p) -> t + p.l + p.v)))),
        (ch, off) -> CASE WHEN ch IS NOT NULL THEN aggregate(ch, struct(off AS at, cast(array() AS array<struct<start:int,finish:int,value:string,context:string>>) AS spans),
            (s, p) -> struct(s.at + p.l + p.v AS at, concat(s.spans, array(struct(s.at + p.l AS start, s.at + p.l + p.v AS finish, p.value AS value, p.context AS context))) AS spans)).spans
        ELSE cast(array() AS array<struct<start:int,finish:int,value:string,context:string>>) END))[0]""".replace("array(chunks)", f"array({chunks})")
    return F.expr(f"CASE WHEN size({segments}) >= 3 THEN flatten({spans}) ELSE cast(array() AS array<struct<start:int,finish:int,value:string,context:string>>) END")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of id and text), base: the valid spans in order, seen: base and candidate spans with their contexts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text"))))
    rows = rows.withColumn("text", F.translate("text", MARK, OTHER))
    for k, pattern in enumerate(PATTERNS):
        marked = F.split(F.regexp_replace("text", pattern, f"{MARK}$0{MARK}"), MARK)
        rows = rows.withColumn(f"segments{k}", F.when(F.col("text").rlike(_TRIGGERS[k]), marked))
    kinds = range(len(PATTERNS))
    rows = rows.select("doc_id", "key", *(_located(f"segments{k}").alias(f"spans{k}") for k in kinds))
    # A candidate ends with its last letter or digit.
    bare = f"transform(spans{CANDIDATE}, s -> struct(s.start + length(s.value) - length(ltrim('._%+@-', s.value)) AS start, s.finish - length(s.value) + length(rtrim('._%+@-', s.value)) AS finish, trim(BOTH '._%+@-' FROM s.value) AS value, s.context AS context))"
    rows = rows.withColumn(f"spans{CANDIDATE}", F.expr(bare))
    valid = [F.expr(f"transform(filter(spans{k}, s -> {_valid(k, 's.value')}), s -> struct(s.start AS start, {k} AS kind, s.finish AS finish, lower(s.value) AS value, s.context AS context))") for k in kinds]
    rows = rows.select("doc_id", "key", F.flatten(F.array(*valid)).alias("seen"))
    base = F.expr(f"sort_array(transform(filter(seen, s -> s.kind < {CANDIDATE}), s -> struct(s.start AS start, s.kind AS kind, s.finish AS finish)))")
    return rows.select("doc_id", "key", base.alias("base"), "seen")


def occurrences(found: DataFrame) -> DataFrame:
    """(key, kind, start, finish, value, pattern): every base span, and the candidates that touch none, behind two words."""
    before = Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind") < CANDIDATE
    rows = found.filter(F.size("seen") > 0).select("key", F.inline("seen")).distinct()
    rows = rows.withColumn("last", F.max(F.when(is_base, F.col("finish"))).over(before)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
    free = is_base | ((F.coalesce("last", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("finish")) >= F.col("finish")))
    words = r"(\S+)\s+(\S+)\s+\S*$"
    pattern = F.concat_ws(" ", F.regexp_extract("context", words, 1), F.regexp_extract("context", words, 2))
    return rows.filter(free).select("key", "kind", "start", "finish", "value", pattern.alias("pattern")).filter("length(pattern) > 1")


def _pairs(docs: DataFrame, patterns: DataFrame, text_col: str, share: int, block: int) -> DataFrame:
    """(pair, total): the hashed pairs of words of ``patterns`` (pair) in the texts, or in one of ``share`` parts of them.

    Patterns are held against the texts in blocks of at most about ``block``, each broadcast; no pair of words is shuffled
    before it is known to be a pattern and counted.
    """
    text = text_of(text_col)
    rows = docs if share == 1 else docs.filter(F.pmod(F.xxhash64(text), F.lit(share)) == 0)
    words = rows.select(F.split(F.lower(text), r"\s+").alias("w")).filter(F.size("w") > 1)
    pairs = words.select(F.inline(F.expr("arrays_zip(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1))"))).toDF("one", "two")
    pairs = pairs.select(F.xxhash64(F.concat_ws(" ", "one", "two")).alias("pair"))
    blocks = -(-patterns.count() // block) or 1
    counts = [pairs.join(F.broadcast(patterns.filter(F.pmod("pair", F.lit(blocks)) == b).select("pair").distinct()), "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("total")) for b in range(blocks)]
    return reduce(DataFrame.unionByName, counts)


def pattern_counts(docs: DataFrame, patterns: DataFrame, text_col: str = "text", confidence: float = MIN_CONFIDENCE, block: int = PATTERN_BLOCK) -> DataFrame:
    """(pattern, total): how often those of ``patterns`` (pattern, n) that can be trusted stand anywhere in the corpus.

    n places with an identifier behind a pattern can't make it trusted if it stands in over n / confidence places. A tenth
    of the texts shows that of common pairs already; the others are counted in all texts.
    """
    keyed = store(patterns.withColumn("pair", F.xxhash64("pattern")), "pii-pairs")
    some = _pairs(docs, keyed, text_col, PART, block)
    rare = store(keyed.join(some, "pair", "left").filter(F.coalesce("total", F.lit(0)) * confidence <= F.col("n")).drop("total"), "pii-rare")
    return rare.join(_pairs(docs, rare, text_col, 1, block), "pair").select("pattern", "total")


def bootstrap(docs: DataFrame, seen: DataFrame, text_col: str = "text", rounds: int = ROUNDS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, kind, score): the patterns that are trusted after the last round, with the kind that each predicts."""
    edges = store(seen.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")), "pii-edges")
    fit = store(edges.groupBy("pattern").agg(F.count_distinct("value").alias("support"), F.sum("n").alias("n")).filter(F.col("support") >= support).select("pattern", "n"), "pii-fit")
    # Only patterns that some seed supports can be reached in the first round; others need a value that an earlier one found.
    totals = store(pattern_counts(docs, fit, text_col, confidence), "pii-totals")
    edges = store(edges.join(totals, "pattern"), "pii-graph")
    seeds = edges.filter(F.col("kind") < CANDIDATE).groupBy("value").agg(F.min("kind").alias("label")).withColumn("weight", F.lit(1.0))
    instances, patterns = seeds, None
    for turn in range(rounds):
        by_kind = edges.join(instances, "value").groupBy("pattern", "label").agg((F.sum(F.col("n") * F.col("weight")) / F.max("total")).alias("score"))
        best = by_kind.groupBy("pattern").agg(F.max(F.struct("score", "label")).alias("best"))
        patterns = store(best.select("pattern", F.col("best.label").alias("label"), F.least("best.score", F.lit(0.999)).alias("score")).filter(F.col("score") >= confidence), f"pii-patterns-{turn}")
        if turn + 1 < rounds:
            fresh = edges.filter(F.col("kind") == CANDIDATE).join(seeds.select("value"), "value", "left_anti").join(patterns, "pattern")
            scored = fresh.groupBy("value").agg(F.max_by("label", "score").alias("label"), (1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("weight"))
            instances = store(seeds.unionByName(scored), f"pii-instances-{turn}")
    return patterns.select("pattern", F.col("label").alias("kind"), "score")


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of (start, kind, finish) in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind_name(s["kind"]), s["start"], s["finish"])), ",")


def _kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans; ``n_found`` counts those that contexts added."""
    found = store(scan(docs, id_col, text_col), "pii-scan")
    seen = store(occurrences(found), "pii-seen")
    trusted = bootstrap(docs, seen, text_col, rounds, support, confidence)
    fresh = seen.filter(F.col("kind") == CANDIDATE).drop("kind").join(trusted.select("pattern", "kind"), "pattern")
    added = fresh.groupBy("key").agg(F.collect_set(F.struct("start", F.col("kind").cast("int").alias("kind"), "finish")).alias("added"))
    rows = found.drop("seen").join(added, "key", "left")
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT) AS n_{name}") for k, name in enumerate(KINDS)]
    every = F.sort_array(F.concat("base", F.coalesce("added", F.expr("slice(base, 1, 0)"))))
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found")
    )
