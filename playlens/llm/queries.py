"""The registered queries of this package, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from playlens.llm import decontaminate, exact, extract, merkle, ngram_lm, packing, pii, prefix_tokens, quality, repeats, simhash, warc, word_runs
from playlens.llm.common import crc_fold, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_decontamination")
def op1(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_simhash")
def op2(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_repeated_passages")
def op3(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query("op4_deleted_interpolation")
def op4(spark, sf_dir):
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def op5(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op6_html_text")
def op6(spark, sf_dir):
    return extract.extracted(table(spark, sf_dir, "pages"))


@query(
    "op7_warc_revisits",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT *, octet_length(encode(html)) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
)
def op7(spark, sf_dir):
    return warc.rewritten(table(spark, sf_dir, "pages")).drop("url")


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query(
    "op9_exact_dedup",
    """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
)
def op9(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def _tree_sql(name: str, base: str) -> str:
    """All levels of the trees of ``base`` (tree, pos, h, n)."""
    return f"""{name} AS (SELECT tree, 0 AS l, pos, h, n FROM {base}
        UNION ALL SELECT tree, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY tree, l, pos // 3)"""


def _fold_sql(name: str, base: str, levels: str) -> str:
    """Every row of ``base`` (row, tree, pos, now, proof) folded through the levels of its tree."""
    runs = f"SELECT tree, l, pos // 3 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {levels} GROUP BY tree, l, pos // 3"
    return f"""{name}_runs AS ({runs}), {name} AS (SELECT row, tree, 0 AS l, pos, now, proof FROM {base}
        UNION ALL SELECT f.row, f.tree, f.l + 1, f.pos // 3,
            sha256(array_to_string(list_concat(hs[1 : f.pos % 3], [now], hs[f.pos % 3 + 2 :]), '')),
            proof || array_to_string(list_concat(hs[1 : f.pos % 3], hs[f.pos % 3 + 2 :]), '')
        FROM {name} f JOIN {name}_runs r ON r.tree = f.tree AND r.l = f.l AND r.run = f.pos // 3 WHERE r.n > 1)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


#: crc32 of the decimal doc_id: each byte is put in and eight bits are shifted out.
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(coalesce(doc_id::VARCHAR, ''), '') IF c <> '']),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
_CUT = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
_LEAF = "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"


@query(
    "op11_merkle_manifest",
    f"""WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS tree, {CRC_SQL} AS crc, row_number() OVER () AS row FROM documents),
    e AS (SELECT row, doc_id, tree, {_LEAF.format(_field_sql("text"))} AS leaf, {_LEAF.format(_field_sql(f"({_CUT})"))} AS now FROM d),
    g AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM e),
    {_tree_sql("lv", "g")},
    s AS (SELECT tree AS source, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, h, count(*) OVER () AS n FROM lv WHERE n = 1),
    {_tree_sql("tops", "s")},
    b AS (SELECT row, tree, pos, now, '' AS proof FROM g),
    {_fold_sql("f", "b", "lv")},
    c AS (SELECT f.row, '' AS tree, s.pos, f.now, f.proof FROM f JOIN lv ON lv.tree = f.tree AND lv.l = f.l AND lv.n = 1 JOIN s ON s.source = f.tree),
    {_fold_sql("t", "c", "tops")},
    r AS (SELECT l, h AS root FROM tops WHERE n = 1)
    SELECT g.doc_id, g.leaf, s.h AS subroot, root, sha256(t.proof) AS proof_sha256, t.now AS folded_root, t.now = root AS verified
    FROM g JOIN s ON s.source = g.tree JOIN t ON t.row = g.row JOIN r ON r.l = t.l""",
)
def op11(spark, sf_dir):
    """Tampering deletes line feeds where 2 divides the crc32 of the id."""
    changed = F.when(crc_fold("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.folded(table(spark, sf_dir, "documents"), changed)


@query("op12_prefix_tokens")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = prefix_tokens.prefix_counts(docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text"), keep=["n_bytes"])
    n_tokens = prefix_tokens.tokens_at(F.size("counts") - 1)
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > 1024).alias("over_limit"), prefix_tokens.longest_within(1024).alias("fitting_chars"))


@query("op13_word_runs")
def op13(spark, sf_dir):
    """Of the documents whose crc32 ends in 0, a tail is replaced by copies of its first words."""
    return word_runs.runs_of(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")
