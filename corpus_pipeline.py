"""The corpus pipeline: documents in, packed training windows out. Each stage is one operator of playlens.llm.

A stage works on all rows that the one before it kept and returns their columns unchanged, whatever further columns there
are. Null texts count as empty. Rows that repeat an id stay or go together in the near-duplicate stage; exact repeats
(same id and text) leave one row in the exact stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from playlens.llm import decontaminate, exact, packing, quality, simhash, similar
from playlens.llm.common import store, table


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores at least the threshold of the classifier, which is trained on these documents and the labels."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_of(model) >= quality.THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest id, once if it repeats."""
    groups = exact.exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    own = _fresh(docs, "own_sha256")
    keyed = docs.withColumn(own, F.lower(F.hex(exact.digest_of("text"))))
    rows = keyed.join(groups, keyed["doc_id"].eqNullSafe(groups["_id"]) & (keyed[own] == groups["_digest"]), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id: texts link by their SimHash (op2: three words, three
    bits) and, as three bits miss most texts that are alike, by five-word similarity of 0.8 or more."""
    groups = similar.near_duplicates(docs, more=simhash.text_links)
    ids = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return docs.filter(F.size(decontaminate.hits_of(table(spark, sf_dir, "benchmark"))) == 0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Fingerprints, edit distances, a trained classifier and a tokenizer can't be said in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, "stage-" + name.replace(" ", "-"))
    return docs
