"""What the operators of this package share: stored intermediate tables, partition counts, plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playlens.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it outlives executors and is worked out once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int = 0, per_part: int = 500_000) -> int:
    """Partitions for work that keeps state per row: the session's number, or more if each would hold too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part), 1)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
