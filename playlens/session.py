"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "playlens", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the session comes from the launcher."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """Unix-second arithmetic on zone-less timestamps only agrees across engines in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the session names it.

    Only a local session, whose executors share the driver's disk, may fall back to a fresh folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared root, never reused between runs."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """While it lasts, stages whose generated methods are too large for the JVM to compile (8000 bytes) run operator by operator,
    with expressions split into methods that it does compile: long rules are several times as fast so."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as compressed files of the shared folder: for a large table that is read more than once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``; it outlives the executors that computed it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(os.path.join(shared_root(df.sparkSession), "checkpoints"))
    return df.checkpoint(eager=True)
