"""Exact duplicates of files and texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlens.sources.files import located

# Bytes.
HASH_CHUNK = 64 * 1024

_c = F.col


def content_key(content: Column) -> Column:
    """``<size>:<sha256 of the whole content>``, null for an empty file."""
    size = F.octet_length(content)
    return F.when(size > 0, F.concat(size.cast("string"), F.lit(":"), F.sha2(content.cast("binary"), 256)))


def duplicates(df: DataFrame, key: Column, item: str) -> DataFrame:
    """(key, n, first): the keys more than one item has. Only keys and ids are shuffled, counted on both sides of it."""
    return (
        df.select(key.alias("key"), item)
        .where(_c("key").isNotNull())
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min(item).alias("first"))
        .where(_c("n") > 1)
    )


def _words(b: bytes) -> int:
    import numpy as np

    return int(np.frombuffer(b[: len(b) // 8 * 8], dtype="<u8").sum(dtype=np.uint64))


def _by_ends(length: int, head: bytes, foot: bytes) -> str:
    return f"{(length + _words(head) + _words(foot)) % 2**64:016x}"


@F.pandas_udf(T.StringType())
def _end_hash(content: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        return None if b is None or len(b) < HASH_CHUNK else _by_ends(len(b), b[:HASH_CHUNK], b[-HASH_CHUNK:])

    return content.map(one)


def end_hash(files: DataFrame) -> DataFrame:
    """(path, length, hash): size and the words of both ends, mod 2^64. ``files`` as ``binaryFile`` reads them.

    A file shorter than one end has no such hash and gets the key of its whole content instead.
    """
    return files.select("path", "length", F.coalesce(_end_hash("content"), content_key(_c("content"))).alias("hash"))


def end_hash_of_files(files: DataFrame) -> DataFrame:
    """:func:`end_hash` of files that stay where they are: ``files`` is (path, length) as ``sources.writers.write_files``
    gives or ``sources.readers.list_files`` lists them.

    Each task opens its files and reads their two ends, 128 KiB of however long a file; shorter ones are read whole, an empty
    one has a null key (Spark lists no empty files). The length is the one found when the file is opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def one(path: str) -> tuple[int, str | None]:
            system, own = located(path)
            with system.open_input_file(own) as f:
                n = f.size()
                if n >= HASH_CHUNK:
                    return n, _by_ends(n, f.read_at(HASH_CHUNK, 0), f.read_at(HASH_CHUNK, n - HASH_CHUNK))
                return n, f"{n}:{hashlib.sha256(f.read()).hexdigest()}" if n else None

        for batch in batches:
            got = [one(p) for p in batch.column("path").to_pylist()]
            columns = [batch.column("path"), pa.array([n for n, _ in got], pa.int64()), pa.array([h for _, h in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "hash"])

    return files.select("path").mapInArrow(run, "path string, length long, hash string")
