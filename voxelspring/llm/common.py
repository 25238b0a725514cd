"""What the operators share: reading tables, intermediate tables, tokens and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.storage import drop_stored, shared_dir, stored

__all__ = ["drop_stored", "shared_dir", "stored"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder; its partitions stay as they are."""
    folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at [\\x20\\x09-\\x0D]: what bytes.lower() and bytes.split() do."""
    return [] if text is None else text.encode("utf-8").lower().split()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words; fewer words make one run; no words make none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : n - size + 1 + i]
        out ^= out >> np.uint64(29)
    return mix64(out)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def as_batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def crc_bucket(column: str, buckets: int):
    """crc32 of an id written as text, modulo buckets; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets
