"""What the operators of this package share: staging tables, word splitting and 64-bit mixing."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.staging import arrow_uri, fresh_path, release, scoped, stage  # noqa: F401

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows where the session has the default of 10,000: whole texts are large, and both sides keep buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    small_batches(df.sparkSession)
    return stage(df, name)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text, b'' for null."""
    at = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in at.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of a batch in Python stays small however many rows Arrow sends at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of splitmix64 over unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met last; cleared when full, so its memory is bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        claim("words", self.clear)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One table for all operators that hash words.
WORDS = WordHashes()
_OWNER: list = []


def claim(owner: str, clear) -> None:
    """Workers go from one operator to the next; the tables of the one before are cleared when another one's begin."""
    if _OWNER and _OWNER[0][0] != owner:
        _OWNER.pop()[1]()
    if not _OWNER:
        _OWNER.append((owner, clear))


@contextmanager
def uncollected():
    """No cycle collection inside: for loops that fill large tables and make no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n hashes, in order."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + m]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return mix64(out)
