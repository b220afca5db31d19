"""What several of these operators need: table reading, slim Arrow input, word caches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.shared import materialise

#: Words by the contract: runs of anything but ASCII space and tab..carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that Python looks at together: long texts must fit a Python worker's memory together.
BATCH_ROWS = 1024
#: Entries a word cache keeps in one Python worker; words beyond it are computed anew each time.
CACHE_ENTRIES = 200_000
#: Longer words are never kept in a cache.
CACHE_WORD_BYTES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """glibc's function that hands free pages back, or None where there is no such library."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Hand free memory back to the machine: a Python worker serves one stage after another, and what one has freed another cannot always use."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` by slices of at most ``rows`` rows.

    Spark bounds a batch by bytes; what Python makes of it is bounded by the
    slices, and the memory of a batch is given back when it is done.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)
            del batch
            give_back()

    return df.mapInArrow(lambda batches: f(slices(batches)), schema)


def written(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``materialise`` with Arrow batches of at most ``rows`` rows; the session's own setting is back afterwards."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return materialise(df, name)
    finally:
        conf.set(key, before)


def fresh(taken: list[str], name: str) -> str:
    """``name``, made longer until no column has it (Spark compares names without case)."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def utf8(name: str) -> Column:
    """A text column as its UTF-8 bytes."""
    return F.col(name).cast("binary").alias(name)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


class BoundedCache(dict):
    """A dict that computes missing entries and stops growing at a bound.

    A Python worker serves one operation after another: ``claim`` empties the
    caches of all other groups, so that they do not add up.
    """

    everyone: list[BoundedCache] = []
    owner = ""

    def __init__(self, compute, group: str, entries: int = CACHE_ENTRIES, longest: int = CACHE_WORD_BYTES):
        super().__init__()
        self.compute, self.group, self.entries, self.longest = compute, group, entries, longest
        BoundedCache.everyone.append(self)

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest and len(self) < self.entries:
            self[key] = value
        return value

    @classmethod
    def claim(cls, group: str) -> None:
        if cls.owner != group:
            for cache in cls.everyone:
                if cache.group != group:
                    cache.clear()
            cls.owner = group


_HASHES = BoundedCache(xxhash.xxh3_64_intdigest, "hashes")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, kept between the batches of a worker."""
    BoundedCache.claim("hashes")
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
