"""Buckets of blobs: how many, which partition each goes to, and how they are read back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents per bucket, and the most buckets.
BUCKET_DOCS, MOST_BUCKETS = 4000, 4096


def buckets_for(n_docs: int) -> int:
    return min(MOST_BUCKETS, max(8, -(-n_docs // BUCKET_DOCS)))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur 3 with seed 42) of ints."""
    with np.errstate(over="ignore"):
        turned = lambda v, by: (v << np.uint32(by)) | (v >> np.uint32(32 - by))
        k = turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


@lru_cache(maxsize=8)
def spread(n: int) -> tuple[int, ...]:
    """For each of n partitions, an int that Spark deals to it."""
    size = 32 * n
    while True:
        to, first = np.unique(spark_hash(np.arange(size, dtype=np.int64)).astype(np.int64) % n, return_index=True)
        if len(to) == n:
            return tuple(first.tolist())
        size *= 2


def dealt(rows: DataFrame, bucket: Column, n: int) -> DataFrame:
    """rows with each of n buckets (a column of 0 to n - 1) in a partition of its own, sorted by the column bucket."""
    key = F.get(F.array(*map(F.lit, spread(n))), bucket)
    return rows.repartition(n, key).sortWithinPartitions("bucket")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket, of batches sorted by bucket."""
    last, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != last and blobs:
                yield last, blobs
                blobs = []
            last = bucket
            blobs.append(blob)
    if blobs:
        yield last, blobs
