"""Token-id shards with a minimal perfect hash index.

A shard is one binary value: a header, the raw little-endian ids of its documents in ascending doc_id
order, the documents' offsets, and an index. The index is a minimal perfect hash: each level hashes the
keys left into a bit array and keeps those alone in their bit; a key's slot is the number of bits set
before its own. A slot stores a 32-bit fingerprint of its key and the document's place, so a lookup
costs one probe per level and one comparison, and foreign keys are refused but for one in 2**32.

Shards are in the order of their keys, and each row says which doc_ids its shard holds (and Parquet keeps
the range of every row group), so a keyed read opens the shard that has the key and no other.

Shards are rows of a Parquet table: Spark's committer writes them, so a lost executor's shards are
written again, and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path
from .tokens import encoder

#: Ids and documents in a shard at most (one long document may be more).
SHARD_IDS, SHARD_DOCS = 2_000_000, 65_536
MAGIC = b"TMIDS1\0\0"
_HEAD = struct.Struct("<8sIIQQI")  # magic, bytes an id, levels, documents, ids, key seed
_GAMMA = 2


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (splitmix) over uint64 values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys_of(doc_ids: np.ndarray, nth: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id, its nth occurrence in the shard); a null doc_id has its own key."""
    with np.errstate(over="ignore"):
        return mix(mix(doc_ids.astype(np.int64).view(np.uint64), 1) + nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64), 2)


@dataclass
class PerfectHash:
    levels: list[np.ndarray]  # of bool, one array a level
    before: list[np.ndarray]  # bits set before each position, over all levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64 values."""
        levels, left = [], keys
        while len(left):
            bits = max(64, _GAMMA * len(left))
            at = mix(left, 11 + len(levels)) % np.uint64(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            levels.append(alone)
            left = left[~alone[at.astype(np.int64)]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls.of(levels)

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> PerfectHash:
        before, total = [], 0
        for bits in levels:
            counts = np.cumsum(bits)
            before.append(counts - bits + total)
            total += int(counts[-1])
        return cls(levels, before)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some keys that were not in build()."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = (mix(keys[open_], 11 + n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 3) >> np.uint64(32)).astype("<u4")


def write_shard(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """A shard of documents in order; offsets has one more entry than doc_ids."""
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"an id needs more than {width} bytes")
    nth = occurrences(doc_ids, null)
    keys = keys_of(doc_ids, nth, null)
    index = PerfectHash.build(keys)
    slot = index.slots(keys)
    place, prints = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4")
    place[slot], prints[slot] = np.arange(len(keys)), fingerprints(keys)
    parts = [
        _HEAD.pack(MAGIC, width, len(index.levels), len(keys), len(ids), 1),
        ids.astype(f"<u{width}").tobytes(), offsets.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(),
        null.astype(np.uint8).tobytes(), place.tobytes(), prints.tobytes(),
    ]
    for bits in index.levels:
        parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
    return b"".join(parts)


def occurrences(doc_ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many times the same doc_id came before, for doc_ids in order."""
    if not len(doc_ids):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (doc_ids[1:] != doc_ids[:-1]) | (null[1:] != null[:-1])])
    at = np.arange(len(doc_ids))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Shard:
    """A shard opened for reading."""

    def __init__(self, raw: bytes) -> None:
        magic, width, levels, n, total, _ = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.ids, self.offsets, self.doc_ids = take(f"<u{width}", total), take("<u8", n + 1).astype(np.int64), take("<i8", n)
        self.null, self.place, self.prints = take("u1", n).astype(bool), take("<u4", n), take("<u4", n)
        bits = []
        for _ in range(levels):
            size = int(take("<u8", 1)[0])
            bits.append(np.unpackbits(take("u1", -(-size // 8)), count=size).astype(bool))
        self.index = PerfectHash.of(bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's document in this shard, -1 where it has none."""
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        return np.where(known, self.place[np.where(known, slot, 0)].astype(np.int64) if len(self.place) else -1, -1)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of a document by its key (None: the null one)."""
        at = self.find(keys_of(np.array([doc_id or 0]), np.array([nth]), np.array([doc_id is None])))[0]
        return None if at < 0 else self.ids[self.offsets[at] : self.offsets[at + 1]]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, kind: str = "byte", width: int = 2) -> None:
    """Writes all documents' ids, each followed by end_id, in ascending doc_id order (null first), as shards under path.

    width: bytes an id (2 for vocabularies under 65,536). Documents with the same doc_id come in the
    order of their texts, and may be spread over shards; null text is empty; an empty table writes no
    shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            nonlocal held, before
            doc_ids, null, ids, size = (np.concatenate(x) for x in zip(*held, strict=True))
            raw = write_shard(doc_ids, null, ids, np.concatenate([[0], np.cumsum(size)]), width)
            known = doc_ids[~null]
            longs = [before, len(ids), len(doc_ids), int(null.sum()), int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None]
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in longs), pa.array([raw], pa.binary())], names=["part", "before", "n_ids", "n_docs", "n_null", "first_id", "last_id", "shard"])
            held, before = [], before + len(ids)
            return out

        docs_held = ids_held = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                ids, cut = enc.encode(some.column(1))
                ids, cut = np.insert(ids, cut[1:], end_id), cut + np.arange(len(cut))
                null = some.column(0).is_null().to_numpy(zero_copy_only=False)
                doc_ids = some.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for a in range(0, len(doc_ids), 512):
                    b = min(a + 512, len(doc_ids))
                    held.append((doc_ids[a:b], null[a:b], ids[cut[a] : cut[b]], np.diff(cut[a : b + 1])))
                    docs_held, ids_held = docs_held + b - a, ids_held + int(cut[b] - cut[a])
                    if docs_held >= SHARD_DOCS or ids_held >= SHARD_IDS:
                        yield shard()
                        docs_held = ids_held = 0
        if held:
            yield shard()

    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    (
        plain.repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(write, "part int, before long, n_ids long, n_docs long, n_null long, first_id long, last_id long, shard binary")
        .write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    )


def find_document(spark, path: str, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
    """The ids of the nth document (from 0) with a doc_id in the shards under path; None if there is none.

    The range of doc_ids is pushed down to the scan, so of all shards those that may hold the key are
    read: one, or those over which a doc_id's repeated rows spread.
    """
    held = F.col("n_null") > 0 if doc_id is None else (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    for row in spark.read.parquet(path).where(held).select("part", "before", "shard").orderBy("part", "before").toLocalIterator():
        shard = Shard(bytes(row["shard"]))
        if (ids := shard.get(doc_id, nth)) is not None:
            return ids
        nth -= int(np.count_nonzero(shard.null if doc_id is None else (shard.doc_ids == doc_id) & ~shard.null))
    return None


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document of the shards under path: each is looked up by its key in its shard's index."""
    shards = spark.read.parquet(path)
    #: One row per written partition reaches the driver, however many documents there are.
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, done = {}, 0
    for part, n in totals:
        bases[part] = done
        done += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, base = Shard(raw), bases[part] + before
                at = shard.find(keys_of(shard.doc_ids, occurrences(shard.doc_ids, shard.null), shard.null))
                if (at < 0).any():
                    raise ValueError("a key is missing from its shard's index")
                begin, end = shard.offsets[at], shard.offsets[at + 1]
                data = memoryview(shard.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=shard.null), pa.array(begin + base), pa.array(end - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the shards to the shared folder and reads every document back from them."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path)
