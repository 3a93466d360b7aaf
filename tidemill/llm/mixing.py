"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, so its prefix sum is its rank
times that number. One offset per source is added, and a document is emitted once per integer that its
interval crosses. Documents are ranked by size, so that large and small ones are taken evenly and the
words taken stay near the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .jaccard_join import has_repeated_ids

#: Weights by the place of a source in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own size.
MOST = 3

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text (null: 0). No UTF-8 byte of another character is white space, so bytes will do."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_binary(texts.type) else texts.cast(pa.large_string()).cast(pa.large_binary())
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(raw):
        return np.zeros(len(texts), np.int64)
    offsets = offsets - offsets[0]
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = word[firsts]
    counts = np.concatenate([[0], np.cumsum(begins)])
    return counts[offsets[1:]] - counts[offsets[:-1]]


def sizes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, source, size and key (0 without one) of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_words(batch.column(2))), batch.column(3)], names=["doc_id", "source", "size", "key"])

    own = F.lit(0).cast("long") if key is None else F.col(key)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("binary"), own.alias("key"))
    return plain.mapInArrow(count, "doc_id long, source string, size long, key long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, n_docs and target.

    Sources ordered by cap over weight reach their caps one after another; the first that doesn't reach
    it, and all after it, share the rest by weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    ranked = by_source.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    to_here, from_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = whole - (F.sum("cap").over(to_here) - F.col("cap"))
    filled = ranked.withColumn("left", left).withColumn("weights", F.sum("weight").over(from_here))
    free = F.col("cap") * F.col("weights") > F.col("left") * F.col("weight")
    filled = filled.withColumn("nth", F.row_number().over(order)).withColumn("free", free)
    first = F.min(F.when(F.col("free"), F.struct("nth", "left", "weights"))).over(Window.partitionBy(F.lit(0)))
    filled = filled.withColumn("first", first)
    share = F.col("first.left") * F.col("weight") / F.col("first.weights")
    target = F.when(F.col("nth") >= F.col("first.nth"), share).otherwise(F.col("cap").cast("double"))
    return filled.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def offset_of(source, seed: int):
    """The one random offset of a source, in [0, 1), fixed by the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("\x00")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def mix_documents(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies * size) and key.

    key: a column of longs that tells rows of one doc_id apart; it goes along (0 without one).

    Null text has size 0; null sources form one source, ordered last; null doc_ids rank first. Repeated
    rows are documents of their own: of equal ones it doesn't matter which is taken. A source without
    words has target 0 and no copies. Empty tables give no rows.
    """
    sized = staged(sizes(docs, key), "sizes")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            n, source = batch.num_rows, batch.column(1)
            coded = source.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.concatenate([[0], np.flatnonzero(np.diff(coded)) + 1])
            at = np.arange(n)
            first = np.zeros(n, np.int64)
            first[new] = new
            ranks = at - np.maximum.accumulate(first)
            if last == (source[0].as_py(),):
                ranks[: new[1] if len(new) > 1 else n] += done
            last, done = (source[n - 1].as_py(),), int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ranks)], names=["doc_id", "source", "size", "key", "part", "rank"])

    order = [F.col("source").asc_nulls_last(), "size", "doc_id", "key"]
    ranked = staged(sized.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(rank, "doc_id long, source string, size long, key long, part int, rank long"), "ranks")
    #: A row per range partition and source in it: at most one more than partitions and sources together.
    runs = ranked.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    facts = runs.join(targets(sized, weights, most).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    facts = facts.withColumnRenamed("source", "s").withColumnRenamed("part", "p")
    both = ranked.join(facts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("rank") + F.col("before")
    u = offset_of(F.col("source"), seed)
    copies = F.least(F.floor(each * (place + 1) + u) - F.floor(each * place + u), F.lit(most)).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


#: The same mix in DuckDB SQL, seed 0.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
    [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM by_source),
filled AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER w - cap))::BIGINT AS rest,
    (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights,
    row_number() OVER (ORDER BY cap / weight, place) AS nth
  FROM ranked WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
free AS (SELECT nth, rest, weights FROM filled WHERE cap * weights > rest * weight ORDER BY nth LIMIT 1),
shares AS (
  SELECT f.source, f.source_size,
    CASE WHEN f.nth >= x.nth THEN x.rest * f.weight / x.weights ELSE f.cap::DOUBLE END AS target,
    ('0x' || substr(md5(coalesce(f.source, chr(0)) || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM filled f LEFT JOIN free x ON true),
placed AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, h.u,
    CASE WHEN h.source_size > 0 THEN h.target / h.source_size ELSE 0 END AS each,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS rank
  FROM sized s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
  (least(floor(each * (rank + 1) + u) - floor(each * rank + u), 3) * size)::BIGINT AS taken
FROM placed
"""


def repeat_documents(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it (not at all, or up to most times).

    The copies find their documents by doc_id. Where doc_ids repeat (null ones included), rows get a key of
    their own first, so that rows alike in all need not gather anywhere.
    """
    columns = docs.columns
    whole = F.struct(*(docs[c] for c in columns)).alias("row")  # so that no name clashes
    held = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].alias("text"), whole)
    key = "doc_id"
    if has_repeated_ids(held.select("doc_id")):
        held, key = staged(held.withColumn("key", F.monotonically_increasing_id()), "keyed"), "key"
    chosen = mix_documents(held, seed, weights, most, None if key == "doc_id" else key).where("copies > 0")
    chosen = chosen.select(F.col(key).alias("of"), F.col("copies").cast("int").alias("copies"))
    joined = held.select(key, "row").join(chosen, F.col(key).eqNullSafe(F.col("of")))
    times = joined.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("again"))
    return times.select(*(F.col("row")[c].alias(c) for c in columns))
