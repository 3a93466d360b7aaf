"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC, case-folded, NFKC again, its white space runs single blanks. Its
fingerprint is the 128-bit xxhash of that form in hexadecimal. Forms with equal hashes are compared byte
by byte; should they differ, each further form gets a suffix, so equal fingerprints mean equal forms.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .filters import Filter, filter_of

#: Documents in an ordered run, and the number of runs beyond which runs grow instead.
RUN_DOCS, MOST_RUNS = 1000, 20_000
_LOWEST = -(1 << 63)


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; null text is empty; repeated rows get a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    hashed = staged(plain.mapInArrow(run, "doc_id long, fingerprint string"), "fingerprints")
    repeated = staged(hashed.groupBy(F.col("fingerprint").alias("hash")).count().where("count > 1").select("hash"), "repeated")
    forms = _forms(plain, filter_of(repeated.select(F.xxhash64("hash").alias("at"))))
    return _told_apart(hashed.withColumn("hash", F.col("fingerprint")), forms, ["fingerprint"]).drop("hash")


def _forms(plain: DataFrame, wanted: Filter) -> DataFrame:
    """doc_id, hash and canonical form of the documents whose hash may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f) for f in forms], pa.string()), pa.array(forms, pa.binary())], names=["doc_id", "hash", "form"])

    return wanted.marked(plain.mapInArrow(run, "doc_id long, hash string, form binary"), F.xxhash64("hash"), "wanted").where("wanted").drop("wanted")


def _told_apart(rows: DataFrame, forms: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the fingerprints in columns told apart where equal hashes hide different forms.

    The comparison is a minimum and a maximum of the bytes in each bucket, so copies meet already where
    they are read. Buckets whose bytes differ are next to never found; only those are ranked.
    """
    differ = staged(forms.groupBy("hash").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("hash"), "collisions")
    if differ.isEmpty():
        return rows
    kinds = staged(forms.join(differ, "hash", "left_semi"), "collided")
    rank = F.dense_rank().over(Window.partitionBy("hash").orderBy("form")) - 1
    ranks = kinds.join(kinds.select("hash", "form").distinct().withColumn("rank", rank), ["hash", "form"]).where("rank > 0")
    ranks = ranks.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "rank").distinct()
    for column in columns:
        hit = rows.join(ranks, rows.doc_id.eqNullSafe(ranks.d) & (rows[column] == ranks.h), "left")
        rows = hit.withColumn(column, F.when(F.col("rank").isNull(), F.col(column)).otherwise(F.concat_ws("-", column, F.col("rank").cast("string")))).drop("d", "h", "rank")
    return rows


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and whether they and the next document's agree.

    The next document is that of the next smaller doc_id; after the smallest comes the largest. Null
    doc_ids count as smallest; documents with equal doc_ids come in the order of their texts. Null text
    is empty; a table of one document has that one next; an empty table gives no rows.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = plain.count()
    runs = max(1, min(MOST_RUNS, -(-n // RUN_DOCS)))
    cuts = np.array(sorted(set(plain.approxQuantile("id", [i / runs for i in range(1, runs)], 0.0 if n < 1_000_000 else 0.1 / runs)) if runs > 1 else []), np.float64)

    @F.pandas_udf("int")
    def run_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.float64), "right").astype(np.int32))

    placed = plain.withColumn("run", run_of("id"))
    #: One row per run, at most MOST_RUNS.
    tops = sorted((r["run"], r["top"]) for r in placed.groupBy("run").agg(F.max("id").alias("top")).collect())
    # Each run also gets the first document of the run below it, and the lowest run that of the highest.
    to = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    if not to:
        to = {0: 0}
    lent_ids = sorted(to)
    lent_runs = np.array([to[k] for k in lent_ids], np.int32)

    @F.pandas_udf("int")
    def lent_to(ids):
        import pandas as pd

        return pd.Series(lent_runs[np.searchsorted(np.array(lent_ids, np.int64), ids.to_numpy(np.int64))])

    lent = plain.where(F.col("id").isin(lent_ids)).withColumn("run", lent_to("id"))
    both = placed.withColumn("lent", F.lit(False)).unionByName(lent.withColumn("lent", F.lit(True)))
    ordered = both.repartition("run").sortWithinPartitions("run", "lent", F.col("id").desc(), "text").select("run", "lent", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            """(document, next document) with their ids, in order."""
            held = None  # (run, doc_id, text), waiting for its next
            for batch in batches:
                for number, is_lent, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held is not None and held[0] == number:
                        yield held[1], held[2], doc_id, text or ""
                    held = None if is_lent else (number, doc_id, text or "")
            if held is not None:
                raise ValueError("a run ends without the next document")

        rows, chars, last = [], 0, (None, None)
        for doc_id, text, next_id, following in pairs():
            edited = edited_text(text, following)
            form = last[1] if last[0] is text else canonical(text)
            changed, after = canonical(edited), canonical(following)
            last = (following, after)
            rows.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(form), digest(changed), float(form == changed), float(form == after), next_id))
            chars += len(text)
            if len(rows) >= 2000 or chars > 4_000_000:
                yield batch_of(rows)
                rows, chars = [], 0
        if rows:
            yield batch_of(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_id long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows = staged(ordered.mapInArrow(run, schema), "edits")
    own, other = F.col("fingerprint"), F.col("edited_fingerprint")
    hashes = rows.select(F.explode(F.when(own == other, F.array(own)).otherwise(F.array(own, other))).alias("hash"))
    repeated = staged(hashes.groupBy("hash").count().where("count > 1").select("hash"), "repeated")
    forms = _forms(plain.select("doc_id", "text"), filter_of(repeated.select(F.xxhash64("hash").alias("at"))))
    edits = rows.where(own != other).join(repeated, other == F.col("hash"), "left_semi").select("doc_id", "next_id", "edited_fingerprint")
    edits = staged(edits, "repeated-edits")
    if not edits.isEmpty():
        forms = forms.unionByName(_edited_forms(plain, edits))
    return _told_apart(rows, forms, ["fingerprint", "edited_fingerprint"]).drop("next_id")


def _edited_forms(plain: DataFrame, edits: DataFrame) -> DataFrame:
    """The canonical forms of edited texts whose hashes are repeated, made again from their two documents."""
    ids = edits.select(F.explode(F.array("doc_id", "next_id")).alias("x")).select(F.xxhash64(F.coalesce("x", F.lit(_LOWEST))).alias("at"))
    texts = filter_of(ids).marked(plain, F.xxhash64("id"), "wanted").where("wanted").select("id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = edits.withColumn("a", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("b", F.coalesce("next_id", F.lit(_LOWEST)))
    both = keyed.join(texts.withColumnRenamed("id", "a"), "a").join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "following"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for doc_id, hash_, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                form = canonical(edited_text(text, following))
                if digest(form) == hash_:  # of documents with equal doc_ids, the right ones
                    kept.append((doc_id, hash_, form))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "hash", "form"])

    return both.select("doc_id", "edited_fingerprint", "text", "following").mapInArrow(run, "doc_id long, hash string, form binary")
