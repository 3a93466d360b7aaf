"""A corpus pipeline over documents: each stage reads all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import jaccard_join, mixing, packing, quality_rules, secrets
from tidemill.llm.common import drop_staged, scope, staged
from tidemill.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy keeps.

    Null and empty texts have no words and go; null doc_ids are judged by their texts; rows alike stay or go together.
    """
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id (of rows that share it, one)."""
    return jaccard_join.keep_one(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words have no share and go; null sources are a source of their own; rows that share a
    doc_id (or have none) are taken each by itself. Copies are equal in all columns.
    """
    return mixing.repeat_documents(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 2048 tokens.

    A null or empty text is the end id alone; rows that share a doc_id (copies of the mix) have pieces each.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", redaction), ("mixing", mixture), ("packing", packs)]

#: Tokenization is beyond SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what each stage returns is written and read again, and goes when the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            kept = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), outside=True)
        if name != STAGES[0][0]:
            drop_staged(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
