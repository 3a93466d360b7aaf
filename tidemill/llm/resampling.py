"""Importance resampling towards a target's distribution of hashed features.

A feature's bucket is its crc32 modulo BUCKETS. What a bucket gains by the target is worked out from counts
alone, of which at most BUCKETS rows are left; the gains stand in the plan as one literal array. Higher-order
functions turn a document into its buckets and those into its weight, so scoring explodes and shuffles
nothing. Gumbel noise, fixed by the seed and the doc_id, makes the highest scores a sample without
replacement. Scores are whole numbers in a range that the counts bound, so a histogram of them finds the
lowest one drawn, and only rows that high are put in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import staged
from .line_dedup import LOWER, UPPER

#: What stands between words: all of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Features are runs of so many words.
LEAST_WORDS, MOST_WORDS = 1, 1
#: Documents of at least so many words take part, and so many percent of them are drawn.
ELIGIBLE_WORDS, PERCENT = 20, 10
SEED = 2024


def words_of(text: Column) -> Column:
    """The words of a text, A to Z in lower case; null counts as no text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def features_of(words: Column, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> Column:
    """All runs of least to most consecutive words, joined by blanks, repeats kept."""

    def runs(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return words if n == 1 else F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    each = [runs(n) for n in range(least, most + 1)]
    return each[0] if len(each) == 1 else F.concat(*each)


def bucketed(docs: DataFrame, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words and buckets (an array with a bucket a feature) of every row."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), words_of(docs["text"].cast("string")).alias("words"))
    buckets = F.transform(features_of(F.col("words"), least, most), lambda f: (F.crc32(f.cast("binary")) % BUCKETS).cast("int"))
    if (least, most) == (1, 1):  # a feature a word: the words needn't be kept for their number
        return own.select("doc_id", buckets.alias("buckets")).select("doc_id", F.size("buckets").alias("n_words"), "buckets")
    return own.select("doc_id", F.size("words").alias("n_words"), buckets.alias("buckets"))


def totals(buckets: DataFrame) -> DataFrame:
    """(bucket, n): how often each is found. Tasks send a row per bucket at most."""
    return buckets.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(spark, all_: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain, from two tables of totals(); a bucket without features has one as well."""
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(all_.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c, add: (F.col(c) + add).cast("double")
    ratio = (real("t", 1) * real("all_s", BUCKETS)) / (real("s", 1) * real("all_t", BUCKETS))
    rows = both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return out


def weight_of(buckets: Column, gain: np.ndarray) -> Column:
    """The floored mean of the gains of a document's buckets; 0 of none."""
    # One literal of all gains: handed over as a text, which Spark folds into an array before the query runs.
    held = F.split(F.lit(",".join(map(str, gain.tolist()))), ",").cast("array<bigint>")
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.element_at(held, b + 1))
    return _floored(total, F.size(buckets).cast("long"))


def _floored(total: Column, n: Column) -> Column:
    struct = F.array(F.struct(total.alias("t"), n.alias("n")))
    return F.element_at(F.transform(struct, lambda x: F.when(x["n"] == 0, F.lit(0).cast("long")).otherwise(((x["t"] - F.pmod(x["t"], F.greatest(x["n"], F.lit(1)))) / F.greatest(x["n"], F.lit(1))).cast("long"))), 1)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, by the seed and the doc_id (null: as an id without digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least: int = LEAST_WORDS, most: int = MOST_WORDS, eligible_words: int = ELIGIBLE_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row.

    docs and target have texts (target's in its column text); a null one has no words, so weight 0. Ties of
    score go to the smaller doc_id, null first; rows of one doc_id and score are ranked in any order, each with a
    rank of its own. An empty table gives no rows; an empty target leaves gains to the smoothing alone.
    """
    spark = docs.sparkSession
    held = staged(bucketed(docs, least, most), "buckets")
    other = bucketed(target.select(F.lit(0).alias("doc_id"), target["text"].alias("text")), least, most)
    gain = gains(spark, totals(held), totals(other))
    scored = held.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight_of(F.col("buckets"), gain).alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id())
    scored = staged(scored, "scores")
    eligible = F.col("n_words") >= eligible_words
    # A row per score: gains and noise lie within about -40,000 and 60,000, whatever the number of documents.
    counts = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.select("score", F.coalesce(higher, F.lit(0)).alias("higher"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    found = sums.where(F.col("higher") < F.expr(f"`all` * {int(percent)} div 100")).agg(F.min("score").alias("lowest"), F.expr(f"max(`all` * {int(percent)} div 100)").alias("k")).first()
    plain = ["doc_id", "n_features", "weight", "score"]
    if found["k"] is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    drawn = eligible & (F.col("score") >= found["lowest"])
    ranked = numbered(scored.where(drawn).select(*plain, "place"), [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("place")], name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= found["k"], F.col("rank")))
    return scored.where(~drawn).select(*plain, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*plain, "rank"))


#: The same in DuckDB SQL, with crc32 over the distinct words by a table made from its polynomial.
RESAMPLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT doc_id, text, 0 AS side FROM documents UNION ALL SELECT item_id::BIGINT, text, 1 FROM benchmark),
words AS (
  SELECT doc_id, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), crc),
each AS (SELECT doc_id, side, bucket FROM words JOIN hashed USING (w)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM each GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT doc_id, count(*)::BIGINT AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""
