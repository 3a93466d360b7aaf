"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the measurements and one integer whose
bit i is set where rule i failed. A policy is a named, versioned mask of bits: applying another policy,
or working out what a rule alone rejects, reads the ledger and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, words_of

#: Rule names by bit, fixed: a policy's mask refers to these places. New rules go at the end.
RULES = (
    "few_words", "repeated_trigrams", "word_length", "symbols", "duplicate_lines", "no_letters", "few_distinct_words",
    "table_bars", "shouting",
)
#: The two rules of the base; every policy has them.
BASE = ("few_words", "repeated_trigrams")
#: Policies by version.
POLICIES = {"base": BASE, "v1": (*BASE, "word_length", "symbols", "duplicate_lines", "no_letters", "few_distinct_words"), "v2": RULES}


def mask(policy: str) -> int:
    return sum(1 << RULES.index(name) for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, of a column whose plan keeps it as it is."""
    n = F.size(words)
    window = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), window))


def ledger(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id, the measurements, failed (the bitmask) of every document; null text has no words.

    carry: a column to take along under the name carry. Repeated rows and null doc_ids get a row each;
    an empty table gives none; columns besides doc_id and text are not read.
    """
    also = [] if carry is None else [carry.alias("carry")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *also)
    held = held.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    held = held.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\|", ""))).cast("long").alias("n_bars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        _repeat_words(F.col("words")).alias("windows"), *(["carry"] if also else []),
    )
    # Only texts with a repeated window go on to find where: neighbours in sorted (window, place) pairs.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    held = held.drop("words").withColumn("pairs", pairs).drop("windows")
    twice = F.filter("pairs", lambda p, k: (F.get("pairs", k - 1)["h"] == p["h"]) | (F.get("pairs", k + 1)["h"] == p["h"]))
    held = held.withColumn("places", F.transform(twice, lambda p: p["i"])).drop("pairs")
    covered = F.array_distinct(F.flatten(F.transform("places", lambda i: F.array(i, i + 1, i + 2))))
    held = held.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).drop("places")
    held = held.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)))
    n = F.col("n_words")
    failed = {
        "few_words": n < 50,
        "repeated_trigrams": 100 * F.col("n_repeat_words") > 50 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n),
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "duplicate_lines": (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "no_letters": 2 * F.col("n_letters") < F.col("word_chars"),
        "few_distinct_words": (n >= 50) & (100 * F.col("n_distinct_words") < 5 * n) & (F.col("n_distinct_words") < 100),
        "table_bars": 10 * F.col("n_bars") > n,
        "shouting": 2 * F.col("n_upper") > F.col("n_letters"),
    }
    bits = [F.when(failed[name], F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return held.withColumn("failed", total.cast("long"))


def judged(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """base_failed and kept of ledger rows under a policy."""
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy) | mask("base"))) == 0)


def lone_rule(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """rows with the one rule of the policy for which a document goes (null: kept, or rejected by several)."""
    failed = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    return rows.withColumn("lone_rule", F.when(F.bit_count(failed) == 1, F.element_at(F.array(*map(F.lit, RULES)), F.bit_count(failed - 1) + 1)))


def ablations(rows: DataFrame) -> DataFrame:
    """For every policy and rule in it: documents that fail the rule, and those kept again if it alone is dropped."""
    failed, sums = F.col("failed"), []
    names = [(policy, rule) for policy in POLICIES for rule in POLICIES[policy]]
    for policy, rule in names:
        bit, whole = 1 << RULES.index(rule), mask(policy)
        sums += [F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"{policy}.{rule}.failed"), F.count_if(failed.bitwiseAND(F.lit(whole)) == bit).alias(f"{policy}.{rule}.alone")]
    once = rows.agg(*sums)
    entries = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col(f"`{p}.{r}.failed`").alias("n_failed"), F.col(f"`{p}.{r}.alone`").alias("n_only_this")) for p, r in names]
    return once.select(F.explode(F.array(*entries)).alias("x")).select("x.*")


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ledger of all documents and reads it back: judged(), lone_rule() and ablations() of any policy need no text any more."""
    rows = ledger(docs)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def filter_documents(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that the policy keeps, all columns; the rules read them in the same pass.

    The observed counts also keep the optimizer from moving the filter below the measurements, where it
    would work each of them out again wherever it is mentioned.
    """
    rows = judged(ledger(docs, F.struct(*(docs[c] for c in docs.columns))), policy)
    seen = rows.observe(f"quality_rules_{policy}", F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept"))
    return seen.where("kept").select("carry.*")


#: The query's columns in DuckDB SQL.
RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
o AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, x, lead(x) OVER v AS y, lead(x, 2) OVER v AS z FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM g WHERE z IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(t) - length(replace(t, '|', '')) AS n_bars, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(list_distinct(ws)) AS n_distinct,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars < 2 * n_words OR word_chars > 14 * n_words, 10 * n_symbols > 3 * n_words,
    n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines, 2 * n_letters < word_chars,
    n_words >= 50 AND 100 * n_distinct < 5 * n_words AND n_distinct < 100, 10 * n_bars > n_words, 2 * n_upper > n_letters] AS rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rules[1] OR rules[2] AS base_failed,
  NOT list_contains(rules, true) AS kept,
  list_sum([CASE WHEN rules[i] THEN 1 << (i - 1) ELSE 0 END for i in range(1, 10)])::BIGINT AS failed,
  CASE WHEN len(list_filter(rules, lambda r: r)) = 1 THEN
    ['few_words', 'repeated_trigrams', 'word_length', 'symbols', 'duplicate_lines', 'no_letters', 'few_distinct_words', 'table_bars', 'shouting'][list_position(rules, true)] END AS lone_rule
FROM f
"""
