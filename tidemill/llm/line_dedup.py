"""Line dedup: lines that many documents share are dropped, but for those of the last document that has them.

Lines are exploded and normalised, and their keys hashed to 128 bits. A hash's documents are counted in two
steps, by hash and document first, so a line that a third of all documents have meets in no task. Hashes
over the threshold meet the lines again, and each text loses its lines by position. All of it is built-in
functions; texts with no line to lose pass a filter where they are read and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, let, scope, staged
from .filters import filter_of

#: A line counts from so many code points of its key on, and goes if so many documents have it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: ASCII white space, and the letters that a key has in lower case.
SPACE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = ["id", "text_a", "text_b"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a missing or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A to Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hashes(text: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits of hash in two columns."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """A document's id and text, with a key of the row that rows of one id and different texts don't share."""
    own = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.struct(*(docs[c] for c in columns)).alias("row"))
    return own.select("id", *hashes(F.col("text"), ("text_a", "text_b")), "text", "row")


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The row, position and hashed key of every line that is long enough to count."""
    each = keyed(docs, ["doc_id"]).select(*_ROW, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return each.where(F.length(F.btrim("line", F.lit(SPACE))) >= least_chars).select(*_ROW, "pos", *hashes(line_key(F.col("line")), ("key_a", "key_b")))


def shared_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Keys found in at least so many documents, with their number of documents and the largest doc_id."""
    once = lines.select("key_a", "key_b", "id").distinct()  # by key and document, so no key is hot
    return once.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last")).where(F.col("n_docs") >= least_docs)


def _with_gone(docs: DataFrame, columns: list[str], least_chars: int, least_docs: int) -> DataFrame:
    """keyed() with gone: the positions of the lines that a text loses (null: none)."""
    with scope(docs.sparkSession):
        lines = staged(long_lines(docs, least_chars), "lines")
        shared = staged(shared_keys(lines, least_docs), "shared")
        lost = lines.join(shared, ["key_a", "key_b"]).where(F.col("id").isNull() | (F.col("id") < F.col("last")))
        # Rows alike in id and text lose the same positions: a set has no more of them than the text has lines.
        gone = staged(lost.groupBy(*_ROW).agg(F.collect_set("pos").alias("gone")), "gone", outside=True)
        marks = filter_of(gone.select("text_a"), outside=True)
    own = marks.marked(keyed(docs, columns), F.col("text_a"), "maybe")
    none = own.where("not maybe").withColumn("gone", F.lit(None).cast("array<int>"))
    other = gone.select(F.struct("text_a", "text_b", "id").alias("of"), "gone")
    asked = own.where("maybe").join(other, F.struct("text_a", "text_b", "id").eqNullSafe(F.col("of")), "left")
    return none.unionByName(asked.drop("of"))


def _kept(text: Column, gone: Column) -> Column:
    """A text without the lines at some positions; work is linear in lines, as array_except hashes."""
    whole = F.sequence(F.lit(0), F.size(lines_of(text)) - 1)
    rest = let(lines_of(text), lambda lines: F.transform(F.array_except(whole, gone), lambda i: F.get(lines, i)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(rest, "\n"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept (the text that stays) of every row.

    Null and empty texts have one empty line, and keep it as an empty text; a text that loses all its lines
    becomes empty. Rows with one doc_id are one document to the count, and so are all with a null doc_id, which
    ranks below every other; each row is cut by itself. Within a text, repeats of a line count once; in the
    document that keeps a line all its repeats stay. Empty tables give no rows.
    """
    own = _with_gone(docs, ["doc_id"], least_chars, least_docs)
    n_dropped = F.coalesce(F.array_size("gone"), F.lit(0))
    return own.select(F.col("row")["doc_id"].alias("doc_id"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), _kept(F.col("text"), F.col("gone")).alias("kept"))


def clean_documents(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents, all columns, with what dedup_lines() keeps of their texts; a null text stays null."""
    own = _with_gone(docs, docs.columns, least_chars, least_docs)
    text = F.when(F.col("row")["text"].isNotNull(), _kept(F.col("text"), F.col("gone")))
    return own.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


#: The digest of op13 in DuckDB SQL.
LINES_SQL = r"""
WITH each AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
shared AS (SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.last AS gone FROM keys k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
