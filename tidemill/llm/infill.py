"""Fill-in-middle: texts are cut into prefix, middle and suffix, which are put in another order between marks.

A text is encoded once as its maximal runs of one class of characters, each with its end and the number of
units that end up to there. A cut after any number of units is then a binary search for its run, and some
arithmetic in the run: nothing of the text is looked at again, so a stored table of runs serves other seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Share of texts, in percent, that are cut, and of those that begin with the suffix.
RATE, SPM = 100, 50
SEED = 7
#: Bytes of text encoded at once.
CHUNK = 8_000_000
UNITS = ("line", "word", "char")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
RUNS = "struct<ends:array<bigint>,units:array<bigint>>"


def runs_of(raw: np.ndarray, starts: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of texts laid end to end: each one's end (code points of its text), the units ended there, and each text's runs.

    raw: UTF-8 bytes; starts: where texts begin, and the end of the last. A line ends behind its feed, a word
    before the next word; the text's end ends the last of either. White space before the first word is part of
    it, and a text of white space alone is one word.
    """
    starts = np.asarray(starts, np.int64)
    full = starts[:-1][starts[:-1] < starts[1:]]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    lead = (raw & 0xC0) != 0x80
    kind = raw == 0x0A if unit == "line" else _SPACE[raw] if unit == "word" else np.zeros(len(raw), bool)
    begins = np.zeros(len(raw), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[full] = True
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(raw))
    chars = np.add.reduceat(lead, at, dtype=np.int64)
    first, last = np.isin(at, full, assume_unique=True), np.isin(ends, starts)
    if unit == "line":
        own = np.where(kind[at], chars, last)
    elif unit == "word":
        own = np.where(kind[at], ~first | last, last)
    else:
        own = chars
    rows = np.searchsorted(at, starts)  # each text's first run
    return _within(np.cumsum(chars), rows), _within(np.cumsum(own.astype(np.int64)), rows), rows


def _within(sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Running sums over all texts, as each text's own."""
    before = np.concatenate([[0], sums])[rows[:-1]]
    return sums - np.repeat(before, np.diff(rows))


def encoded(texts: pa.Array, unit: str) -> pa.Array:
    """RUNS of each text (null: none)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    parts, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        ends, units, rows = runs_of(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], unit)
        lists = [pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(x)) for x in (ends, units)]
        parts.append(pa.StructArray.from_arrays(lists, names=["ends", "units"]))
        at = to
    kind = pa.struct([("ends", pa.list_(pa.int64())), ("units", pa.list_(pa.int64()))])
    return pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind)


def cut(runs: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """n, prefix_chars and middle_chars: the units, and the cuts after the smaller and the larger of a % (n + 1) and b % (n + 1) of them."""
    units, ends = runs.field("units"), runs.field("ends")
    rows = units.offsets.to_numpy().astype(np.int64)
    flat, end = (x.values.to_numpy(zero_copy_only=False) for x in (units, ends))
    size, last = np.diff(rows), np.maximum(rows[1:] - 1, 0)
    n = np.where(size > 0, flat[last] if len(flat) else 0, 0)
    # One ascending row of all texts' units, so all cuts are found by one search.
    base = np.cumsum(n) - n
    row = flat[rows[0] : rows[-1]] + np.repeat(base, size)
    a, b = a % (n + 1), b % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        if not len(row):
            return np.zeros(len(k), np.int64)
        run = np.minimum(np.searchsorted(row, base + k), len(row) - 1)  # the first run that ends so many units
        return np.where(k > 0, end[rows[0] + run] - (row[run] - base - k), 0)

    one, other = place(np.minimum(a, b)), place(np.maximum(a, b))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(one), pa.array(other - one)], names=["n", "prefix_chars", "middle_chars"])


def class_runs(text: Column, unit: str = "line") -> Column:
    """The runs of a text, to be stored: ends and units."""
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")

    @F.arrow_udf(RUNS)
    def encode(texts: pa.Array) -> pa.Array:
        return encoded(texts, unit)

    return encode(text.cast("binary"))


def cuts(runs: Column, a: Column, b: Column) -> Column:
    """The struct of cut() for stored runs and two random longs."""

    @F.arrow_udf("struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>")
    def find(runs: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return cut(runs, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))

    return find(runs, a, b)


def drawn(doc_id: Column, seed: int, nth: int) -> Column:
    """The nth of a document's random numbers below 2**32 (null: as an id without digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    parts = F.split(output, "|".join(MARKS), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = "line", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    Empty and null texts, texts that hold a mark, and (at a rate below 100) those not drawn are plain: the
    output is the text, a null one's is empty, and the lengths are null. Pieces may be empty. Rows with one
    doc_id draw the same numbers, and so do all with a null one. Nothing is shuffled; empty tables give no rows.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    text, h = F.col("text"), [drawn(F.col("doc_id"), seed, i) for i in (1, 2, 3, 4)]
    found = own.withColumn("cut", cuts(class_runs(text, unit), h[0], h[1])).select("doc_id", "text", "cut.*")
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit(MARKS[0]), prefix, F.lit(MARKS[1]), suffix, F.lit(MARKS[2]), middle)
    spm_ = F.concat(F.lit(MARKS[1]), suffix, F.lit(MARKS[0]), prefix, F.lit(MARKS[2]), middle)
    formed = found.withColumn("form", form)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm_)
    sized = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    return formed.select("doc_id", "n", "form", sized("prefix_chars"), sized("middle_chars"), output.alias("output"))


#: The digest of op12 in DuckDB SQL, seed 7.
INFILL_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
