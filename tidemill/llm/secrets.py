"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Battery. Every run of 20 or more characters that could be a key, and every piece of it between slashes,
underscores or hyphens (each choice of those), gets an encoding (hexadecimal, base32,
base64) from its alphabet, and three tests against a random string in it: chi-squared of its characters
over the alphabet, runs of characters above and below the alphabet's middle, and serial correlation of
neighbouring characters. Each test is a squared normal score, so the worst of the three is one number
that is small for keys and large for text.

False discovery. The worst of three normal scores has a known distribution for random strings, so each
candidate has the chance that a key looks as little random as it does. A Benjamini-Hochberg threshold per
length class over all candidates says which are dismissed as text. A key is dismissed with a chance of
about RATE at most, whatever else the table holds (normal approximation; README has the measured shares).
The others are reported, and short text that passes the tests is among them: the rate holds for what is
dismissed, not for what is reported. Candidates are counted over a fixed grid.
"""

from __future__ import annotations

from math import erfc, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, let, running

#: Patterns of the base by kind, in the order of ties, with the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: What the battery looks at: it holds a digit and a letter, as keys do and words don't. '=' is only padding at its end.
CANDIDATE = r"[A-Za-z0-9+/_-]{18,}+==(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{19,}+=(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{20,}+"
#: Pieces of a candidate that are looked at as well: what stands between separators of each choice.
PIECES = tuple(f"[^{s}]{{20,}}" for s in ("/", "_", "\\-", "/_", "/\\-", "_\\-", "/_\\-"))
#: Bins of the worst score, classes of length, and the false-discovery rate.
BINS, BIN_WIDTH, LENGTHS, RATE = 200, 0.25, (20, 24, 32, 48, 64), 0.01


_SPANS = "array<struct<start:int,end:int,found:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def spans_of(text: Column, pattern: str) -> Column:
    """(start, end, found) of every match, leftmost and non-overlapping, in code points."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def placed(v: Column) -> Column:
        sized = F.transform(F.slice(v["gaps"], 1, F.size(v["found"])), lambda g, i: F.length(g) + F.length(F.get(v["found"], i)))
        ends = let(F.struct(v["found"].alias("found"), sized.alias("sized"), running(sized, lambda a, x: a + x).alias("before")), lambda w: F.transform(
            w["found"], lambda f, i: F.struct((F.get(w["before"], i) + F.get(w["sized"], i) - F.length(f)).alias("start"), (F.get(w["before"], i) + F.get(w["sized"], i)).alias("end"), f.alias("found"))))
        return ends

    return let(F.struct(gaps.alias("gaps"), found.alias("found")), placed)


def _scanned(text: Column, kind: str) -> Column:
    none = _none()
    if kind == "assign":
        value = lambda s: F.length(F.regexp_extract(s["found"], "(?s)^" + ASSIGN + "$", 2)) >= ASSIGN_LEAST
        return F.when(text.rlike(ASSIGN), F.filter(spans_of(text, ASSIGN), value)).otherwise(none)
    if kind == "access":
        return F.when(text.rlike(ACCESS), F.filter(spans_of(text, ACCESS), lambda s: s["end"] - s["start"] >= ACCESS_LEAST)).otherwise(none)
    pattern = HEX if kind == "hex" else CANDIDATE
    return F.when(text.rlike(pattern), spans_of(text, pattern)).otherwise(none)


def pieces(s: Column) -> Column:
    """A span, and where its text has separators, what stands between them: (start, end, found) each, none twice."""
    within = lambda pattern: F.transform(spans_of(s["found"], pattern), lambda p: F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["end"]).alias("end"), p["found"].alias("found")))
    once = lambda v: F.filter(v, lambda p, i: (i == 0) | ((p["start"] != F.get(v, i - 1)["start"]) | (p["end"] != F.get(v, i - 1)["end"])))
    return F.when(s["found"].rlike("[/_-]"), let(F.sort_array(F.concat(F.array(s), *map(within, PIECES))), once)).otherwise(F.array(s))


def candidates(text: Column) -> Column:
    """All that the battery tests in a text: runs that may be keys, whole and in pieces."""
    return F.filter(F.flatten(F.transform(_scanned(text, "random"), pieces)), lambda p: keyish(p["found"]))


def worst_score(found: Column) -> Column:
    """The worst squared normal score of a candidate under the three tests, for its inferred encoding."""
    hexes, sixty = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"
    hexed = found.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    alphabet = F.when(hexed, F.lit(hexes)).when(found.rlike("^[A-Z2-7]+=*$"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(F.lit(sixty))
    body = F.regexp_replace(F.when(hexed, F.lower(found)).otherwise(F.translate(found, "-_", "+/")), "=+", "")
    return let(F.struct(alphabet.alias("alphabet"), body.alias("body")), lambda c: let(
        F.struct(
            F.transform(F.filter(F.split(c["body"], ""), lambda x: x != ""), lambda x: F.instr(c["alphabet"], x) - 1).alias("codes"),
            F.length(c["alphabet"]).cast("double").alias("k"),
        ), _tests))


def _tests(v: Column) -> Column:
    codes, k = v["codes"], v["k"]
    n = F.size(codes).cast("double")
    # In order, equal codes are neighbours: the i-th of a run of them adds 2 i - 1, so a run of c adds c * c.
    run = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("nth"), F.lit(0.0).alias("sum"))
    nth = lambda a, c: F.when(a["last"] == c, a["nth"] + 1).otherwise(F.lit(1))
    squares = F.aggregate(F.sort_array(codes), run, lambda a, c: F.struct(c.alias("last"), nth(a, c).alias("nth"), (a["sum"] + 2 * nth(a, c) - 1).alias("sum")), lambda a: a["sum"])
    chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.size(F.filter(codes, lambda c: c >= k / 2)).cast("double")
    pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes) - 1).alias("b"))
    flips = F.size(F.filter(pairs, lambda p: (p["a"] < k / 2) != (p["b"] < k / 2))) + F.lit(1.0)
    mean = 2 * high * (n - high) / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    runs = F.when(spread > 0, (flips - mean) / spread).otherwise(n)
    centre = (k - 1) / 2
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - centre) * (p["b"] - centre))
    correlation = serial / ((k * k - 1) / 12 * F.sqrt(n - 1))
    chi = F.greatest(chi, F.lit(0.0))
    return F.when(n >= 16, F.greatest(chi * chi, runs * runs, correlation * correlation)).otherwise(F.lit(1e9))


def keyish(found: Column) -> Column:
    """A candidate with digits and letters may be a key."""
    return found.rlike("[0-9]") & found.rlike("[A-Za-z]")


def score_bin(found: Column) -> Column:
    return F.least(F.floor(worst_score(found) / BIN_WIDTH), F.lit(BINS - 1)).cast("int")


def length_class(found: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(F.length(found) >= least, F.lit(i)).otherwise(out)
    return out


def chance(score: float) -> float:
    """The chance that a random string's worst squared score is score or more; only a high chi-squared counts."""
    tail = erfc(sqrt(score / 2))
    return tail * (2 - tail) + (1 - tail) ** 2 * tail / 2


def most_of(counts: dict[int, int]) -> int:
    """The largest bin of the score that is kept, for the number of a class's candidates by bin: those above are dismissed."""
    total, above, most = sum(counts.values()), 0, BINS - 2
    for at in range(BINS - 1, -1, -1):
        above += counts.get(at, 0)
        if chance(at * BIN_WIDTH) * total <= RATE * above:
            most = min(most, at - 1)
    return most


def thresholds(docs: DataFrame) -> dict[int, int]:
    """Per length class, the largest bin of the score that false-discovery control keeps, over all documents.

    At most len(LENGTHS) * BINS sums leave the aggregation and reach the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(F.explode(candidates(text)["found"]).alias("found"))
    counts: dict[int, dict[int, int]] = {}
    for r in each.groupBy(length_class(F.col("found")).alias("class"), score_bin(F.col("found")).alias("bin")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["class"], {})[r["bin"]] = r["n"]
    return {c: most_of(n) for c, n in counts.items()}


def _meets(s: Column):
    return lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])


def apart(spans: Column, own) -> Column:
    """own(cluster) of each cluster of spans that overlap, one after the other; no span meets one of another cluster."""

    def clustered(v: Column) -> Column:
        reach = running(F.transform(v, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        firsts = let(reach, lambda r: F.filter(F.transform(v, lambda s, i: F.when(s["start"] >= F.get(r, i), i)), lambda i: i.isNotNull()))
        return let(firsts, lambda at: F.flatten(F.transform(at, lambda i, k: own(F.slice(v, i + 1, F.coalesce(F.get(at, k + 1), F.size(v)) - i)))))

    return let(F.sort_array(spans), clustered)


def _random(text: Column, base: Column, most: dict[int, int]) -> Column:
    """The spans of candidates that pass and touch no base span; of those that overlap, the longest."""
    limit = lambda f: F.coalesce(*(F.when(length_class(f) == c, F.lit(b)) for c, b in sorted(most.items())), F.lit(-1))
    # Where base spans are few, what meets them needs no test; the clusters see to it in any case.
    free = lambda s, b: (F.size(b) > BLOCK) | ~F.exists(b, _meets(s))
    good = lambda b: F.filter(candidates(text), lambda s: F.when(free(s, b), score_bin(s["found"]) <= limit(s["found"])).otherwise(F.lit(False)))
    entry = lambda is_base: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(is_base).alias("base"), s["found"].alias("found"))

    def longest(cluster: Column) -> Column:
        mine = F.array_sort(F.transform(F.filter(cluster, lambda s: ~s["base"]), lambda s: F.struct((s["start"] - s["end"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["found"].alias("found"))))
        taken = F.aggregate(mine, F.filter(cluster, lambda s: s["base"]), lambda acc, s: F.when(F.exists(acc, _meets(s)), acc).otherwise(F.concat(acc, F.array(entry(False)(s)))))
        return F.transform(F.filter(taken, lambda s: ~s["base"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    every = let(base, lambda b: let(good(b), lambda g: F.when(F.size(g) > 0, apart(F.concat(F.transform(b, entry(True)), F.transform(g, entry(False))), longest)).otherwise(_none())))
    return F.when(text.rlike(CANDIDATE), every).otherwise(_none())


def scan(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id, text, and per kind an array of (start, end, found); the battery's spans don't touch those of the base."""
    most = thresholds(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    also = [] if carry is None else [carry.alias("carry")]
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *also)
    held = held.select("*", *(_scanned(F.col("text"), k).alias(k) for k in KINDS[:3]))
    return held.withColumn("random", _random(F.col("text"), F.concat(*KINDS[:3]), most))


def _joined(kinds: tuple[str, ...]) -> Column:
    placed = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    rows = [F.transform(k, placed(i)) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, by start) per document.

    Null text is empty; null doc_ids and repeated rows get a row each; an empty table gives none. Base
    spans always stay and may overlap; the battery's (kind random) are added. Columns besides doc_id and
    text are not read.
    """
    found = scan(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with each of these spans, in order and apart, replaced by mark.

    A substring is found by counting from the start, so the text is first cut into stretches of BLOCK
    spans, and these into what lies before each span.
    """
    blocks = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), lambda i: F.slice(spans, i, BLOCK))).otherwise(F.array().cast("array<array<struct<start:int,end:int>>>"))

    def stretch(all_: Column):
        def cut(block: Column, k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.element_at(F.get(all_, k - 1), -1)["end"])
            part = F.substring(text, begin + 1, F.element_at(block, -1)["start"] - begin)
            gap = lambda p: lambda s, i: F.substring(p, F.when(i == 0, F.lit(0)).otherwise(F.get(block, i - 1)["end"] - begin) + 1, s["start"] - F.when(i == 0, begin).otherwise(F.get(block, i - 1)["end"]))
            return let(part, lambda p: F.concat(F.array_join(F.transform(block, gap(p)), mark), F.lit(mark)))

        return F.concat(F.array_join(F.transform(all_, cut), ""), F.substring(text, F.element_at(F.element_at(all_, -1), -1)["end"] + 1, F.length(text)))

    return let(blocks, stretch)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with each stretch of secret characters replaced by mark; null text stays null."""
    found = scan(docs, F.struct(*(docs[c] for c in docs.columns)))
    spans = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    union = apart(spans, lambda c: F.array(F.struct(F.get(c, 0)["start"].alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end"))))
    clean = let(union, lambda u: _replaced(F.col("text"), u, mark))
    n = sum((F.size(k) for k in KINDS), F.lit(0))
    found = found.withColumn("clean", F.when(n > 0, clean).otherwise(F.col("carry.text")))
    return found.select(*(F.col("clean").alias("text") if c == "text" else F.col("carry")[c].alias(c) for c in docs.columns))
