"""Text column functions: Unicode regular expressions, clause windows, word ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive with Unicode case, boundaries and classes, as a str pattern has in Python.
UNICODE = "(?iuU)"


def text_of(column: Column) -> Column:
    """A missing value is an empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def strip(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def collapse(column: Column) -> Column:
    return strip(F.regexp_replace(column, r"(?U)\s+", " "))


def strip_tags(column: Column, by: str = " ") -> Column:
    return F.regexp_replace(column, "<[^>]+>", by)


def join_filled(parts: Column, by: str) -> Column:
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), by)


def any_term(column: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text as whole words; no terms match nothing."""
    if not terms:
        return F.lit(False)
    return column.rlike(UNICODE + r"\b(?:" + "|".join(rf"\Q{t}\E" for t in terms) + r")\b")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(column: Column, pattern: str, body) -> Column:
    """body(gaps, found): the stretches between the matches of a pattern, and the matches."""
    both = F.struct(F.split(column, pattern, -1).alias("gaps"), F.regexp_extract_all(column, F.lit(pattern), 0).alias("found"))
    return _let(both, lambda v: body(v["gaps"], v["found"]))


def windows_before(column: Column, pattern: str, size: int, ends: str = ".;<") -> Column:
    """Per match, what precedes it: at most size characters, and none before the clause's start."""

    def body(gaps, found):
        def window(_, i):
            before = F.concat(F.array_join(F.transform(F.slice(gaps, 1, i), lambda g, k: F.concat(g, F.get(found, k))), ""), F.get(gaps, i))
            return F.regexp_extract(F.right(before, F.lit(size)), f"[^{ends}]*$", 0)

        return F.transform(found, window)

    return _matches(column, UNICODE + pattern, body)


def windows_after(column: Column, pattern: str, size: int, ends: str = ".;<") -> Column:
    """Per match, what follows it: at most size characters, and none past the clause's end."""

    def body(gaps, found):
        n = F.size(found)

        def window(_, i):
            rest = F.transform(F.slice(gaps, i + 2, n - i), lambda g, k: F.concat(g, F.coalesce(F.get(found, i + 1 + k), F.lit(""))))
            return F.regexp_extract(F.left(F.array_join(rest, ""), F.lit(size)), f"^[^{ends}]*", 0)

        return F.transform(found, window)

    return _matches(column, UNICODE + pattern, body)


def phrase_without(column: Column, phrase: str, negation: str, size: int) -> Column:
    """Whether a match of phrase has no negation in the clause before it."""
    clear = F.exists(windows_before(column, phrase, size), lambda w: ~w.rlike(UNICODE + negation))
    return F.when(column.rlike(UNICODE + phrase), clear).otherwise(F.lit(False))


def phrase_not_waived(column: Column, phrase: str, waiver: str, unless: str, size: int) -> Column:
    """Whether a match of phrase is not waived in the clause after it; a waiver after a mention of unless is another's."""

    def holds(window):
        return ~window.rlike(UNICODE + waiver) | F.get(F.split(window, UNICODE + waiver, 2), F.lit(0)).rlike(UNICODE + unless)

    return F.when(column.rlike(UNICODE + phrase), F.exists(windows_after(column, phrase, size), holds)).otherwise(F.lit(False))


#: A letter of a word of prose.
LETTER = "[a-zA-ZäöüÄÖÜß]"


def words_among(column: Column, words: list[str]) -> Column:
    """How many words of a tag-free lower-cased text are in the list: one pass of one pattern."""
    return F.regexp_count(column, F.lit(f"(?<!{LETTER})(?:{'|'.join(words)})(?!{LETTER})"))


def prose(column: Column) -> Column:
    return F.lower(strip_tags(column))


def squeeze_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def names_match(a: Column, b: Column) -> Column:
    """Whether one squeezed name holds the other; empty ones match nothing."""
    x, y = squeeze_name(a), squeeze_name(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))
