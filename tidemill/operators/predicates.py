"""Predicates over postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import UNICODE, any_term, phrase_not_waived, phrase_without, prose, strip, text_of, words_among


def title_matches(title: Column, terms: list[str] | None = None) -> Column:
    return any_term(text_of(title), rules.TITLE_TERMS if terms is None else terms)


def in_scope_city(location: Column, free_text: Column, city: str = rules.CITY, placeholders: list[str] | None = None) -> Column:
    """The city in the location; in the free text only where the location says nothing."""
    location, free_text = text_of(location), text_of(free_text)
    says_nothing = F.lower(strip(location)).isin(rules.PLACEHOLDERS if placeholders is None else placeholders)
    return F.when(location.rlike(UNICODE + city), F.lit(True)).when(says_nothing, free_text.rlike(UNICODE + city)).otherwise(F.lit(False))


def in_scope_remote(location: Column, description: Column) -> Column:
    location, description = text_of(location), text_of(description)
    clear = phrase_without(description, rules.REMOTE_PHRASE, rules.NEGATION, rules.NEGATION_WINDOW)
    return F.when(location.rlike(UNICODE + rules.REMOTE_LOCATION), F.lit(True)).otherwise(clear)


def maybe_in_germany(location: Column) -> Column:
    """True unless a place abroad is named and none in Germany."""
    location = text_of(location)
    return location.rlike(UNICODE + rules.IN_GERMANY) | ~location.rlike(UNICODE + rules.ABROAD)


def surely_in_germany(location: Column) -> Column:
    return text_of(location).rlike(UNICODE + rules.IN_GERMANY)


def states_german(description: Column) -> Column:
    """A statement that German is required which its clause doesn't waive."""
    waiver, out = "|".join(rules.DISCLAIMERS), F.lit(False)
    text = text_of(description)
    for pattern in rules.GERMAN_REQUIRED:
        out = out | phrase_not_waived(text, pattern, waiver, rules.ENGLISH_MENTION, rules.DISCLAIMER_WINDOW)
    some = "|".join(f"(?:{p})" for p in rules.GERMAN_REQUIRED)
    return F.when(text.rlike(UNICODE + some), out).otherwise(F.lit(False))


def mostly_german(description: Column) -> Column:
    """German function words are many enough, and enough of the German and English ones."""
    text = prose(text_of(description))
    counts = F.transform(F.array(text), lambda t: F.struct(words_among(t, rules.GERMAN_WORDS).alias("de"), words_among(t, rules.ENGLISH_WORDS).alias("en")))
    ratio = lambda c: F.try_divide(c["de"].cast("double"), c["de"] + c["en"])
    return F.exists(counts, lambda c: (c["de"] >= rules.MIN_GERMAN_WORDS) & (F.coalesce(ratio(c), F.lit(0.0)) >= rules.MIN_GERMAN_RATIO))


def german_required(description: Column) -> Column:
    return F.when(states_german(description), F.lit(True)).otherwise(mostly_german(description))


@dataclass(frozen=True)
class CountryPolicy:
    """How a structured country field decides: its expected value, how it is normalised, and what a missing one means."""

    expected: str
    fold: str = "none"  # none, lower or upper; folded values are stripped too
    missing: str = "keep"  # keep, drop, or guard: judge the location text

    def keeps(self, country: Column, location: Column) -> Column:
        value = text_of(country)
        if self.fold != "none":
            value = strip(F.lower(value) if self.fold == "lower" else F.upper(value))
        otherwise = {"keep": F.lit(True), "drop": F.lit(False), "guard": maybe_in_germany(location)}[self.missing]
        return F.when(value != "", value == self.expected).otherwise(otherwise)


SCOPES = {"city": lambda: in_scope_city(F.col("location"), F.col("description")), "remote": lambda: in_scope_remote(F.col("location"), F.col("description"))}


def filter_scope(postings: DataFrame, scope: str) -> DataFrame:
    return postings.where(SCOPES[scope]())


def filter_title(postings: DataFrame, terms: list[str] | None = None) -> DataFrame:
    return postings.where(title_matches(F.col("title"), terms))


def with_url(postings: DataFrame) -> DataFrame:
    return postings.where(F.length("url") > 0)
