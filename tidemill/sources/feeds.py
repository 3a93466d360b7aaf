"""Boards whose responses are JSON or XML, or hold them: read by built-in functions.

JSON is read as VARIANT, so a value of another type costs itself and not its neighbours; what follows the first
value of a text is not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import join_filled, strip, text_of

#: A feed's title, its company and tag; where documents stand in a page; a page's rows; paths.
TITLE_AT_COMPANY = r"^(.+?)\s*@\s*(.+?)(?:\s*\[.*\])?$"
NEXT_DATA = r'(?s)<script[^>]*\bid="__NEXT_DATA__"[^>]*>(.*?)</script>'
LINKED_DATA = r'(?s)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'
APP_DATA = "App.Data = {"
FERCHAU_PAGE = 25
_CHANNEL = "channel struct<item:array<struct<title:string,link:string,description:string>>>"
ROW = "struct<title:string,company:string,url:string,location:string,description:string>"


def at(doc: Column, path: str) -> Column:
    """A text at a path, "" where there is none."""
    return text_of(F.try_variant_get(doc, path, "string"))


def each(doc: Column, path: str) -> Column:
    """The values of an array at a path; no array has none."""
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def row(title: Column, company: Column, url: Column, location: Column, description: Column) -> Column:
    return F.struct(title.alias("title"), company.alias("company"), url.alias("url"), location.alias("location"), description.alias("description"))


def _or(text: Column, other: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


def _within(base: str, path: Column) -> Column:
    return F.when(path == "", "").otherwise(F.concat(F.lit(base), path))


def next_data(body: Column) -> Column:
    return F.regexp_extract(body, NEXT_DATA, 1)


def app_data(body: Column) -> Column:
    """From the object literal that a script assigns on."""
    found = F.locate(APP_DATA, body)
    return F.when(found > 0, F.substring(body, found + (len(APP_DATA) - 1), F.length(body)))


def job_posting(body: Column) -> Column:
    """The first JSON-LD block of a page that is a job posting."""
    blocks = F.transform(F.regexp_extract_all(text_of(body), F.lit(LINKED_DATA), 1), lambda b: F.try_parse_json(b))
    return F.get(F.filter(blocks, lambda b: at(b, "$['@type']") == "JobPosting"), F.lit(0))


def _feed_item(item: Column) -> Column:
    raw = strip(text_of(item["title"]))
    # No match extracts "", and a match's title has a sign at least.
    title, company = strip(F.regexp_extract(raw, TITLE_AT_COMPANY, 1)), strip(F.regexp_extract(raw, TITLE_AT_COMPANY, 2))
    split = raw.rlike(TITLE_AT_COMPANY)
    return row(F.when(split, title).otherwise(raw), F.when(split, company).otherwise("Unknown"), strip(text_of(item["link"])), F.lit("Germany"), text_of(item["description"]))


def _get_in_it(doc: Column) -> Column:
    places = lambda j: join_filled(F.transform(each(j, "$.locations"), lambda x: at(x, "$.name")), ", ")
    return F.transform(each(doc, "$.props.initialState.jobSearchJobs.jobs"), lambda j: row(at(j, "$.title"), at(j, "$.company.title"), _within("https://www.get-in-it.de", at(j, "$.url")), places(j), F.lit("")))


def _agency(doc: Column) -> Column:
    here = lambda j: F.filter(each(j, "$.stellenlokationen"), lambda x: at(x, "$.adresse.land") == "DEUTSCHLAND")
    jobs = F.filter(each(doc, "$.ergebnisliste"), lambda j: (at(j, "$.referenznummer") != "") & (F.size(here(j)) > 0))
    place = lambda j: join_filled(F.transform(here(j), lambda x: at(x, "$.adresse.ort")), ", ")
    return F.transform(jobs, lambda j: row(at(j, "$.stellenangebotsTitel"), at(j, "$.firma"), _within("https://www.arbeitsagentur.de/jobsuche/jobdetail/", at(j, "$.referenznummer")), place(j), F.lit("")))


_FERCHAU = "$.ControllerResponse.Data"


def _ferchau(doc: Column) -> Column:
    plain = lambda text: F.replace(text, F.lit("\xad"), F.lit(""))
    jobs = F.filter(each(doc, f"{_FERCHAU}.Offers"), lambda j: (F.upper(strip(at(j, "$.locationCountryCode"))) == "DE") & (at(j, "$.slug") != ""))

    def part(j: Column, k: str) -> Column:
        return F.when(at(j, f"$.{k}") == "", "").otherwise(F.concat(F.lit("<p>"), at(j, f"$.{k}Headline"), F.lit("</p>"), at(j, f"$.{k}")))

    def text(j: Column) -> Column:
        return F.concat(at(j, "$.intro"), part(j, "tasks"), part(j, "requirements"), part(j, "benefits"))

    def place(j: Column) -> Column:
        return join_filled(F.array(at(j, "$.locationCity"), at(j, "$.locationRegion"), at(j, "$.locationCountry")), ", ")

    return F.transform(jobs, lambda j: row(plain(at(j, "$.title")), plain(_or(at(j, "$.contactPersonOrganizationName"), "FERCHAU")), F.concat(F.lit("https://touch.ferchau.com"), at(j, "$.slug")), _or(plain(place(j)), "Germany"), plain(text(j))))


def _ferchau_ends(doc: Column, page: Column) -> Column:
    total = F.coalesce(F.try_variant_get(doc, f"{_FERCHAU}.OffersCount.total", "bigint"), F.lit(0))
    return page * FERCHAU_PAGE >= total


@dataclass(frozen=True)
class Feed:
    """text: the JSON in a body (xml: the body is XML); rows: postings of the document; there: what it must have to count as read."""

    rows: Callable[[Column], Column]
    text: Callable[[Column], Column] = lambda body: body
    xml: bool = False
    there: str = "$"
    ends: Callable[[Column, Column], Column] | None = None  # whether no page is asked for after this one


FEEDS = {
    "germantechjobs": Feed(lambda doc: F.transform(doc["channel"]["item"], _feed_item), xml=True),
    "get_in_it": Feed(_get_in_it, next_data),
    "bundesagentur": Feed(_agency),
    "ferchau": Feed(_ferchau, app_data, there=_FERCHAU, ends=_ferchau_ends),
}
DETAILS: dict[str, Callable[[Column], Column]] = {
    "get_in_it": lambda body: at(F.try_parse_json(next_data(body)), "$.props.initialState.jobJob.job.content"),
    "bundesagentur": lambda body: at(job_posting(body), "$.description"),
}


def pick(board: Column, names: list[str], value: Callable[[str], Column], other: Column) -> Column:
    """What belongs to a row's board, worked out for that board only."""
    return F.coalesce(*(F.when(board == n, value(n)) for n in names), other)


def documents(pages):
    """pages (board, body) with json and xml: what their bodies hold, null where it can't be read."""
    board = F.col("board")
    texts = pick(board, [n for n, f in FEEDS.items() if not f.xml], lambda n: FEEDS[n].text(F.col("body")), F.lit(None).cast("string"))
    feed = F.when(board.isin([n for n, f in FEEDS.items() if f.xml]), F.from_xml("body", _CHANNEL, {"ignoreSurroundingSpaces": "false"}))
    return pages.withColumn("json", F.try_parse_json(texts)).withColumn("xml", feed)


def listing_of(page: Column) -> Column:
    """struct(rows, ends, reason) of a row of documents(); null of a board that is no feed."""
    none = F.array().cast(f"array<{ROW}>")

    def found(n: str) -> Column:
        feed = FEEDS[n]
        doc = F.col("xml" if feed.xml else "json")
        read = doc["channel"].isNotNull() if feed.xml else F.try_variant_get(doc, feed.there, "variant").isNotNull()
        ends = F.lit(False) if feed.ends is None else F.coalesce(feed.ends(doc, page), F.lit(True))
        reason = F.when(~F.coalesce(read, F.lit(False)), f"no readable {'XML' if feed.xml else 'JSON'}")
        return F.struct(F.when(reason.isNull(), F.coalesce(feed.rows(doc).cast(f"array<{ROW}>"), none)).otherwise(none).alias("rows"), ends.alias("ends"), reason.alias("reason"))

    return F.coalesce(*(F.when(F.col("board") == n, found(n)) for n in FEEDS))
