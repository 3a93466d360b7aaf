"""Job boards: captured responses to postings.

Each board has a parser of its listing pages, perhaps one of its detail pages, and rules for how details
count. JSON and XML are read by built-in functions (feeds.py), HTML by the parsers here, one response at a
time. Every response is read once, into a table of what it holds or why it can't be read; everything after
that (paging, merging by url, joining details, dropping what is confirmed as foreign) is DataFrame work, the
same for all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.rules import TITLE_TERMS
from ..functions.text import text_of
from ..operators import dedup, lookups, paging
from ..operators.predicates import title_matches, with_url
from ..operators.staging import staged
from . import feeds
from .html import Node, parse
from .reading import listed, texts, with_read
from .schema import packed_ord

Row = tuple[str, str, str, str, str]  # title, company, url, location, description
#: Umlauts as slugs write them; what a board adds to places; a title in a description. So are the selectors and urls of the parsers below.
_UMLAUTS = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"})
MORE_PLACES = r"\s*\+\s*\d+\s*weitere\s*$"
TITLE_IN_TEXT = r"^html\s*<title>.*?</title>\s*"
JSON_LD = r'<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'


def tight(node: Node | None) -> str:
    return node.tight() if node else ""


def inner(node: Node | None) -> str:
    return node.inner() if node else ""


def json_of(text: str | None) -> dict:
    try:
        data = json.loads(text or "")
    except ValueError:
        return {}
    return data if isinstance(data, dict) else {}


def dig(data, *path):
    for key in path:
        data = data.get(key) if isinstance(data, dict) else None
    return data


def named(items, *path) -> str:
    """What path finds in each item, without what is missing, by commas."""
    return ", ".join(x for x in (dig(i, *path) for i in items or []) if x)


def job_posting(body: str) -> dict:
    """The first JSON-LD block that is a job posting."""
    for node in parse(body).select('script[type="application/ld+json"]'):
        if (data := json_of(node.text())).get("@type") == "JobPosting":
            return data
    return {}


def arbeitnow(body: str) -> Iterator[Row]:
    data = json.loads(body)
    for card in parse(dig(data, "data")).select("div[data-link]"):
        yield tight(card.first('h3[itemprop="title"] a')), tight(card.first('a[itemprop="hiringOrganization"]')), card.get("data-link"), tight(card.first("span.text-gray-600")), ""


def stepstone(body: str) -> Iterator[Row]:
    for card in parse(body).select('[data-testid="job-item"]'):
        title = card.first('[data-testid="job-item-title"]')
        href = title.get("href") if title else ""
        yield tight(title), tight(card.first('[data-at="job-item-company-name"]')), href and "https://www.stepstone.de" + href, tight(card.first('[data-at="job-item-location"]')), inner(card.first('[data-at="jobcard-content"]'))


def devjobs(body: str) -> Iterator[Row]:
    for card in parse(body).select('a[href^="/job/"]'):
        yield tight(card.first("h2")), tight(card.first("div.ml-2 p")), "https://en.devjobs.de" + card.get("href"), tight(card.first("div.ml-2 span")), inner(card.first("p.line-clamp-2"))


def testdevjobs(body: str) -> Iterator[Row]:
    for card in parse(body).select("div.job-tile-wrapper"):
        badges = [b.tight() for b in card.select('span[itemprop="address"] span[itemprop="addressCountry"]')]
        places = ", ".join(b.rstrip(",").strip() for b in badges[:-1])
        link = card.first('a[href^="/job/"]')
        yield tight(card.first("p.jobtitle")), tight(card.first("p.comptitle")), "https://testdevjobs.com" + link.get("href") if link else "", f"{places} {badges[-1] if badges else ''}".strip(), ""


_HEADING = re.compile(r"^## (.+)$", re.MULTILINE)


def wearedevelopers(body: str) -> Iterator[Row]:
    parts = _HEADING.split(body)
    for title, block in zip(parts[1::2], parts[2::2], strict=True):
        fields = dict(re.findall(r"^- \*\*(\w+):\*\* (.+)$", block, re.MULTILINE))
        link = re.search(r"^- \[View job\]\((\S+)\)$", block, re.MULTILINE)
        yield title.strip(), fields.get("Company", ""), link[1] if link else "", fields.get("Location", ""), ""


def englishjobs(body: str) -> Iterator[Row]:
    for card in parse(body).select("div.job.js-job"):
        title, key = card.first('[itemprop="title"]'), card.get("id")
        company, place = ([li.tight() for li in card.select("ul.space-y-1 li")] + ["", ""])[:2]
        yield " ".join(title.text().split()) if title else "", company, key and f"https://englishjobs.de/clickout/{key}", place, inner(card.first("div.mr-4"))


def builtin(body: str) -> Iterator[Row]:
    for card in parse(body).select("div.job-bounded-responsive"):
        title, pin, house = card.first('[data-id="job-card-title"]'), card.first("i.fa-location-dot"), card.first("i.fa-house-building")
        box = pin.above('div[class*="d-flex"]') if pin else None
        place = tight(box.following("span")) if box else ""
        side = house.above("div") if house else None
        mode = tight(side.sibling("span")) if side else ""
        href = title.get("href") if title else ""
        yield tight(title), tight(card.first('[data-id="company-title"] span')), href and "https://builtin.com" + href, f"{place} {mode}".strip(), ""


def xing(body: str) -> Iterator[Row]:
    for card in parse(body).select('article[data-testid="job-search-result"]'):
        link, place = card.first("a[href]"), card.first('div[class*="multi-location-display-styles__Container"]')
        href = link.get("href") if link else ""
        where = re.sub(MORE_PLACES, "", place.tight(" ")).strip() if place else ""
        yield tight(card.first('[data-testid="job-teaser-list-title"]')), tight(card.first('p[class*="Company"]')), href if href.startswith("http") else href and "https://www.xing.com" + href, where, ""


#: The sitemap's namespace, where its English pages start, and the id at a slug's end.
SITEMAP = "{http://www.sitemaps.org/schemas/sitemap/0.9}loc"
SITEMAP_PAGES = "https://jobs.instaffo.com/en/job/"
SLUG_ID = "-[0-9a-f]{12}$"


def sitemap_urls(body: str | None) -> list[str]:
    """A sitemap's English job pages, in order; none if it can't be read. Elements go when they are closed, so no tree of it is held."""
    reader, found = ElementTree.XMLPullParser(("start", "end")), []
    open_: list[ElementTree.Element] = []
    try:
        for start in range(0, len(body or ""), _PIECE):
            reader.feed(body[start : start + _PIECE])
            _take(reader, open_, found)
        reader.close()
        _take(reader, open_, found)
    except ElementTree.ParseError:
        return []
    return [u for u in found if u and u.startswith(SITEMAP_PAGES)]


_PIECE = 1 << 16


def _take(reader: ElementTree.XMLPullParser, open_: list[ElementTree.Element], found: list[str | None]) -> None:
    for what, element in reader.read_events():
        if what == "start":
            open_.append(element)
        else:
            open_.pop()
            if element.tag == SITEMAP:
                found.append(element.text)
            if open_:
                open_[-1].remove(element)


def plain_letters(text: Column) -> Column:
    """Lower case, umlauts written plainly."""
    return F.lower(F.replace(F.translate(text, "äöü", "aou"), F.lit("ß"), F.lit("ss")))


def slug_matches(url: Column, terms: list[str]) -> Column:
    """Whether the words of a url's last part hold one of the terms, umlauts written plainly."""
    words = plain_letters(F.replace(F.regexp_replace(F.substring_index(url, "/", -1), SLUG_ID, ""), F.lit("-"), F.lit(" ")))
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(words, F.lit(term.lower().translate(_UMLAUTS)))
    return out


def instaffo_urls(sitemap: str, terms: list[str]) -> list[str]:
    """The sitemap's English job pages whose slug holds one of the terms; slug_matches() in plain Python."""
    slug = lambda u: re.sub(SLUG_ID, "", u.rsplit("/", 1)[-1]).replace("-", " ").translate(_UMLAUTS).lower()
    return [u for u in sitemap_urls(sitemap) if any(t.lower().translate(_UMLAUTS) in slug(u) for t in terms)]


def instaffo(body: str) -> Iterator[Row]:
    """One page, one posting; its url is the response's own."""
    if data := job_posting(body):
        yield data.get("title") or "", dig(data, "hiringOrganization", "name") or "", "", named(data.get("jobLocation"), "address", "addressLocality"), data.get("description") or ""


def munich_startup(body: str) -> Iterator[Row]:
    for card in parse(body).select('a[href^="/jobs/anzeige/"]'):
        if title := card.first(".text-card-title"):
            yield title.tight(), tight(card.first(".text-card-meta")), "https://www.munich-startup.de" + card.get("href"), "Germany", ""


def stellenanzeigen(body: str) -> Iterator[Row]:
    for card in parse(body).select("div[data-jobid]"):
        link, pin = card.first("h3 a[href]"), card.first("i.fa-map-marker-alt")
        if link and link.get("href").startswith("/job/"):
            place = pin.following("span") if pin else None
            yield link.tight(), tight(card.first('[data-testid="company-name"]')), "https://www.stellenanzeigen.de" + link.get("href"), place.tight() if place else "Germany", ""


# Detail pages: description and country ("" where unknown).


def picked(selector: str) -> Callable[[str], tuple[str, str]]:
    return lambda body: (inner(parse(body).first(selector)), "")


def markdown_detail(body: str) -> tuple[str, str]:
    found = _HEADING.search(body)
    return body[found.end() :].strip() if found else "", ""


def xing_detail(body: str) -> tuple[str, str]:
    page = parse(body)
    block = page.first('script[type="application/ld+json"]')
    places = json_of(block.text() if block else None).get("jobLocation")
    country = dig(places[0], "address", "addressCountry") if isinstance(places, list) and places else ""
    return inner(page.first('[data-testid="expandable-content"]')), country or ""


def stellenanzeigen_detail(body: str) -> tuple[str, str]:
    found = re.search(JSON_LD, body, re.DOTALL)
    data = json_of(found[1] if found else None)
    places = data.get("jobLocation")
    country = (dig(places[0], "address", "addressCountry") or "").strip().upper() if isinstance(places, list) and places else ""
    return re.sub(TITLE_IN_TEXT, "", data.get("description") or "", flags=re.DOTALL), country


@dataclass(frozen=True)
class Board:
    """listing, detail: parsers of HTML; a board without a listing parser is one of feeds.FEEDS."""

    listing: Callable[[str], Iterator[Row]] | None = None
    detail: Callable[[str], tuple[str, str]] | None = None
    overwrite: bool = False  # an empty detail counts as well
    page_cap: int = 0  # at most so many pages, until the one that ends them
    details_of: str = ""  # only urls that start so have details
    own_url: bool = False  # a listing response is one posting's page


BOARDS = {
    "arbeitnow": Board(arbeitnow, picked('[itemprop="description"]'), overwrite=True),
    "germantechjobs": Board(),
    "stepstone": Board(stepstone, picked('[data-at="job-ad-content"]')),
    "devjobs": Board(devjobs, picked('div[class*="md:-mt-2"]'), page_cap=30),
    "testdevjobs": Board(testdevjobs, picked('[itemprop="description"]'), page_cap=10),
    "wearedevelopers": Board(wearedevelopers, markdown_detail),
    "englishjobs": Board(englishjobs),
    "builtin": Board(builtin, picked("div.job-post-item"), page_cap=10),
    "xing": Board(xing, xing_detail, details_of="https://www.xing.com/jobs/"),
    "get_in_it": Board(),
    "instaffo": Board(instaffo, own_url=True),
    "bundesagentur": Board(),
    "ferchau": Board(page_cap=4),
    "munich_startup": Board(munich_startup, picked(".pinboard-prose"), overwrite=True),
    "stellenanzeigen": Board(stellenanzeigen, stellenanzeigen_detail, overwrite=True),
}
#: Adapter names of a sources table that are not the board's name here.
ADAPTERS = {
    "arbeitnow_api": "arbeitnow", "html_scrape": "germantechjobs", "englishjobsde": "englishjobs", "xing_jobs": "xing",
    "ferchau_jobs": "ferchau", "munich_startup_jobs": "munich_startup", "stellenanzeigende": "stellenanzeigen",
}
_ROWS = "array<struct<title:string,company:string,url:string,location:string,description:string>>"
_FIELDS = ("title", "company", "url", "location", "description")


def board_of(adapter: Column) -> Column:
    return F.coalesce(*(F.when(adapter == k, F.lit(v)) for k, v in ADAPTERS.items()), adapter)


def request_key(board: Column, term: Column) -> Column:
    """A search term as the board's requests write it."""
    quoted = lambda t: F.replace(F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.when(board == "stepstone", quoted(F.replace(term, F.lit(" "), F.lit("-")))).when(board == "englishjobs", F.replace(term, F.lit(" "), F.lit("_"))).otherwise(quoted(term))


def requests(sources: DataFrame, terms: list[str]) -> DataFrame:
    """source_id, adapter, term, request_key and ord of what is to be asked: every source with every term."""
    each = sources.select(F.col("id").alias("source_id"), "adapter", F.posexplode(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("ord", "term"))
    return each.select("source_id", "adapter", "term", request_key(board_of(F.col("adapter")), F.col("term")).alias("request_key"), "ord")


def _why(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def read_listing(name: str, body: str | None) -> tuple[list[dict], str | None]:
    """A response's rows, and why it has none if it can't be read, whatever is wrong with it."""
    listing = BOARDS[name].listing
    if listing is None:
        return [], None
    try:
        return [dict(zip(_FIELDS, map(str, r), strict=True)) for r in listing(body or "")], None
    except Exception as error:  # noqa: BLE001  one bad response costs its own rows only
        return [], _why(error)


def _detail(name: str, body: str | None) -> tuple[str, str, str | None]:
    try:
        description, country = BOARDS[name].detail(body or "")
        return str(description), str(country), None
    except Exception as error:  # noqa: BLE001
        return "", "", _why(error)


def read_detail(name: str, body: str | None) -> tuple[str, str]:
    """A detail page's description and country; of a page of another shape, none."""
    return _detail(name, body)[:2]


def has_detail(name: str) -> bool:
    return BOARDS[name].detail is not None or name in feeds.DETAILS


def _boards(spark) -> DataFrame:
    """What differs between boards, a row each."""
    rows = [(k, has_detail(k), b.overwrite, b.page_cap, b.details_of, b.own_url) for k, b in BOARDS.items()]
    return F.broadcast(spark.createDataFrame(rows, "board string, has_detail boolean, overwrite boolean, page_cap int, details_of string, own_url boolean"))


FAILURE = "source_id string, kind string, request_key string, page int, url string, reason string, ord long"


def _listings(mine: DataFrame) -> DataFrame:
    """Every listing response with rows, ends (no page is asked for after it) and reason (null: it was read)."""

    def read(batch: dict[str, list]) -> list[pa.Array]:
        found = [(None, None) if n in feeds.FEEDS else read_listing(n, b) for n, b in zip(batch["board"], batch["body"], strict=True)]
        return [listed([f[0] for f in found], _FIELDS), texts([f[1] for f in found])]

    ok = F.col("status") == 200
    columns = ("source_id", "request_key", "page", "kind", "url", "ord", "board", "rank", "has_detail", "overwrite", "page_cap", "details_of", "own_url")
    asked = mine.where("kind = 'listing'").select(*columns, "status", F.when(ok, F.col("body")).alias("body"))
    pages = feeds.documents(with_read(asked, "board", list(feeds.FEEDS), ("board", "body"), read, f"html_rows {_ROWS}, html_reason string"))
    pages = pages.withColumn("feed", feeds.listing_of(F.col("page")))
    rows = F.coalesce("feed.rows", "html_rows")
    reason = F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("status "), text_of(F.col("status")))).otherwise(F.coalesce("feed.reason", "html_reason"))
    ends = F.coalesce(F.col("feed.ends"), F.size("html_rows") == 0)
    return pages.select(*columns, F.when(reason.isNull(), rows).otherwise(F.array().cast(_ROWS)).alias("rows"), ends.alias("ends"), reason.alias("reason"))


def _details(mine: DataFrame) -> DataFrame:
    """Every detail response that was looked at, with description, country and reason; of those of one url the first that was answered."""

    def read(batch: dict[str, list]) -> list[pa.Array]:
        found = [("", "", None) if n in feeds.DETAILS else _detail(n, b) for n, b in zip(batch["board"], batch["body"], strict=True)]
        return [texts([f[i] for f in found]) for i in range(3)]

    columns = ("source_id", "url", "kind", "request_key", "page", "ord", "board", "status", "body")
    pages = mine.where("kind = 'detail' and has_detail").select(*columns)
    good = dedup.first_wins(pages.where("status = 200"), ["source_id", "url"], "ord").select(*columns)
    good = with_read(good, "board", list(feeds.DETAILS), ("board", "body"), read, "html_description string, html_country string, html_reason string")
    found = feeds.pick(F.col("board"), list(feeds.DETAILS), lambda n: feeds.DETAILS[n](F.col("body")), F.col("html_description"))
    kept = columns[:-2]
    good = good.select(*kept, found.alias("description"), F.col("html_country").alias("country"), F.col("html_reason").alias("reason"))
    bad = pages.where("status is null or status <> 200").select(*kept, F.lit("").alias("description"), F.lit("").alias("country"), F.concat(F.lit("status "), text_of(F.col("status"))).alias("reason"))
    return good.unionByName(bad)


@dataclass(frozen=True)
class Scan:
    """What a scan gave: postings; failures (FAILURE), a row for each response, id or adapter that has none; counts of the same pass."""

    postings: DataFrame
    failures: DataFrame
    counts: dict[str, int]


def _counted(rows: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """rows as a written table, and what was counted while it was written."""
    seen = Observation()
    held = staged(rows.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return held, {k: int(v or 0) for k, v in seen.get.items()}


def _scan(payloads: DataFrame, terms: list[str], names: list[str]) -> Scan:
    """Postings of payloads with board and rank: every response is read once.

    What it holds is written, so that pages can be counted before their rows are moved. A source's pages end by
    bitsets of its requests; rows of boards without pages pass by.
    """
    mine = payloads.join(_boards(payloads.sparkSession), "board")
    failed = F.count_if(F.col("reason").isNotNull())
    listings, counts = _counted(_listings(mine), "listings", n_listings=F.count(F.lit(1)), n_failed_listings=failed, n_rows=F.sum(F.size("rows")))
    pages = listings.where("reason is null")
    if any(BOARDS[n].page_cap for n in names):
        pages = paging.until_last(pages, ["source_id", "request_key"], "page", F.col("ends"), F.col("page_cap"), F.col("page_cap") > 0)
    each = pages.select("source_id", "board", "rank", "has_detail", "overwrite", "details_of", "own_url", F.col("url").alias("page_url"), F.col("ord").alias("req"), F.posexplode("rows").alias("i", "r"))
    url = F.when(F.col("own_url"), F.col("page_url")).otherwise(F.col("r.url"))
    rows = each.select(
        "source_id", F.col("r.title").alias("title"), F.col("r.company").alias("company"), url.alias("url"), F.col("r.location").alias("location"), F.col("r.description").alias("description"),
        "board", "has_detail", "overwrite", "details_of", packed_ord(0, F.col("rank"), F.col("req"), F.col("i")).alias("ord"),
    )
    if "instaffo" in names:
        rows = _of_sitemaps(rows, mine, terms)
    rows = dedup.last_value_first_position(with_url(rows), ["source_id", "url"], "ord")
    what = ("source_id", "kind", "request_key", "page", "url", "reason", "ord")
    failures = listings.where("reason is not null").select(*what)
    if not any(map(has_detail, names)):
        return Scan(rows.select("source_id", *_FIELDS, "ord"), failures, counts)
    read, more = _counted(_details(mine), "details", n_details=F.count(F.lit(1)), n_failed_details=failed)
    failures = failures.unionByName(read.where("reason is not null").select(*what))
    details = read.where("reason is null or reason not like 'status %'").select("source_id", "url", "description", "country")
    asked = F.col("has_detail") & title_matches(F.col("title"), terms) & F.col("url").startswith(F.col("details_of"))
    other = details.select(F.col("source_id").alias("__s"), F.col("url").alias("__u"), F.col("description").alias("__detail"), F.col("country").alias("__country"))
    both = rows.withColumn("asked", asked).join(other, F.col("asked") & (F.col("source_id") == F.col("__s")) & (F.col("url") == F.col("__u")), "left")
    use = F.col("__s").isNotNull() & (F.col("overwrite") | (F.col("__detail") != ""))
    both = both.withColumn("description", F.when(use, F.col("__detail")).otherwise(F.col("description")))
    # What a detail places abroad goes.
    here = both.where(F.coalesce("__country", F.lit("")).isin("", "DE")).select("source_id", *_FIELDS, "ord")
    return Scan(here, failures, counts | more)


def _of_sitemaps(rows: DataFrame, payloads: DataFrame, terms: list[str]) -> DataFrame:
    """Where a source's sitemap was captured, only its pages whose slug holds a term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, body in zip(*batch.columns, strict=True):
                urls = sitemap_urls(body.as_py()) or [None]  # a map without pages is a map still
                yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(urls), pa.string()), texts(urls)], ["source_id", "url"])

    maps = payloads.where("kind = 'sitemap' and status = 200").select("source_id", "body").mapInArrow(read, "source_id string, url string")
    sources = maps.select(F.col("source_id").alias("__m")).distinct()
    wanted = maps.where(slug_matches(F.col("url"), terms)).select(F.col("source_id").alias("__s"), F.col("url").alias("__u")).distinct()
    both = rows.join(sources, F.col("source_id") == F.col("__m"), "left").join(wanted, (F.col("source_id") == F.col("__s")) & (F.col("url") == F.col("__u")), "left")
    return both.where("__m is null or __s is not null").drop("__m", "__s", "__u")


def scan_board(payloads: DataFrame, name: str, terms: list[str] | None = None) -> DataFrame:
    """One board's postings with ord from its captured responses, which are read at once."""
    return _scan(payloads.withColumn("board", F.lit(name)).withColumn("rank", F.lit(0)), TITLE_TERMS if terms is None else terms, [name]).postings


def scan_reported(payloads: DataFrame, sources: DataFrame, active: DataFrame, terms: list[str] | None = None) -> Scan:
    """All active sources' postings, and what could not be read.

    active: id. ord follows the order of the sources' ids, then of the responses. Ids without a source, and
    sources without a board of that adapter, have no rows and a failure each (kind source); a bad response costs
    its own rows only.
    """
    ids = active.select("id").distinct()
    known = lookups.looked_up(ids, sources.select("id", "adapter"), ["id"])
    known = known.select(F.col("id").alias("source_id"), "adapter", board_of(F.col("adapter")).alias("board"), (F.row_number().over(Window.orderBy("id")) - 1).alias("rank"))  # a configuration's rows
    # A configuration's rows go to the responses; by the few ids, all responses of a source would meet in one task.
    found = _scan(payloads.join(F.broadcast(known.drop("adapter")), "source_id"), TITLE_TERMS if terms is None else terms, list(BOARDS))
    lost = lookups.missing(ids, sources, ["id"]).select(F.col("id").alias("source_id"), F.lit("source not found").alias("reason"))
    lost = lost.unionByName(known.where(~F.coalesce(F.col("board").isin(list(BOARDS)), F.lit(False))).select("source_id", F.concat(F.lit("no board for adapter "), text_of(F.col("adapter"))).alias("reason")))
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    lost = lost.select("source_id", F.lit("source").alias("kind"), no("string", "request_key"), no("int", "page"), no("string", "url"), "reason", no("bigint", "ord"))
    return Scan(found.postings, found.failures.unionByName(lost), found.counts)


def scan_boards(payloads: DataFrame, sources: DataFrame, active: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """The postings of scan_reported()."""
    return scan_reported(payloads, sources, active, terms).postings
