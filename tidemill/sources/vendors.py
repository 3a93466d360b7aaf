"""Company-direct sources: captured vendor responses to postings, by built-in JSON and XML functions.

A payload's source_id is the company's name here, or '#' and its ord where names repeat; kind is listing, detail or facets. Each vendor has a
schema, the path of its rows, and columns; country rules differ and stand with each.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TITLE_TERMS
from ..functions.text import join_filled, strip, text_of
from ..operators import dedup, lookups, paging
from ..operators.predicates import CountryPolicy, maybe_in_germany, surely_in_germany, title_matches, with_url
from ..operators.staging import staged
from .html import parse
from .reading import listed, with_read
from .schema import packed_ord


def late_udf(schema: str):
    """A pandas UDF made where it is used, as its type needs a session to be read."""
    return lambda f: lambda *columns: F.pandas_udf(f, schema)(*columns)


GUARD_LOWER = lambda word: CountryPolicy(word, "lower", "guard")


@late_udf("string")
def unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t or ""))


def city_in_germany(city: Column) -> Column:
    return F.when(city != "", F.concat(city, F.lit(", Germany"))).otherwise(F.lit("Germany"))


def or_else(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(text_of(first), F.lit("")), text_of(second))


@dataclass(frozen=True)
class Vendor:
    """rows: an array column out of the response body; the rest are columns of a row r (identifier and company stand beside it)."""

    rows: Callable[[Column], Column]
    title: Callable[[Column], Column]
    url: Callable[[Column], Column]
    location: Callable[[Column], Column]
    keep: Callable[[Column], Column]
    description: Callable[[Column], Column] = lambda r: F.lit("")
    company: Callable[[Column], Column] = lambda r: F.col("company")
    source_id: Callable[[Column], Column] | None = None  # default: vendor:identifier
    detail: Callable[[Column], Column] | None = None
    detail_for_titles: bool = False  # only title-matched rows have details
    escaped: bool = False  # descriptions are HTML written as text


def _json(schema: str, path: str = "") -> Callable[[Column], Column]:
    return lambda body: F.from_json(body, schema)[path] if path else F.from_json(body, schema)


def _text(column: Column) -> Column:
    return strip(text_of(column))


def _id() -> Column:
    return F.col("identifier")


def _next_data(body: Column) -> Column:
    return F.regexp_extract(body, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def _bamboo_country(r: Column) -> Column:
    return strip(or_else(r["atsLocation"]["country"], r["location"]["addressCountry"]))


def _bamboo_city(r: Column) -> Column:
    return strip(or_else(r["location"]["city"], r["atsLocation"]["city"]))


def _links(body: str | None, base: str | None) -> list[dict]:
    found: dict[str, str] = {}
    for a in parse(body).select("a[href]"):
        title = " ".join(a.text().split())
        if "/job/" in a.get("href") and title:
            found.setdefault(urljoin(base or "", a.get("href")), title)
    return [{"title": t, "url": u} for u, t in found.items()]


@late_udf("array<struct<title:string,url:string>>")
def _softgarden_links(bodies: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([_links(b, u) for b, u in zip(bodies, bases, strict=True)])


@late_udf("string")
def page_words(bodies: pd.Series) -> pd.Series:
    """The text of a page's body, its strings parted by blanks."""

    def words(body: str) -> str:
        node = parse(body).first("body")
        return " ".join(" ".join(node.strings()).split()) if node else ""

    return bodies.map(words)


def _cards(body: str | None) -> list[dict]:
    out = []
    for card in parse(body).select('a[data-testid="job-card"][href]'):
        title, info = card.first('[data-testid="job-title"]'), card.first('[data-testid="job-more-info"]')
        if title and title.tight():
            out.append({"title": title.tight(), "url": card.get("href"), "city": (info.tight() if info else "").split("|")[0].strip()})
    return out


@late_udf("array<struct<title:string,url:string,city:string>>")
def _onlyfy_cards(bodies: pd.Series) -> pd.Series:
    return bodies.map(_cards)


def _onlyfy_url(r: Column) -> Column:
    return F.when(r["url"].startswith("/"), F.concat(F.lit("https://"), _id(), F.lit(".onlyfy.jobs"), r["url"])).otherwise(text_of(r["url"]))


_POSITION = "id string, name string, office string, additionalOffices struct<office:array<string>>, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"


def _positions(body: str | None) -> list[str]:
    try:
        return [ElementTree.tostring(p, encoding="unicode") for p in ElementTree.fromstring(body or "").findall("./position")]
    except ElementTree.ParseError:
        return []


@late_udf("array<string>")
def xml_positions(bodies: pd.Series) -> pd.Series:
    """The position elements of a feed; a feed that can't be read has none."""
    return bodies.map(_positions)


def _offices(r: Column) -> Column:
    return join_filled(F.concat(F.array(_text(r["office"])), F.transform(F.coalesce(r["additionalOffices"]["office"], F.array().cast("array<string>")), _text)), ", ")


_ITEM = "title:string,idParam:string,id:bigint,city:struct<cityName:string>,country:struct<iso3166:string>"
VENDORS = {
    "greenhouse": Vendor(
        _json("jobs array<struct<title:string,company_name:string,absolute_url:string,location:struct<name:string>,content:string>>", "jobs"),
        lambda r: _text(r["title"]), lambda r: text_of(r["absolute_url"]), lambda r: _text(r["location"]["name"]), lambda r: maybe_in_germany(_text(r["location"]["name"])),
        lambda r: text_of(r["content"]), lambda r: or_else(r["company_name"], F.col("company")), escaped=True,
    ),
    "lever": Vendor(
        _json("array<struct<text:string,hostedUrl:string,categories:struct<location:string>,description:string,country:string>>"),
        lambda r: _text(r["text"]), lambda r: text_of(r["hostedUrl"]), lambda r: text_of(r["categories"]["location"]),
        lambda r: CountryPolicy("DE", "upper", "guard").keeps(r["country"], r["categories"]["location"]), lambda r: text_of(r["description"]),
    ),
    "ashby": Vendor(
        _json("jobs array<struct<title:string,jobUrl:string,location:string,address:struct<postalAddress:struct<addressCountry:string>>,descriptionHtml:string>>", "jobs"),
        lambda r: _text(r["title"]), lambda r: text_of(r["jobUrl"]), lambda r: text_of(r["location"]),
        lambda r: GUARD_LOWER("germany").keeps(r["address"]["postalAddress"]["addressCountry"], r["location"]), lambda r: text_of(r["descriptionHtml"]),
    ),
    "smartrecruiters": Vendor(
        _json("content array<struct<id:string,name:string,location:struct<country:string,fullLocation:string,city:string>>>", "content"),
        lambda r: _text(r["name"]), lambda r: F.concat(F.lit("https://jobs.smartrecruiters.com/"), _id(), F.lit("/"), r["id"]),
        lambda r: or_else(r["location"]["fullLocation"], r["location"]["city"]), lambda r: GUARD_LOWER("de").keeps(r["location"]["country"], r["location"]["fullLocation"]),
        detail=lambda b: F.array_join(F.filter(F.transform(F.array(*map(F.lit, ("companyDescription", "jobDescription", "qualifications", "additionalInformation"))),
            lambda k: F.try_element_at(F.from_json(b, "jobAd struct<sections:map<string,struct<text:string>>>")["jobAd"]["sections"], k)["text"]), lambda t: t.isNotNull() & (t != "")), "\n"),
        detail_for_titles=True,
    ),
    "personio": Vendor(
        lambda body: F.transform(xml_positions(body), lambda x: F.from_xml(x, _POSITION)),
        lambda r: _text(r["name"]), lambda r: F.when((_text(r["id"]) != "") & (_text(r["name"]) != ""), F.concat(F.lit("https://"), _id(), F.lit(".jobs.personio.de/job/"), _text(r["id"]))).otherwise(""),
        _offices, lambda r: maybe_in_germany(_offices(r)),
        lambda r: join_filled(F.transform(F.coalesce(r["jobDescriptions"]["jobDescription"], F.array().cast("array<struct<name:string,value:string>>")), lambda d: F.when(_text(d["value"]) != "", d["value"]).otherwise("")), "\n"),
    ),
    "workable": Vendor(
        _json("jobs array<struct<title:string,url:string,shortlink:string,country:string,city:string,description:string>>", "jobs"),
        lambda r: _text(r["title"]), lambda r: or_else(r["url"], r["shortlink"]), lambda r: city_in_germany(_text(r["city"])),
        lambda r: CountryPolicy("Germany", "none", "guard").keeps(_text(r["country"]), r["city"]), lambda r: text_of(r["description"]),
    ),
    "recruitee": Vendor(
        _json("offers array<struct<title:string,careers_url:string,country_code:string,location:string,description:string>>", "offers"),
        lambda r: _text(r["title"]), lambda r: text_of(r["careers_url"]), lambda r: or_else(r["location"], F.lit("Germany")),
        lambda r: CountryPolicy("DE", "upper", "drop").keeps(r["country_code"], F.lit("")), lambda r: text_of(r["description"]),
    ),
    "softgarden": Vendor(
        lambda body: _softgarden_links(body, F.col("page_url")), lambda r: text_of(r["title"]), lambda r: text_of(r["url"]), lambda r: F.lit("Germany"), lambda r: F.lit(True),
        source_id=lambda r: F.concat(F.lit("softgarden:"), _id(), F.lit(":"), r["url"]), detail=page_words,
    ),
    "bamboohr": Vendor(
        _json("result array<struct<id:string,jobOpeningName:string,location:struct<city:string,state:string,addressCountry:string>,atsLocation:struct<country:string,city:string>>>", "result"),
        lambda r: _text(r["jobOpeningName"]), lambda r: F.when(text_of(r["id"]) != "", F.concat(F.lit("https://"), _id(), F.lit(".bamboohr.com/careers/"), r["id"])).otherwise(""),
        lambda r: city_in_germany(_bamboo_city(r)), lambda r: GUARD_LOWER("germany").keeps(_bamboo_country(r), _bamboo_city(r)),
        source_id=lambda r: F.concat(F.lit("bamboohr:"), _id(), F.lit(":"), r["id"]), detail=lambda b: F.get_json_object(b, "$.result.jobOpening.description"),
    ),
    "join": Vendor(
        lambda body: F.from_json(_next_data(body), f"props struct<pageProps:struct<initialState:struct<jobs:struct<items:array<struct<{_ITEM}>>>>>>")["props"]["pageProps"]["initialState"]["jobs"]["items"],
        lambda r: _text(r["title"]), lambda r: F.when(text_of(r["idParam"]) != "", F.concat(F.lit("https://join.com/companies/"), _id(), F.lit("/"), r["idParam"])).otherwise(""),
        lambda r: city_in_germany(text_of(r["city"]["cityName"])), lambda r: CountryPolicy("DE", "upper", "drop").keeps(r["country"]["iso3166"], F.lit("")),
        source_id=lambda r: F.concat(F.lit("join:"), _id(), F.lit(":"), r["id"].cast("string")), detail=lambda b: F.get_json_object(_next_data(b), "$.props.pageProps.initialState.job.description"),
    ),
    "onlyfy": Vendor(
        _onlyfy_cards, lambda r: text_of(r["title"]), _onlyfy_url, lambda r: F.concat(r["city"], F.lit(", Germany")), lambda r: surely_in_germany(r["city"]),
        source_id=lambda r: F.concat(F.lit("onlyfy:"), _id(), F.lit(":"), _onlyfy_url(r)),
    ),
}
WORKDAY_PAGE, WORKDAY_PAGES = 20, 5
_FACETS = "facets array<struct<values:array<struct<facetParameter:string,values:array<struct<descriptor:string,id:string>>>>>>"
_FOUND = "total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string>>"


def named(companies: DataFrame) -> DataFrame:
    """companies with source: what a payload's source_id says of each, its name, or '#' and its ord where names repeat.

    ord is a company's key: it is unique, and a name or url may change or repeat. A payload that gives a
    repeated name is no company's, as nothing tells whose it is.
    """
    often = companies.groupBy(F.col("name").alias("__name")).agg((F.count(F.lit(1)) > 1).alias("__often"))
    both = companies.join(often, F.col("name").eqNullSafe(F.col("__name")))
    return both.withColumn("source", F.when(F.col("__often"), F.concat(F.lit("#"), F.col("ord").cast("string"))).otherwise(F.col("name"))).drop("__name", "__often")


#: Source ids of no company that are dropped where payloads are read; any other one has less than a thousandth of the payloads.
MOST_STRANGERS = 1000


def of_companies(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    """payloads without those of the commonest ids that no company has, which no join with the companies would keep.

    A board has a single id: by it, all its responses would go to one task, only to fall out there. Ids are counted in
    a pass of their own, without the bodies.
    """
    known = companies.select(F.explode(F.array("name", F.concat(F.lit("#"), F.col("ord").cast("string")))).alias("source_id"))
    there = payloads.where("source_id is not null")
    strangers = there.groupBy("source_id").count().join(known, "source_id", "left_anti").orderBy(F.desc("count"), "source_id").limit(MOST_STRANGERS)
    return there.where(~F.col("source_id").isin([r["source_id"] for r in strangers.collect()]))


def workday_facets(payloads: DataFrame) -> DataFrame:
    """Per company, the ids by parameter of the location facets that lie in Germany, in order."""
    groups = payloads.where("kind = 'facets' and status = 200").select("source_id", F.explode(F.from_json("body", _FACETS)["facets"]).alias("g"))
    subs = groups.select("source_id", F.posexplode(F.col("g.values")).alias("i", "s")).where("s.facetParameter <> ''")
    each = subs.select("source_id", F.col("s.facetParameter").alias("param"), "i", F.posexplode(F.col("s.values")).alias("j", "v"))
    here = each.where(surely_in_germany(F.col("v.descriptor"))).select("source_id", "param", F.struct("i", "j").alias("at"), F.col("v.id").alias("id"))
    return paging.keyed_lists(here, ["source_id"], "param", "id", "at")


def scan_workday(payloads: DataFrame, companies: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Workday postings; companies without a facet in Germany have none, and what a detail places elsewhere goes.

    A search's pages end with an empty one, or where a page's own total is reached. Listings are read once,
    into a written table, so pages are counted before their rows are moved.
    """
    here = workday_facets(payloads).select("source_id")
    known = named(companies.where("ats = 'workday'")).select(F.col("source").alias("source_id"), F.col("name").alias("company"), F.col("identifier_workday").alias("w"), F.col("ord").alias("rank"))
    mine = payloads.join(here, "source_id", "left_semi").join(known, "source_id").where("status = 200")
    read = mine.where("kind = 'listing'").withColumn("found", F.from_json("body", _FOUND))
    read = staged(read.select("source_id", "request_key", "page", "company", "w", "rank", F.col("ord").alias("req"), "found.total", "found.jobPostings"), "workday")
    ends = (F.coalesce(F.array_size("jobPostings"), F.lit(0)) == 0) | (F.col("page") * WORKDAY_PAGE >= F.coalesce("total", F.lit(0)))
    pages = paging.until_last(read, ["source_id", "request_key"], "page", ends, WORKDAY_PAGES)
    each = pages.select("company", "w", "rank", "req", F.posexplode("jobPostings").alias("i", "r"))
    base = F.concat(F.lit("https://"), F.col("w.tenant"), F.lit("."), F.col("w.wd_host"), F.lit(".myworkdayjobs.com/"), F.col("w.site"))
    rows = each.where((text_of(F.col("r.externalPath")) != "") & (_text(F.col("r.title")) != "")).select(
        F.concat(F.lit("workday:"), "w.tenant", F.lit("/"), "w.site").alias("source_id"), _text(F.col("r.title")).alias("title"), "company",
        F.concat(base, F.col("r.externalPath")).alias("url"), text_of(F.col("r.locationsText")).alias("location"), F.lit("").alias("description"), packed_ord(1, F.col("rank"), F.col("req"), F.col("i")).alias("ord"),
    )
    rows = dedup.last_value_first_position(rows, ["source_id", "url"], "ord")
    asked = title_matches(F.col("title"), TITLE_TERMS if terms is None else terms)
    info = F.from_json("body", "jobPostingInfo struct<country:struct<descriptor:string>,jobDescription:string>")["jobPostingInfo"]
    details = dedup.first_wins(mine.where("kind = 'detail'").select("url", info.alias("info"), "ord"), ["url"], "ord").select("url", F.col("info.jobDescription").alias("description"), F.col("info.country.descriptor").alias("country"))
    foreign = details.where("country <> '' and country <> 'Germany'")
    matched = rows.where(asked).join(foreign.select("url"), "url", "left_semi")
    filled = lookups.filled(rows, details, ["url"], "description", asked)
    return lookups.without_foreign(filled, matched, ["url"]).where(maybe_in_germany(F.col("location")))


_ROW = "array<struct<source_id:string,title:string,company:string,url:string,location:string,description:string>>"


#: Vendors whose responses Python reads: what it makes of a body and its url, and the rows in that.
READ: dict[str, tuple[Callable[[str | None, str | None], list[dict]], Callable[[Column], Column]]] = {
    "personio": (lambda body, url: [{"xml": x} for x in _positions(body)], lambda found: F.transform(found, lambda x: F.from_xml(x["xml"], _POSITION))),
    "softgarden": (_links, lambda found: found),
    "onlyfy": (lambda body, url: _cards(body), lambda found: found),
}
_FOUND_FIELDS = ("title", "url", "city", "xml")


def _with_found(listings: DataFrame, names: list[str]) -> DataFrame:
    """listings (ats, page_url, body) with found, what Python makes of the bodies that it reads, in one pass; other bodies stay."""
    mine = [n for n in names if n in READ]
    if not mine:
        return listings

    def read(batch: dict[str, list]) -> list[pa.Array]:
        rows = [READ[a][0](b, u) if a in mine else None for a, b, u in zip(batch["ats"], batch["body"], batch["page_url"], strict=True)]
        return [listed(rows, _FOUND_FIELDS)]

    return with_read(listings, "ats", [n for n in names if n not in READ], ("ats", "body", "page_url"), read, "found array<struct<title:string,url:string,city:string,xml:string>>")


def _rows_of(name: str) -> Column:
    """A vendor's postings in a response; what its rules drop is left out. Other vendors' bodies are not parsed."""
    vendor = VENDORS[name]
    rows = READ[name][1](F.when(F.col("ats") == name, F.col("found"))) if name in READ else vendor.rows(F.when(F.col("ats") == name, F.col("body")))
    source = vendor.source_id or (lambda r: F.concat(F.lit(f"{name}:"), _id()))
    row = lambda r: F.struct(source(r).alias("source_id"), vendor.title(r).alias("title"), vendor.company(r).alias("company"), vendor.url(r).alias("url"), vendor.location(r).alias("location"), vendor.description(r).alias("description"))
    return F.transform(F.filter(rows, vendor.keep), row).cast(_ROW)


def _scan(payloads: DataFrame, companies: DataFrame, names: list[str], terms: list[str]) -> DataFrame:
    """Postings of some vendors: one pass over the listings, and one over the details."""
    known = named(companies.where(F.col("ats").isin(names))).select("source", F.col("name").alias("company"), "ats", "identifier", F.col("ord").alias("rank"))
    mine = payloads.join(known, payloads.source_id == F.col("source")).where("status = 200")
    listings = mine.where("kind = 'listing'").select("source", "company", "ats", "identifier", "rank", "ord", F.col("url").alias("page_url"), "body")
    listings = _with_found(listings, names).withColumn("rows", F.coalesce(*(F.when(F.col("ats") == n, _rows_of(n)) for n in names)))
    each = listings.select("ats", F.col("source").alias("asked_of"), "rank", F.col("ord").alias("req"), F.posexplode("rows").alias("i", "r"))
    rows = each.select("ats", "asked_of", "r.*", packed_ord(1, F.col("rank"), F.col("req"), F.col("i")).alias("ord"))
    if any(VENDORS[n].escaped for n in names):
        is_ = F.col("ats").isin([n for n in names if VENDORS[n].escaped])
        rows = rows.withColumn("description", F.when(is_, unescaped(F.when(is_, F.col("description")))).otherwise(F.col("description")))
    rows = with_url(rows)
    if "softgarden" in names and terms:  # without terms it keeps all
        rows = rows.where((F.col("ats") != "softgarden") | title_matches(F.col("title"), terms))
    columns = ["source_id", "title", "company", "url", "location", "description", "ord"]
    detailed = [n for n in names if VENDORS[n].detail]
    if not detailed:
        return rows.select(*columns)
    pages = dedup.first_wins(mine.where(F.col("ats").isin(detailed) & (F.col("kind") == "detail")).select(F.col("source").alias("asked_of"), "url", "ats", "body", "ord"), ["asked_of", "url"], "ord")
    of = F.coalesce(*(F.when(F.col("ats") == n, VENDORS[n].detail(F.when(F.col("ats") == n, F.col("body")))) for n in detailed))
    details = pages.select("asked_of", "url", of.alias("description"))
    for_titles = F.col("ats").isin([n for n in detailed if VENDORS[n].detail_for_titles])
    asked = F.col("ats").isin(detailed) & (~for_titles | title_matches(F.col("title"), terms))
    return lookups.filled(rows, details, ["asked_of", "url"], "description", asked, overwrite=True).select(*columns)


def scan_vendor(payloads: DataFrame, companies: DataFrame, name: str, terms: list[str] | None = None) -> DataFrame:
    """One vendor's postings with ord, of the companies whose ats it is."""
    return _scan(payloads, companies, [name], TITLE_TERMS if terms is None else terms)


def scan_companies(payloads: DataFrame, companies: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """All companies' postings; those of an unregistered vendor have none. ord follows the companies' order, after all boards."""
    return _scan_all(of_companies(payloads, companies), companies, terms)


def _scan_all(mine: DataFrame, companies: DataFrame, terms: list[str] | None) -> DataFrame:
    return _scan(mine, companies, list(VENDORS), TITLE_TERMS if terms is None else terms).unionByName(scan_workday(mine, companies, terms))


def scan_reported(payloads: DataFrame, companies: DataFrame, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """scan_companies() and failures(); the ids of payloads are counted once for both."""
    mine = of_companies(payloads, companies)
    return _scan_all(mine, companies, terms), _failures(mine, companies)


def failures(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    """What companies' scans can't read: responses of another status or shape, vendors without a reader, payloads of a repeated name.

    source_id, kind, request_key, page, url, reason, ord. It is worked out when it is read, in a pass of its own.
    """
    return _failures(of_companies(payloads, companies), companies)


def _failures(payloads: DataFrame, companies: DataFrame) -> DataFrame:
    known = named(companies)
    mine = payloads.join(known.select("source", F.col("name").alias("company"), "ats", "identifier"), payloads.source_id == F.col("source")).withColumn("page_url", F.col("url"))
    names, listing = list(VENDORS), F.col("kind") == "listing"
    read = F.coalesce(*(F.when(F.col("ats") == n, VENDORS[n].rows(F.when(listing, F.col("body"))).isNotNull()) for n in names), F.when(F.col("ats") == "workday", F.from_json("body", _FOUND)["jobPostings"].isNotNull()), F.lit(True))
    status = F.coalesce(F.col("status") == 200, F.lit(False))
    reason = F.when(~status, F.concat(F.lit("status "), text_of(F.col("status")))).when(listing & ~read, "no readable postings")
    what = ("source_id", "kind", "request_key", "page", "url", "reason", "ord")
    bad = mine.where(F.col("ats").isin([*names, "workday"])).withColumn("reason", reason).where("reason is not null").select(*what)
    shared = known.where(F.col("source") != F.col("name")).select(F.col("name").alias("source_id")).distinct()
    whose = payloads.join(shared, "source_id", "left_semi").withColumn("reason", F.lit("several companies have this name")).select(*what)
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    other = known.where(F.col("ats").isNotNull() & ~F.col("ats").isin([*names, "workday", "custom", "unresolved", ""]))
    other = other.select(F.col("source").alias("source_id"), F.lit("source").alias("kind"), no("string", "request_key"), no("int", "page"), no("string", "url"), F.concat(F.lit("no reader for vendor "), "ats").alias("reason"), no("bigint", "ord"))
    return bad.unionByName(whose).unionByName(other)
