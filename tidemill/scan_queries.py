"""Every board and vendor as a query: responses are written from the driver's parts, scanned, and held against plain SQL.

A part is a posting; twenty make a response, and a vendor's response is a company's. Each case has the
markup of one posting and of its detail page, and says in SQL what comes out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.scan import scan
from .sources import boards, vendors
from .sources.schema import COMPANY

TERMS = ["ring", "bolt"]
#: Parts whose responses a task writes: of one board or vendor, and where a task for each of all of them has its share.
TASK_ROWS, SHARED_TASK_ROWS = 10_000, 40_000
#: Urls of a sitemap: its protocol allows 50,000 at most, so a site with more has several.
SITEMAP_URLS = 20_000
#: Values by the remainder of a part's key, for fields the parts don't have.
VALUES = {
    "city": ["Berlin", "Madrid", "Ulm", "", "München"], "de": ["DE", "de", "US", ""], "german": ["Germany", "germany", "Spain", ""],
    "land": ["DEUTSCHLAND", "SPANIEN"], "abroad": ["AT", "DE"], "far": ["Norway", "Germany"], "full": ["", "Berlin full", "Madrid full"],
}
_JOBS = f"""j AS (SELECT p_partkey AS id, p_name AS title, p_brand AS company, p_partkey // 20 AS g, regexp_matches(p_name, '\\b(ring|bolt)\\b') AS hit, p_partkey % 3 = 0 AS has_detail,
  {", ".join(f"{v!r}[p_partkey % {len(v)} + 1] AS {k}" for k, v in VALUES.items())} FROM part)"""


@dataclass(frozen=True)
class Case:
    card: str
    url: str
    prefix: str = ""
    suffix: str = ""
    sep: str = ""
    detail: str = ""
    title: str = "title"
    company: str = "company"
    location: str = "city"
    description: str = "''"
    found: str = ""  # the description of a posting whose detail counts
    asked: str = "hit"
    where: str = "true"
    source: str = ""
    extra: dict = field(default_factory=dict)


_LD = '<script type="application/ld+json">%s</script>'
_NEXT = '<script id="__NEXT_DATA__" type="application/json">%s</script>'
_FULL = "'<p>full ' || id || '</p>'"


def _next(before: str, after: str) -> dict:
    prefix, suffix = (_NEXT % f"{before}\x00{after}").split("\x00")
    return {"prefix": prefix, "suffix": suffix, "sep": ","}


BOARDS = {
    "arbeitnow": Case(
        "<div data-link='https://a.test/{id}'><h3 itemprop='title'><a>{title} </a></h3><a itemprop='hiringOrganization'>{company}</a><span class='text-gray-600'>{city}</span></div>", "https://a.test/{id}",
        '{"data": "', '"}', detail='<div itemprop="description"><p>full {id}</p></div>', found=_FULL,
    ),
    "germantechjobs": Case("<item><title>{title} @ {company} [x]</title><link> https://r.test/{id} </link><description>d{id}</description></item>", "https://r.test/{id}", "<rss><channel>", "</channel></rss>", location="'Germany'", description="'d' || id"),
    "stepstone": Case(
        '<article data-testid="job-item"><a data-testid="job-item-title" href="/{id}">{title}</a><span data-at="job-item-company-name">{company}</span><span data-at="job-item-location">{city}</span><div data-at="jobcard-content"><b>s{id}</b></div></article>',
        "https://www.stepstone.de/{id}", description="'<b>s' || id || '</b>'", detail='<div data-at="job-ad-content"><p>full {id}</p></div>', found=_FULL,
    ),
    "devjobs": Case(
        '<a href="/job/{id}"><h2>{title}</h2><div class="ml-2"><p>{company}</p><span>{city}</span></div><p class="line-clamp-2">s{id}</p></a>', "https://en.devjobs.de/job/{id}", description="'s' || id",
        detail='<div class="x md:-mt-2 y"><p>full {id}</p></div>', found=_FULL, where="g % 10 < 7", extra={"empty": 7},
    ),
    "testdevjobs": Case(
        '<div class="job-tile-wrapper"><p class="jobtitle">{title}</p><p class="comptitle">{company}</p><a href="/job/{id}">x</a><span itemprop="address"><span itemprop="addressCountry">{city},</span><span itemprop="addressCountry">Remote</span></span></div>',
        "https://testdevjobs.com/job/{id}", location="trim(city || ' Remote')", detail='<div itemprop="description"><p>full {id}</p></div>', found=_FULL, where="g % 10 < 5", extra={"empty": 5},
    ),
    "wearedevelopers": Case("## {title}\n- **Company:** {company}\n- **Location:** {city}\n- [View job](https://w.test/{id})\n", "https://w.test/{id}", "# jobs\n", detail="# top\n## T\n\nfull {id}\n", found="'full ' || id"),
    "englishjobs": Case(
        '<div class="job js-job" id="{id}"><h3 itemprop="title"><b>{title}</b>\n x</h3><ul class="space-y-1"><li>{company}</li><li>{city}</li></ul><div class="mr-4">s{id}</div></div>', "https://englishjobs.de/clickout/{id}",
        title="title || ' x'", description="'s' || id",
    ),
    "builtin": Case(
        '<div class="job-bounded-responsive"><a data-id="job-card-title" href="/job/{id}">{title}</a><div data-id="company-title"><span>{company}</span></div><div class="d-flex x"><div><i class="fa-location-dot"></i></div><div><span>{city}</span></div></div><div><i class="fa-house-building"></i></div><span>Hybrid</span></div>',
        "https://builtin.com/job/{id}", location="trim(city || ' Hybrid')", detail='<div class="job-post-item"><p>full {id}</p></div>', found=_FULL,
    ),
    "xing": Case(
        '<article data-testid="job-search-result"><a href="/jobs/{id}"><h2 data-testid="job-teaser-list-title">{title}</h2></a><p class="x-Company-y">{company}</p><div class="multi-location-display-styles__Container-z"><span>{city}</span> <b>+ 2 weitere</b></div></article>',
        "https://www.xing.com/jobs/{id}", detail=_LD % '{"jobLocation": [{"address": {"addressCountry": "{abroad}"}}]}' + '<div data-testid="expandable-content"><p>full {id}</p></div>', found=_FULL,
        where="NOT (hit AND has_detail AND abroad = 'AT')",
    ),
    "get_in_it": Case(
        '{"title": "{title}", "company": {"title": "{company}"}, "url": "/p{id}", "locations": [{"name": "{city}"}, {"name": "Bonn"}]}', "https://www.get-in-it.de/p{id}",
        **_next('{"props": {"initialState": {"jobSearchJobs": {"jobs": [', "]}}}}"), location="CASE WHEN city = '' THEN 'Bonn' ELSE city || ', Bonn' END",
        detail=_NEXT % '{"props": {"initialState": {"jobJob": {"job": {"content": "full {id}"}}}}}', found="'full ' || id",
    ),
    "instaffo": Case(
        _LD % '{"@type": "JobPosting", "title": "{title}", "hiringOrganization": {"name": "{company}"}, "description": "d{id}", "jobLocation": [{"address": {"addressLocality": "{city}"}}, {}]}',
        "https://jobs.instaffo.com/en/job/{slug}-{hex}", description="'d' || id", where="contains(title, 'ring') OR contains(title, 'bolt')", extra={"single": True},
    ),
    "bundesagentur": Case(
        '{"referenznummer": "{id}", "stellenangebotsTitel": "{title}", "firma": "{company}", "stellenlokationen": [{"adresse": {"land": "{land}", "ort": "{city}"}}, {"adresse": {"land": "FRANKREICH", "ort": "Paris"}}, {"adresse": null}]}',
        "https://www.arbeitsagentur.de/jobsuche/jobdetail/{id}", '{"ergebnisliste": [', "]}", ",", where="land = 'DEUTSCHLAND'", detail=_LD % '{"@type": "JobPosting", "description": "full {id}"}', found="'full ' || id",
    ),
    "ferchau": Case(
        '{"slug": "/s{id}", "title": "{title}", "locationCountryCode": "{de}", "locationCity": "{city}", "locationCountry": "D", "intro": "i{id}", "tasks": "t", "tasksHeadline": "T", "contactPersonOrganizationName": "{company}"}',
        "https://touch.ferchau.com/s{id}", '<script>App.Data = {"ControllerResponse": {"Data": {"Offers": [', '], "OffersCount": {"total": 60}}}}; more()</script>', ",",
        location="CASE WHEN city = '' THEN 'D' ELSE city || ', D' END", description="'i' || id || '<p>T</p>t'", where="upper(de) = 'DE' AND g % 10 < 3",
    ),
    "munich_startup": Case(
        '<a href="/jobs/anzeige/{id}"><p class="text-card-title">{title}</p><p class="text-card-meta">{company}</p></a><a href="/jobs/anzeige/n{id}"></a>', "https://www.munich-startup.de/jobs/anzeige/{id}", location="'Germany'",
        detail='<div class="pinboard-prose"><p>full {id}</p></div>', found=_FULL,
    ),
    "stellenanzeigen": Case(
        '<div data-jobid="{id}"><h3><a href="/job/{id}">{title}</a></h3><p data-testid="company-name">{company}</p><i class="fa-map-marker-alt"></i><span>{city}</span></div>', "https://www.stellenanzeigen.de/job/{id}",
        detail=_LD % '{"description": "html <title>x</title> full {id}", "jobLocation": [{"address": {"addressCountry": " {abroad}"}}]}', found="'full ' || id", where="NOT (hit AND has_detail AND abroad = 'AT')",
    ),
}

_ABROAD = "city <> 'Madrid'"
_GERMANY = "CASE WHEN city = '' THEN 'Germany' ELSE city || ', Germany' END"
_OWN = "'Company' || g"
VENDORS = {
    "greenhouse": Case(
        '{"title": " {title} ", "company_name": "{company}", "absolute_url": "https://g.test/{id}", "location": {"name": "{city}"}, "content": "&lt;p&gt;{id}&lt;/p&gt;"}', "https://g.test/{id}", '{"jobs": [', "]}", ",",
        description="'<p>' || id || '</p>'", where=_ABROAD,
    ),
    "lever": Case('{"text": "{title}", "hostedUrl": "https://l.test/{id}", "categories": {"location": "{city}"}, "description": "d{id}", "country": "{de}"}', "https://l.test/{id}", "[", "]", ",", company=_OWN, description="'d' || id", where=f"CASE WHEN de <> '' THEN upper(de) = 'DE' ELSE {_ABROAD} END"),
    "ashby": Case(
        '{"title": "{title}", "jobUrl": "https://h.test/{id}", "location": "{city}", "address": {"postalAddress": {"addressCountry": "{german}"}}, "descriptionHtml": "d{id}"}', "https://h.test/{id}", '{"jobs": [', "]}", ",", company=_OWN,
        description="'d' || id", where=f"CASE WHEN german <> '' THEN lower(german) = 'germany' ELSE {_ABROAD} END",
    ),
    "smartrecruiters": Case(
        '{"id": "{id}", "name": "{title}", "location": {"country": "{de}", "city": "{city}", "fullLocation": "{full}"}}', "https://jobs.smartrecruiters.com/c{g}/{id}", '{"content": [', "]}", ",", company=_OWN, location="CASE WHEN \"full\" = '' THEN city ELSE \"full\" END",
        detail='{"jobAd": {"sections": {"additionalInformation": {"text": "a{id}"}, "qualifications": {"text": ""}, "jobDescription": {"text": "j{id}"}}}}', found="'j' || id || chr(10) || 'a' || id",
        where="CASE WHEN de <> '' THEN lower(de) = 'de' ELSE \"full\" <> 'Madrid full' END",
    ),
    "personio": Case(
        "<position><id>{id}</id><name>{title}</name><office>{city}</office><additionalOffices><office>X{id}</office></additionalOffices><jobDescriptions><jobDescription><name>n</name><value><![CDATA[<b>{id}</b>]]></value></jobDescription><jobDescription><name>n</name><value>y</value></jobDescription></jobDescriptions></position>",
        "https://c{g}.jobs.personio.de/job/{id}", "<workzag-jobs>", "</workzag-jobs>", company=_OWN, location="CASE WHEN city = '' THEN '' ELSE city || ', ' END || 'X' || id", description="'<b>' || id || '</b>' || chr(10) || 'y'", where=_ABROAD,
    ),
    "workable": Case('{"title": "{title}", "shortlink": "https://k.test/{id}", "country": "{german}", "city": "{city}", "description": "d{id}"}', "https://k.test/{id}", '{"jobs": [', "]}", ",", company=_OWN, location=_GERMANY, description="'d' || id", where=f"CASE WHEN german <> '' THEN german = 'Germany' ELSE {_ABROAD} END"),
    "recruitee": Case('{"title": "{title}", "careers_url": "https://e.test/{id}", "country_code": "{de}", "location": "{city}", "description": "d{id}"}', "https://e.test/{id}", '{"offers": [', "]}", ",", company=_OWN, location="CASE WHEN city = '' THEN 'Germany' ELSE city END", description="'d' || id", where="upper(de) = 'DE'"),
    "softgarden": Case('<a href="/job/{id}">{title}\n x</a><a href="/other/{id}">y</a>', "https://c{g}.softgarden.io/job/{id}", title="title || ' x'", company=_OWN, location="'Germany'", detail="<body><h1>T</h1><p>full  {id}</p></body>", found="'T full ' || id", asked="true", where="hit", source="'softgarden:c' || g || ':' || url"),
    "bamboohr": Case(
        '{"id": "{id}", "jobOpeningName": "{title}", "location": {"city": "{city}", "addressCountry": "{german}"}, "atsLocation": {"country": "{german}"}}', "https://c{g}.bamboohr.com/careers/{id}", '{"result": [', "]}", ",", company=_OWN, location=_GERMANY,
        detail='{"result": {"jobOpening": {"description": "full {id}"}}}', found="'full ' || id", asked="true", where=f"CASE WHEN german <> '' THEN lower(german) = 'germany' ELSE {_ABROAD} END", source="'bamboohr:c' || g || ':' || id",
    ),
    "join": Case(
        '{"id": {id}, "idParam": "{id}-x", "title": "{title}", "city": {"cityName": "{city}"}, "country": {"iso3166": "{de}"}}', "https://join.com/companies/c{g}/{id}-x", **_next('{"props": {"pageProps": {"initialState": {"jobs": {"items": [', "]}}}}}"), company=_OWN, location=_GERMANY,
        detail=_NEXT % '{"props": {"pageProps": {"initialState": {"job": {"description": "full {id}"}}}}}', found="'full ' || id", asked="true", where="upper(de) = 'DE'", source="'join:c' || g || ':' || id",
    ),
    "onlyfy": Case('<a data-testid="job-card" href="/j{id}"><h3 data-testid="job-title">{title}</h3><p data-testid="job-more-info">{city} | Full</p></a>', "https://c{g}.onlyfy.jobs/j{id}", company=_OWN, location="city || ', Germany'", where="city IN ('Berlin', 'München')", source="'onlyfy:c' || g || ':' || url"),
    "workday": Case(
        '{"title": "{title}", "externalPath": "/job/{id}", "locationsText": "{city}"}', "https://t{g}.wd3.myworkdayjobs.com/s/job/{id}", '{"total": 20, "jobPostings": [', "]}", ",", company=_OWN,
        detail='{"jobPostingInfo": {"country": {"descriptor": "{far}"}, "jobDescription": "full {id}"}}', found="'full ' || id", where=f"g % 3 <> 0 AND {_ABROAD} AND NOT (hit AND has_detail AND far = 'Norway')", source="'workday:t' || g || '/s'",
    ),
}


def _jobs(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    values = [F.get(F.array(*map(F.lit, v)), (key % len(v)).cast("int")).alias(k) for k, v in VALUES.items()]
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("slug")
    jobs = part.select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.floor(key / 20).cast("int").alias("g"), slug, F.lpad(key.cast("string"), 12, "0").alias("hex"), *values)
    # Rows are small and their responses are not, so tasks go by the number of rows; by bytes, Spark would take one for all.
    return jobs.repartition(max(1, math.ceil(part.count() / task_rows)), "g")


_NAMES = ["id", "title", "company", "g", "slug", "hex", *VALUES]


def _written(template: str, of: Column | None = None) -> Column:
    """A template with the fields of a posting (of: a struct of them) in it."""
    parts, names = [], _NAMES
    rest = template
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in names if "{" + n + "}" in rest), default=(len(rest), None))
        parts.append(F.lit(rest[:at]))
        if name is not None:
            parts.append((F.col(name) if of is None else of[name]).cast("string"))
        rest = rest[at + len(name) + 2 :] if name else ""
    return F.concat(*parts)


def _payloads(jobs: DataFrame, name: str, case: Case, source: Column) -> DataFrame:
    """The responses of one board or vendor about these postings, and the details of every third."""
    empty = case.extra.get("empty")
    request = lambda g: (F.floor(g / 10).cast("string").alias("request_key"), (g % 10 + 1).alias("page"))
    paged = name not in VENDORS
    base = "https://x.test/" if paged else f"https://c%s.{name}.io/"
    if case.extra.get("single"):
        listings = jobs.select(source.alias("source_id"), F.lit("").alias("request_key"), F.lit(1).alias("page"), F.lit("listing").alias("kind"), _written(case.url).alias("url"), F.lit(200).alias("status"), _written(case.card).alias("body"), F.col("id").cast("long").alias("ord"))
        maps = jobs.groupBy(F.floor(F.col("id") / SITEMAP_URLS).alias("map"))
        urls = maps.agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), _written(case.url), F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
        return listings.unionByName(urls.select(source.alias("source_id"), F.lit("").alias("request_key"), F.lit(1).alias("page"), F.lit("sitemap").alias("kind"), F.lit("").alias("url"), F.lit(200).alias("status"), "body", F.lit(0).cast("long").alias("ord")))
    # What a card is written of is grouped, not its markup: tasks that sort by group hold less, and less is shuffled.
    needed = [n for n in _NAMES if n != "id" and "{" + n + "}" in case.card]
    cards = jobs.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", *needed))).alias("cards"))
    text = F.array_join(F.transform("cards", lambda c: _written(case.card, c)), case.sep)
    if empty is not None:
        text = F.when(F.col("g") % 10 == empty, F.lit("")).otherwise(text)
    key, page = request(F.col("g"))
    url = F.lit(base) if paged else F.format_string(base, "g")
    listings = cards.select(source.alias("source_id"), key, (page if paged else F.lit(1)).alias("page"), F.lit("listing").alias("kind"), url.alias("url"), F.lit(200).alias("status"), F.concat(F.lit(case.prefix), text, F.lit(case.suffix)).alias("body"), F.col("g").cast("long").alias("ord"))
    if case.detail:
        details = jobs.where("id % 3 = 0").select(source.alias("source_id"), F.lit("").alias("request_key"), F.lit(1).alias("page"), F.lit("detail").alias("kind"), _written(case.url).alias("url"), F.lit(200).alias("status"), _written(case.detail).alias("body"), F.col("id").cast("long").alias("ord"))
        listings = listings.unionByName(details)
    if name == "workday":
        places = F.when(F.col("g") % 3 == 0, F.lit("Oslo")).otherwise(F.lit("Berlin"))
        body = F.concat(F.lit('{"facets": [{"values": [{"facetParameter": "loc", "values": [{"descriptor": "'), places, F.lit('", "id": "1"}]}]}]}'))
        listings = listings.unionByName(cards.select(source.alias("source_id"), F.lit("").alias("request_key"), F.lit(1).alias("page"), F.lit("facets").alias("kind"), F.lit("").alias("url"), F.lit(200).alias("status"), body.alias("body"), F.lit(0).cast("long").alias("ord")))
    return listings


def _companies(jobs: DataFrame, ats: Column) -> DataFrame:
    rows = jobs.select("g").distinct()
    workday = F.struct(F.concat(F.lit("t"), "g").alias("tenant"), F.lit("wd3").alias("wd_host"), F.lit("s").alias("site"))
    found = {"name": F.concat(F.lit("Company"), "g"), "ats": ats, "identifier": F.concat(F.lit("c"), "g"), "identifier_workday": workday, "ord": F.col("g").cast("long")}
    types = dict(x.rsplit(" ", 1) for x in COMPANY.replace("identifier_workday struct<tenant:string,wd_host:string,site:string>, ", "").split(", "))
    return rows.select(*(found.get(n, F.lit(None).cast(t)).alias(n) for n, t in types.items()), workday.alias("identifier_workday"))


_COLUMNS = ("source_id", "title", "company", "url", "location", "description")


def _sql(name: str, case: Case, where: str = "true") -> str:
    """What comes out of a case's responses, over j."""
    url = "'" + case.url.replace("{slug}", "' || replace(title, ' ', '-') || '").replace("{hex}", "' || lpad(id::VARCHAR, 12, '0') || '").replace("{id}", "' || id || '").replace("{g}", "' || g || '") + "'"
    source = case.source or (f"'{name}'" if name in BOARDS else f"'{name}:c' || g")
    text = f"CASE WHEN has_detail AND {case.asked} THEN {case.found} ELSE {case.description} END" if case.detail else case.description
    return f"SELECT {source} AS source_id, {case.title} AS title, {case.company} AS company, url, {case.location} AS location, {text} AS description FROM (SELECT *, {url} AS url FROM j) WHERE ({case.where}) AND {where}"


def _board_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        payloads = _payloads(_jobs(spark, sf_dir), name, BOARDS[name], F.lit(name))
        return boards.scan_board(payloads, name, TERMS).select(*_COLUMNS)

    return run


def _vendor_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jobs = _jobs(spark, sf_dir)
        payloads = _payloads(jobs, name, VENDORS[name], F.concat(F.lit("Company"), "g"))
        companies = _companies(jobs, F.lit(name))
        found = vendors.scan_workday(payloads, companies, TERMS) if name == "workday" else vendors.scan_vendor(payloads, companies, name, TERMS)
        return found.select(*_COLUMNS)

    return run


def _everything(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """payloads, sources, active, companies: all boards about all parts, and each vendor about the companies that are its own."""
    jobs, names = _jobs(spark, sf_dir, SHARED_TASK_ROWS), list(VENDORS)
    payloads = None
    for name, case in BOARDS.items():
        some = _payloads(jobs, name, case, F.lit(name))
        payloads = some if payloads is None else payloads.unionByName(some)
    for i, name in enumerate(names):
        payloads = payloads.unionByName(_payloads(jobs.where(F.col("g") % len(names) == i), name, VENDORS[name], F.concat(F.lit("Company"), "g")))
    known = {v: k for k, v in boards.ADAPTERS.items()}
    sources = spark.createDataFrame([(n, known.get(n, n)) for n in BOARDS] + [("other", "todo")], "id string, adapter string")
    active = sources.select("id").unionByName(spark.createDataFrame([("missing",)], "id string"))
    ats = F.get(F.array(*map(F.lit, names)), (F.col("g") % len(names)).cast("int"))
    return payloads, sources, active, _companies(jobs, ats)


def q_scan_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All active sources in one plan; the place of each source in the order of ids."""
    payloads, sources, active, _ = _everything(spark, sf_dir)
    return boards.scan_boards(payloads, sources, active, TERMS).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.shiftright("ord", 42)).alias("rank"))


def q_scan_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies in one plan, each by its vendor."""
    payloads, _, _, companies = _everything(spark, sf_dir)
    return vendors.scan_companies(payloads, companies, TERMS).select(*_COLUMNS)


def q_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards, then companies, with one order."""
    payloads, sources, active, companies = _everything(spark, sf_dir)
    rows = scan(payloads, sources, active, companies, TERMS)
    return rows.groupBy((F.shiftright("ord", 62) == 1).alias("of_company")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("n_ord"), F.count_if(F.col("description") != "").alias("n_described"))


def _variant(jobs: DataFrame, name: str, case: Case, source: Column, nth: int, page: Column, body: Column | None = None) -> DataFrame:
    """One more listing page a group, of postings of its own (their ids above those of the parts), or with a body of its own."""
    more = jobs.withColumn("id", F.col("id") + 10_000_000 * nth)
    listing = _payloads(more, name, case, source).where("kind = 'listing'")
    group = F.col("ord")
    return listing.withColumn("request_key", group.cast("string")).withColumn("page", page).withColumn("body", F.col("body") if body is None else F.coalesce(body, F.col("body"))).withColumn("ord", group * 8 + nth)


def q_scan_workday_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: by company, a second page that is empty, full, beyond the total or missing; what counts of the third and fourth."""
    jobs, case, source = _jobs(spark, sf_dir), VENDORS["workday"], F.concat(F.lit("Company"), "g")
    g, none = F.col("ord"), '{"total": 100, "jobPostings": []}'
    total = lambda n: F.replace(F.col("body"), F.lit('"total": 20'), F.lit(f'"total": {n}'))
    first = _payloads(jobs, "workday", case, source)
    first = first.withColumn("request_key", F.when(F.col("kind") == "listing", g.cast("string")).otherwise("")).withColumn("body", F.when((F.col("kind") == "listing") & (g % 4 != 2), total(100)).otherwise(F.col("body"))).withColumn("ord", F.when(F.col("kind") == "listing", g * 8).otherwise(g))
    second = _variant(jobs, "workday", case, source, 1, F.lit(2), F.when(g % 4 == 0, F.lit(none)).otherwise(total(100))).where("cast(request_key as long) % 4 <> 3")
    third = _variant(jobs, "workday", case, source, 2, F.lit(3), total(60))
    fourth = _variant(jobs, "workday", case, source, 3, F.lit(4), total(100))
    payloads = first.unionByName(second).unionByName(third).unionByName(fourth)
    return vendors.scan_workday(payloads, _companies(jobs, F.lit("workday")), TERMS).select("source_id", "url", "company")


def q_scan_ferchau_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: an offer-less page that does not end a search, one without data that does, a repeated page, and the cap of four."""
    jobs, case, source = _jobs(spark, sf_dir), BOARDS["ferchau"], F.lit("ferchau")
    g = F.col("ord")
    many = F.replace(F.col("body"), F.lit('"total": 60'), F.lit('"total": 500'))
    empty = F.lit('App.Data = {"ControllerResponse": {"Data": {"Offers": [], "OffersCount": {"total": 500}}}}')
    payloads = _variant(jobs, "ferchau", case, source, 0, F.lit(1), many).unionByName(_variant(jobs, "ferchau", case, source, 1, F.lit(2), F.when(g % 3 == 0, empty).when(g % 3 == 1, F.lit("<html>sorry</html>")).otherwise(many)))
    payloads = payloads.unionByName(_variant(jobs, "ferchau", case, source, 2, F.lit(3), many)).unionByName(_variant(jobs, "ferchau", case, source, 3, F.lit(3), many))
    payloads = payloads.unionByName(_variant(jobs, "ferchau", case, source, 4, F.lit(4), many)).unionByName(_variant(jobs, "ferchau", case, source, 5, F.lit(5), many))
    return boards.scan_board(payloads, "ferchau", TERMS).select("url", "company")


_BROKEN = ["", "{broken", "[]", "<rss><channel>", "<html>", '{"ergebnisliste": 3}']


def _with_broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads of the boards that built-in functions read, and of one that Python does, a good one and a broken one a group; their names."""
    jobs, names = _jobs(spark, sf_dir), ["bundesagentur", "ferchau", "germantechjobs", "arbeitnow"]
    broken = F.get(F.array(*map(F.lit, _BROKEN)), (F.col("ord") % len(_BROKEN)).cast("int"))
    out = None
    for name in names:
        good = _payloads(jobs, name, BOARDS[name], F.lit(name)).where("kind = 'listing'").withColumn("page", F.lit(1)).withColumn("request_key", F.concat(F.lit("good "), "ord"))
        bad = good.withColumn("status", F.when(F.col("ord") % 5 == 4, 503).otherwise(200)).withColumn("body", broken).withColumn("request_key", F.concat(F.lit("bad "), "ord")).withColumn("ord", F.col("ord") + 1_000_000)
        both = good.unionByName(bad)
        out = both if out is None else out.unionByName(both)
    return out, spark.createDataFrame([(n, n) for n in names] + [("todo", "no such board")], "id string, adapter string")


def q_scan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of good bodies, failures of broken ones and of sources that can't be asked, and the counts of the same pass."""
    payloads, sources = _with_broken(spark, sf_dir)
    active = sources.select("id").unionByName(spark.createDataFrame([("missing",)], "id string"))
    found = boards.scan_reported(payloads, sources, active, TERMS)
    sides = found.failures.groupBy("source_id", F.regexp_replace("reason", "^[A-Za-z]+Error: .*", "error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    rows = found.postings.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).select("source_id", F.lit("read").alias("reason"), "n")
    counts = F.array(*(F.struct(F.lit(k).alias("reason"), F.lit(found.counts[k]).cast("long").alias("n")) for k in ("n_listings", "n_failed_listings")))
    passed = spark.range(1).select(F.explode(counts).alias("c")).select(F.lit("all").alias("source_id"), "c.*")
    return sides.unionByName(rows).unionByName(passed)


def q_scan_companies_of_one_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of one name are apart by key, and a payload that gives the name alone is no one's."""
    jobs = _jobs(spark, sf_dir)
    companies = _companies(jobs, F.lit("lever")).withColumn("name", F.concat(F.lit("Twin"), F.floor(F.col("ord") / 2)))
    keyed = _payloads(jobs, "lever", VENDORS["lever"], F.concat(F.lit("#"), "g"))
    named = _payloads(jobs.withColumn("id", F.col("id") + 10_000_000), "lever", VENDORS["lever"], F.concat(F.lit("Twin"), F.floor(F.col("g") / 2)))
    payloads = keyed.unionByName(named)
    lost = vendors.failures(payloads, companies).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    read = vendors.scan_companies(payloads, companies, TERMS).groupBy(F.col("source_id").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return read.unionByName(lost)


_BOARD_ROWS = " UNION ALL ".join(f"({_sql(n, c)})" for n, c in BOARDS.items())
_COMPANY_ROWS = " UNION ALL ".join(f"({_sql(n, c, f'g % {len(VENDORS)} = {i}')})" for i, (n, c) in enumerate(VENDORS.items()))
QUERIES = {f"q_scan_{n}": _board_query(n) for n in BOARDS} | {f"q_scan_{n}": _vendor_query(n) for n in VENDORS}
QUERIES |= {f.__name__: f for f in (q_scan_boards, q_scan_companies, q_scan_all, q_scan_workday_pages, q_scan_ferchau_pages, q_scan_failures, q_scan_companies_of_one_name)}
ORACLE_SQL = {f"q_scan_{n}": f"WITH {_JOBS} {_sql(n, c)}" for n, c in (BOARDS | VENDORS).items()} | {
    "q_scan_boards": f"WITH {_JOBS}, r AS ({_BOARD_ROWS}) SELECT source_id, count(*) AS n, (list_position(list_sort([{', '.join(repr(n) for n in [*BOARDS, 'other'])}]), source_id) - 1)::BIGINT AS rank FROM r GROUP BY source_id",
    "q_scan_companies": f"WITH {_JOBS} {_COMPANY_ROWS}",
    "q_scan_all": f"WITH {_JOBS}, r AS (SELECT *, false AS of_company FROM ({_BOARD_ROWS}) UNION ALL SELECT *, true FROM ({_COMPANY_ROWS})) SELECT of_company, count(*) AS n, count(*) AS n_ord, count(*) FILTER (description <> '') AS n_described FROM r GROUP BY of_company",
    "q_scan_workday_pages": f"""WITH {_JOBS}, v AS (SELECT *, unnest([0, 1, 2, 3]) AS p FROM j)
SELECT 'workday:t' || g || '/s' AS source_id, 'https://t' || g || '.wd3.myworkdayjobs.com/s/job/' || (id + 10000000 * p) AS url, {_OWN} AS company FROM v
WHERE g % 3 <> 0 AND {_ABROAD} AND NOT (p = 0 AND hit AND has_detail AND far = 'Norway')
  AND (p = 0 OR (p < 3 AND g % 4 = 1))""",
    "q_scan_ferchau_pages": f"""WITH {_JOBS}, v AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS p FROM j)
SELECT 'https://touch.ferchau.com/s' || (id + 10000000 * p) AS url, company FROM v
WHERE upper(de) = 'DE' AND (p = 0 OR (p = 1 AND g % 3 = 2) OR (p IN (2, 3, 4) AND g % 3 <> 1))""",
    "q_scan_failures": f"""WITH {_JOBS}, g AS (SELECT DISTINCT g FROM j), s AS (SELECT unnest(['bundesagentur', 'ferchau', 'germantechjobs', 'arbeitnow']) AS source_id),
f AS (SELECT source_id, CASE WHEN g % 5 = 4 THEN 'status 503' WHEN source_id = 'germantechjobs' THEN 'no readable XML' WHEN source_id = 'ferchau' THEN 'no readable JSON'
  WHEN source_id = 'bundesagentur' AND g % 6 NOT IN (2, 5) THEN 'no readable JSON' WHEN source_id = 'arbeitnow' AND g % 6 NOT IN (2, 5) THEN 'error' END AS reason FROM g, s)
SELECT source_id, reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'missing', 'source not found', 1 UNION ALL SELECT 'todo', 'no board for adapter no such board', 1
UNION ALL SELECT source_id, 'read', count(*) FROM j, s WHERE source_id NOT IN ('bundesagentur', 'ferchau') OR (source_id = 'bundesagentur' AND land = 'DEUTSCHLAND') OR (source_id = 'ferchau' AND upper(de) = 'DE') GROUP BY ALL
UNION ALL SELECT 'all', 'n_listings', (SELECT 2 * count(*) FROM g, s) UNION ALL SELECT 'all', 'n_failed_listings', (SELECT count(reason) FROM f)""",
    "q_scan_companies_of_one_name": f"""WITH {_JOBS}, c AS (SELECT g, count(*) OVER (PARTITION BY g // 2) > 1 AS twin FROM (SELECT DISTINCT g FROM j)), w AS (SELECT j.*, twin FROM j JOIN c USING (g))
SELECT 'lever:c' || g AS reason, count(*) AS n FROM w WHERE (CASE WHEN de <> '' THEN upper(de) = 'DE' ELSE {_ABROAD} END) GROUP BY g
UNION ALL SELECT 'several companies have this name', count(*) FROM c WHERE twin HAVING count(*) > 0""",
}
