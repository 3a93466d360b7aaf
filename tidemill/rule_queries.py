"""The fixed rules, the resolution of companies and the report's sinks as queries, each with DuckDB SQL.

The driver's tables hold no postings. Where a rule needs text of its own, a case is dealt to each row by
its key, and the SQL either works the rule out again or lists what each case comes to.
"""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .functions.text import collapse, join_filled, squeeze_name, strip, text_of
from .operators import containment, dedup, predicates, report, resolve
from .operators.dedup import SeenTable
from .operators.outbox import Outbox
from .operators.predicates import CountryPolicy
from .operators.staging import scratch
from .plans.report import build_report
from .plans.report import run as run_report
from .plans.scan import CompaniesTable
from .queries import table
from .sources import boards, config, fetch, vendors
from .sources.schema import PAYLOAD

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def dealt(values: list, key: str) -> Column:
    """One of the values by the remainder of a key."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def listed(values: list, key: str) -> str:
    """The same in SQL."""
    text = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{text}][{key} % {len(values)} + 1]"


# ---- predicates

#: Statements, and whether they require German.
STATEMENTS = {
    "Deutsch auf C1 Niveau": True, "German language skills are a must": True, "very good knowledge of the German language": True, "Fließende Deutschkenntnisse; kein Muss": True,
    "Deutschkenntnisse von Vorteil": False, "gute Deutschkenntnisse von Vorteil": False, "German C1 is a plus": False, "German C1, English optional": True, "German B2 (English is nice to have)": True,
    "fluent in German": True, "native German speaker": True, "we are a German company": False, "": False, "Englisch C1": False, "Deutsch als Muttersprache": True, "Deutschkenntnisse (erforderlich)": True,
}


@query(f"SELECT p_partkey, {listed(list(STATEMENTS.values()), 'p_partkey')} AS required FROM part")
def q_german_statement(spark, sf_dir):
    """all twelve statements and their disclaimers."""
    part = table(spark, sf_dir, "part").withColumn("text", F.concat(dealt(list(STATEMENTS), "p_partkey"), F.lit(". "), "p_name"))
    return part.select("p_partkey", predicates.states_german(F.col("text")).alias("required"))


_PROSE = "wir sind ein team und du bist für die tests bei uns auf dem weg zum kunden mit der app " * 2


@query(f"SELECT p_partkey, ({listed(list(STATEMENTS.values()), 'p_partkey')} OR p_partkey % 3 = 0) AS german FROM part")
def q_german_required(spark, sf_dir):
    """a statement, or else prose that is mostly German."""
    part = table(spark, sf_dir, "part")
    text = F.concat(dealt(list(STATEMENTS), "p_partkey"), F.lit(". "), F.when(F.col("p_partkey") % 3 == 0, F.lit(_PROSE)).otherwise(F.lit("the app is for you and the team")))
    return part.select("p_partkey", predicates.german_required(text).alias("german"))


PLACES = ["Berlin", "Paris", "Paris or Munich", "Remote", "", "KÖLN", "Koeln", "Uk", "Ukraine", "U.S.", "Essen, Germany", "Vienna, Austria", "Nürnberg", "new york, usa", None]
_SURE = f"regexp_matches(coalesce(place, ''), '(?i){rules.IN_GERMANY}')"
_MAYBE = f"({_SURE} OR NOT regexp_matches(coalesce(place, ''), '(?i){rules.ABROAD}'))"


@query(f"SELECT p_partkey, {_MAYBE} AS maybe, {_SURE} AS sure FROM (SELECT p_partkey, {listed(PLACES, 'p_partkey')} AS place FROM part)")
def q_in_germany(spark, sf_dir):
    """the guard that keeps what it doesn't know, and the one that drops it."""
    place = dealt(PLACES, "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", predicates.maybe_in_germany(place).alias("maybe"), predicates.surely_in_germany(place).alias("sure"))


#: Location, description, and whether that is the city and remote.
SCOPES = [
    ("München", "", True, False), ("Berlin", "our office is in Munich", False, False), (" Deutschland ", "Büro in MÜNCHEN", True, False), ("", "x", False, False), ("Germany (Remote)", "", False, True), ("Berlin", "100 % remote", False, True),
    ("Berlin", "not fully remote", False, False), ("Berlin", "not here. Fully remote", False, True), ("Berlin", "remote-first", False, False), ("Ulm", "kein full-remote; komplett remote", False, True), ("Muenchen, remote", "", True, True), (None, None, False, False),
]


@query(f"SELECT p_partkey, {listed([s[2] for s in SCOPES], 'p_partkey')} AS city, {listed([s[3] for s in SCOPES], 'p_partkey')} AS remote FROM part")
def q_scope_rules(spark, sf_dir):
    """the city and remote scopes with their own words."""
    location, text = (dealt([s[i] for s in SCOPES], "p_partkey") for i in (0, 1))
    return table(spark, sf_dir, "part").select("p_partkey", predicates.in_scope_city(location, text).alias("city"), predicates.in_scope_remote(location, text).alias("remote"))


@query(f"SELECT p_partkey, 'city' AS scope FROM part WHERE {listed([s[2] for s in SCOPES], 'p_partkey')} UNION ALL SELECT p_partkey, 'remote' FROM part WHERE {listed([s[3] for s in SCOPES], 'p_partkey')}")
def q_filter_scopes(spark, sf_dir):
    """the scopes by name as filters."""
    part = table(spark, sf_dir, "part").select("p_partkey", *(dealt([s[i] for s in SCOPES], "p_partkey").alias(n) for i, n in enumerate(("location", "description"))))
    return predicates.filter_scope(part, "city").select("p_partkey", F.lit("city").alias("scope")).unionByName(predicates.filter_scope(part, "remote").select("p_partkey", F.lit("remote").alias("scope")))


TITLES = ["Senior QA Engineer (m/w/d)", "Softwaretester", "Softwaretesterin", "SDET II", "Equality Engineer", "qualitätsingenieur", "Head of Baking", None, "Software-Testingenieur"]
_TITLES = [True, True, False, True, False, True, False, False, True]


@query(f"SELECT p_partkey, {listed(TITLES, 'p_partkey')} AS title FROM part WHERE {listed(_TITLES, 'p_partkey')}")
def q_title_terms(spark, sf_dir):
    """the fixed terms."""
    return predicates.filter_title(table(spark, sf_dir, "part").select("p_partkey", dealt(TITLES, "p_partkey").alias("title")))


_COUNTRIES = ["DE", " de ", "Germany", "AT", "", None]
_POLICIES = [(f, m) for f in ("none", "lower", "upper") for m in ("keep", "drop", "guard")]


def _policy_sql(fold: str, missing: str) -> str:
    value = {"none": "c", "lower": "lower(trim(c))", "upper": "upper(trim(c))"}[fold]
    other = {"keep": "true", "drop": "false", "guard": _MAYBE}[missing]
    return f"CASE WHEN {value} <> '' THEN {value} = '{'de' if fold == 'lower' else 'DE'}' ELSE {other} END AS {fold}_{missing}"


@query(f"SELECT p_partkey, {', '.join(_policy_sql(*p) for p in _POLICIES)} FROM (SELECT p_partkey, coalesce({listed(_COUNTRIES, 'p_partkey')}, '') AS c, {listed(PLACES, 'p_partkey // 6')} AS place FROM part)")
def q_country_rules(spark, sf_dir):
    """F8: every fold with every meaning of a missing country."""
    country, place = dealt(_COUNTRIES, "p_partkey"), F.get(F.array(*map(F.lit, PLACES)), (F.floor(F.col("p_partkey") / 6) % len(PLACES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", *(CountryPolicy("de" if f == "lower" else "DE", f, m).keeps(country, place).alias(f"{f}_{m}") for f, m in _POLICIES))


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url ELSE '' END AS url FROM pages WHERE page_id % 3 > 0")
def q_with_url(spark, sf_dir):
    """rows without a url go."""
    return predicates.with_url(table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, F.col("url")).when(F.col("page_id") % 2 > 0, "").alias("url")))


_TERMS = ["Größe", "the and", "für"]
_SLUG = "replace(replace(replace(replace(lower(replace(regexp_replace(regexp_extract(url, '[^/]*$'), '-[0-9a-f]{12}$', ''), '-', ' ')), 'ä', 'a'), 'ö', 'o'), 'ü', 'u'), 'ß', 'ss')"
_SLUGS = ["die-Grösse-des-0123456789ab", "the-and-more", "theand-0123456789ab", "fur-alle", "nothing", "grosse-x-0123456789a"]


@query(f"SELECT page_id, (contains(s, 'grosse') OR contains(s, 'the and') OR contains(s, 'fur')) AS wanted FROM (SELECT page_id, {_SLUG} AS s FROM (SELECT page_id, 'https://a.test/en/job/' || {listed(_SLUGS, 'page_id')} AS url FROM pages))")
def q_slug_prefilter(spark, sf_dir):
    """the words of a slug, umlauts written plainly, hold a term."""
    return table(spark, sf_dir, "pages").select("page_id", boards.slug_matches(F.concat(F.lit("https://a.test/en/job/"), dealt(_SLUGS, "page_id")), _TERMS).alias("wanted"))


@query("""SELECT s_suppkey AS source_id, t.term, CASE s_suppkey % 3 WHEN 0 THEN url_encode(replace(t.term, ' ', '-')) WHEN 1 THEN replace(t.term, ' ', '_') ELSE url_encode(t.term) END AS request_key
FROM supplier CROSS JOIN (SELECT unnest(['QA Engineer', 'Qualitätsingenieur', 'C++ & Qt']) AS term) t""")
def q_requests(spark, sf_dir):
    """Every source with every term, as its requests write it."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), dealt(["stepstone", "englishjobsde", "devjobs"], "s_suppkey").alias("adapter"))
    return boards.requests(sources, ["QA Engineer", "Qualitätsingenieur", "C++ & Qt"]).select("source_id", "term", "request_key")


# ---- resolution

SIGNS = [
    ("src='https://boards.greenhouse.io/embed/job_board/js?for=acme'", "greenhouse", "acme"), ("https://boards-api.greenhouse.io/v1/boards/${x}", None, None), ("https://job-boards.eu.greenhouse.io/raisin", "greenhouse", "raisin"), (r"https:\/\/jobs.lever.co\/finn", "lever", "finn"),
    ("https://JOBS.ashbyhq.com/n8n x jobs.lever.co/second", "lever", "second"), (r"https://jobs.ashbyhq.com/one", "ashby", "one"), ("matomo.softgarden.io brand-x.softgarden.io", "softgarden", "brand-x"), ("a.recruitee.com b.recruitee.com", "recruitee", "a"),
    ("https://x.rexx-systems.com", "rexx", None), ("<div data-board-token='tok'>", "greenhouse", "tok"), ("data-personio-client=\"p1\"", "personio", "p1"), ("nothing here", None, None), ("brand-x.teamtailor.com", "teamtailor", "brand-x"),
]
_HOW = [None if a is None else "data_attr" if "data-" in t else "page_scan" for t, a, _ in SIGNS]


@query(f"SELECT page_id, {listed([s[1] for s in SIGNS], 'page_id')} AS ats, {listed([s[2] for s in SIGNS], 'page_id')} AS identifier, {listed(_HOW, 'page_id')} AS match_method FROM pages")
def q_signatures(spark, sf_dir):
    """The fixed signatures over whole pages, the company's name preferred, then data attributes."""
    pages = table(spark, sf_dir, "pages").withColumn("body", F.concat("html", dealt([s[0] for s in SIGNS], "page_id")))
    return pages.select("page_id", resolve.scan_page(F.lit("https://x.test"), F.col("body"), F.lit("Brand X GmbH")).alias("m")).select("page_id", "m.ats", "m.identifier", "m.match_method")


@query("SELECT page_id, 't' || page_id AS tenant, 'wd3' AS wd_host, 'Careers' AS site FROM pages")
def q_three_part_identifier(spark, sf_dir):
    """An identifier of three parts."""
    body = F.concat("html", F.lit(" https://t"), "page_id", F.lit(".wd3.myworkdayjobs.com/Careers/job/1"))
    found = resolve.scan_page(F.lit(""), body, F.lit(""))["identifier_workday"]
    return table(spark, sf_dir, "pages").select("page_id", found.alias("w")).select("page_id", "w.tenant", "w.wd_host", "w.site")


_NAV = ['<a href="/team">Karriere</a><a href="jobs-{i}?a=1#b">x</a><a href="/zweitjob">Blog</a><a href="/team">Jobs</a>', "<a href='https://other.test/Career'>c</a>", '<a href="/x">wir  suchen</a>', ""]
_BASE = "regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1)"
_GUESSES = ", ".join(f"{_BASE} || '{p}'" for p in rules.CAREER_PATHS)
_FOUND = [f"[{_BASE} || '/team', regexp_extract(url, '^[^?#]*/') || 'jobs-' || page_id || '?a=1#b', {_BASE} || '/zweitjob']", "['https://other.test/Career']", "[]", "[]"]


@query(f"SELECT page_id, array_to_string(CASE page_id % 4 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(_FOUND))} END || [{_GUESSES}], ' ') AS urls FROM pages")
def q_career_urls(spark, sf_dir):
    """Links to career pages out of a page's markup, then the usual paths, none twice."""
    nav = F.replace(dealt(_NAV, "page_id"), F.lit("{i}"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", resolve.page_links(F.col("url"), F.concat(F.lit("<html><body>"), nav, F.lit("<p>"))).alias("links"))
    return pages.select("page_id", F.array_join(resolve.career_urls(F.col("url"), F.col("links")), " ").alias("urls"))


@query(r"""SELECT page_id, array_to_string(list_distinct_in_order, ' ') AS links FROM (SELECT page_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS list_distinct_in_order FROM
  (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="(/[^"]*)">', 1), lambda x: regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || x) AS h FROM pages))""")
def q_page_links(spark, sf_dir):
    """All links of a page, in order, once each."""
    pages = table(spark, sf_dir, "pages").select("page_id", resolve.page_links(F.col("url"), F.col("html")).alias("links"))
    return pages.select("page_id", F.array_join(resolve.matching_links(F.filter("links", lambda x: x["href"].startswith("/")), "."), " ").alias("links"))


@query(r"""SELECT p_partkey, array_to_string(list_filter([h, n], lambda x, i: x <> '' AND (i = 1 OR x <> h)), ' ') AS slugs FROM (SELECT p_partkey,
  ['scalable', 'acme-x', '', 'shop'][p_partkey % 4 + 1] AS h, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS n FROM part)""")
def q_slugs(spark, sf_dir):
    """The host's slug, then the name's."""
    url = dealt(["https://www.de.scalable.capital/x", "https://ACME-x.com", "https://www.de", "https://m.shop.de:8080/"], "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(resolve.slug_candidates(url, F.col("p_name")), " ").alias("slugs"))


PROBED = [
    ("greenhouse", '{"jobs": [{"company_name": "Brand#1 GmbH"}]}', True), ("greenhouse", '{"jobs": [{"company_name": "Other"}]}', False), ("greenhouse", '{"jobs": []}', True), ("greenhouse", '{"error": "x", "jobs": []}', False),
    ("lever", "[]", True), ("lever", '{"ok": false}', False), ("ashby", '{"jobs": []}', True), ("ashby", '{"jobs": 1}', False), ("personio", "\n<?xml version='1.0'?>", True), ("personio", "<html>", False),
    ("smartrecruiters", '{"content": []}', False), ("smartrecruiters", '{"content": [{"company": {"name": "brand 1"}}]}', True), ("smartrecruiters", '{"content": [{"company": null}]}', False), ("lever", "<broken", False), ("workday", "[]", False),
]


@query(f"SELECT p_partkey, {listed([p[0] for p in PROBED], 'p_partkey')} AS ats, {listed([p[2] for p in PROBED], 'p_partkey')} AS ok FROM part")
def q_probe_answers(spark, sf_dir):
    """What each vendor's answer to a guessed slug shows."""
    ats, body = (dealt([p[i] for p in PROBED], "p_partkey") for i in (0, 1))
    return table(spark, sf_dir, "part").select("p_partkey", ats.alias("ats"), resolve.probe_ok(ats, body, F.lit("Brand#1")).alias("ok"))


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Name "), "s_suppkey").alias("name"), F.concat(F.lit("https://c"), "s_suppkey", F.lit(".test")).alias("url"), F.col("s_suppkey").cast("long").alias("ord"))
    types = {"ats": "string", "identifier": "string", "identifier_workday": "struct<tenant:string,wd_host:string,site:string>", "careers_url": "string", "match_method": "string", "resolved_at": "timestamp"}
    return s.select("name", "url", *(F.lit(None).cast(t).alias(n) for n, t in types.items()), "ord")


#: By the remainder of a company's number: what its pages say.
_SITES = 8


def _captures(companies: DataFrame) -> DataFrame:
    """Captured pages: 0 a vendor at home, 1 on a career page, 2 a listing behind it, 3 none, 4 no home page, 5 a vendor only by probe, 6 as 5 with a career page, 7 nothing but home."""
    k, base = F.col("ord") % _SITES, F.col("url")
    page = lambda path, body: F.struct(F.concat(base, F.lit(path)).alias("request_url"), F.concat(base, F.lit(path)).alias("url"), F.lit(body).alias("body"))
    home = {0: "jobs.lever.co/zero", 1: '<a href="/team">Karriere</a>', 2: '<a href="/hub">Karriere</a>', 3: '<a href="/hub">Karriere</a>', 5: "", 6: "", 7: ""}
    rows = [F.when(k == i, F.array(page("", b))) for i, b in home.items()]
    more = {1: [("/team", "jobs.ashbyhq.com/one")], 2: [("/hub", '<a href="/list">See our open roles</a>'), ("/list", "two.recruitee.com"), ("/jobs", "jobs.lever.co/late")], 3: [("/hub", "culture")], 4: [("/jobs", "jobs.lever.co/never")], 6: [("/careers", "culture")]}
    rows += [F.when(k == i, F.array(*(page(*p) for p in ps))) for i, ps in more.items()]
    return companies.select(F.explode(F.flatten(F.filter(F.array(*rows), lambda x: x.isNotNull()))).alias("p")).select("p.*")


def _answers(companies: DataFrame) -> DataFrame:
    """Every company's second slug answers at lever; those of 4, 5 and 6 at ashby too."""
    slug = F.concat(F.lit("name-"), "ord")
    both = F.when((F.col("ord") % _SITES).isin(4, 5, 6), F.array(F.lit("lever"), F.lit("ashby"))).otherwise(F.array().cast("array<string>"))
    return companies.select(slug.alias("slug"), F.explode(both).alias("ats")).withColumn("body", F.when(F.col("ats") == "lever", "[]").otherwise('{"jobs": []}'))


_RESOLVED = """SELECT 'Name ' || k AS name, ['lever', 'ashby', 'recruitee', 'custom', 'ashby', 'ashby', 'ashby', 'unresolved'][k % 8 + 1] AS ats,
  CASE WHEN k % 8 IN (4, 5, 6) THEN 'name-' || k ELSE ['zero', 'one', 'two', NULL, NULL, NULL, NULL, NULL][k % 8 + 1] END AS identifier,
  'https://c' || k || ['.test', '.test/team', '.test/list', '.test/hub', NULL, NULL, NULL, NULL][k % 8 + 1] AS careers_url,
  ['page_scan', 'page_scan', 'page_scan', NULL, 'api_probe', 'api_probe', 'api_probe', NULL][k % 8 + 1] AS match_method FROM (SELECT s_suppkey AS k FROM supplier)"""


@query(_RESOLVED)
def q_resolved(spark, sf_dir):
    """Two hops over captured pages, then probes."""
    companies = _companies(spark, sf_dir)
    return resolve.resolve(companies, _captures(companies), _answers(companies)).select("name", "ats", "identifier", "careers_url", "match_method")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k, stage, cand_ord, hop_ord FROM (
  SELECT k, 0 AS stage, 0 AS cand_ord, 0 AS hop_ord FROM s WHERE k % 8 <> 4 UNION ALL SELECT k, 1, 0, 0 FROM s WHERE k % 8 IN (1, 2, 3, 6)
  UNION ALL SELECT k, 1, 0, 1 FROM s WHERE k % 8 = 2 UNION ALL SELECT k, 1, 3, 0 FROM s WHERE k % 8 = 2)""")
def q_crawl(spark, sf_dir):
    """Which pages are looked at, in which order."""
    companies = _companies(spark, sf_dir)
    rows = resolve.crawl(companies, _captures(companies))
    return rows.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("k"), "stage", "cand_ord", "hop_ord")


@query(f"SELECT name, ats, identifier, careers_url, match_method, 2::BIGINT AS version FROM ({_RESOLVED})")
def q_write_back(spark, sf_dir):
    """New companies are resolved and written back; a second run writes nothing."""
    companies = _companies(spark, sf_dir)
    kept = CompaniesTable(spark, scratch(spark, "companies"))
    kept.write(companies)
    for _ in range(2):
        kept.resolve(_captures(companies), _answers(companies))
    return kept.read().select("name", "ats", "identifier", "careers_url", "match_method", F.lit(kept.version()).cast("long").alias("version"))


@query(f"""SELECT ord, CASE WHEN ord % 8 < 4 THEN 'Name ' || ord % 8 ELSE name END AS name, ats, identifier, careers_url, match_method, 2::BIGINT AS version, (SELECT count(*) FROM supplier) AS written
FROM (SELECT *, substr(name, 6)::BIGINT AS ord FROM ({_RESOLVED}))""")
def q_write_back_names(spark, sf_dir):
    """Companies of one name keep what is their own; a run by hand that finds nothing new writes nothing."""
    companies = _companies(spark, sf_dir)
    pages, answers = _captures(companies), _answers(companies)
    companies = companies.withColumn("name", F.when(F.col("ord") % 8 < 4, F.concat(F.lit("Name "), F.col("ord") % 8)).otherwise(F.col("name")))
    kept = CompaniesTable(spark, scratch(spark, "companies"))
    kept.write(companies)
    for force in ("new", "needs", "all"):
        kept.resolve(pages, answers, force)
    written = spark.read.parquet(*kept.versions.entry()["deltas"]).count()
    return kept.read().select("ord", "name", "ats", "identifier", "careers_url", "match_method", F.lit(kept.version()).cast("long").alias("version"), F.lit(written).cast("long").alias("written"))


_STATES = [None, "custom", "unresolved", "lever", "ashby", "lever"]


@query(f"SELECT s_suppkey, a IS NULL AS new, (a IS NULL OR a IN ('unresolved', 'custom')) AS needs FROM (SELECT s_suppkey, {listed(_STATES, 's_suppkey')} AS a FROM supplier)")
def q_pending(spark, sf_dir):
    """What an ordinary run resolves, and what a run by hand."""
    rows = _companies(spark, sf_dir).withColumn("ats", F.get(F.array(*map(F.lit, _STATES)), (F.col("ord") % len(_STATES)).cast("int"))).withColumn("identifier", F.lit("x"))
    new, needs = (resolve.pending(rows, f).select("ord", F.lit(True).alias(f)) for f in ("new", "needs"))
    both = rows.join(new, "ord", "left").join(needs, "ord", "left")
    return both.select(F.col("ord").alias("s_suppkey"), F.coalesce("new", F.lit(False)).alias("new"), F.coalesce("needs", F.lit(False)).alias("needs"))


_PERCENT = "printf('%.1f', n * 100.0::DOUBLE / t)"


@query(f"""WITH c AS (SELECT s_suppkey AS k, coalesce({listed(_STATES, 's_suppkey')}, 'new') AS b FROM supplier), t AS (SELECT count(*) AS t FROM c),
n AS (SELECT CASE WHEN b IN ('new', 'custom', 'unresolved') THEN b ELSE 'resolved' END AS b, count(*) AS n FROM c GROUP BY 1),
l AS (SELECT i, b, n, t, h FROM (VALUES (6, 'resolved', '- Resolved (real vendor): '), (7, 'custom', '- Custom (careers page found, no recognized vendor): '), (8, 'unresolved', '- Unresolved (attempted, no careers page found): '), (9, 'new', '- New (never attempted): ')) v(i, b, h) JOIN n USING (b), t),
o AS (SELECT 0 AS section, i AS ord, h || n || ' (' || {_PERCENT} || '%)' AS text FROM l UNION ALL SELECT 0, 2, 'Total companies: ' || t FROM t
  UNION ALL SELECT 0, i, x FROM (VALUES (0, '# ATS resolution report'), (1, ''), (3, ''), (4, '## Bucket summary'), (5, ''), (10, ''), (11, '## Resolved by vendor'), (12, '')) v(i, x)
  UNION ALL SELECT 1, min(k), '- ' || b || ': ' || count(*) FROM c WHERE b NOT IN ('new', 'custom', 'unresolved') GROUP BY b
  UNION ALL SELECT s, i, x FROM (VALUES (2, '## Unresolved companies (attempted, found nothing)'), (4, '## Custom (candidate for a future generic scraper)'), (6, '## New (never attempted)')) v(s, h), (VALUES (0), (1), (2)) w(i), LATERAL (SELECT CASE WHEN i = 1 THEN h ELSE '' END AS x)
  UNION ALL SELECT CASE b WHEN 'unresolved' THEN 3 WHEN 'custom' THEN 5 ELSE 7 END, k, '- Name ' || k || ' — https://c' || k || CASE WHEN b = 'custom' AND k % 4 = 1 THEN '.test/jobs' ELSE '.test' END FROM c WHERE b IN ('new', 'custom', 'unresolved'))
SELECT section::INTEGER AS section, ord::BIGINT AS ord, text FROM o""")
def q_resolution_report(spark, sf_dir):
    """The resolution report's lines."""
    rows = _companies(spark, sf_dir).withColumn("ats", F.get(F.array(*map(F.lit, _STATES)), (F.col("ord") % len(_STATES)).cast("int")))
    rows = rows.withColumn("careers_url", F.when(F.col("ord") % 4 == 1, F.concat("url", F.lit("/jobs"))))
    return report.resolution_lines(rows).select("place.section", "place.ord", "text")


# ---- report and sinks


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the rows of a report."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("Title "), "s_suppkey").alias("title"), F.col("s_name").alias("company"), F.concat(F.lit("Ort "), "s_nationkey").alias("location"), F.concat(F.lit("https://x.test/"), "s_suppkey").alias("url"),
        F.sha2(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), 256).alias("job_id"), (F.col("s_suppkey") % 3 == 0).alias("german"), F.col("s_suppkey").alias("ord"),
    )


_BLOCKS = """b AS (
  SELECT g::INTEGER AS s, n, n || '. Title ' || k || ' — ' || c || ' (Ort ' || l || ')' || chr(10) || '   https://x.test/' || k AS text, k FROM
    (SELECT s_suppkey AS k, s_name AS c, s_nationkey AS l, s_suppkey % 3 = 0 AS g, (row_number() OVER (PARTITION BY s_suppkey % 3 = 0 ORDER BY s_suppkey))::INTEGER AS n FROM supplier)
  UNION ALL SELECT (s_suppkey % 3 = 0)::INTEGER, 0, CASE WHEN s_suppkey % 3 = 0 THEN '🇩🇪 German-speaking (' ELSE '🇬🇧 English-speaking (' END || count(*) || ')', NULL FROM supplier GROUP BY s_suppkey % 3 = 0, 1, CASE WHEN s_suppkey % 3 = 0 THEN '🇩🇪 German-speaking (' ELSE '🇬🇧 English-speaking (' END
  UNION ALL SELECT -1, 0, '📅 02.03.2024 — New QA jobs', NULL)"""


@query(f"WITH {_BLOCKS} SELECT s, n, text FROM b")
def q_message_blocks(spark, sf_dir):
    """The date, headers with sizes, numbered entries."""
    return report.blocks(_entries(spark, sf_dir), F.lit("2024-03-02").cast("date")).select("place.s", "place.n", "text")


_CHUNKS = f"""{_BLOCKS}, o AS (SELECT *, row_number() OVER (ORDER BY s, n) AS i FROM b),
r AS (SELECT i, k, text, 0 AS chunk, length(text) + 2 AS used FROM o WHERE i = 1 UNION ALL
  SELECT o.i, o.k, o.text, CASE WHEN r.used + length(o.text) + 2 > 4096 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + length(o.text) + 2 > 4096 THEN length(o.text) + 2 ELSE r.used + length(o.text) + 2 END
  FROM r JOIN o ON o.i = r.i + 1)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT chunk::INTEGER AS chunk, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, count(k) AS n_ids FROM r GROUP BY chunk")
def q_message_chunks(spark, sf_dir):
    """K6: messages under the size limit."""
    parts = report.blocks(_entries(spark, sf_dir), F.lit("2024-03-02").cast("date"))
    return report.chunks(parts).select("chunk", "text", F.size("job_ids").cast("long").alias("n_ids"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT sha256('s:' || k) AS job_id FROM r WHERE chunk < 2 AND k IS NOT NULL")
def q_delivery(spark, sf_dir):
    """K7, K8: what was sent before the first failure."""
    sent: list[str] = []

    def send(text: str) -> None:
        if len(sent) == 2:
            raise OSError("full")
        sent.append(text)

    ids = report.deliver(report.chunks(report.blocks(_entries(spark, sf_dir), F.lit("2024-03-02").cast("date"))), send)
    return spark.createDataFrame([(i,) for i in ids], "job_id string")


@query("SELECT user_id::VARCHAR AS job_id, min(event_type) FILTER (WHERE event_id = f) AS title, min(ts) FILTER (WHERE event_id = f) AS first_seen_at FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM events) GROUP BY user_id")
def q_seen_table(spark, sf_dir):
    """K1, K2: a table made where there is none; marking again keeps the first time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("title"), F.lit("c").alias("company"), "ts", "event_id")
    first = dedup.first_wins(events, ["job_id"], "event_id")
    seen = SeenTable(spark, scratch(spark, "seen"))
    seen.create()
    seen.mark(first, F.col("ts").cast("timestamp"))
    seen.mark(events, F.col("ts").cast("timestamp"))
    seen.mark(events.limit(0))
    return seen.read().select("job_id", "title", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings: four share a url with the next four, scopes and languages by case."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.lit("s").alias("source_id"), F.concat(dealt(TITLES, "p_partkey"), F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("company"), F.concat(F.lit("u"), F.floor(F.col("p_partkey") / 8) * 4 + F.col("p_partkey") % 4).alias("url"),
        dealt([s[0] for s in SCOPES], "p_partkey").alias("location"), F.concat(text_of(dealt([s[1] for s in SCOPES], "p_partkey")), F.lit(" | "), dealt(list(STATEMENTS), "p_partkey")).alias("description"), F.col("p_partkey").alias("ord"),
    )


_POSTINGS = f"""p AS (SELECT p_partkey AS k, {listed(TITLES, 'p_partkey')} || ' ' || p_name AS title, 'u' || (p_partkey // 8 * 4 + p_partkey % 4) AS url, {listed([s[2] for s in SCOPES], 'p_partkey')} AS city,
  {listed([s[3] for s in SCOPES], 'p_partkey')} AS remote, {listed(list(STATEMENTS.values()), 'p_partkey')} AS german, {listed(_TITLES, 'p_partkey')} AS hit FROM part),
u AS (SELECT *, 0 AS s FROM p WHERE city UNION ALL SELECT *, 1 FROM p WHERE remote),
m AS (SELECT url, arg_max(struct_pack(title := title, german := german, hit := hit), struct_pack(s := s, k := k)) AS v, min(struct_pack(s := s, k := k)) AS pos FROM u GROUP BY url),
r AS (SELECT url, v.title AS title, v.german AS german, pos.s AS scope, pos.k AS ord, sha256('s:' || url) AS job_id FROM m WHERE v.hit),
n AS (SELECT * FROM r WHERE length(url) % 2 = 0)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting whose url has an odd number of characters was reported before."""
    urls = _postings(spark, sf_dir).where("length(url) % 2 = 1").select(dedup.job_id(F.col("source_id"), F.col("url")).alias("job_id")).distinct()
    return urls.select("job_id", F.lit("").alias("title"), F.lit("").alias("company"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at"))


@query(f"WITH {_POSTINGS} SELECT url, title, german, scope, ord, job_id FROM n")
def q_report(spark, sf_dir):
    """The report plan: scopes, merge by url, titles, seen, language."""
    return build_report(_postings(spark, sf_dir), _seen(spark, sf_dir)).select("url", "title", "german", "ord.scope", "ord.ord", "job_id")


@query(f"""WITH {_POSTINGS} SELECT (SELECT count(*) FROM p) AS n_scanned, (SELECT count(*) FROM p WHERE city) AS n_city, (SELECT count(*) FROM p WHERE remote) AS n_remote, (SELECT count(*) FROM r) AS n_matched,
  (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM n WHERE german) AS n_german, (SELECT count(*) FROM n WHERE NOT german) AS n_english""")
def q_run_metrics(spark, sf_dir):
    """The counts of a run, seen in passing."""
    metrics: dict = {}
    build_report(_postings(spark, sf_dir), _seen(spark, sf_dir), metrics=metrics).write.format("noop").mode("overwrite").save()
    found = {k: v for seen in metrics.values() for k, v in seen.get.items()}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"WITH {_POSTINGS} SELECT (SELECT count(*) FROM r) AS n_dry, 0::BIGINT AS n_after_dry, (SELECT count(*) FROM r) AS n_sent, (SELECT count(*) FROM r) AS n_marked, 0::BIGINT AS n_again")
def q_report_run(spark, sf_dir):
    """K7, K9: a dry run leaves the table alone; a run marks what was sent, and the next has nothing to send."""
    postings, seen = _postings(spark, sf_dir), SeenTable(spark, scratch(spark, "seen"))
    dry = len(run_report(postings, seen, lambda text: None, dry_run=True))
    after = seen.read().count()
    sent = len(run_report(postings, seen, lambda text: None))
    return spark.createDataFrame([(dry, after, sent, seen.read().count(), len(run_report(postings, seen, lambda text: None)))], "n_dry long, n_after_dry long, n_sent long, n_marked long, n_again long")


@query("SELECT source_id, url, max(title) AS title, min(ord) AS ord FROM (SELECT lang AS source_id, left(md5(text), 2) AS url, max_by(source, doc_id) OVER (PARTITION BY lang, left(md5(text), 2)) AS title, doc_id AS ord FROM documents) GROUP BY source_id, url")
def q_connector_dedup(spark, sf_dir):
    """Within a source one row per url."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("source_id"), F.substring(F.md5(F.col("text").cast("binary")), 1, 2).alias("url"), F.col("source").alias("title"), F.col("doc_id").alias("ord"))
    return dedup.last_value_first_position(docs, ["source_id", "url"], "ord")


_FIRMS = "SELECT 'Firm ' || c_custkey AS l FROM customer UNION ALL SELECT p_name FROM part"
_BOARDS = "SELECT 'firm ' || s_suppkey || '!' AS r FROM supplier UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT n_name || ' firm ' || n_nationkey FROM nation UNION ALL SELECT ' - ' UNION ALL SELECT 'm'"


@query(f"""WITH l AS (SELECT l, regexp_replace(lower(l), '[^a-z0-9]', '', 'g') AS a FROM ({_FIRMS})), r AS (SELECT r, regexp_replace(lower(r), '[^a-z0-9]', '', 'g') AS b FROM ({_BOARDS}))
SELECT l, r, count(*) AS n FROM l, r WHERE a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) GROUP BY l, r""")
def q_names_held(spark, sf_dir):
    """Firms and boards whose names hold one another, by a gram index."""
    part, one = table(spark, sf_dir, "part"), lambda text: spark.range(1).select(F.lit(text).alias("r"))
    firms = table(spark, sf_dir, "customer").select(F.concat(F.lit("Firm "), "c_custkey").alias("l")).unionAll(part.select("p_name"))
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("firm "), "s_suppkey", F.lit("!")).alias("r")).unionAll(part.select(F.split_part("p_name", F.lit(" "), F.lit(1))).distinct())
    names = names.unionAll(table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" firm "), "n_nationkey"))).unionAll(one(" - ")).unionAll(one("m"))
    return containment.containing(firms, names, "l", "r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT 1 AS n_first, (SELECT max(chunk) + 1 FROM r)::INTEGER AS n_sent, (SELECT count(k) FROM r) AS n_ids, 0::BIGINT AS n_twice, 0 AS n_again")
def q_outbox(spark, sf_dir):
    """K7, K2: a run that dies after one message goes on with the second; a run that is done sends nothing."""
    box, out, rows = Outbox(spark, scratch(spark, "box")), [], _entries(spark, sf_dir)

    def dies(text: str) -> None:
        if out:
            raise KeyboardInterrupt
        out.append(text)

    def put(day: str) -> None:
        box.put("day", report.chunks(report.blocks(rows, F.lit(day).cast("date"))), rows.select("job_id", "title", "company"))

    put("2024-03-02")
    with suppress(KeyboardInterrupt):
        box.deliver("day", dies)
    first = len(out)
    put("2024-03-03")  # what was put first stays
    sent = box.deliver("day", out.append)
    box.close("day")
    again = box.deliver("day", out.append) - sent
    ids = box.sent_ids("day").agg(F.count(F.lit(1)).alias("n_ids"))
    return ids.select(F.lit(first).alias("n_first"), F.lit(sent).alias("n_sent"), "n_ids", F.lit(len(out) - len(set(out))).cast("long").alias("n_twice"), F.lit(again).alias("n_again"))


# ---- requests and configuration


@query("SELECT p_partkey AS ord, 'page ' || p_partkey AS body FROM part WHERE p_partkey % 97 <> 3")
def q_capture(spark, sf_dir):
    """Requests by host, asked again after a passing error; those that fail are left out."""
    wanted = table(spark, sf_dir, "part").select(
        F.lit("s").alias("source_id"), F.lit("").alias("request_key"), F.lit(1).alias("page"), F.lit("listing").alias("kind"), F.concat(F.lit("https://h"), F.col("p_partkey") % 5, F.lit(".test/"), "p_partkey").alias("url"), F.lit(0).alias("status"),
        F.lit("").alias("body"), F.col("p_partkey").alias("ord"),
    )
    tried: dict[str, int] = {}

    def answer(method: str, url: str, timeout: float) -> tuple[int, str, str]:
        key = int(url.rsplit("/", 1)[1])
        tried[url] = tried.get(url, 0) + 1
        if key % 97 == 3:
            return 404, url, ""
        if key % 50 == 1 and tried[url] == 1:
            raise ConnectionError
        return (503 if key % 50 == 2 and tried[url] == 1 else 200), url, f"page {key}"

    assert [c.split()[0] for c in PAYLOAD.split(", ")] == wanted.columns
    return fetch.capture(wanted, answer, backoff=0.0).select("ord", "body")


@query(r"SELECT p_partkey, regexp_replace('https://x.test/bot' || p_partkey || ':Ab_c-' || p_size || '/send?bot=1', '(/bot)\d+:[A-Za-z0-9_-]+(/)', '\1***REDACTED***\2') AS url FROM part")
def q_redacted(spark, sf_dir):
    """No token in what is logged."""
    url = F.concat(F.lit("https://x.test/bot"), "p_partkey", F.lit(":Ab_c-"), "p_size", F.lit("/send?bot=1"))
    return table(spark, sf_dir, "part").select("p_partkey", fetch.redacted(url).alias("url"))


@query("SELECT 'source ' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'stepstone' ELSE 'todo' END AS adapter, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS ord FROM nation")
def q_configuration(spark, sf_dir):
    """A sources table out of a YAML file."""
    line = F.concat(F.lit("- {id: source "), "n_nationkey", F.lit(", adapter: "), F.when(F.col("n_nationkey") % 2 == 0, "stepstone").otherwise("todo"), F.lit(", priority: 1}"))
    path = scratch(spark, "sources")
    lines = table(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("l"))
    lines.select(F.concat(F.lit("sources:\n"), "l").alias("value")).coalesce(1).write.text(path)
    return config.sources(spark, path).select("id", "adapter", "ord")


# ---- scalars

_SPACED = ["  a b ", "\t x  y\n", "plain", "", " "]


@query(f"SELECT p_partkey, {listed([s.strip() for s in _SPACED], 'p_partkey')} AS stripped, {listed([' '.join(s.split()) for s in _SPACED], 'p_partkey')} AS collapsed FROM part")
def q_white_space(spark, sf_dir):
    """Trimming and collapsing white space of any kind."""
    text = dealt(_SPACED, "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", strip(text).alias("stripped"), collapse(text).alias("collapsed"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand || '-' || p_name), '[^a-z0-9]', '', 'g') AS squeezed, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand || ', ' || p_name ELSE '' END AS joined, split_part(p_name, ' ', 1) AS first, upper(left(p_type, 3)) AS short FROM part")
def q_text_parts(spark, sf_dir):
    """Names squeezed, parts joined without empty ones, split, cut, upper case."""
    k = F.col("p_partkey") % 3
    parts = F.array(F.when(k == 1, F.col("p_brand")).when(k == 0, ""), F.when(k < 2, F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", squeeze_name(F.concat_ws("-", "p_brand", "p_name")).alias("squeezed"), join_filled(parts, ", ").alias("joined"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.upper(F.left("p_type", F.lit(3))).alias("short"))


@query("SELECT p_partkey, '<p>' || p_name || ' & ' || p_size || '</p>' AS text FROM part")
def q_unescaped(spark, sf_dir):
    """HTML written as text, read back once."""
    text = F.concat(F.lit("&lt;p&gt;"), "p_name", F.lit(" &amp; "), "p_size", F.lit("&lt;/p&gt;"))
    return table(spark, sf_dir, "part").select("p_partkey", vendors.unescaped(text).alias("text"))


@query(r"SELECT page_id, regexp_replace('T ' || replace(regexp_extract(url, '[^/]*$'), '-', ' ') || ' end', '\s+', ' ', 'g') AS words FROM pages")
def q_page_words(spark, sf_dir):
    """The text of a page's body by the tree, its strings parted by blanks."""
    last = F.replace(F.regexp_extract("url", "[^/]*$", 0), F.lit("-"), F.lit(" "))
    escaped = F.replace(last, F.lit("&"), F.lit("&amp;"))
    body = F.concat(F.lit("<head><title>no</title></head><body><h1> T</h1><div><p>"), escaped, F.lit("</p></div>\n<p> end</p></body>"))
    words = table(spark, sf_dir, "pages").select("page_id", collapse(vendors.page_words(body)).alias("words"))
    return words


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'n' || p_partkey END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::VARCHAR END AS size FROM part")
def q_xml_positions(spark, sf_dir):
    """Fields of XML elements; a broken feed has none."""
    feed = F.concat(F.lit("<r><position><id>"), "p_size", F.lit("</id><name>n"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "</name>").otherwise("</name></position></r>"))
    read = table(spark, sf_dir, "part").select("p_partkey", F.get(vendors.xml_positions(feed), 0).alias("x"))
    return read.select("p_partkey", F.from_xml("x", "id string, name string").alias("p")).select("p_partkey", "p.name", F.col("p.id").alias("size"))


@query("SELECT event_id, strftime(ts, '%d.%m.%Y') AS day, sha256('s:' || event_id) AS job_id FROM events")
def q_dates_and_hashes(spark, sf_dir):
    """Days as a message writes them; the identity of a posting."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy").alias("day"), dedup.job_id(F.lit("s"), F.col("event_id")).alias("job_id"))


