"""Resolution of companies to vendors."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import UNICODE, names_match, strip, text_of


def page_text(url: Column, body: Column) -> Column:
    """What signatures are looked for in: escaped slashes of embedded JSON count as slashes."""
    return F.replace(F.replace(F.concat(text_of(url), F.lit("\n"), text_of(body)), F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))


def literal_of(pattern: str) -> str:
    """The longest text that every match of a pattern has in it, in lower case; "" if none is sure.

    Groups, classes and what may be left out count as unknown, and so does a pattern of alternatives.
    """
    pieces, piece, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        step, plain = 1, c
        if c == "\\":
            step, plain = 2, pattern[i + 1] if not pattern[i + 1].isalnum() else ""
        elif c == "[":  # to its end, past a first or escaped bracket
            step, plain = re.match(r"\[\^?\]?(?:\\.|[^\]\\])*\]", pattern[i:]).end(), ""
        elif c == "{":
            step, plain = pattern.index("}", i) + 1 - i, ""
        elif c in "()":
            depth, plain = depth + (1 if c == "(" else -1), ""
        elif c in ".^$|?*+{}":
            if c == "|" and not depth:
                return ""
            plain = ""
        i += step
        if depth or not plain or pattern[i : i + 1] in ("?", "*", "{"):
            pieces, piece = [*pieces, piece], ""
        else:
            piece += plain
            if pattern[i : i + 1] == "+":
                pieces, piece = [*pieces, piece], ""
    return max([*pieces, piece], key=len).lower()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(haystack: Column, table: list[tuple[str, list[str]]], name: Column) -> Column:
    """struct(ats, identifier, identifier_workday) by the first vendor, and of it the first pattern, that matches; else null.

    Of several identifiers the first that fits the name counts, or else the first. A pattern is tried only on a
    text that has its literal: that is a search for bytes, while most patterns begin with a group and would be
    tried at every word.
    """
    return _let(F.struct(haystack.alias("text"), F.lower(haystack).alias("small"), name.alias("name")), lambda x: _first_match(x, table))


def _first_match(x: Column, table: list[tuple[str, list[str]]]) -> Column:
    branches, text = [], x["text"]
    for ats, patterns in table:
        for pattern in patterns:
            regex = "(?i)" + pattern
            groups = pattern.count("(") - pattern.count("(?:") - pattern.count("\\(")
            none = F.lit(None).cast("string")
            workday = F.lit(None).cast("struct<tenant:string,wd_host:string,site:string>")
            if groups == 3:
                workday = F.struct(*(F.regexp_extract(text, regex, i).alias(k) for i, k in enumerate(("tenant", "wd_host", "site"), 1)))
                found = none
            elif groups:
                each = F.array_distinct(F.regexp_extract_all(text, F.lit(regex), 1))
                found = _let(each, lambda e: F.coalesce(F.get(F.filter(e, lambda c: names_match(c, x["name"])), F.lit(0)), F.get(e, F.lit(0))))
            else:
                found = none
            there = text.rlike(regex)
            if literal := literal_of(pattern):
                there = F.contains(x["small"], F.lit(literal)) & there
            branches.append(F.when(there, F.struct(F.lit(ats).alias("ats"), found.alias("identifier"), workday.alias("identifier_workday"))))
    return F.coalesce(*branches)


def scan_page(url: Column, body: Column, name: Column) -> Column:
    """struct(ats, identifier, identifier_workday, match_method) of a page: by signature, else by a data attribute; else null."""
    by_url = first_match(page_text(url, body), rules.SIGNATURES, name)
    by_attribute = first_match(text_of(body), [(a, [p]) for a, p in rules.DATA_ATTRIBUTES], F.lit(""))
    full = lambda match, how: _let(match, lambda m: F.when(m.isNotNull(), F.struct(m["ats"].alias("ats"), m["identifier"].alias("identifier"), m["identifier_workday"].alias("identifier_workday"), F.lit(how).alias("match_method"))))
    return F.coalesce(full(by_url, "page_scan"), full(by_attribute, "data_attr"))


def slug_candidates(url: Column, name: Column) -> Column:
    """The host's first label that isn't noise, then the hyphenated name; no empty ones, no repeats."""
    noise = "|".join(rules.NOISE_LABELS)
    host = F.regexp_extract(text_of(url), r"^[^/?#]*://([^/?#]*)", 1)
    label = F.regexp_extract(host, rf"^(?:(?:{noise})(?:\.|$))*([^.]*)", 1)
    by_host = F.regexp_replace(F.lower(label), "[^a-z0-9-]", "")
    by_name = F.regexp_replace(F.regexp_replace(F.lower(text_of(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.array_distinct(F.filter(F.array(by_host, by_name), lambda s: s != ""))


def needs_resolution(ats: Column, identifier: Column) -> Column:
    unset = ats.isNull() | ats.isin("unresolved", "custom")
    return F.coalesce(unset | (identifier.isNull() & ~ats.isin(rules.NO_SLUG_VENDORS)), F.lit(True))


def is_new_entry(ats: Column) -> Column:
    return ats.isNull()


def matching_links(links: Column, pattern: str) -> Column:
    """The distinct urls, in order, of links (array of struct href, text, url) whose href or text matches."""
    regex = UNICODE + pattern
    return F.array_distinct(F.transform(F.filter(links, lambda x: x["href"].rlike(regex) | x["text"].rlike(regex)), lambda x: x["url"]))


def career_urls(company_url: Column, links: Column) -> Column:
    """Links to career pages, then the usual paths on the company's own host."""
    base = F.regexp_extract(text_of(company_url), r"^([^/?#]*://[^/?#]*)", 1)
    guesses = F.array(*(F.concat(base, F.lit(p)) for p in rules.CAREER_PATHS))
    return F.array_distinct(F.concat(matching_links(links, rules.CAREER_LINK), guesses))


_LINKS = "array<struct<href:string,text:string,url:string>>"


def page_links(url: Column, body: Column) -> Column:
    """Every link of a page in order: its href, its text, and the url it leads to."""

    @F.pandas_udf(_LINKS)
    def read(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        from ..sources.html import parse

        def links(url: str | None, body: str | None) -> list[dict]:
            out = []
            for a in parse(body).select("a[href]"):
                try:
                    out.append({"href": a.get("href"), "text": a.text(), "url": urljoin(url or "", a.get("href"))})
                except ValueError:  # an href that is no url
                    continue
            return out

        return pd.Series([links(u, b) for u, b in zip(urls, bodies, strict=True)])

    return read(url, body)


def crawl(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages looked at for each company, in order, out of captured ones.

    companies: name, url and ord, which is a company's key. pages: request_url, url (where it led), body (null:
    not reached). Returned: key, name, stage (0 the home page, 1 career pages and what they link to), cand_ord,
    hop_ord (0 the career page, from 1 the listings it links to), url, body. No page is looked at twice: what an
    earlier page led to is no career page any more. Without a home page there is nothing else.
    """
    got = pages.where("body is not null").select(F.col("request_url").alias("asked"), F.coalesce("url", "request_url").alias("url"), "body")
    # Career pages are read for their links to listings, home pages for those to career pages: once each.
    linked = got.withColumn("links", page_links(F.col("url"), F.col("body")))
    home = companies.select(F.col("ord").alias("key"), "name", F.col("url").alias("company_url")).join(linked.withColumnRenamed("asked", "company_url"), "company_url")
    candidates = home.select("key", "name", F.col("url").alias("home"), F.posexplode(career_urls(F.col("company_url"), F.col("links"))).alias("cand_ord", "asked"))
    deeper = linked.select("asked", matching_links(F.col("links"), rules.LISTING_LINK).alias("deeper"))
    each = candidates.join(deeper, "asked", "left").groupBy("key", "name", "home").agg(F.array_sort(F.collect_list(F.struct("cand_ord", "asked", "deeper"))).alias("candidates"))
    visit = "array<struct<cand_ord:int,hop_ord:int,asked:string>>"
    start = F.struct(F.array("home").alias("seen"), F.array().cast(visit).alias("visits"))

    def step(acc: Column, c: Column) -> Column:
        new = F.array_except(F.coalesce(c["deeper"], F.array().cast("array<string>")), F.concat(acc["seen"], F.array(c["asked"])))
        hops = F.transform(new, lambda u, i: F.struct(c["cand_ord"].alias("cand_ord"), (i + 1).alias("hop_ord"), u.alias("asked")))
        visits = F.concat(acc["visits"], F.array(F.struct(c["cand_ord"].alias("cand_ord"), F.lit(0).alias("hop_ord"), c["asked"].alias("asked"))).cast(visit), hops.cast(visit))
        return F.when(F.array_contains(acc["seen"], c["asked"]), acc).otherwise(F.struct(F.concat(acc["seen"], F.array(c["asked"]), new).alias("seen"), visits.alias("visits")))

    visits = each.select("key", "name", F.explode(F.aggregate("candidates", start, step, lambda acc: acc["visits"])).alias("v")).select("key", "name", "v.*")
    found = visits.join(got, "asked").select("key", "name", F.lit(1).alias("stage"), "cand_ord", "hop_ord", "url", "body")
    return home.select("key", "name", F.lit(0).alias("stage"), F.lit(0).alias("cand_ord"), F.lit(0).alias("hop_ord"), "url", "body").unionByName(found)


def _keyed(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """rows with their company's key; where they have none they find it by name, which then must be one company's."""
    return rows if "key" in rows.columns else rows.join(companies.select("name", F.col("ord").alias("key")), "name")


def resolved(companies: DataFrame, pages: DataFrame, probes: DataFrame) -> DataFrame:
    """key and name with ats, identifier, identifier_workday, careers_url and match_method, by the best evidence captured.

    pages: as crawl() returns them. probes: key, slug_ord, probe_ord, ats, slug, ok. Pages come before
    probes, each in order, and career pages count only if the home page was reached. A probe tells no
    careers_url. Without a vendor, a career page that was reached makes a company custom; else it is
    unresolved. Companies of one name are apart.
    """
    pages, probes, known = _keyed(pages, companies), _keyed(probes, companies), companies.select(F.col("ord").alias("key"), "name")
    read = pages.drop("name").join(known, "key").where("body is not null").withColumn("m", scan_page(F.col("url"), F.col("body"), F.col("name")))
    order = F.struct("stage", "cand_ord", "hop_ord")
    hit, career = F.col("m").isNotNull(), (F.col("stage") > 0) & (F.col("hop_ord") == 0)
    by_page = read.groupBy("key").agg(
        F.min_by(F.when(hit, F.struct("m", "url")), F.when(hit, order)).alias("page"),
        F.min_by(F.when(career, F.col("url")), F.when(career, order)).alias("reached"), F.bool_or(F.col("stage") == 0).alias("home"),
    )
    by_page = by_page.where("home").drop("home")
    by_probe = probes.where("ok").groupBy("key").agg(F.min_by(F.struct("ats", "slug"), F.struct("slug_ord", "probe_ord")).alias("probe"))
    both = known.join(by_page, "key", "left").join(by_probe, "key", "left")
    page, probe = F.col("page.m"), F.col("probe")
    ats = F.coalesce(page["ats"], probe["ats"], F.when(F.col("reached").isNotNull(), F.lit("custom")), F.lit("unresolved"))
    method = F.coalesce(page["match_method"], F.when(probe.isNotNull(), F.lit("api_probe")))
    return both.select(
        "key", "name", ats.alias("ats"), F.when(page.isNotNull(), page["identifier"]).otherwise(probe["slug"]).alias("identifier"), page["identifier_workday"].alias("identifier_workday"),
        F.when(page.isNotNull(), F.col("page.url")).when(probe.isNull(), F.col("reached")).alias("careers_url"), method.alias("match_method"),
    )


def resolve(companies: DataFrame, pages: DataFrame, answers: DataFrame) -> DataFrame:
    """resolved() from captured pages (request_url, url, body) and answers to guessed slugs (slug, ats, body)."""
    return resolved(companies, crawl(companies, pages), probes_of(companies, answers))


def pending(companies: DataFrame, force: str = "new") -> DataFrame:
    """The companies to resolve: new ones, those that need it (needs), or all."""
    test = {"new": is_new_entry(F.col("ats")), "needs": needs_resolution(F.col("ats"), F.coalesce(F.col("identifier"), F.col("identifier_workday.tenant"))), "all": F.lit(True)}[force]
    return companies.where(test)


#: What resolution says of a company.
FIELDS = ("ats", "identifier", "identifier_workday", "careers_url", "match_method")


def changed(companies: DataFrame, found: DataFrame) -> DataFrame:
    """ord, FIELDS and resolved_at (now) of the companies of which found says something else than they do."""
    new = found.select("key", F.struct(*FIELDS).alias("__new"))
    both = companies.join(new, companies["ord"] == new["key"])
    differs = ~F.struct(*FIELDS).eqNullSafe(F.col("__new"))
    return both.where(differs).select("ord", *(F.col(f"__new.{f}").alias(f) for f in FIELDS), F.current_timestamp().alias("resolved_at"))


def updated(companies: DataFrame, found: DataFrame) -> DataFrame:
    """companies with FIELDS and resolved_at replaced where found has the key."""
    at = found["resolved_at"] if "resolved_at" in found.columns else F.current_timestamp()
    key = found["key"] if "key" in found.columns else found["ord"]
    new = found.select(key.alias("__key"), F.struct(*(found[f] for f in FIELDS), at.alias("resolved_at")).alias("__new"))
    joined = companies.join(new, companies["ord"] == new["__key"], "left")
    for f in (*FIELDS, "resolved_at"):
        joined = joined.withColumn(f, F.when(F.col("__new").isNotNull(), F.col(f"__new.{f}")).otherwise(F.col(f)))
    return joined.select(*companies.columns)


#: Vendors whose answer to a guessed slug is looked at, in this order for each slug.
PROBES = ("greenhouse", "ashby", "lever", "personio", "smartrecruiters")


def probe_ok(ats: Column, body: Column, name: Column) -> Column:
    """Whether a captured answer to a guessed slug shows a board; two vendors' answers also name the company."""
    at = lambda path: F.get_json_object(body, path)
    whole, flag = at("$"), F.coalesce(at("$.error"), F.lit(""))
    tests = {
        "greenhouse": whole.startswith("{") & flag.isin("", "false", "0") & (at("$.jobs[0]").isNull() | names_match(text_of(at("$.jobs[0].company_name")), name)),
        "ashby": at("$.jobs").startswith("["),
        "lever": whole.startswith("["),
        "personio": strip(text_of(body)).startswith("<?xml"),
        "smartrecruiters": at("$.content[0]").isNotNull() & names_match(text_of(at("$.content[0].company.name")), name),
    }
    return F.coalesce(*(F.when(ats == k, t) for k, t in tests.items()), F.lit(False))


def probes_of(companies: DataFrame, answers: DataFrame) -> DataFrame:
    """key, name, slug_ord, probe_ord, ats, slug and ok of every captured answer (slug, ats, body) to a company's slugs."""
    slugs = companies.select(F.col("ord").alias("key"), "name", F.posexplode(slug_candidates(F.col("url"), F.col("name"))).alias("slug_ord", "slug"))
    order = F.array_position(F.array(*map(F.lit, PROBES)), F.col("ats")) - 1
    return slugs.join(answers, "slug").where(F.col("ats").isin(*PROBES)).select("key", "name", "slug_ord", order.alias("probe_ord"), "ats", "slug", probe_ok(F.col("ats"), F.col("body"), F.col("name")).alias("ok"))
