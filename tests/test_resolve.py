import pytest
from pyspark.sql import functions as F

from tidemill.operators import resolve
from tidemill.sources.schema import COMPANY


def scanned(spark, body, name="Acme", url="https://acme.test"):
    frame = spark.createDataFrame([(url, body, name)], "u string, b string, n string")
    return frame.select(resolve.scan_page(F.col("u"), F.col("b"), F.col("n")).alias("m")).first()["m"]


@pytest.mark.parametrize(("body", "expected"), [
    ('<a href="https://boards.greenhouse.io/acme">', ("greenhouse", "acme", "page_scan")),
    ('src="https://boards.greenhouse.io/embed/job_board/js?for=acme"', ("greenhouse", "acme", "page_scan")),
    ("boards-api.greenhouse.io/v1/boards/${slug}", None),
    (r"https://jobs.ashbyhq.com/acme", ("ashby", "acme", "page_scan")),
    ("https:\\/\\/jobs.lever.co\\/acme", ("lever", "acme", "page_scan")),
    ("matomo.softgarden.io acme.softgarden.io", ("softgarden", "acme", "page_scan")),
    ("one.recruitee.com two.recruitee.com", ("recruitee", "one", "page_scan")),
    ("https://x.rexx-systems.com", ("rexx", None, "page_scan")),
    ("<div data-board-token='acme'>", ("greenhouse", "acme", "data_attr")),
    ("nothing", None), (None, None),
])
def test_signatures(spark, body, expected):
    found = scanned(spark, body)
    assert (found and (found["ats"], found["identifier"], found["match_method"])) == expected


def test_workday_has_three_parts(spark):
    found = scanned(spark, "https://acme.wd3.myworkdayjobs.com/Careers/x")
    assert tuple(found["identifier_workday"]) == ("acme", "wd3", "Careers") and found["identifier"] is None


def test_slugs(spark):
    cases = {("https://www.de.scalable.capital/x", "Scalable Capital GmbH"): ["scalable", "scalable-capital-gmbh"], ("https://acme.com", "Acme"): ["acme"], ("https://www.de", " "): []}
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, u string, n string").select("i", resolve.slug_candidates(F.col("u"), F.col("n"))).orderBy("i").collect()
    assert [r[1] for r in rows] == list(cases.values())


def test_links(spark):
    links = "array(named_struct('href', '/zweitjob', 'text', 'Blog', 'url', 'https://a.de/zweitjob'), named_struct('href', '/k', 'text', 'Karriere', 'url', 'https://a.de/careers'), named_struct('href', '/x', 'text', 'x', 'url', 'https://a.de/x'))"
    found = spark.range(1).select(resolve.career_urls(F.lit("https://a.de/start"), F.expr(links))).first()[0]
    assert found[:2] == ["https://a.de/zweitjob", "https://a.de/careers"] and len(found) == 9


def test_resolved(spark):
    companies = spark.createDataFrame([(n, f"https://{n}.test", None, None, None, None, None, None, i) for i, n in enumerate("abcdefgh")], COMPANY)
    pages = spark.createDataFrame([
        ("a", 0, 0, 0, "https://a.test", "jobs.lever.co/a"), ("a", 1, 0, 0, "https://a.test/jobs", "jobs.ashbyhq.com/a"),
        ("b", 0, 0, 0, "https://b.test", ""), ("b", 1, 1, 1, "https://b.test/list", "jobs.ashbyhq.com/b"), ("b", 1, 0, 0, "https://b.test/jobs", "x"),
        ("c", 1, 0, 0, "https://c.test/jobs", "jobs.lever.co/c"), ("g", 0, 0, 0, "https://g.test", ""), ("g", 1, 0, 0, "https://g.test/jobs", "none"), ("h", 0, 0, 0, "https://h.test", ""), ("h", 1, 2, 0, "https://h.test/jobs", "none"), ("d", 0, 0, 0, "https://d.test", None), ("e", 0, 0, 0, "https://e.test", "x"),
    ], "name string, stage int, cand_ord int, hop_ord int, url string, body string")
    probes = spark.createDataFrame([("c", 0, 0, "lever", "c", False), ("g", 0, 0, "lever", "g", True), ("e", 1, 0, "greenhouse", "e2", True), ("e", 0, 1, "ashby", "e", True)], "name string, slug_ord int, probe_ord int, ats string, slug string, ok boolean")
    found = resolve.resolved(companies, pages, probes)
    rows = {r["name"]: (r["ats"], r["identifier"], r["careers_url"], r["match_method"]) for r in found.collect()}
    assert rows == {
        "a": ("lever", "a", "https://a.test", "page_scan"), "b": ("ashby", "b", "https://b.test/list", "page_scan"), "c": ("unresolved", None, None, None), "g": ("lever", "g", None, "api_probe"), "h": ("custom", None, "https://h.test/jobs", None),
        "d": ("unresolved", None, None, None), "e": ("ashby", "e", None, "api_probe"), "f": ("unresolved", None, None, None),
    }
    after = resolve.updated(companies, found.where("name = 'a'"))
    assert sorted((r["name"], r["ats"]) for r in after.collect())[:2] == [("a", "lever"), ("b", None)]
    assert resolve.pending(after).count() == 7 and resolve.pending(after, "all").count() == 8


def test_probes(spark):
    cases = [
        ("greenhouse", '{"jobs": [{"company_name": "Acme GmbH"}]}', True), ("greenhouse", '{"jobs": [{"company_name": "Other"}]}', False), ("greenhouse", '{"jobs": []}', True), ("greenhouse", '{"error": "x"}', False),
        ("lever", "[]", True), ("lever", '{"ok": false}', False), ("ashby", '{"jobs": []}', True), ("ashby", "{}", False), ("personio", " <?xml ?>", True), ("personio", "<html>", False),
        ("smartrecruiters", '{"content": []}', False), ("smartrecruiters", '{"content": [{"company": {"name": "acme"}}]}', True), ("lever", "<broken", False), ("lever", None, False),
    ]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string").select("i", resolve.probe_ok(F.col("a"), F.col("b"), F.lit("Acme"))).orderBy("i")
    assert [r[1] for r in frame.collect()] == [c[2] for c in cases]


def test_crawl(spark):
    companies = spark.createDataFrame([(n, f"https://{n}.test", None, None, None, None, None, None, i) for i, n in enumerate("abcd")], COMPANY)
    link = lambda href, text="x": f'<a href="{href}">{text}</a>'
    got = {
        "https://a.test": link("/zweitjob", "Blog") + link("karriere/", "Karriere") + link("/jobs"),
        "https://a.test/zweitjob": "nothing", "https://a.test/karriere/": link("/list", "See our open roles") + link("/jobs", "open positions") + link("/list", "open roles"),
        "https://a.test/list": "jobs.ashbyhq.com/a", "https://a.test/jobs": link("/list2", "open roles"), "https://a.test/list2": "x",
        "https://b.test": "", "https://b.test/careers": "b", "https://c.test/careers": "jobs.lever.co/c", "https://d.test": "<div>" * 3000 + link("http://[bad", "jobs") + link("/jobs"), "https://d.test/jobs": None,
    }
    pages = spark.createDataFrame([(u, u, b) for u, b in got.items()], "request_url string, url string, body string")
    rows = sorted((r["name"], r["stage"], r["cand_ord"], r["hop_ord"], r["url"].split(".test")[1]) for r in resolve.crawl(companies, pages).collect())
    assert rows == [
        ("a", 0, 0, 0, ""), ("a", 1, 0, 0, "/zweitjob"), ("a", 1, 1, 0, "/karriere/"), ("a", 1, 1, 1, "/list"), ("a", 1, 1, 2, "/jobs"),  # /jobs is no candidate after that, so /list2 is not reached
        ("b", 0, 0, 0, ""), ("b", 1, 0, 0, "/careers"), ("d", 0, 0, 0, ""),
    ]
    answers = spark.createDataFrame([("d", "lever", "[]")], "slug string, ats string, body string")
    found = {r["name"]: (r["ats"], r["identifier"], r["careers_url"], r["match_method"]) for r in resolve.resolve(companies, pages, answers).collect()}
    assert found == {"a": ("ashby", "a", "https://a.test/list", "page_scan"), "b": ("custom", None, "https://b.test/careers", None), "c": ("unresolved", None, None, None), "d": ("lever", "d", None, "api_probe")}


def test_write_back_and_report(spark, tmp_path):
    from tidemill.operators.report import resolution_summary
    from tidemill.plans.scan import CompaniesTable

    table = CompaniesTable(spark, str(tmp_path / "companies"))
    table.write(spark.createDataFrame([("A", "https://a.test", None, None, None, None, None, None, 0), ("B", "https://b.test", "custom", None, None, "https://b.test/jobs", None, None, 1), ("C", "https://c.test", "unresolved", None, None, None, None, None, 2)], COMPANY))
    pages = spark.createDataFrame([("https://a.test", "https://a.test", "jobs.lever.co/a")], "request_url string, url string, body string")
    answers = spark.createDataFrame([], "slug string, ats string, body string")
    assert [r["name"] for r in table.resolve(pages, answers).collect()] == ["A"] and table.version() == 2
    assert table.resolve(pages, answers).count() == 0 and table.version() == 2
    assert resolution_summary(table.read()).first()[0] == (
        "# ATS resolution report\n\nTotal companies: 3\n\n## Bucket summary\n\n- Resolved (real vendor): 1 (33.3%)\n- Custom (careers page found, no recognized vendor): 1 (33.3%)\n"
        "- Unresolved (attempted, no careers page found): 1 (33.3%)\n- New (never attempted): 0 (0.0%)\n\n## Resolved by vendor\n\n- lever: 1\n\n## Unresolved companies (attempted, found nothing)\n\n- C — https://c.test\n\n"
        "## Custom (candidate for a future generic scraper)\n\n- B — https://b.test/jobs\n\n## New (never attempted)\n\n(none)\n")  # fmt: skip
    assert table.resolve(pages, answers, "needs").count() == 2 and table.version() == 3


def test_literals_of_patterns():
    from tidemill.functions import rules

    cases = {r"a|bcd": "", r"x?abc+d": "abc", r"(abc)": "", r"ab{2}cd": "cd", r"\bfoo\d+bars": "bars", r"[a\]]xy[^]z]": "xy", r"A\.b": "a.b", r"(?:x|y)?q": "q", r"[x]*": ""}
    assert {p: resolve.literal_of(p) for p in cases} == cases
    patterns = [p for _, ps in rules.SIGNATURES for p in ps] + [p for _, p in rules.DATA_ATTRIBUTES]
    assert all(len(resolve.literal_of(p)) > 9 or "io" in resolve.literal_of(p) for p in patterns)


def test_prefiltered_signatures_find_what_plain_ones_find(spark):
    import random
    import re

    from tidemill.functions import rules

    r = random.Random(2)
    parts = ["https://boards.greenhouse.io/embed/job_board/js?a=1&for=acme ", "JOBS.LEVER.CO/Acme", "x.jobs.personio.de", " acme.career.softgarden.io ", "job-boards.eu.greenhouse.io/acme", "t.wd5.myworkdayjobs.com/site", "join.com/companies/", "acme", "İ.recruitee.com", "-", ".teamtailor.com", "D-Vinci.de", "\n", "apply.workable.com/a_1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", resolve.first_match(F.col("t"), rules.SIGNATURES, F.lit("")).alias("m")).collect()
    for x in got:
        want = next(((a, re.search("(?i)" + p, texts[x["i"]], re.ASCII)) for a, ps in rules.SIGNATURES for p in ps if re.search("(?i)" + p, texts[x["i"]], re.ASCII)), None)
        assert (x["m"] and x["m"]["ats"]) == (want and want[0])
        if want and want[1].re.groups == 1:
            assert x["m"]["identifier"] == want[1][1]


def companies_of(spark, *rows):
    return spark.createDataFrame([(name, url, ats, None, None, None, None, None, i) for i, (name, url, ats) in enumerate(rows)], COMPANY)


def test_companies_of_one_name_are_resolved_apart(spark, tmp_path):
    from tidemill.plans.scan import CompaniesTable

    table = CompaniesTable(spark, str(tmp_path / "companies"))
    table.write(companies_of(spark, ("Acme", "https://a.test", None), ("Acme", "https://b.test", None), ("Acme", "https://c.test", "custom")))
    pages = spark.createDataFrame([(u, u, b) for u, b in (("https://a.test", "jobs.lever.co/a"), ("https://b.test", "jobs.ashbyhq.com/b"))], "request_url string, url string, body string")
    answers = spark.createDataFrame([], "slug string, ats string, body string")
    assert table.resolve(pages, answers).count() == 2
    assert [(r["ord"], r["ats"], r["identifier"]) for r in table.read().orderBy("ord").collect()] == [(0, "lever", "a"), (1, "ashby", "b"), (2, "custom", None)]
    assert table.resolve(pages, answers, "all").count() == 3 and table.version() == 3  # the third is unresolved now
    assert table.resolve(pages, answers, "all").count() == 3 and table.version() == 3  # nothing changed
    assert [len(table.versions.entry(n)["deltas"]) for n in (1, 2, 3)] == [0, 1, 2]
    assert spark.read.parquet(*table.versions.entry()["deltas"]).count() == 3
    with pytest.raises(ValueError, match="key"):
        table.write(companies_of(spark, ("A", "u", None)).unionAll(companies_of(spark, ("B", "u", None))))


def test_deltas_are_written_whole_after_a_while(spark, tmp_path):
    from tidemill.plans.scan import CompaniesTable

    table = CompaniesTable(spark, str(tmp_path / "companies"))
    table.MOST_DELTAS = 1
    table.write(companies_of(spark, ("A", "https://a.test", None)))
    answers = spark.createDataFrame([], "slug string, ats string, body string")
    for body in ("jobs.lever.co/a", "jobs.lever.co/b", "jobs.lever.co/c"):
        table.resolve(spark.createDataFrame([("https://a.test", "https://a.test", body)], "request_url string, url string, body string"), answers, "all")
    assert table.read().first()["identifier"] == "c" and len(table.versions.entry()["deltas"]) == 1 and table.version() == 4


def test_command_line(spark, tmp_path, capsys):
    from tidemill.plans import scan

    table = scan.CompaniesTable(spark, str(tmp_path / "companies"))
    table.write(companies_of(spark, ("A", "https://a.test", None), ("B", "https://b.test", "lever")))
    spark.createDataFrame([("https://a.test", "https://a.test", "jobs.lever.co/a")], "request_url string, url string, body string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([], "slug string, ats string, body string").write.parquet(str(tmp_path / "answers"))
    where = [str(tmp_path / n) for n in ("companies", "pages", "answers", "report")]
    scan.main(where)
    assert "2 companies resolved" in capsys.readouterr().out  # B has no identifier
    lines = [r["value"] for r in spark.read.text(where[3]).collect()]
    assert lines[0] == "# ATS resolution report" and "- lever: 1" in lines and "- B — https://b.test" in lines
    scan.main([*where, "--force"])
    assert "2 companies resolved" in capsys.readouterr().out and table.version() == 2


def test_a_day_resolves_before_it_scans(spark, tmp_path):
    from tidemill.operators.dedup import SeenTable
    from tidemill.plans.scan import CompaniesTable, run_daily
    from tidemill.sources.schema import PAYLOAD

    table, out = CompaniesTable(spark, str(tmp_path / "companies")), []
    table.write(companies_of(spark, ("Acme", "https://a.test", None)))
    pages = spark.createDataFrame([("https://a.test", "https://a.test", "jobs.lever.co/a")], "request_url string, url string, body string")
    body = '[{"text": "SDET", "hostedUrl": "u", "categories": {"location": "Munich"}, "country": "DE"}]'
    payloads = spark.createDataFrame([("Acme", "k", 1, "listing", "x", 200, body, 0)], PAYLOAD)
    none = spark.createDataFrame([], "id string, adapter string")
    sent = run_daily(payloads, none, none.select("id"), table, pages, spark.createDataFrame([], "slug string, ats string, body string"), SeenTable(spark, str(tmp_path / "seen")), out.append)
    assert len(sent) == 1 and "SDET — Acme (Munich)" in out[0]
