import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import boards, reading, vendors
from tidemill.sources.html import parse
from tidemill.sources.schema import COMPANY, PAYLOAD


@pytest.fixture
def payloads(spark):
    def make(*rows):
        full = [{"source_id": "s", "request_key": "k", "page": 1, "kind": "listing", "url": "https://x.test/", "status": 200, "body": "", "ord": i} | r for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[k] for k in ("source_id", "request_key", "page", "kind", "url", "status", "body", "ord")) for r in full], PAYLOAD)

    return make


def scanned(frame):
    return [(r["title"], r["company"], r["url"], r["location"], r["description"]) for r in frame.orderBy("ord").collect()]


def test_html():
    page = parse('<div class="a b" id="x"><p>One <b>two</b><br>3 &amp; 4</p><i></i><span data-k="v">s</span></div><span>t</span>')
    assert page.first("div.b#x p").inner() == "One <b>two</b><br/>3 &amp; 4"
    assert page.first("p").tight() == "Onetwo3 & 4" and page.first('span[data-k="v"]').text() == "s"
    assert page.first("i").sibling("span").text() == "s" and page.first('[data-k^="v"]').following("span").text() == "t"
    assert page.first("b").above("div").get("id") == "x" and page.first("p i") is None


def test_plain_markup_is_read_as_the_parser_reads_it():
    from tidemill.sources import html

    dump = lambda n: (n.tag, n.attrs, [c if isinstance(c, str) else dump(c) for c in n.children])
    plain = ["", "a &amp; b", '<p class="x">1<br>2<br/></p></q>', "<a x='1' y=\"2\" x=\"3\">t", '<script type="j">{"a&amp;b"}</script>&lt;', "<i><b></i>c</b>"]
    other = ["<P>", "<p x=1>", '<p x="&amp;">', "a < b", "<!-- c -->", "<script>if (a<b)</script>", "<script>x", "<title><b></title>", "</p >", "<p\tx='1'>", "<a b>"]
    assert all(dump(html._plain(t)) == dump(html._parsed(t)) for t in plain) and not any(html._plain(t) for t in other)


def test_rows_leave_the_worker_in_slices(spark, payloads, monkeypatch):
    monkeypatch.setattr(reading, "SLICE", 3)
    card = '<article data-testid="job-item"><a data-testid="job-item-title" href="/%s">SDET</a></article>'
    odd = {"source_id": "i", "url": "u", "body": LD % '{"@type": "JobPosting", "title": "SDET \\ud800"}'}
    rows = payloads(*({"source_id": "s", "page": i, "body": "".join(card % f"{i}-{k}" for k in range(i % 4))} for i in range(20)), odd, {"source_id": "s", "status": 500, "body": card % "no"})
    names = spark.createDataFrame([("s", "stepstone"), ("i", "instaffo")], "id string, adapter string")
    found = boards.scan_boards(rows, names, names).orderBy("ord").collect()
    assert [r["url"] for r in found] == ["u"] + [f"https://www.stepstone.de/{i}-{k}" for i in range(20) for k in range(i % 4)] and found[0]["title"] == "SDET ?"
    assert reading.listed([[], None, [dict.fromkeys(boards._FIELDS, "x")]], boards._FIELDS).to_pylist() == [[], None, [dict.fromkeys(boards._FIELDS, "x")]]
    plan = boards._listings(rows.withColumn("board", F.lit("stepstone")).withColumn("rank", F.lit(0)).join(boards._boards(spark), "board"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # a batch's rows aren't held until the last is read


NEXT = '<script id="__NEXT_DATA__" type="application/json">%s</script>'
LD = '<script type="application/ld+json">%s</script>'
BOARD_CASES = {
    "arbeitnow": (json.dumps({"data": '<div data-link="u1"><h3 itemprop="title"><a>QA Engineer </a></h3><a itemprop="hiringOrganization">C</a><span class="text-gray-600">Berlin</span></div>'}), ("QA Engineer", "C", "u1", "Berlin", "")),
    "germantechjobs": ("<rss><channel><item><title>QA Engineer @ Foo GmbH [50k]</title><link> l1 </link><description>d</description></item></channel></rss>", ("QA Engineer", "Foo GmbH", "l1", "Germany", "d")),
    "stepstone": ('<article data-testid="job-item"><a data-testid="job-item-title" href="/j1">QA Engineer</a><span data-at="job-item-company-name">C</span><span data-at="job-item-location">Ulm</span><div data-at="jobcard-content"><b>x</b></div></article>', ("QA Engineer", "C", "https://www.stepstone.de/j1", "Ulm", "<b>x</b>")),
    "devjobs": ('<a href="/job/1"><h2>QA Engineer</h2><div class="ml-2"><p>C</p><span>Ulm</span></div><p class="line-clamp-2">s</p></a>', ("QA Engineer", "C", "https://en.devjobs.de/job/1", "Ulm", "s")),
    "testdevjobs": ('<div class="job-tile-wrapper"><p class="jobtitle">SDET</p><p class="comptitle">C</p><a href="/job/2">x</a><span itemprop="address"><span itemprop="addressCountry">Ulm,</span><span itemprop="addressCountry">Remote</span></span></div>', ("SDET", "C", "https://testdevjobs.com/job/2", "Ulm Remote", "")),
    "wearedevelopers": ("# x\n## QA Engineer\n- **Company:** C\n- **Location:** Ulm\n- [View job](https://w/1)\n## Other\n- **Company:** D\n", ("QA Engineer", "C", "https://w/1", "Ulm", "")),
    "englishjobs": ('<div class="job js-job" id="7"><h3 itemprop="title"><b>QA</b>\n Engineer</h3><ul class="space-y-1"><li>C</li><li>Ulm</li></ul><div class="mr-4">s</div></div>', ("QA Engineer", "C", "https://englishjobs.de/clickout/7", "Ulm", "s")),
    "builtin": ('<div class="job-bounded-responsive"><a data-id="job-card-title" href="/job/3">SDET</a><div data-id="company-title"><span>C</span></div><div class="d-flex x"><div><i class="fa-location-dot"></i></div><div><span>Ulm</span></div></div><div><i class="fa-house-building"></i></div><span>Hybrid</span></div>', ("SDET", "C", "https://builtin.com/job/3", "Ulm Hybrid", "")),
    "xing": ('<article data-testid="job-search-result"><a href="/jobs/4"><h2 data-testid="job-teaser-list-title">SDET</h2></a><p class="x-Company-y">C</p><div class="multi-location-display-styles__Container-z"><span>Ulm</span> <b>+ 2 weitere</b></div></article>', ("SDET", "C", "https://www.xing.com/jobs/4", "Ulm", "")),
    "get_in_it": (NEXT % json.dumps({"props": {"initialState": {"jobSearchJobs": {"jobs": [{"title": "SDET", "company": None, "url": "/p1", "locations": [{"name": "Ulm"}, {"name": "Bonn"}]}, {"title": "no url"}]}}}}), ("SDET", "", "https://www.get-in-it.de/p1", "Ulm, Bonn", "")),
    "instaffo": (LD % json.dumps({"@type": "JobPosting", "title": "SDET", "hiringOrganization": {"name": "C"}, "description": "d", "jobLocation": [{"address": {"addressLocality": "Ulm"}}, {}]}), ("SDET", "C", "https://x.test/", "Ulm", "d")),
    "bundesagentur": (json.dumps({"ergebnisliste": [{"referenznummer": "r", "stellenangebotsTitel": "SDET", "firma": None, "stellenlokationen": [{"adresse": {"land": "DEUTSCHLAND", "ort": "Ulm"}}, {"adresse": {"land": "X", "ort": "Y"}}, {"adresse": None}]}, {"referenznummer": "q", "stellenlokationen": []}]}), ("SDET", "", "https://www.arbeitsagentur.de/jobsuche/jobdetail/r", "Ulm", "")),
    "ferchau": ('<script>App.Data = {"ControllerResponse":{"Data":{"Offers":[{"slug":"/s","title":"SD­ET","locationCountryCode":"de","locationCity":"Ulm","locationCountry":"DE","intro":"i","tasks":"t","tasksHeadline":"T"},{"slug":"/a","locationCountryCode":"AT"}],"OffersCount":{"total":2}}}}; more()</script>', ("SDET", "FERCHAU", "https://touch.ferchau.com/s", "Ulm, DE", "i<p>T</p>t")),
    "munich_startup": ('<a href="/jobs/anzeige/1"><p class="text-card-title">SDET</p><p class="text-card-meta">C</p></a><a href="/jobs/anzeige/2"></a>', ("SDET", "C", "https://www.munich-startup.de/jobs/anzeige/1", "Germany", "")),
    "stellenanzeigen": ('<div data-jobid="1"><h3><a href="/job/5">SDET</a></h3><p data-testid="company-name">C</p></div><div data-jobid="2"><h3><a href="/x">n</a></h3></div>', ("SDET", "C", "https://www.stellenanzeigen.de/job/5", "Germany", "")),
}


def test_every_board_reads_its_listing(spark, payloads):
    assert set(BOARD_CASES) == set(boards.BOARDS)
    rows = payloads(*(r | {"source_id": name} for name, (body, _) in BOARD_CASES.items() for r in ({"body": body}, {"body": "{broken", "page": 2})))
    names = spark.createDataFrame([(n, n) for n in BOARD_CASES], "id string, adapter string")
    found = boards.scan_boards(rows, names, names).orderBy("ord").collect()
    assert [(r["source_id"], r["title"], r["company"], r["url"], r["location"], r["description"]) for r in found] == [(n, *BOARD_CASES[n][1]) for n in sorted(BOARD_CASES)]
    body, expected = BOARD_CASES["stepstone"]
    assert scanned(boards.scan_board(payloads({"body": body}), "stepstone")) == [expected]


def test_details(payloads):
    card = '<article data-testid="job-item"><a data-testid="job-item-title" href="/%s">%s</a><div data-at="jobcard-content">snippet</div></article>'
    body = "".join(card % x for x in (("1", "SDET"), ("2", "SDET"), ("3", "Baker")))
    page = {"kind": "detail", "body": '<div data-at="job-ad-content"><p>full</p></div>'}
    rows = payloads({"body": body}, page | {"url": "https://www.stepstone.de/1"}, page | {"url": "https://www.stepstone.de/3"}, page | {"url": "https://www.stepstone.de/2", "status": 500})
    assert [r[4] for r in scanned(boards.scan_board(rows, "stepstone"))] == ["<p>full</p>", "snippet", "snippet"]


def test_foreign_details_go(payloads):
    teaser = '<article data-testid="job-search-result"><a href="/jobs/%s"><h2 data-testid="job-teaser-list-title">SDET</h2></a></article>'
    at = lambda n, c: {"kind": "detail", "url": f"https://www.xing.com/jobs/{n}", "body": LD % json.dumps({"jobLocation": [{"address": {"addressCountry": c}}]})}
    rows = payloads({"body": "".join(teaser % i for i in "123")}, at(1, "AT"), at(2, "DE"))
    assert [r[2][-1] for r in scanned(boards.scan_board(rows, "xing"))] == ["2", "3"]


def test_pages_end_at_the_first_empty_one(payloads):
    card = '<a href="/job/%s"><h2>SDET</h2></a>'
    rows = payloads(*({"page": p, "body": b} for p, b in ((1, card % 1), (2, card % 2), (3, ""), (4, card % 4))))
    assert [r[2][-1] for r in scanned(boards.scan_board(rows, "devjobs"))] == ["1", "2"]


def test_boards_by_active_source(spark, payloads):
    sources = spark.createDataFrame([("b", "stepstone"), ("a", "munich_startup"), ("z", "nothing_todo")], "id string, adapter string")
    active = spark.createDataFrame([("a",), ("b",), ("missing",), ("z",)], "id string")
    rows = payloads({"source_id": "b", "body": BOARD_CASES["stepstone"][0]}, {"source_id": "a", "body": BOARD_CASES["munich_startup"][0]}, {"source_id": "z", "body": "x"})
    assert [r["source_id"] for r in boards.scan_boards(rows, sources, active).orderBy("ord").collect()] == ["a", "b"]


def test_a_sources_responses_are_read_where_they_are(spark, payloads, monkeypatch):
    """By the source's id they would all meet in one task."""
    rows = payloads(*[{"source_id": "a"}] * 8).repartition(8, "ord").withColumn("at", F.spark_partition_id())
    names = spark.createDataFrame([("a", "arbeitnow")], "id string, adapter string")
    held = []
    monkeypatch.setattr(boards, "_scan", lambda mine, *_: held.append(mine) or boards.Scan(mine, spark.createDataFrame([], boards.FAILURE), {}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        boards.scan_reported(rows, names, names)
        assert held[0].where(F.col("at") != F.spark_partition_id()).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sitemap():
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://jobs.instaffo.com/en/job/qualitatsingenieur-0123456789ab</loc></url><url><loc>https://jobs.instaffo.com/de/job/sdet-0123456789ab</loc></url></urlset>'
    assert len(boards.instaffo_urls(xml, ["Qualitätsingenieur", "SDET"])) == 1 and boards.instaffo_urls("<broken", ["x"]) == []


VENDOR_CASES = {
    "greenhouse": (json.dumps({"jobs": [{"title": " SDET ", "absolute_url": "u", "location": {"name": "Berlin"}, "content": "&lt;p&gt;"}, {"title": "x", "absolute_url": "v", "location": {"name": "Madrid"}}]}), ("SDET", "Acme", "u", "Berlin", "<p>")),
    "lever": (json.dumps([{"text": "SDET", "hostedUrl": "u", "categories": {"location": "Remote"}, "description": "d"}, {"text": "x", "hostedUrl": "v", "country": "US"}]), ("SDET", "Acme", "u", "Remote", "d")),
    "ashby": (json.dumps({"jobs": [{"title": "SDET", "jobUrl": "u", "location": "Ulm", "address": {"postalAddress": {"addressCountry": "Germany"}}, "descriptionHtml": "d"}, {"title": "x", "jobUrl": "v", "location": "Berlin", "address": {"postalAddress": {"addressCountry": "Spain"}}}]}), ("SDET", "Acme", "u", "Ulm", "d")),
    "smartrecruiters": (json.dumps({"content": [{"id": "1", "name": "SDET", "location": {"country": "de", "city": "Ulm"}}, {"id": "2", "name": "x", "location": {"country": "us"}}]}), ("SDET", "Acme", "https://jobs.smartrecruiters.com/acme/1", "Ulm", "")),
    "personio": ("<r><position><id>1</id><name>SDET</name><office>Ulm</office><additionalOffices><office>Bonn</office></additionalOffices><jobDescriptions><jobDescription><name>n</name><value><![CDATA[<b>x</b>]]></value></jobDescription><jobDescription><value>y</value></jobDescription></jobDescriptions></position><position><id>2</id><name>x</name><office>Paris</office></position></r>", ("SDET", "Acme", "https://acme.jobs.personio.de/job/1", "Ulm, Bonn", "<b>x</b>\ny")),
    "workable": (json.dumps({"jobs": [{"title": "SDET", "shortlink": "u", "country": "Germany", "city": "Ulm", "description": "d"}, {"title": "x", "url": "v", "country": "germany"}]}), ("SDET", "Acme", "u", "Ulm, Germany", "d")),
    "recruitee": (json.dumps({"offers": [{"title": "SDET", "careers_url": "u", "country_code": "de"}, {"title": "x", "careers_url": "v"}]}), ("SDET", "Acme", "u", "Germany", "")),
    "softgarden": ('<a href="/job/1">SDET\n one</a><a href="/job/1">again</a><a href="/other">x</a>', ("SDET one", "Acme", "https://x.test/job/1", "Germany", "")),
    "bamboohr": (json.dumps({"result": [{"id": "1", "jobOpeningName": "SDET", "location": {"city": "Ulm"}, "atsLocation": {"country": "Germany"}}, {"id": "2", "jobOpeningName": "x", "location": {"addressCountry": "Spain"}}]}), ("SDET", "Acme", "https://acme.bamboohr.com/careers/1", "Ulm, Germany", "")),
    "join": (NEXT % json.dumps({"props": {"pageProps": {"initialState": {"jobs": {"items": [{"id": 1, "idParam": "1-sdet", "title": "SDET", "city": {"cityName": "Ulm"}, "country": {"iso3166": "de"}}, {"id": 2, "idParam": "2", "country": {"iso3166": "AT"}}]}}}}}), ("SDET", "Acme", "https://join.com/companies/acme/1-sdet", "Ulm, Germany", "")),
    "onlyfy": ('<a data-testid="job-card" href="/j1"><h3 data-testid="job-title">SDET</h3><p data-testid="job-more-info">Berlin | Full</p></a><a data-testid="job-card" href="/j2"><h3 data-testid="job-title">x</h3><p data-testid="job-more-info">Ulm | Full</p></a>', ("SDET", "Acme", "https://acme.onlyfy.jobs/j1", "Berlin, Germany", "")),
}


@pytest.fixture
def company(spark):
    return lambda ats, workday=None: spark.createDataFrame([("Acme", "https://acme.test", ats, "acme", workday, None, None, None, 0)], COMPANY)


def test_vendors_rows_leave_the_worker_in_slices(payloads, company):
    for name in vendors.READ:
        plan = vendors.scan_vendor(payloads({"source_id": "Acme", "body": VENDOR_CASES[name][0]}), company(name), name)._jdf.queryExecution()
        optimized = plan.optimizedPlan().toString()
        assert optimized.count("MapInArrow") == 1 and "_links(" not in optimized and "_cards(" not in optimized and "xml_positions(" not in optimized


def test_every_vendor_reads_its_listing(spark, payloads, company):
    assert set(VENDOR_CASES) == set(vendors.VENDORS)
    rows = payloads(*({"source_id": source, "body": body} for name, (own, _) in VENDOR_CASES.items() for source, body in ((name, own), (name, "{broken"), ("Other", own))))
    companies = spark.createDataFrame([(n, "https://acme.test", n, "acme", None, None, None, None, i) for i, n in enumerate(VENDOR_CASES)], COMPANY)
    # The company's name stands in for Acme's, where a vendor's answer names none.
    assert scanned(vendors.scan_companies(rows, companies)) == [tuple(name if v == "Acme" else v for v in expected) for name, (_, expected) in VENDOR_CASES.items()]
    body, expected = VENDOR_CASES["lever"]
    assert scanned(vendors.scan_vendor(payloads({"source_id": "Acme", "body": body}), company("lever"), "lever")) == [expected]


def test_a_boards_responses_do_not_meet_where_companies_are_looked_up(spark, payloads, company, monkeypatch):
    """By the board's id they would all go to one task of the join, with their bodies, and fall out there."""
    body, expected = VENDOR_CASES["lever"]
    rows = payloads(*[{"source_id": "a", "body": "x"}] * 8, {"source_id": "Acme", "body": body}, {"source_id": "#0", "body": body}, {"source_id": None}, {"source_id": "b"}, {"source_id": "b"}, {"source_id": "c"})
    real, held = vendors._scan, []
    monkeypatch.setattr(vendors, "_scan", lambda mine, *more: held.append(mine) or real(mine, *more))
    monkeypatch.setattr(vendors, "MOST_STRANGERS", 2)
    assert scanned(vendors.scan_companies(rows, company("lever"))) == [expected]
    assert vendors.failures(rows, company("lever")).isEmpty()
    assert sorted(r["source_id"] for r in held[0].collect()) == ["#0", "Acme", "c"]


def test_vendor_details(payloads, company):
    detail = {"jobAd": {"sections": {"qualifications": {"text": "q"}, "companyDescription": {"text": "c"}, "jobDescription": {"text": ""}}}}
    rows = payloads({"source_id": "Acme", "body": VENDOR_CASES["smartrecruiters"][0]}, {"source_id": "Acme", "kind": "detail", "url": "https://jobs.smartrecruiters.com/acme/1", "body": json.dumps(detail)})
    assert scanned(vendors.scan_vendor(rows, company("smartrecruiters"), "smartrecruiters"))[0][4] == "c\nq"


def test_workday(payloads, company):
    facets = {"facets": [{"values": [{"facetParameter": "loc", "values": [{"descriptor": "Berlin", "id": "1"}, {"descriptor": "Oslo", "id": "2"}]}]}]}
    listing = {"total": 3, "jobPostings": [{"title": "SDET", "externalPath": f"/job/{i}", "locationsText": "Berlin"} for i in range(3)]}
    detail = lambda i, c: {"source_id": "Acme", "kind": "detail", "url": f"https://t.wd3.myworkdayjobs.com/s/job/{i}", "body": json.dumps({"jobPostingInfo": {"country": {"descriptor": c}, "jobDescription": f"d{i}"}})}
    rows = payloads({"source_id": "Acme", "kind": "facets", "body": json.dumps(facets)}, {"source_id": "Acme", "body": json.dumps(listing)}, {"source_id": "Acme", "page": 2, "body": json.dumps(listing)}, detail(0, "Germany"), detail(1, "Norway"))
    who = company("workday", ("t", "wd3", "s"))
    assert [(r[2][-1], r[4]) for r in scanned(vendors.scan_workday(rows, who))] == [("0", "d0"), ("2", "")]
    assert vendors.workday_facets(rows).first()["lists"] == {"loc": ["1"]}
    assert vendors.scan_workday(rows.where(F.col("kind") != "facets"), who).count() == 0


def test_a_bad_response_costs_its_own_rows_only():
    odd = LD % json.dumps({"description": "d", "jobLocation": [{"address": {"addressCountry": 49}}]})
    deep = "<div>" * 20_000
    for name, board in boards.BOARDS.items():
        for body in (odd, deep, None, "{", "[]", '{"data": 3, "ergebnisliste": 4}', NEXT % '{"props": {"initialState": {"jobSearchJobs": {"jobs": 5}}}}', "<rss>", "App.Data = {"):
            assert boards.read_listing(name, body)[0] in ([], [{"title": "", "company": "", "url": "", "location": "Germany", "description": ""}]) or name == "instaffo"
            if board.detail:
                assert len(boards.read_detail(name, body)) == 2
    assert boards.read_detail("stellenanzeigen", odd) == ("", "") and parse(deep + "x" + "</div>").first("div").inner().startswith("<div>")


def test_requests_and_sitemaps(spark, payloads):
    sources = spark.createDataFrame([("s", "stepstone"), ("e", "englishjobsde"), ("b", "bundesagentur")], "id string, adapter string")
    rows = {(r["source_id"], r["ord"]): r["request_key"] for r in boards.requests(sources, ["QA Engineer", "C/C++"]).collect()}
    assert rows == {("s", 0): "QA-Engineer", ("s", 1): "C/C%2B%2B", ("e", 0): "QA_Engineer", ("e", 1): "C/C++", ("b", 0): "QA%20Engineer", ("b", 1): "C/C%2B%2B"}
    page = lambda slug: {"url": f"https://jobs.instaffo.com/en/job/{slug}", "body": BOARD_CASES["instaffo"][0]}
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">%s</urlset>' % "".join(f"<url><loc>https://jobs.instaffo.com/en/job/{s}</loc></url>" for s in ("sdet-0123456789ab", "baker-0123456789ab"))
    found = boards.scan_board(payloads({"kind": "sitemap", "body": xml}, page("sdet-0123456789ab"), page("baker-0123456789ab"), page("sdet-of-another-map")), "instaffo")
    assert [r[2].rsplit("/", 1)[1] for r in scanned(found)] == ["sdet-0123456789ab"]


def test_feeds_of_odd_shapes(payloads):
    jobs = lambda *x: json.dumps({"ergebnisliste": list(x)})
    good = {"referenznummer": "r", "stellenangebotsTitel": "SDET", "firma": 7, "stellenlokationen": [{"adresse": {"land": "DEUTSCHLAND", "ort": "Ulm"}}, 3, None]}
    rows = payloads({"body": jobs(5, None, good, {"referenznummer": "x", "stellenlokationen": "DEUTSCHLAND"}, {"referenznummer": 9, "stellenlokationen": [{"adresse": {"land": "DEUTSCHLAND", "ort": None}}]})}, {"body": '{"ergebnisliste": 3}'}, {"body": None}, {"body": "[]"})
    base = "https://www.arbeitsagentur.de/jobsuche/jobdetail/"
    assert scanned(boards.scan_board(rows, "bundesagentur")) == [("SDET", "7", base + "r", "Ulm", ""), ("", "", base + "9", "", "")]
    feed = "<rss><channel><title>t</title><item><title> SDET@A &amp; B </title><link>l1</link></item><item><title>no company</title><link> l2 </link><description><![CDATA[ <p>d</p> ]]></description></item><item/></channel></rss>"
    assert scanned(boards.scan_board(payloads({"body": feed}, {"body": "<rss><channel>"}), "germantechjobs")) == [("SDET", "A & B", "l1", "Germany", ""), ("no company", "Unknown", "l2", "Germany", " <p>d</p> ")]
    page = "<script defer id=\"__NEXT_DATA__\">" + json.dumps({"props": {"initialState": {"jobSearchJobs": {"jobs": [{"title": "SDET", "url": "/a", "locations": 4}, 8]}}}}) + "</script>"
    detail = {"kind": "detail", "url": "https://www.get-in-it.de/a", "body": NEXT % json.dumps({"props": {"initialState": {"jobJob": {"job": {"content": "<p>full</p>"}}}}})}
    assert scanned(boards.scan_board(payloads({"body": page}, {"body": NEXT % "{"}, detail), "get_in_it")) == [("SDET", "", "https://www.get-in-it.de/a", "", "<p>full</p>")]
    jobs_page = [{"kind": "detail", "url": base + "r", "body": LD % '{"@type": "Organization"}' + LD % "{" + LD % '{"@type": "JobPosting", "description": "full"}'}]
    assert scanned(boards.scan_board(payloads({"body": jobs(good)}, *jobs_page), "bundesagentur"))[0][4] == "full"


def test_what_could_not_be_read(spark, payloads):
    sources = spark.createDataFrame([("a", "bundesagentur"), ("b", "stepstone"), ("c", "arbeitnow_api"), ("z", "nothing_todo")], "id string, adapter string")
    active = spark.createDataFrame([("a",), ("b",), ("c",), ("missing",), ("z",), ("a",)], "id string")
    rows = payloads(
        {"source_id": "a", "body": BOARD_CASES["bundesagentur"][0]}, {"source_id": "a", "body": "<html>", "page": 2}, {"source_id": "a", "status": 503, "page": 3}, {"source_id": "b", "body": BOARD_CASES["stepstone"][0]}, {"source_id": "b", "kind": "detail", "status": 404, "url": "u"},
        {"source_id": "c", "body": "{"}, {"source_id": "b", "kind": "detail", "url": "https://www.stepstone.de/j1", "body": '<div data-at="job-ad-content">full</div>'}, {"source_id": "gone", "body": "x"},
    )
    found = boards.scan_reported(rows, sources, active)
    assert [r["source_id"] for r in found.postings.orderBy("ord").collect()] == ["a", "b"]
    got = sorted((r["source_id"], r["kind"], r["page"], r["reason"].split(":")[0]) for r in found.failures.collect() if r["page"]) + sorted((r["source_id"], r["kind"], r["reason"]) for r in found.failures.collect() if not r["page"])
    assert got == [("a", "listing", 2, "no readable JSON"), ("a", "listing", 3, "status 503"), ("b", "detail", 1, "status 404"), ("c", "listing", 1, "JSONDecodeError"), ("missing", "source", "source not found"), ("z", "source", "no board for adapter nothing_todo")]
    assert found.counts == {"n_listings": 5, "n_failed_listings": 3, "n_rows": 2, "n_details": 2, "n_failed_details": 1}
    none = boards.scan_reported(rows.limit(0), sources.limit(0), active.limit(0))
    assert none.postings.count() == 0 and none.failures.count() == 0 and none.counts["n_listings"] == 0


def test_no_window_over_pages(payloads):
    card = '<a href="/job/%s"><h2>SDET</h2></a>'
    found = boards.scan_board(payloads(*({"page": p, "body": card % p} for p in (1, 2, 4))), "devjobs")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString() and len(scanned(found)) == 2


def test_companies_of_one_name(spark, payloads):
    twins = spark.createDataFrame([("Acme", "https://a.test", "lever", "one", None, None, None, None, 0), ("Acme", "https://b.test", "lever", "two", None, None, None, None, 1), ("Other", "https://c.test", "no vendor", "x", None, None, None, None, 2), ("Solo", "https://d.test", "lever", "solo", None, None, None, None, 3)], COMPANY)
    body = VENDOR_CASES["lever"][0]
    rows = payloads({"source_id": "#0", "body": body}, {"source_id": "Acme", "body": body}, {"source_id": "Solo", "body": "{broken"}, {"source_id": "Solo", "status": 500, "kind": "detail"}, {"source_id": "Other", "body": "x"})
    assert [(r["source_id"], r["company"]) for r in vendors.scan_companies(rows, twins).collect()] == [("lever:one", "Acme")]
    assert sorted((r["source_id"], r["reason"]) for r in vendors.failures(rows, twins).collect()) == [("Acme", "several companies have this name"), ("Other", "no reader for vendor no vendor"), ("Solo", "no readable postings"), ("Solo", "status 500")]


def test_workday_pages(payloads, company):
    facets = {"source_id": "Acme", "kind": "facets", "body": json.dumps({"facets": [{"values": [{"facetParameter": "loc", "values": [{"descriptor": "Berlin", "id": "1"}]}]}]})}
    page = lambda key, n, total, *ids: {"source_id": "Acme", "request_key": key, "page": n, "body": json.dumps({"total": total, "jobPostings": [{"title": "Baker", "externalPath": f"/{i}", "locationsText": "Berlin"} for i in ids]})}
    rows = payloads(
        facets, facets | {"status": 500, "body": "{"}, page("empty", 1, 99, "a1"), page("empty", 2, 99), page("empty", 3, 99, "a3"), page("total", 1, 30, "b1"), page("total", 2, 30, "b2"), page("total", 3, 30, "b3"),
        page("gap", 1, 99, "c1"), page("gap", 3, 99, "c3"), *(page("cap", n, 999, f"d{n}") for n in range(1, 8)), page("none", 1, None, "e1"), page("none", 2, None, "e2"),
    )
    found = {r[2].rsplit("/", 1)[1] for r in scanned(vendors.scan_workday(rows, company("workday", ("t", "wd3", "s"))))}
    assert found == {"a1", "b1", "b2", "c1", "d1", "d2", "d3", "d4", "d5", "e1"}
