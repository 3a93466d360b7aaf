import pytest

from tidemill.sources import config, fetch
from tidemill.sources.schema import PAYLOAD


def answers(*given):
    left = list(given)

    def open_url(method, url, timeout):
        one = left.pop(0)
        if isinstance(one, Exception):
            raise one
        return one, url + "#", "body"

    return open_url


def test_requests_are_asked_again_once():
    slept = []
    ask = lambda *given: fetch.request("https://a.test", open_url=answers(*given), sleep=slept.append)
    assert ask(200) == (200, "https://a.test#", "body") and not slept
    assert ask(503, 200)[0] == 200 and ask(ConnectionError(), 200)[0] == 200 and slept == [5.0, 5.0]
    for given in ((429, 429), (404,), (ConnectionError(), ConnectionError())):
        with pytest.raises(OSError):
            ask(*given)


def test_each_keeps_order_and_drops_failures():
    def one(x):
        if x == 2:
            raise OSError
        return x * 10

    slept = []
    assert list(fetch.fetch_each([1, 2, 3], one, delay=1.0, sleep=slept.append)) == [(1, 10), (3, 30)] and slept == [1.0, 1.0]
    assert list(fetch.fetch_each(range(1, 9), one, workers=4)) == [(x, x * 10) for x in range(1, 9) if x != 2]


def test_tokens_are_hidden(spark):
    url = "https://x.test/bot12:Ab_c-9/send"
    assert fetch.redacted_text(url) == "https://x.test/bot***REDACTED***/send"
    rows = spark.createDataFrame([(url,), ("https://x.test/robots/1",)], "u string")
    assert [r[0] for r in rows.select(fetch.redacted(rows.u)).collect()] == ["https://x.test/bot***REDACTED***/send", "https://x.test/robots/1"]


def test_messages_are_posted():
    import json

    seen = []

    def open_url(method, url, timeout, data):
        seen.append((method, url, json.loads(data)))
        return (500 if len(seen) > 1 else 200), url, ""

    send = fetch.message_sender("1:a", "7", open_url=open_url, sleep=lambda s: None)
    send("hello")
    assert seen == [("POST", "https://api.telegram.org/bot1:a/sendMessage", {"chat_id": "7", "text": "hello", "disable_web_page_preview": True})]
    with pytest.raises(OSError, match="REDACTED"):
        send("again")
    assert len(seen) == 3


def test_capture(spark):
    fake = lambda method, url, timeout: ((404 if "gone" in url else 200), url, f"page {url[-1]}")
    wanted = [("s", "k", i, "listing", f"https://h{i % 2}.test/{'gone' if i == 3 else ''}{i}", 0, "", i) for i in range(6)]
    found = fetch.capture(spark.createDataFrame(wanted, PAYLOAD), open_url=fake, backoff=0).collect()
    assert {(r["ord"], r["body"], r["status"]) for r in found} == {(i, f"page {i}", 200) for i in range(6) if i != 3}


def test_configuration(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("sources:\n- {id: b, adapter: stepstone, url: u, priority: 1}\n- {id: a, adapter: todo}\n")
    (tmp_path / "c.yaml").write_text("companies:\n- {name: A, url: u, ats: workday, identifier: {tenant: t, wd_host: wd3, site: s}, resolved_at: '2024-01-02T03:04:05+00:00'}\n- {name: B, url: v}\n")
    (tmp_path / "k.yaml").write_text("title_match_terms: [QA Engineer, SDET]\n")
    assert [(r["id"], r["adapter"], r["url"], r["ord"]) for r in config.sources(spark, str(tmp_path / "a.yaml")).collect()] == [("b", "stepstone", "u", 0), ("a", "todo", None, 1)]
    a, b = config.companies(spark, str(tmp_path / "c.yaml")).collect()
    assert tuple(a["identifier_workday"]) == ("t", "wd3", "s") and a["identifier"] is None and a["resolved_at"] is not None and (b["name"], b["ats"], b["ord"]) == ("B", None, 1)
    assert config.terms(spark, str(tmp_path / "k.yaml")) == ["QA Engineer", "SDET"]
