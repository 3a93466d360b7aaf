"""Requests with a retry: the optional live side of the sources. Nothing else in the engine uses the network.

open_url(method, url, timeout) returns (status, url, body) or raises OSError if there is no answer.
"""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: What is asked again, how often, and after how long; a bot's token in a url.
RETRIED = frozenset((429, 500, 502, 503, 504))
TIMEOUT, BACKOFF, RETRIES = 30.0, 5.0, 1
TOKEN, HIDDEN = r"(/bot)\d+:[A-Za-z0-9_-]+(/)", "***REDACTED***"

Answer = tuple[int, str, str]


class RequestFailed(OSError):
    """An answer that is an error."""


def redacted(url: Column) -> Column:
    """A url without the token in it, for logs."""
    return F.regexp_replace(url, TOKEN, f"$1{HIDDEN}$2")


def redacted_text(url: str) -> str:
    return re.sub(TOKEN, rf"\1{HIDDEN}\2", url)


def open_with_urllib(method: str, url: str, timeout: float, data: bytes | None = None) -> Answer:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, data, {"Content-Type": "application/json"} if data else {}, method=method), timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.url, answer.read().decode("utf-8", "replace")
    except HTTPError as error:
        return error.code, url, error.read().decode("utf-8", "replace")


def request(url: str, method: str = "GET", open_url: Callable[[str, str, float], Answer] = open_with_urllib, timeout: float = TIMEOUT, retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The answer to a request; asked again after a pause if there is none or one of a passing error, then an error."""
    for left in range(retries, -1, -1):
        try:
            answer = open_url(method, url, timeout)
        except OSError as error:
            if not left:
                raise
            log.warning("%s %s: %s, asked again", method, redacted_text(url), type(error).__name__)
        else:
            if answer[0] < 400:
                return answer
            if answer[0] not in RETRIED or not left:
                raise RequestFailed(f"{method} {redacted_text(url)}: {answer[0]}")
            log.warning("%s %s: %d, asked again", method, redacted_text(url), answer[0])
        sleep(backoff)
    raise AssertionError


def message_sender(token: str, chat: str, host: str = "https://api.telegram.org", open_url: Callable[..., Answer] = open_with_urllib, **how) -> Callable[[str], None]:
    """What sends a message's text to a chat of a bot; the token is in no error and no log."""
    import json

    def send(text: str) -> None:
        data = json.dumps({"chat_id": chat, "text": text, "disable_web_page_preview": True}).encode()
        request(f"{host}/bot{token}/sendMessage", "POST", lambda method, url, timeout: open_url(method, url, timeout, data), **how)

    return send


def fetch_each[T, R](items: Iterable[T], fetch: Callable[[T], R], workers: int = 1, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[T, R]]:
    """(item, result) in the items' order, without those that fail; by one worker spaced by delay, by more at once."""

    def safe(item: T) -> list[tuple[T, R]]:
        try:
            return [(item, fetch(item))]
        except OSError as error:
            log.warning("%r failed: %s", item, error)
            return []

    if workers > 1:
        with ThreadPoolExecutor(workers) as pool:
            for found in pool.map(safe, list(items)):
                yield from found
        return
    for i, item in enumerate(items):
        if i and delay:
            sleep(delay)
        yield from safe(item)


def capture(wanted, open_url: Callable[[str, str, float], Answer] = open_with_urllib, workers: int = 4, retries: int = RETRIES, backoff: float = BACKOFF):
    """Payloads of requests (source_id, request_key, page, kind, url, ord): a request a row, failed ones left out.

    Each host's requests are in one partition, so no host is asked by more than workers at once.
    """
    from ..sources.schema import PAYLOAD

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = frame.to_dict("records")
            found = fetch_each(rows, lambda r: request(r["url"], open_url=open_url, retries=retries, backoff=backoff), workers)
            out = [{**r, "url": url, "status": status, "body": body} for r, (status, url, body) in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAYLOAD.split(", ")])

    host = F.regexp_extract("url", "^[^/?#]*://([^/?#]*)", 1)
    return wanted.repartition(host).mapInPandas(run, PAYLOAD)
