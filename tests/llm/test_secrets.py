"""The secret scan's battery against a plain one, and very long runs."""

import base64
import math
import random
import re
import time

from tidemill.llm import secrets

SIXTY = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"


def plain_score(found):
    hexed = re.fullmatch("[0-9a-f]+|[0-9A-F]+", found)
    alphabet = "0123456789abcdef" if hexed else "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if re.fullmatch("[A-Z2-7]+=*", found) else SIXTY
    body = (found.lower() if hexed else found.replace("-", "+").replace("_", "/")).replace("=", "")
    codes, k, n = [alphabet.index(c) for c in body], len(alphabet), len(body)
    if n < 16:
        return 1e9
    chi = (sum(codes.count(c) ** 2 for c in set(codes)) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [c >= k / 2 for c in codes]
    flips, h = sum(a != b for a, b in zip(high, high[1:], strict=False)) + 1, sum(high)
    mean = 2 * h * (n - h) / n + 1
    spread = math.sqrt(max(0, (mean - 1) * (mean - 2) / (n - 1)))
    runs = (flips - mean) / spread if spread > 0 else n
    serial = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(codes, codes[1:], strict=False)) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    return max(max(chi, 0) ** 2, runs**2, serial**2)


def plain_candidates(text):
    """(start, end) of all that is tested, each once."""
    out = set()
    for m in re.finditer(r"[A-Za-z0-9+/_-]{18,}==(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{19,}=(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_-]{20,}", text):
        out.add((m.start(), m.end()))
        for separators in ("/", "_", "-", "/_", "/-", "_-", "/_-"):
            out |= {(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(f"[^{re.escape(separators)}]{{20,}}", m[0])}
    return {(a, b) for a, b in out if re.search("[0-9]", text[a:b]) and re.search("[A-Za-z]", text[a:b])}


def plain_random(texts, bases):
    """The spans that a plain Benjamini-Hochberg procedure keeps, of those that overlap the longest."""
    length = lambda n: sum(n >= least for least in secrets.LENGTHS) - 1
    tested = [{(a, b): min(int(plain_score(t[a:b]) / secrets.BIN_WIDTH), secrets.BINS - 1) for a, b in plain_candidates(t)} for t in texts]
    most = {}
    for c in range(len(secrets.LENGTHS)):
        bins = [s for one in tested for (a, b), s in one.items() if length(b - a) == c]
        rejected = [s for s in set(bins) if secrets.chance(s * secrets.BIN_WIDTH) * len(bins) <= secrets.RATE * sum(x >= s for x in bins)]
        most[c] = min([secrets.BINS - 2, *(s - 1 for s in rejected)])
    out = []
    for one, base in zip(tested, bases, strict=True):
        taken = []
        for a, b in sorted((s for s, score in one.items() if score <= most[length(s[1] - s[0])]), key=lambda s: (s[0] - s[1], s[0])):
            if not any(x < b and a < y for x, y in [*base, *taken]):
                taken.append((a, b))
        out.append(sorted(taken))
    return out


def spans(row, kinds):
    return [(int(a), int(b)) for k, a, b in (x.split(":") for x in row["spans"].split(",") if x) if k in kinds]


def test_battery_against_a_plain_one(spark):
    r = random.Random(9)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    words = ["river", "stone", "token", "path", "value", "2024", "v2", "item", "page"]
    texts = []
    for i in range(300):
        parts = [r.choice([
            lambda: some(signs, r.randrange(15, 70)), lambda: some("0123456789abcdef", r.randrange(18, 70)), lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r.randrange(18, 60)),
            lambda: r.choice("/_-").join(r.choice(words) for _ in range(r.randrange(3, 9))), lambda: "/".join(some(signs, r.randrange(3, 40)) for _ in range(4)), lambda: f"secret = {some(signs, 24)}",
            lambda: some(signs + "-_", 44) + "=", lambda: "NAME_KEY=" + some(signs, 32), lambda: r.choice(words) * 5 + "1",
        ])() for _ in range(r.randrange(1, 6))]
        texts.append(r.choice([" ", "\n", " é "]).join(parts))
    rows = {x["doc_id"]: x for x in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_random(texts, [spans(rows[i], ("assign", "access", "hex")) for i in range(len(texts))])
    got = [sorted(spans(rows[i], ("random",))) for i in range(len(texts))]
    assert got == want and sum(map(len, got)) > 200


def test_very_long_runs(spark):
    """A 1 MB run of base64, many keys, many overlapping spans: linear time, and all of it replaced."""
    raw = random.Random(1).randbytes(750_000)
    run, lines = base64.b64encode(raw).decode(), base64.encodebytes(raw[:300_000]).decode()
    many, dense = " token=abcdef1" * 30_000, "secret=token=" * 20_000
    rows = spark.createDataFrame([(0, f"key {run} end"), (1, lines), (2, many), (3, dense), (4, "q" * 500_000)], "doc_id long, text string")
    began = time.time()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert time.time() - began < 60  # of one core a text, with start-up
    assert clean[2] == " [SECRET]" * 30_000 and clean[4] == "q" * 500_000 and len(clean[0]) < 100_000
