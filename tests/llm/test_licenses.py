"""Licence scans: recall on wrapped and changed notices, clean text left alone, cues that hide nothing."""

import math
import random
import re
import textwrap
import time
from pathlib import Path

from tidemill.llm import licenses


def scan(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["families"] for r in licenses.find_licenses(rows).collect()}


def prose(r, n):
    words = "river stone walks under the old bridge and people of the town public work general free copy program library notice terms".split()
    return " ".join(r.choice(words) for _ in range(n))


def test_cues_hide_nothing_that_could_be_confirmed():
    some = re.compile(licenses.cue())
    for template in (t for ts in licenses.TEMPLATES.values() for t in ts):
        threes = set(licenses.grams(template.split(), (3,)))
        hidden = [g for g in threes if not some.search(f" {g} ")]
        assert len(hidden) < licenses.LEAST_SHARE * len(threes), template
    for family, names in licenses.NAMES.items():
        called = [c.format(licenses.ABBREVIATIONS[family]) for c in licenses.CALLED if family in licenses.ABBREVIATIONS]
        assert all(some.search(f" {n} ") for n in (*names, *called)), family


def test_recall_on_wrapped_and_changed_notices(spark):
    r = random.Random(21)
    cases = []
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            for _ in range(6):
                words = template.split()
                for _ in range(len(words) // 30):  # a name filled in, a word lost
                    i = r.randrange(len(words))
                    words[i : i + 1] = r.choice([[], ["ACME", "Inc."], [words[i].upper()]])
                text = " ".join(words)
                text = r.choice([str, str.upper, str.capitalize])(text)
                prefix = r.choice(["", "# ", " * ", "// "])
                lines = [prefix + x for x in textwrap.wrap(text, r.randrange(50, 90))]
                around = lambda: [prose(r, 12) for _ in range(r.randrange(0, 9))]
                cases.append(("\n".join([*around(), "", *lines, "", *around()]), family))
    got = scan(spark, [t for t, _ in cases])
    missed = [f for i, (_, f) in enumerate(cases) if f not in got[i].split(",")]
    wrong = [(f, got[i]) for i, (_, f) in enumerate(cases) if set(got[i].split(",")) - {f, ""}]
    assert len(missed) <= 0.1 * len(cases), (len(missed), len(cases), missed)
    assert len(wrong) <= 0.05 * len(cases), wrong


def test_clean_text_and_odd_rows(spark):
    r = random.Random(22)
    texts = [prose(r, r.randrange(5, 200)) for _ in range(60)] + [*licenses.OTHERS] + ["the license of the driver and the terms of the general library program " * 3, "a" * 300_000, "license " * 20_000, "x\n" * 20_000 + "MIT License", None, ""]
    got = scan(spark, texts)
    clean = [i for i in range(len(texts)) if got[i]]
    assert clean == [len(texts) - 3] and got[len(texts) - 3] == "mit"
    as_is = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."
    assert scan(spark, [as_is, "Eclipse Public License 2.0", "Released under The Unlicense.", "SPDX-License-Identifier: Zlib"]) == {0: "mit", 1: "epl", 2: "unlicense", 3: "zlib"}


def plainly(text):
    """find_licenses() of one text, in plain Python: paragraphs, scores and the families confirmed."""
    weights, bias, temperature = licenses.train()
    some, known = re.compile(licenses.cue()), set(licenses.known_words())
    lower = (text or "").lower()
    lines = lower.split("\n")
    starts = range(1, max(len(lines) - licenses.WINDOW // 2, 1) + 1, licenses.WINDOW // 2) if len(lines) > 1 else []
    paragraphs = [x for x in [*lines, *(" ".join(lines[i - 1 : i - 1 + licenses.WINDOW]) for i in starts)] if some.search(x)]
    families, best = set(), 0.0
    for paragraph in paragraphs:
        clean = re.sub(r"(?<![^ ])\.+|\.+(?![^ ])", "", re.sub(r"[^a-z0-9.+-]+", " ", paragraph))
        tokens = []
        for w in clean.split():
            if w in known or not tokens or tokens[-1] != "~":
                tokens.append(w if w in known else "~")
        n = max(1, len(clean.split()))
        scores = [b for b in bias]
        for k in range(len(bias)):
            total = sum(weights[g][k] for g in dict.fromkeys(licenses.grams(tokens)) if g in weights)
            scores[k] = (total / n**0.5 + bias[k]) / temperature
        family = licenses.FAMILIES[scores.index(max(scores))]
        probability = 1 / sum(math.exp(s - max(scores)) for s in scores)
        if family == "unknown":
            continue
        threes = set(licenses.grams(tokens, (3,)))
        share = max(len(threes & (own := set(licenses.grams(t.split(), (3,))))) / len(own) for t in licenses.TEMPLATES[family])
        if re.search(licenses.named(family), f" {' '.join(tokens)} "):
            share = 1.0
        if probability >= licenses.LEAST_PROBABILITY and share >= licenses.LEAST_SHARE:
            families.add(family)
            best = max(best, probability)
    return len(paragraphs), ",".join(sorted(families)), best


def test_every_document_against_plain_python(spark):
    r = random.Random(4)
    docs = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if Path("/root/testdata/sf0.001").exists() else []
    made = []
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            words = [w if r.random() > 0.08 else r.choice(["river", "stone"]) for w in t.split()]
            made += [t, "\n".join(textwrap.wrap(" ".join(words), r.randrange(30, 80))), prose(r, 40) + "\n# " + " ".join(words).capitalize() + ".\n" + prose(r, 30)]
    names = [f"{prose(r, 5)} {n} {prose(r, 5)}\n\n" for ns in licenses.NAMES.values() for n in ns]
    texts = [*docs, *made, *names, None, "", "License: MIT", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed\n" * 60, "License: MIT " + "zebra . lion  " * 60_000]
    rows = licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for x in rows:
        n, families, best = plainly(texts[x["doc_id"]])
        assert (x["n_paragraphs"], x["families"]) == (n, families) and abs(x["probability"] - best) < 1e-9, texts[x["doc_id"]]
    assert sum(x["families"] != "" for x in rows) > 60 and len(rows) == len(texts)


def test_the_expression_is_made_quickly(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    licenses.find_licenses(docs)  # trains
    start = time.perf_counter()
    licenses.find_licenses(docs)
    assert time.perf_counter() - start < 5
