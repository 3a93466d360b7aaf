"""Line dedup, fill-in-middle and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import infill, line_dedup, resampling

SCHEMA = "doc_id long, text string, lang string, row string, pos int, line string, gone int, cut string, id long, n long, score int, place int"
SPACE = " \t\n\x0b\x0c\r"


def texts():
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdeéßZ") for _ in range(r.randrange(1, 8))) for _ in range(n))
    shared = [prose(14) for _ in range(4)]
    out = [None, "", "\n", "\n\n\n", "x", " \t ", "a\n<P>b\n", "tail<\nS>", "é\nß\n\n", "x" * 39, shared[0], f"\x0b {shared[0].upper()} \r"]
    for i in range(40):
        lines = [prose(r.randrange(0, 14)) for _ in range(r.randrange(1, 9))]
        for _ in range(r.randrange(4)):
            lines.insert(r.randrange(len(lines) + 1), r.choice(["", "  ", "\t"]) + r.choice(shared) + r.choice(["", " ", "\r"]))
        out.append("\n".join(lines) + r.choice(["", "\n", "\n\n"]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "r", 1, "l", 2, "c", 3, 4, 5, 6) for i, t in enumerate(texts())], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, one doc_id with two texts, null doc_ids."""
    line = "the same long line of words that many documents have in common"
    rows = [(1, line), (1, line), (1, f"{line}\nother"), (None, line), (None, f"own\n{line}"), (None, None), (2, line), (3, line), (4, f"{line}\n{line}\nend")]
    return spark.createDataFrame([(i, t, "en", "r", 1, "l", 2, "c", 3, 4, 5, 6) for i, t in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, least_chars, least_docs):
    """Of each row: lines, dropped lines and the text that stays."""
    split, held = [(i, (t or "").split("\n")) for i, t in rows], defaultdict(set)
    keys = [[lower(x.strip(SPACE)) for x in lines] for _, lines in split]
    for (i, _), own in zip(split, keys, strict=True):
        for k in own:
            if len(k) >= least_chars:
                held[k].add(-math.inf if i is None else i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for (i, lines), own in zip(split, keys, strict=True):
        stays = [x for x, k in zip(lines, own, strict=True) if not (k in gone and (-math.inf if i is None else i) < gone[k])]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


@pytest.mark.parametrize(("chars", "n"), [(40, 5), (1, 2), (40, 10_000), (0, 1)])
def test_lines(docs, chars, n):
    got = line_dedup.dedup_lines(docs, chars, n).collect()
    want = plain_lines(list(enumerate(texts())), chars, n)
    assert sorted(map(tuple, got)) == sorted(want)
    assert chars != 40 or n != 5 or sum(x[2] for x in want) > 20


def test_lines_of_repeated_and_missing_ids(odd):
    rows = [(x["doc_id"], x["text"]) for x in odd.collect()]
    got = line_dedup.dedup_lines(odd).collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, 40, 5))
    clean = line_dedup.clean_documents(odd)
    assert clean.columns == odd.columns
    kept = Counter((x["doc_id"], x["text"]) for x in clean.collect())
    assert kept == Counter({(1, ""): 2, (1, "other"): 1, (None, ""): 1, (None, "own"): 1, (None, None): 1, (2, ""): 1, (3, ""): 1, (4, rows[-1][1]): 1})
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0 and line_dedup.clean_documents(odd.limit(0)).count() == 0


def test_a_line_of_a_third_of_all_documents_meets_in_no_task(spark):
    line = "a line that a very large share of all documents have in common"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.when(F.col("id") % 3 == 0, line), F.concat(F.lit("number "), "id")).alias("text"))
    shared = line_dedup.shared_keys(line_dedup.long_lines(docs)).collect()
    assert [(x["n_docs"], x["last"]) for x in shared] == [(1000, 2997)]
    out = line_dedup.dedup_lines(docs)
    assert out.where("n_dropped = 1").count() == 999 and out.where("kept like 'a line%'").count() == 1


def units(text, unit):
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    if text and not text.strip(SPACE):
        return [text]
    return re.findall(r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)


def plain_infill(doc_id, text, seed, unit, rate, spm):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    text = text or ""
    own = units(text, unit)
    n = len(own)
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize(("unit", "seed", "rate", "spm"), [("line", 7, 100, 50), ("word", 1, 100, 0), ("char", 2, 60, 100)])
def test_infill(docs, unit, seed, rate, spm):
    out = infill.fill_in_middle(docs, seed, unit, rate, spm)
    got = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    for x in got:
        text = texts()[x["doc_id"]]
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"]) == plain_infill(x["doc_id"], text, seed, unit, rate, spm)
        assert x["back"] == (text or "")
    assert len(got) == len(texts()) and len({x["form"] for x in got}) > 1


def test_infill_of_odd_rows(odd):
    rows = [(x["doc_id"], x["text"]) for x in odd.collect()]
    got = infill.fill_in_middle(odd).collect()
    assert Counter((x["doc_id"], x["output"]) for x in got) == Counter((i, plain_infill(i, t, 7, "line", 100, 50)[-1]) for i, t in rows)
    assert infill.fill_in_middle(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="units"):
        infill.fill_in_middle(odd, unit="page")


def test_runs_are_maximal_and_cuts_are_found_in_any_chunk(monkeypatch):
    r = random.Random(3)
    rows = ["".join(r.choice("a\n é\t") for _ in range(r.randrange(0, 30))) for _ in range(400)]
    a, b = (np.array([r.randrange(1 << 32) for _ in rows]) for _ in "ab")
    for chunk in (1, 40, 1 << 20):
        monkeypatch.setattr(infill, "CHUNK", chunk)
        for unit in infill.UNITS:
            found = infill.encoded(pa.array(rows[:7] + rows)[7:], unit)
            for text, runs in zip(rows, found.to_pylist(), strict=True):
                kinds = {"line": [c == "\n" for c in text], "word": [c in SPACE for c in text], "char": [0] * len(text)}[unit]
                assert runs["ends"] == [i + 1 for i in range(len(text)) if i + 1 == len(text) or kinds[i] != kinds[i + 1]]
                assert not text or runs["units"][-1] == len(units(text, unit))
            for text, x, p, q in zip(rows, infill.cut(found, a, b).to_pylist(), a.tolist(), b.tolist(), strict=True):
                own = units(text, unit)
                i, j = sorted((p % (len(own) + 1), q % (len(own) + 1)))
                assert (x["n"], x["prefix_chars"], x["middle_chars"]) == (len(own), len("".join(own[:i])), len("".join(own[i:j])))


def test_stored_runs_serve_other_seeds(docs):
    stored = docs.select("doc_id", infill.class_runs(F.col("text")).alias("runs"))
    again = stored.select("doc_id", infill.cuts(F.col("runs"), infill.drawn(F.col("doc_id"), 9, 1), infill.drawn(F.col("doc_id"), 9, 2)).alias("c")).collect()
    want = {x["doc_id"]: x for x in infill.fill_in_middle(docs, 9).collect()}
    assert all(want[x["doc_id"]]["form"] == "plain" or (x["c"]["prefix_chars"], x["c"]["middle_chars"]) == (want[x["doc_id"]]["prefix_chars"], want[x["doc_id"]]["middle_chars"]) for x in again)


def plain_resample(rows, target, percent, seed, least, most, eligible):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    own, other = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in other for b in f)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= eligible])
    drawn = sorted((x for x in out if x[4]), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    for k, x in enumerate(drawn):
        x.append(k + 1 if k < percent * len(drawn) // 100 else None)
    return [tuple(x[:4]) + (x[5] if len(x) > 5 else None,) for x in out]


@pytest.mark.parametrize(("percent", "least", "most"), [(10, 1, 1), (100, 1, 2), (0, 2, 3)])
def test_resampling(spark, docs, percent, least, most):
    target = [texts()[20], texts()[21], None, "Zé a"]
    want = plain_resample(list(enumerate(texts())), target, percent, 2024, least, most, 20)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, 2024, least, most).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_resampling_of_odd_rows(spark, odd):
    rows, target = [(x["doc_id"], x["text"]) for x in odd.collect()], spark.createDataFrame([("same line",)], "text string")
    got = resampling.resample(odd, target, 50, eligible_words=1).collect()
    want = plain_resample(rows, ["same line"], 50, 2024, 1, 1, 1)
    assert Counter(map(tuple, got)) == Counter(want)  # rows alike have ranks of their own, and all have some
    none = resampling.resample(odd, target.limit(0), 10, eligible_words=1).collect()
    assert len(none) == len(rows) and resampling.resample(odd.limit(0), target).count() == 0
