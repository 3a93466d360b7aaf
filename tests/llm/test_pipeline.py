"""The pipeline's result against plain versions of its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tidemill.llm import quality_rules
from tidemill.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(150)
    texts = [base, base, base.replace(" ", "  ", 3), base + " tail", None, "", "short", "LOUD " * 80, *(prose(r.randrange(60, 120)) for _ in range(10)), prose(70) + " token = abcdef123 " + prose(10)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    ledger = quality_rules.judged(quality_rules.ledger(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    kept = sorted(x["doc_id"] for x in ledger.where("kept").collect())
    assert not {4, 5, 6, 7} & set(kept) and len(kept) == len(texts) - 4
    heads = [i for i in kept if not any(j < i and 100 * len(shingles(texts[i]) & shingles(texts[j])) >= 75 * len(shingles(texts[i]) | shingles(texts[j])) for j in kept)]
    assert heads == [0, *range(8, len(texts))]
    clean = {i: re.sub(r"token = \w+", "[SECRET]", texts[i]) for i in heads}
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in clean.items()}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    taken = Counter()
    for p in out:
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        taken[p["doc_id"]] += p["length"]
    copies = {i: taken[i] / len(ids[i]) for i in heads}
    assert all(c == int(c) and c <= 3 for c in copies.values())
    size = {i: len(WORD.findall(clean[i])) for i in heads}
    sources = {s: [i for i in heads if i % 2 == s] for s in (0, 1)}
    total = sum(size.values())
    for s, weight in ((0, 1), (1, 2)):
        each = min(total * weight / 3, 3 * sum(size[i] for i in sources[s])) / sum(size[i] for i in sources[s])
        assert abs(sum(copies[i] for i in sources[s]) - each * len(sources[s])) <= 1
