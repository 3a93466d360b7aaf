"""Long words and lines, null and repeated ids, clashing columns, empty tables: every operator and every stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import classifier, fingerprints, infill, jaccard_join, licenses, line_dedup, mixing, packing, quality_rules, resampling, secrets, substring_dedup, token_files
from tidemill.llm.queries import tokenizer_path

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, __id string, __own string, carry string, __key int, __maybe boolean, place int, bits string, gone int, __times int"
OPERATORS = {
    "op1": fingerprints.compare_edits, "op2": lambda d: classifier.score_documents(d, d.sparkSession.createDataFrame([(2, 1), (5, 0), (6, 1)], "doc_id long, quality int")), "op3": lambda d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json")), "op4": mixing.mix_documents, "op5": lambda d: quality_rules.judged(quality_rules.ledger(d)),
    "op6": jaccard_join.link_documents, "op7": licenses.find_licenses, "op8": secrets.find_secrets, "op9": lambda d: token_files.token_files(d, tokenizer_path("byte_bpe_50k.json")), "op10": substring_dedup.dedup_substrings,
    "op11": lambda d: resampling.resample(d, d), "op12": infill.fill_in_middle, "op13": line_dedup.dedup_lines,
}


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(6)
    text = prose(r, 90)
    rows = [(1, text), (1, text), (1, prose(r, 80)), (None, text), (None, prose(r, 70)), (None, None), (2, None), (3, ""), (4, text + " more"), (5, prose(r, 60) + " password = hunter2secret")]
    return spark.createDataFrame([(i, t, "en", None if i == 4 else "s", len(t or ""), "x", "y", "z", 1, True, 2, "b", 3, 4) for i, t in rows], CLASHING)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_very_long_words_and_lines(spark, name):
    r = random.Random(5)
    texts = ["w" * 400_000, "é" * 100_000, prose(r, 40_000), "\n" * 50_000 + "x", "a b " * 60_000, "=" * 100_000, "x\n" * 50_000]
    rows = OPERATORS[name](spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))).collect()
    assert {x["doc_id"] for x in rows} == set(range(len(texts)))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_with_odd_rows(spark, docs, name, stage):
    out = stage(spark, docs, "")
    rows = out.collect()
    if name == "quality rules":
        assert sorted(map(str, (x["doc_id"] for x in rows))) == ["1", "1", "1", "4", "5", "None", "None"]
    elif name == "n-gram Jaccard join":  # one of the five alike, the others, and each of the different empty ones
        assert len(rows) == 7 and sum(x["text"] is not None and x["text"][:30] == docs.first()["text"][:30] for x in rows) == 1
    elif name == "secret scans":
        assert len(rows) == 10 and sum("[SECRET]" in (x["text"] or "") for x in rows) == 1 and sum(x["text"] is None for x in rows) == 2
    elif name == "mixing":
        assert {x["text"] for x in rows} <= {x["text"] for x in docs.collect()}
    else:
        assert sum(x["length"] for x in rows) == sum(x["doc_tokens"] for x in rows if x["start"] == 0)
    if stage is not corpus_pipeline.packs:
        assert out.columns == docs.columns and all(x["__id"] == "x" and x["carry"] == "z" and x["gone"] == 3 for x in rows)
    none = stage(spark, docs.limit(0), "")
    assert none.count() == 0 and none.columns == out.columns


def test_pipeline_of_an_empty_table(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
