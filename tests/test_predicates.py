import pytest
from pyspark.sql import functions as F

from tidemill.operators import predicates as p


def verdicts(spark, expr, rows, columns):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in columns))
    return [r[1] for r in frame.select("i", expr).orderBy("i").collect()]


def test_titles(spark):
    cases = {"Senior qa engineer (m/w/d)": True, "SDET": True, "Baker": False, "Verkauf in Emsdetten": False, "Softwaretesterin": False, "Softwaretester:in": True, None: False, "Äußerer TEST ENGINEER": True, "äTest Engineer": False}
    assert verdicts(spark, p.title_matches(F.col("t")), [(c,) for c in cases], ["t"]) == list(cases.values())
    assert verdicts(spark, p.title_matches(F.col("t"), []), [("QA Engineer",)], ["t"]) == [False]


def test_city(spark):
    cases = [("MÜNCHEN", "", True), ("Ulm", "Sitz bei München", False), ("Germany", "office in Munich", True), ("  ", "muenchen", True), ("Berlin", "", False), (None, "Munich", True)]
    assert verdicts(spark, p.in_scope_city(F.col("l"), F.col("d")), [c[:2] for c in cases], ["l", "d"]) == [c[2] for c in cases]


def test_remote(spark):
    cases = [
        ("", "Remote-Erstgespräch, 2 Tage Homeoffice", False), ("", "hybrid, not full remote", False), ("", "Remote-first, hybrid in the office", False), ("Fully Remote", "", True),
        ("", "Arbeite vollständig remote", True), ("", "not full remote. Later 100% remote", True), ("", "nicht hier; fully remote", True), ("", "KEINE 100 % REMOTE Stelle", False),
        ("", "not full remote; " + "x" * 40 + " full remote", True), ("", "", False), (None, None, False),
    ]
    assert verdicts(spark, p.in_scope_remote(F.col("l"), F.col("d")), [c[:2] for c in cases], ["l", "d"]) == [c[2] for c in cases]


def test_countries(spark):
    cases = {"Berlin": (True, True), "Deutschland": (True, True), "Barcelona": (False, False), "Remote - Spain": (False, False), "Remote": (True, False), "": (True, False), "Hessen": (True, True), "Paris or Bonn": (True, True), "u.s.": (True, False)}
    assert verdicts(spark, F.struct(p.maybe_in_germany(F.col("l")), p.surely_in_germany(F.col("l"))), [(c,) for c in cases], ["l"]) == list(cases.values())


@pytest.mark.parametrize(("missing", "expected"), [("keep", [True, False, True, True]), ("drop", [True, False, False, False]), ("guard", [True, False, True, False])])
def test_country_policy(spark, missing, expected):
    rows = [(" de ", ""), ("at", "Berlin"), ("", "Berlin"), (None, "Vienna")]
    assert verdicts(spark, p.CountryPolicy("DE", "upper", missing).keeps(F.col("c"), F.col("l")), rows, ["c", "l"]) == expected


def test_language(spark):
    german = "Wir suchen dich und bieten dir mit der und die das für uns auch eine und einen von der auf dem im am zu den bei und"
    cases = {
        "Deutschkenntnisse mind. auf C1-Niveau": True, "Gute Deutschkenntnisse von Vorteil": False, "Gute Deutschkenntnisse. Englisch von Vorteil": True,
        "gute Deutschkenntnisse, Englischkenntnisse von Vorteil": True, "Fluent English skills and German as a plus.": False, "FLIESSENDE fließende Deutschkenntnisse": True,
        german: True, "": False, None: False, "the and with for is are you": False, "<b>" + german.replace(" ", "</b> <b>") + "</b>": True,
        "German B2 optional; gute Deutschkenntnisse": True,
    }
    assert verdicts(spark, p.german_required(F.col("d")), [(c,) for c in cases], ["d"]) == list(cases.values())


def test_windows_match_plain_python(spark):
    import random
    import re

    from tidemill.functions.text import windows_after, windows_before

    r = random.Random(5)
    texts = ["".join(r.choice(["ab", "x", ".", "<", " ", "Ü", ";"]) for _ in range(r.randrange(40))) for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = frame.select("i", windows_before(F.col("t"), "ab", 7), windows_after(F.col("t"), "ab", 7)).orderBy("i").collect()
    for (_, before, after), t in zip(got, texts, strict=True):
        found = list(re.finditer("ab", t))
        assert before == [re.search("[^.;<]*$", t[max(0, m.start() - 7) : m.start()])[0] for m in found]
        assert after == [re.match("[^.;<]*", t[m.end() : m.end() + 7])[0] for m in found]
