"""Names that hold one another, against all pairs."""

import random
import re

from pyspark.sql import functions as F

from tidemill.operators.containment import containing


def squeezed(name):
    return re.sub("[^a-z0-9]", "", (name or "").lower())


def test_all_pairs_that_hold_one_another(spark):
    r = random.Random(5)
    name = lambda: "".join(r.choice("abAB c-1") for _ in range(r.randrange(0, 9)))
    left = [(i, name()) for i in range(120)] + [(900, None), (901, "aab aab"), (902, "x"), (903, "aab aab")]
    right = [(i, name()) for i in range(90)] + [(900, None), (901, "AABAAB"), (902, "xyz")]
    rows = containing(spark.createDataFrame(left, "l long, ln string"), spark.createDataFrame(right, "r long, rn string"), "ln", "rn")
    holds = lambda a, b: a != "" and b != "" and (a in b or b in a)
    assert sorted((x["l"], x["r"]) for x in rows.collect()) == sorted((i, j) for i, a in left for j, b in right if holds(squeezed(a), squeezed(b)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and rows.where(F.lit(False)).count() == 0
