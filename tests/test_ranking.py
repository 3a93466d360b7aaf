"""Numbers without a window over all rows."""

import random

from pyspark.sql import functions as F

from tidemill.operators import ranking


def test_numbers_of_sections(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(40), i) for i in range(600)]
    out = ranking.numbered(spark.createDataFrame(rows, "s string, v int, id long").repartition(5), [F.desc("v"), F.col("id")], ["s"], "n", "all").collect()
    for s in ("a", "b", None):
        own = sorted((x for x in out if x["s"] == s), key=lambda x: x["n"])
        assert [(x["v"], x["id"]) for x in own] == sorted(((v, i) for k, v, i in rows if k == s), key=lambda x: (-x[0], x[1]))
        assert [x["n"] for x in own] == list(range(1, len(own) + 1)) and {x["all"] for x in own} == {len(own)}


def test_numbers_of_all_rows_ties_and_none(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("v"), "id")
    out = ranking.numbered(rows, [F.col("v")], first=0)
    assert sorted(x["n"] for x in out.collect()) == list(range(500)) and out.columns == ["v", "id", "n"]
    assert [x["v"] for x in sorted(out.collect(), key=lambda x: x["n"])] == sorted(i % 3 for i in range(500))
    assert ranking.numbered(rows.limit(0), [F.col("v")], ["v"], size="k").count() == 0
