"""Buckets in partitions of their own, and filters."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import buckets, filters


def test_spark_deals_each_bucket_to_its_partition(spark):
    keys = spark.range(2000).select(F.col("id").cast("int").alias("x")).select("x", F.hash("x").alias("h")).collect()
    assert buckets.spark_hash(np.array([r["x"] for r in keys])).tolist() == [r["h"] for r in keys]
    for n in (1, 8, 67):
        rows = spark.range(n * 3).select((F.col("id") % n).cast("int").alias("bucket"))
        parts = buckets.dealt(rows, F.col("bucket"), n).select("bucket", F.spark_partition_id().alias("p")).distinct().collect()
        assert sorted(r["p"] for r in parts) == list(range(n)) and all(r["bucket"] == r["p"] for r in parts)


def test_filters_lose_nothing(spark):
    r = random.Random(4)
    keys = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, 1 << 62]
    others = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    held = filters.filter_of(spark.createDataFrame([(k,) for k in keys], "k long"))
    rows = spark.createDataFrame([(k, i < len(keys)) for i, k in enumerate(keys + others)], "k long, own boolean")
    out = held.marked(rows, F.col("k"), "maybe").groupBy("own").agg(F.count_if("maybe").alias("n"), F.count("*").alias("all")).collect()
    found = {x["own"]: (x["n"], x["all"]) for x in out}
    assert found[True] == (len(keys), len(keys)) and found[False][0] < 0.15 * len(others)
    packed = held.packed()
    assert filters.inside(packed, np.array(keys)).all() and filters.inside(packed, np.array(others)).sum() == found[False][0]
    none = filters.filter_of(spark.createDataFrame([], "k long"))
    assert none.marked(rows, F.col("k"), "maybe").where("maybe").isEmpty() and not none.packed().any()
    assert filters.size_for(1 << 40) == filters.MOST_BITS
