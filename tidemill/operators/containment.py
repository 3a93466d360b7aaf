"""Names that hold one another: a join by a gram index, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze_name, text_of

#: Signs of a gram; a shorter name is its own.
GRAM = 3


def _grams(name: Column, size: Column | int) -> Column:
    """A name's distinct parts of so many signs (none of a shorter name)."""
    n = F.lit(size) if isinstance(size, int) else size
    at = F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(name, i, n)))


def _held(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): distinct squeezed names of two tables of which the first is part of the second.

    long's names are listed under all their grams, short's under one: of their own grams the one that fewest
    long names have. A gram that no long name has leaves the name out.
    """
    index = long.select("long", F.explode(F.flatten(F.array(*(_grams(F.col("long"), n) for n in range(1, GRAM + 1))))).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts = short.select("short", F.explode(_grams(F.col("short"), F.least(F.length("short"), F.lit(GRAM)))).alias("gram"))
    known = parts.join(often, "gram", "left")
    key = known.groupBy("short").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return key.join(index, "gram").where(F.contains(F.col("long"), F.col("short"))).select("short", "long")


def containing(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """All pairs of rows of two tables of which one's squeezed name holds the other's; empty names match nothing.

    Equal names are compared once. The result has both tables' columns, which must have names of their own. A
    name that very many others hold gives as many pairs: that is the size of the answer, and Spark splits it.
    """
    one = left.withColumn("__l", squeeze_name(text_of(F.col(left_name)))).where("__l <> ''")
    two = right.withColumn("__r", squeeze_name(text_of(F.col(right_name)))).where("__r <> ''")
    names, others = one.select(F.col("__l").alias("short")).distinct(), two.select(F.col("__r").alias("short")).distinct()
    there = _held(others, names.withColumnRenamed("short", "long")).select(F.col("long").alias("__l"), F.col("short").alias("__r"))
    back = _held(names, others.withColumnRenamed("short", "long")).select(F.col("short").alias("__l"), F.col("long").alias("__r"))
    pairs = there.unionByName(back.where("__l <> __r"))  # equal names are in both
    return one.join(pairs, "__l").join(two, "__r").select(*left.columns, *right.columns)
