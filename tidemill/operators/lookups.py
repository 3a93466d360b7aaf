"""Dimension lookups and detail filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Inner lookup; unknown keys fall out. Which side is sent is the optimizer's choice, by size."""
    return rows.join(dimension, on)


def missing(rows: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the dimension lacks, for warnings."""
    return rows.join(dimension.select(*on), on, "left_anti")


def filled(rows: DataFrame, details: DataFrame, on: list[str], column: str, asked: Column, overwrite: bool = False) -> DataFrame:
    """rows with column taken from details where asked holds; all rows stay.

    overwrite: an empty detail counts as well; otherwise only one with text does.
    """
    wanted = rows.withColumn("__asked", asked)
    other = details.select(*(F.col(k).alias(f"__{k}") for k in on), F.col(column).alias("__detail"), F.lit(True).alias("__found"))
    same = F.col("__asked")
    for k in on:
        same = same & (wanted[k] == other[f"__{k}"])
    detail = F.coalesce("__detail", F.lit(""))
    use = F.coalesce("__found", F.lit(False)) if overwrite else F.length(detail) > 0
    return wanted.join(other, same, "left").withColumn(column, F.when(use, detail).otherwise(F.coalesce(F.col(column), F.lit("")))).select(*rows.columns)


def without_foreign(rows: DataFrame, confirmed: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(confirmed.select(*on), on, "left_anti")
