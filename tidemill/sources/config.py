"""Configuration tables: sources, companies and terms out of YAML files in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import COMPANY, SOURCE


def load_yaml(spark: SparkSession, path: str) -> dict:
    """A YAML file as a dictionary; the driver reads it, as it is a configuration."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def _rows(spark: SparkSession, found: list[dict], schema: str) -> DataFrame:
    names, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(schema[start:i].split()[0])
            start = i + 1
    return spark.createDataFrame([tuple(i if n == "ord" else row.get(n) for n in names) for i, row in enumerate(found)], schema)


def sources(spark: SparkSession, path: str) -> DataFrame:
    """id, adapter and where to ask; ord is the place in the file."""
    return _rows(spark, load_yaml(spark, path).get("sources") or [], SOURCE)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """name, url and what is resolved of them; a three-part identifier goes to identifier_workday."""
    from datetime import datetime

    found = []
    for row in load_yaml(spark, path).get("companies") or []:
        row, parts, at = dict(row), row.get("identifier"), row.get("resolved_at")
        if isinstance(parts, dict):
            row |= {"identifier": None, "identifier_workday": (parts.get("tenant"), parts.get("wd_host"), parts.get("site"))}
        row["resolved_at"] = datetime.fromisoformat(at) if isinstance(at, str) else at
        found.append(row)
    return _rows(spark, found, COMPANY)


def terms(spark: SparkSession, path: str) -> list[str]:
    return [str(t) for t in load_yaml(spark, path).get("title_match_terms") or []]
