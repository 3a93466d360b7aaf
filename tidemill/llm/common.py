"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every contract of this subpackage.
WS = r"[\x20\x09-\x0D]+"
#: Places of a block in running().
BLOCK = 64

_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where all of Spark is one process may the session name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what staged() wrote inside it, but for tables staged for outside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def scratch_path(spark: SparkSession, name: str, outside: bool = False) -> str:
    """A new path in the shared folder, removed when its scope or else the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    if len(_SCOPES) > outside:
        _SCOPES[-1 - outside].append(path)
    return path


def staged(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors.

    outside: the table outlives the innermost scope.
    """
    path = scratch_path(df.sparkSession, name, outside)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files behind a staged() frame that no later plan reads."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def words_of(text):
    """The words of a text column, no empty ones; null counts as no text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op, zero: Column | None = None) -> Column:
    """For each place of an array of ints, op over all values before it; op is associative, zero (0) its neutral value.

    An accumulator that grows by each value would be copied for each. Here that happens within blocks,
    and then once for each block, so long arrays cost little more than short ones.
    """
    zero = F.lit(0) if zero is None else zero
    ints, blocks = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def scanned(v: Column) -> Column:
        cut = F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda i: F.slice(v, i, BLOCK))).otherwise(blocks)
        each = F.transform(cut, lambda b: F.aggregate(b, F.struct(zero.alias("at"), ints.alias("out")), lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))))
        start = F.struct(zero.alias("at"), blocks.alias("out"))
        join = lambda a, b: F.struct(op(a["at"], b["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(b["out"], lambda x: op(a["at"], x)))).alias("out"))
        return F.flatten(F.aggregate(each, start, join, lambda a: a["out"]))

    return let(values, scanned)
