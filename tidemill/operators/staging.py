"""Tables written to the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where all of Spark is one process may the session name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, of any store that Spark reads."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    of, files = hadoop_path(spark, path)
    files.deleteOnExit(of)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a scratch path and reads it back, so its size is known to the optimizer."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
