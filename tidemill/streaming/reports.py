"""An extension: the report over newly arrived postings, as a stream that takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.dedup import SeenTable
from ..operators.outbox import Outbox
from ..plans.report import run
from ..sources.schema import POSTING


def report_available(spark: SparkSession, folder: str, checkpoint: str, seen_path: str, send: Callable[[str], None]) -> None:
    """Reports the posting files that arrived in folder since the last call.

    A batch is a run of the outbox beside the checkpoint, by its id: one that broke off and comes again sends
    only what was not sent.
    """
    seen, outbox = SeenTable(spark, seen_path), Outbox(spark, f"{checkpoint.rstrip('/')}-outbox")

    def batch(postings: DataFrame, number: int) -> None:
        run(postings, seen, send, outbox=outbox, name=f"batch-{number}")

    stream = spark.readStream.schema(POSTING).parquet(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
