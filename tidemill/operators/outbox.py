"""What a run sends, kept from before it is sent until it is marked, so that a run that breaks off goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import hadoop_path
from .versions import Versions

MESSAGE = "chunk int, text string, job_ids array<string>, oversize boolean"


class Outbox:
    """Runs by name, in versions each: its messages and rows are written first, then that they are done.

    A message is acknowledged as soon as it is sent, by an empty file of its number: one step, whatever was sent
    before. Closing a run writes the number of them into its entry and deletes the files. Only a run that dies
    between sending and acknowledging sends one message again; whatever happens after the acknowledgement, such
    as marking, sends none twice.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, run: str) -> Versions:
        return Versions(self.spark, f"{self.path}/{run}")

    def _acknowledged(self, run: str):
        """The folder of a run's acknowledgements, and its file system."""
        return hadoop_path(self.spark, f"{self.path}/{run}/sent")

    def state(self, run: str) -> dict:
        """messages, rows (folders), sent and done; {} of a run not put yet."""
        entry = self._of(run).entry()
        if entry and not entry["done"]:
            folder, files = self._acknowledged(run)
            names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
            entry["sent"] = max((int(n) + 1 for n in names if n.isdigit()), default=entry["sent"])
        return entry

    def put(self, run: str, messages: DataFrame, rows: DataFrame) -> None:
        """Writes a run's messages and the rows that they are about; if another put them first, that one's count and nothing is worked out."""
        of = self._of(run)
        if of.number():
            return
        folders = of.new_folder(), of.new_folder()
        messages.write.parquet(folders[0])
        rows.write.parquet(folders[1])
        of.change(lambda entry: None if entry else {"messages": folders[0], "rows": folders[1], "sent": 0, "done": False})

    def messages(self, run: str) -> DataFrame:
        return self.spark.read.schema(MESSAGE).parquet(self._of(run).entry()["messages"])

    def rows(self, run: str) -> DataFrame:
        return self.spark.read.parquet(self._of(run).entry()["rows"])

    def sent_ids(self, run: str) -> DataFrame:
        """job_id of what was sent."""
        return self.messages(run).where(F.col("chunk") < self.state(run)["sent"]).select(F.explode("job_ids").alias("job_id"))

    def deliver(self, run: str, send: Callable[[str], None], failures: tuple[type[Exception], ...] = (OSError,)) -> int:
        """Sends what is left of a run in order, up to the first failure; the number sent by now."""
        state = self.state(run)
        n, (folder, files) = state["sent"], self._acknowledged(run)
        acknowledge = self._acknowledging(folder, files)
        for row in self.messages(run).where(F.col("chunk") >= n).select("chunk", "text").orderBy("chunk").toLocalIterator():
            try:
                send(row["text"])
            except failures:
                break
            acknowledge(f"{row['chunk']:010d}")
            n = row["chunk"] + 1
        return n

    def _acknowledging(self, folder, files) -> Callable[[str], None]:
        """What puts an empty file of a name into the folder. On a local file system Hadoop would start a process for its mode and one for its checksum's."""
        jvm = self.spark.sparkContext._jvm
        if files.getScheme() != "file":
            return lambda name: files.create(jvm.org.apache.hadoop.fs.Path(folder, name), True).close()
        local = folder.toUri().getPath()

        def acknowledge(name: str) -> None:
            jvm.java.io.File(local).mkdirs()  # another run may have closed this one
            jvm.java.io.FileOutputStream(f"{local}/{name}").close()

        return acknowledge

    def close(self, run: str) -> None:
        """Nothing of the run is left to do; what was not sent is no later run's debt."""
        sent = self.state(run)["sent"]
        self._of(run).change(lambda entry: None if entry["done"] else entry | {"sent": max(sent, entry["sent"]), "done": True})
        folder, files = self._acknowledged(run)
        files.delete(folder, True)
