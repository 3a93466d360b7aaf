"""Numbered versions of a table in a folder: which data folders it is made of, committed one after another.

Data is written under names of its own first. A version is a small JSON entry that must not be there yet when
it is put in its place; a run that comes second sees that, looks at the new state and tries again. Readers see
whole versions only, and data that no version names is nobody's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from .staging import hadoop_path

#: Times a change is worked out again because another run was faster.
TRIES = 20


class Versions:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _of(self, name: str):
        return hadoop_path(self.spark, f"{self.path}/{name}")

    def number(self) -> int:
        """The newest version; 0 of none."""
        log, files = self._of("_log")
        names = [s.getPath().getName() for s in files.listStatus(log)] if files.exists(log) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def entry(self, number: int | None = None) -> dict:
        """What a version (the newest) says; {} of none."""
        number = self.number() if number is None else number
        if not number:
            return {}
        path, files = self._of(f"_log/{number:010d}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def new_folder(self) -> str:
        """A folder for data of the version to come."""
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def commit(self, number: int, entry: dict) -> bool:
        """Puts an entry in its place; whether it is there now, and not another run's."""
        aside, files = self._of(f"_log/.{uuid.uuid4().hex}")
        stream = files.create(aside, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        to, _ = self._of(f"_log/{number:010d}.json")
        try:
            return self._placed(files, aside, to)
        finally:
            files.delete(aside, False)

    def _placed(self, files, aside, to) -> bool:
        from py4j.protocol import Py4JJavaError

        jvm = self.spark.sparkContext._jvm
        try:
            if files.getScheme() == "file":  # a link to a file is refused where the name is taken
                local = lambda path: jvm.java.io.File(path.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(files.makeQualified(to)), local(files.makeQualified(aside)))
            else:
                rename = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, to, rename)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True

    def change(self, work: Callable[[dict], dict | None]) -> int:
        """Commits what work makes of the newest entry (None: nothing); the version then. work is done again if another run comes first."""
        for _ in range(TRIES):
            number = self.number()
            entry = work(self.entry(number))
            if entry is None or self.commit(number + 1, entry):
                return number + (entry is not None)
        raise OSError(f"{self.path}: other runs were faster {TRIES} times")
