"""De-duplication, set difference and the seen table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_of
from .staging import staged
from .versions import Versions

SEEN_SCHEMA = "job_id string, title string, company string, first_seen_at timestamp"


def job_id(source_id: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws(":", text_of(source_id), text_of(url)), 256)


def last_value_first_position(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row per key: the values of its last row by position, at the position of its first."""
    others = [c for c in rows.columns if c not in (*key, position)]
    merged = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(position)).alias("__row"), F.min(position).alias(position))
    return merged.select(*key, *(F.col("__row")[c].alias(c) for c in others), position).select(*rows.columns)


def first_wins(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """One row per key: its first by position. An aggregation, so copies meet before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(position)).alias("__row"))
    return first.select(*key, *(F.col("__row")[c].alias(c) for c in others)).select(*rows.columns)


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose job_id is not in seen; repeated ones stay. The optimizer picks broadcast or shuffle by size."""
    return rows.join(seen.select("job_id"), "job_id", "left_anti")


class SeenTable:
    """The persistent set of reported postings, in versions (operators/versions.py).

    Its rows are partitioned by the first digits of their job_id, so a question reads only the partitions it asks
    for. Beside each folder of rows lie bitmaps of their ids, by partition: an id that is in none of them is new
    without a look at the table. A run that marks while another does sees the other's rows before its own count.
    """

    #: Bitmaps of 32,768 bits a partition: an id has one bit of so many; when they fill, more ids are looked up.
    PIECES = 8
    #: Folders of rows, before the younger ones are merged.
    MOST_FOLDERS = 24

    def __init__(self, spark: SparkSession, path: str, digits: int = 1) -> None:
        self.spark, self.versions, self.digits = spark, Versions(spark, path), digits

    def create(self) -> None:
        """Creates the table if there is none."""
        self.versions.change(lambda entry: None if entry else {"digits": self.digits, "rows": [], "bits": [], "counts": []})

    def _rows(self, entry: dict, folders: list[str] | None = None) -> DataFrame:
        """The rows of some folders (all) with their prefix."""
        folders = entry.get("rows", []) if folders is None else folders
        schema = f"{SEEN_SCHEMA}, prefix string"
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f) for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows(self.versions.entry()).drop("prefix")

    def _digits(self, entry: dict) -> int:
        return entry.get("digits", self.digits)

    def _placed(self, rows: DataFrame, digits: int) -> DataFrame:
        """rows with the place of their id: prefix, piece of the partition's bitmap, bit in that."""
        at = F.pmod(F.xxhash64("job_id"), F.lit(self.PIECES << 15))
        return rows.withColumns({"prefix": F.left("job_id", F.lit(digits)), "piece": F.shiftright(at, 15).cast("int"), "bit": at.bitwiseAND((1 << 15) - 1).cast("int")})

    def _maybe(self, rows: DataFrame, entry: dict) -> DataFrame:
        """The distinct ids of rows, with their prefix, that may be in the table."""
        ids = self._placed(rows.select("job_id").where("job_id is not null").distinct(), self._digits(entry))
        bits = self.spark.read.schema("prefix string, piece int, bits binary").parquet(*entry["bits"]).groupBy("prefix", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
        byte = F.conv(F.hex(F.expr("substring(bits, shiftright(bit, 3) + 1, 1)")), 16, 10).cast("int")
        return ids.join(bits, ["prefix", "piece"]).where(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) != 0).select("job_id", "prefix")

    def _unseen(self, rows: DataFrame, entry: dict) -> DataFrame:
        if not entry.get("rows"):
            return rows
        maybe = staged(self._maybe(rows, entry), "maybe")
        prefixes = [r["prefix"] for r in maybe.select("prefix").distinct().collect()]  # 16 to the power of digits at most
        if not prefixes:
            return rows
        there = self._rows(entry).where(F.col("prefix").isin(prefixes)).join(maybe.select("job_id"), "job_id", "left_semi")
        return unseen(rows, there)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose job_id is not in the table; repeated ones stay, and so do null ones. rows is read twice."""
        return self._unseen(rows, self.versions.entry())

    def _written(self, rows: DataFrame, digits: int) -> tuple[str, str]:
        """Folders of rows, a file a partition, and of their bitmaps."""
        folder, beside = self.versions.new_folder(), self.versions.new_folder()
        rows.withColumn("prefix", F.left("job_id", F.lit(digits))).repartition("prefix").write.partitionBy("prefix").parquet(folder)
        placed = self._placed(self.spark.read.schema(SEEN_SCHEMA).parquet(folder), digits)
        placed.groupBy("prefix", "piece").agg(F.bitmap_construct_agg("bit").alias("bits")).coalesce(1).write.parquet(beside)
        return folder, beside

    def _merged(self, entry: dict) -> dict:
        """entry with its younger folders in one, so that each is larger than all after it together."""
        counts = entry["counts"]
        if len(counts) <= self.MOST_FOLDERS:
            return entry
        at = next(i for i in range(len(counts)) if counts[i] <= sum(counts[i + 1 :]) or i == len(counts) - 2)
        folder, beside = self._written(self._rows(entry, entry["rows"][at:]).drop("prefix"), self._digits(entry))
        return entry | {"rows": [*entry["rows"][:at], folder], "bits": [*entry["bits"][:at], beside], "counts": [*counts[:at], sum(counts[at:])]}

    def mark(self, rows: DataFrame, at: Column | None = None) -> None:
        """Adds what is not there yet; what is there keeps its first time. No rows touch nothing; a null job_id is none."""
        at = (F.current_timestamp() if at is None else at).cast("timestamp")
        mine = staged(rows.where("job_id is not null").select("job_id", text_of(F.col("title")).alias("title"), text_of(F.col("company")).alias("company"), at.alias("first_seen_at")), "marks")

        def work(entry: dict) -> dict | None:
            new = staged(self._unseen(mine, entry).dropDuplicates(["job_id"]), "new")
            n = new.count()
            if not n:
                return None
            folder, beside = self._written(new, self._digits(entry))
            old = entry or {"digits": self.digits, "rows": [], "bits": [], "counts": []}
            return self._merged(old | {"rows": [*old["rows"], folder], "bits": [*old["bits"], beside], "counts": [*old["counts"], n]})

        if not mine.isEmpty():
            self.versions.change(work)
