"""From captured payloads to a sent report: resolution, scans, the report plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report as messages
from ..operators import resolve
from ..operators.dedup import SeenTable
from ..operators.outbox import Outbox
from ..operators.staging import staged
from ..operators.versions import Versions
from ..sources import boards, vendors
from ..sources.schema import COMPANY
from . import report


class CompaniesTable:
    """The companies with what is resolved of them, in versions; ord is a company's key, names may repeat.

    A version is a whole table and the deltas since: what runs resolved, by key. They are merged when the table
    is read, so a run writes what it found out and not the table. After MOST_DELTAS the next one is written whole.
    """

    MOST_DELTAS = 16
    _DELTA = "ord long, ats string, identifier string, identifier_workday struct<tenant:string,wd_host:string,site:string>, careers_url string, match_method string, resolved_at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    def version(self) -> int:
        return self.versions.number()

    def _read(self, entry: dict) -> DataFrame:
        if not entry:
            return self.spark.createDataFrame([], COMPANY)
        whole = self.spark.read.schema(COMPANY).parquet(entry["whole"])
        if not entry["deltas"]:
            return whole
        deltas = [self.spark.read.schema(self._DELTA).parquet(d).withColumn("__nth", F.lit(i)) for i, d in enumerate(entry["deltas"])]
        every = reduce(DataFrame.unionByName, deltas)
        fields = [c for c in every.columns if c not in ("ord", "__nth")]
        last = every.groupBy("ord").agg(F.max_by(F.struct(*fields), "__nth").alias("last")).select("ord", "last.*")
        return resolve.updated(whole, last)

    def read(self) -> DataFrame:
        return self._read(self.versions.entry())

    def write(self, companies: DataFrame) -> None:
        """Makes companies the table; an error if a key is missing or repeats."""
        folder = self.versions.new_folder()
        companies.write.parquet(folder)
        held = self.spark.read.schema(COMPANY).parquet(folder)
        if not held.where("ord is null").isEmpty() or not held.groupBy("ord").count().where("count > 1").isEmpty():
            raise ValueError("ord is a company's key: it is there and unique")
        self.versions.change(lambda entry: {"whole": folder, "deltas": []})

    def resolve(self, pages: DataFrame, answers: DataFrame, force: str = "new") -> DataFrame:
        """Resolves the companies that force says from captures and writes back what changed; those that were resolved.

        With none to resolve, or none of which anything else is known now, nothing is written.
        """
        keys: list[DataFrame] = []

        def work(entry: dict) -> dict | None:
            now = self._read(entry)
            todo = resolve.pending(now, force)
            keys[:] = [todo.select("ord")]
            if todo.isEmpty():
                return None
            delta = staged(resolve.changed(todo, resolve.resolve(todo, pages, answers)), "resolved")
            if delta.isEmpty():
                return None
            folder = self.versions.new_folder()
            if len(entry["deltas"]) < self.MOST_DELTAS:
                delta.write.parquet(folder)
                return entry | {"deltas": [*entry["deltas"], folder]}
            resolve.updated(now, delta).write.parquet(folder)
            return {"whole": folder, "deltas": []}

        self.versions.change(work)
        return self.read().join(keys[0], "ord", "left_semi").select(*self.spark.createDataFrame([], COMPANY).columns)


@dataclass(frozen=True)
class Reported:
    """Postings, what could not be read, and what was counted while responses were read."""

    postings: DataFrame
    failures: DataFrame
    counts: dict[str, int]


def scan_reported(payloads: DataFrame, sources: DataFrame, active: DataFrame, companies: DataFrame, terms: list[str] | None = None) -> Reported:
    """All postings, those of boards before those of companies, with the failures of both."""
    found = boards.scan_reported(payloads, sources, active, terms)
    postings, failures = vendors.scan_reported(payloads, companies, terms)
    return Reported(found.postings.unionByName(postings), found.failures.unionByName(failures), found.counts)


def scan(payloads: DataFrame, sources: DataFrame, active: DataFrame, companies: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """All postings, those of boards before those of companies; one ord for both."""
    return boards.scan_boards(payloads, sources, active, terms).unionByName(vendors.scan_companies(payloads, companies, terms))


def run(payloads: DataFrame, sources: DataFrame, active: DataFrame, companies: DataFrame, seen: SeenTable, send: Callable[[str], None], day: Column | None = None, terms: list[str] | None = None, dry_run: bool = False, outbox: Outbox | None = None, name: str | None = None) -> list[str]:
    """Scans, reports what is new, and marks what was sent; the job_ids of that."""
    return report.run(scan(payloads, sources, active, companies, terms), seen, send, day, terms, dry_run, outbox, name)


def run_daily(payloads: DataFrame, sources: DataFrame, active: DataFrame, table: CompaniesTable, pages: DataFrame, answers: DataFrame, seen: SeenTable, send: Callable[[str], None], day: Column | None = None, terms: list[str] | None = None, dry_run: bool = False, outbox: Outbox | None = None, name: str | None = None) -> list[str]:
    """A whole day's run: new companies are resolved first, so their vendors' payloads count already, then run()."""
    table.resolve(pages, answers, "new")
    return run(payloads, sources, active, table.read(), seen, send, day, terms, dry_run, outbox, name)


def main(argv: list[str] | None = None) -> None:
    """Resolves companies: python -m tidemill.plans.scan COMPANIES PAGES ANSWERS REPORT [--force]"""
    import argparse

    parser = argparse.ArgumentParser(description=main.__doc__)
    for name, what in (("companies", "folder of the companies' versions"), ("pages", "captured pages, Parquet"), ("answers", "captured answers to guessed slugs, Parquet"), ("report", "folder for the report's text")):
        parser.add_argument(name, help=what)
    parser.add_argument("--force", action="store_true", help="every company, not only those unresolved or custom")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    table = CompaniesTable(spark, args.companies)
    done = table.resolve(spark.read.parquet(args.pages), spark.read.parquet(args.answers), "all" if args.force else "needs")
    lines = messages.resolution_lines(table.read())
    lines.orderBy("place").select("text").coalesce(1).write.mode("overwrite").text(args.report)
    print(f"{done.count()} companies resolved")


if __name__ == "__main__":
    main()
