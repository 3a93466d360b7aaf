"""Sections, numbering, message packing and delivery of a report; the resolution summary."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import EMPTY_REPORT, MESSAGE_LIMIT
from . import ranking

GAP = "\n\n"


def numbered(rows: DataFrame, section: str, order: str) -> DataFrame:
    """n (from 1) and section_size of each row in its section, by ranks over sorted ranges: no section meets in a task."""
    return ranking.numbered(rows, [F.col(order)], [section], "n", "section_size")


def entry_text() -> Column:
    return F.format_string("%d. %s — %s (%s)\n   %s", "n", "title", "company", "location", "url")


def blocks(report: DataFrame, day: Column) -> DataFrame:
    """(place, text, job_id) of a report's blocks: the date, then each non-empty section's header and entries.

    report: title, company, location, url, job_id, german (boolean), ord. English comes first. An empty
    report has one block.
    """
    rows = numbered(report, "german", "ord")
    entries = rows.select(F.struct(F.col("german").cast("int").alias("s"), F.col("n")).alias("place"), entry_text().alias("text"), "job_id")
    title = F.when(F.col("german"), F.lit("🇩🇪 German-speaking (%d)")).otherwise(F.lit("🇬🇧 English-speaking (%d)"))
    heads = rows.groupBy("german").agg(F.max("section_size").alias("k"))
    heads = heads.select(F.struct(F.col("german").cast("int").alias("s"), F.lit(0).alias("n")).alias("place"), F.replace(title, F.lit("%d"), F.col("k").cast("string")).alias("text"), F.lit(None).cast("string").alias("job_id"))
    top = report.agg(F.count(F.lit(1)).alias("k")).select(
        F.struct(F.lit(-1).alias("s"), F.lit(0).alias("n")).alias("place"),
        F.when(F.col("k") == 0, F.lit(EMPTY_REPORT)).otherwise(F.concat(F.lit("📅 "), F.date_format(day, "dd.MM.yyyy"), F.lit(" — New QA jobs"))).alias("text"),
        F.lit(None).cast("string").alias("job_id"),
    )
    return top.unionByName(heads).unionByName(entries)


def _next(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For blocks in a row: their lengths up to each one's end, and where the chunk after one that begins there begins."""
    ends = np.cumsum(sizes)
    return ends, np.maximum(np.searchsorted(ends, ends - sizes + limit, "right"), np.arange(len(sizes)) + 1)


def _passage(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a range of blocks does to a chunk that is open before it.

    Of each block that may be the first to open a chunk: the lengths up to its end, the chunks that are opened
    from there on, and the length in the last of them (limit + 1 where nothing fits any more). Pointers to next
    chunks are doubled until all lead out of the range.
    """
    ends, to = _next(sizes, limit)
    n = len(sizes)
    to, opened = np.append(to, n), np.append(np.ones(n, np.int64), 0)
    last = np.append(np.arange(n), n)  # the last chunk's first block
    while (to[:n] < n).any():
        opened, last = opened + opened[to], np.where(to < n, last[to], last)
        to = to[to]
    first = int(np.searchsorted(ends, limit, "right")) + 1
    left = np.minimum(ends[-1] - (ends - sizes)[last[:n]], limit + 1)
    return ends[:first], opened[:n][:first], left[:first]


def packed(rows: DataFrame, length: str, order: list[str], limit: int = MESSAGE_LIMIT, gap: int = len(GAP)) -> DataFrame:
    """rows with i (from 0) and the chunk of each: one opens a chunk if it would pass the limit and the open one isn't empty.

    Rows are sorted over ranges. Where a range's first chunk opens depends on the ranges before it, so each
    range first tells what it makes of any chunk that it finds open (at most limit / gap cases); the driver
    walks through these, a step per range, and then the ranges number their chunks, all at once. Only lengths
    are gathered, and only those of one range in a task.
    """
    held = ranking.in_ranges(rows, [F.col(c) for c in order], "blocks")
    lengths = held.select("__part", "__at", (F.col(length) + gap).cast("long").alias("__size"))

    def sizes_of(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by("__at")
        return table, table.column("__size").to_numpy()

    def passage(table: pa.Table) -> pa.Table:
        table, sizes = sizes_of(table)
        found = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in _passage(sizes, limit)]
        return pa.table([table.column("__part").combine_chunks().slice(0, 1), pa.array([len(sizes)]), pa.array([int(sizes.sum())]), *found], names=["part", "n", "total", "ends", "opened", "left"])

    steps = lengths.groupBy("__part").applyInArrow(passage, "part long, n long, total long, ends array<long>, opened array<long>, left array<long>")
    used, chunk, i, begins = limit + 1, -1, 0, []
    for step in sorted(steps.collect(), key=lambda s: s["part"]):  # a row per range
        begins.append((step["part"], used, chunk, i))
        at = bisect_right(step["ends"], limit - used)
        used, chunk = (used + step["total"], chunk) if at == len(step["ends"]) else (step["left"][at], chunk + step["opened"][at])
        i += step["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(begins, "__p long, __used long, __chunk long, __first long"))

    def number(table: pa.Table) -> pa.Table:
        table, sizes = sizes_of(table)
        ends, to = _next(sizes, limit)
        opens, at = np.zeros(len(sizes), np.int64), int(np.searchsorted(ends, limit - table.column("__used")[0].as_py(), "right"))
        while at < len(sizes):
            opens[at] = 1
            at = int(to[at])
        chunks_ = np.cumsum(opens) + table.column("__chunk")[0].as_py()
        return pa.table([table.column("__part"), table.column("__at"), pa.array(chunks_.astype(np.int32))], names=["p", "a", "chunk"])

    placed = lengths.join(starts, F.col("__part") == F.col("__p")).groupBy("__part").applyInArrow(number, "p long, a long, chunk int")
    both = held.join(starts.select("__p", "__first"), F.col("__part") == F.col("__p")).join(placed, (F.col("__part") == F.col("p")) & (F.col("__at") == F.col("a")))
    return both.select(*rows.columns, (F.col("__first") + F.col("__at")).alias("i"), "chunk")


def chunks(parts: DataFrame, limit: int = MESSAGE_LIMIT) -> DataFrame:
    """(chunk, text, job_ids, oversize) of a report's blocks."""
    rows = packed(parts.withColumn("length", F.length("text").cast("long")), "length", ["place"], limit)
    held = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("i", "text", "job_id"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["text"]), GAP)
    ids = F.filter(F.transform("b", lambda x: x["job_id"]), lambda x: x.isNotNull())
    return held.select("chunk", text.alias("text"), ids.alias("job_ids"), (F.length(text) > limit).alias("oversize"))


def deliver(messages: DataFrame, send: Callable[[str], None], failures: tuple[type[Exception], ...] = (OSError,)) -> list[str]:
    """Sends chunks in order up to the first failure; the job_ids of what was sent."""
    sent: list[str] = []
    for row in messages.orderBy("chunk").toLocalIterator():
        try:
            send(row["text"])
        except failures:
            break
        sent += row["job_ids"]
    return sent


def bucket_counts(rows: DataFrame, bucket: str, default: str = "new") -> DataFrame:
    """Rows per bucket, the missing and empty ones under the default."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(bucket), F.lit("")), F.lit(default)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, bucket: str, order: str) -> DataFrame:
    """bucket, n and place (from 1): buckets by their number of rows, ties in order of first appearance."""
    counts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "__first"))).drop("__first")  # of buckets, not of rows


def shares(counts: DataFrame, apart: Iterable[str] = ("custom", "unresolved", "new")) -> DataFrame:
    """total, resolved and the named buckets' counts, each with its percentage to one decimal (0.0 of nothing)."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    named = {name: F.coalesce(F.sum(F.when(F.col("bucket") == name, F.col("n"))), F.lit(0)) for name in apart}
    columns = {"resolved": total - sum(named.values(), F.lit(0)), **named}
    once = counts.agg(total.alias("total"), *(c.alias(k) for k, c in columns.items()))
    percent = lambda k: F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.lit(100.0) * F.col(k) / F.when(F.col("total") != 0, F.col("total"))), 1)
    return once.select("total", *(x for k in columns for x in (F.col(k), percent(k).alias(f"{k}_percent"))))


#: The headings and lines of the resolution report.
REPORT_TITLE, REPORT_TOTAL = "# ATS resolution report", "Total companies: %d"
REPORT_BUCKETS = {
    "resolved": "- Resolved (real vendor): %d (%.1f%%)", "custom": "- Custom (careers page found, no recognized vendor): %d (%.1f%%)",
    "unresolved": "- Unresolved (attempted, no careers page found): %d (%.1f%%)", "new": "- New (never attempted): %d (%.1f%%)",
}
REPORT_SECTIONS = {
    "summary": "## Bucket summary", "vendors": "## Resolved by vendor", "unresolved": "## Unresolved companies (attempted, found nothing)",
    "custom": "## Custom (candidate for a future generic scraper)", "new": "## New (never attempted)",
}


def resolution_lines(companies: DataFrame) -> DataFrame:
    """The resolution report's lines with their place (section, rank, ord): totals, vendors by count, companies by bucket.

    Lines stay rows, so a report of any number of companies needs no array of them.
    """
    rows = companies.withColumn("bucket", F.coalesce(F.nullif("ats", F.lit("")), F.lit("new")))
    place = lambda section, rank, ord_: F.struct(F.lit(section).alias("section"), rank.cast("long").alias("rank"), ord_.cast("long").alias("ord")).alias("place")
    text = lambda section, ord_, line: F.struct(place(section, F.lit(0), F.lit(ord_)), line.alias("text"))
    line = lambda k: F.format_string(REPORT_BUCKETS[k], F.col(k), F.col(f"{k}_percent"))
    top = [F.lit(REPORT_TITLE), F.lit(""), F.format_string(REPORT_TOTAL, "total"), F.lit(""), F.lit(REPORT_SECTIONS["summary"]), F.lit(""), *(line(k) for k in REPORT_BUCKETS), F.lit(""), F.lit(REPORT_SECTIONS["vendors"]), F.lit("")]
    share = shares(bucket_counts(rows, "ats"))
    out = share.select(F.explode(F.array(*(text(0, i, x) for i, x in enumerate(top)))).alias("x")).select("x.*")
    named = ["custom", "unresolved", "new"]
    vendors = rows.where(~F.col("bucket").isin(named)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    out = out.unionByName(vendors.select(place(1, -F.col("n"), F.col("first")), F.concat(F.lit("- "), "bucket", F.lit(": "), F.col("n").cast("string")).alias("text")))
    for i, bucket in enumerate(("unresolved", "custom", "new"), 1):
        head = share.select(F.explode(F.array(*(text(2 * i, k, x) for k, x in enumerate((F.lit(""), F.lit(REPORT_SECTIONS[bucket]), F.lit(""))))).alias("x")).alias("x")).select("x.*")
        none = share.where(F.col(bucket) == 0).select(place(2 * i + 1, F.lit(0), F.lit(0)), F.lit("(none)").alias("text"))
        at = F.coalesce(F.nullif("careers_url", F.lit("")), F.col("url")) if bucket == "custom" else F.col("url")
        listed = rows.where(F.col("bucket") == bucket).select(place(2 * i + 1, F.lit(0), F.col("ord")), F.concat(F.lit("- "), "name", F.lit(" — "), at).alias("text"))
        out = out.unionByName(head).unionByName(none).unionByName(listed)
    return out


def resolution_summary(companies: DataFrame) -> DataFrame:
    """The report as one text. One row holds it, so this is for a configuration's companies; resolution_lines() has no such bound."""
    lines = resolution_lines(companies).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))
    return lines.select(F.concat(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))
