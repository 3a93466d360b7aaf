"""The report plan: from scanned postings to new ones in two sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import report as messages
from ..operators.dedup import SeenTable, job_id, unseen
from ..operators.outbox import Outbox
from ..operators.predicates import german_required, in_scope_city, in_scope_remote, title_matches
from ..operators.staging import scratch, staged


def _counts(stage: str) -> dict[str, Column]:
    """What is counted at each stage of a run."""
    n = F.count(F.lit(1))
    return {
        "scanned": {"n_scanned": n, "n_city": F.count_if(F.col("__scopes")[0]), "n_remote": F.count_if(F.col("__scopes")[1])},
        "matched": {"n_matched": n}, "new": {"n_new": n, "n_german": F.count_if("german"), "n_english": F.count_if(~F.col("german"))},
    }[stage]


def build_report(postings: DataFrame, seen: DataFrame | SeenTable, terms: list[str] | None = None, metrics: dict[str, Observation] | None = None) -> DataFrame:
    """New postings in scope whose title matches, with job_id, german and ord.

    postings: source_id, title, company, url, location, description, ord. Rows of both scopes come as
    (0, ord) for the city, then (1, ord) for remote; of equal urls the last row counts, at the place of
    the first. The scopes are worked out once per row. ord is a posting's own, so it finds the row again. seen: reported job_ids, or the table of them, of which
    only the partitions of matched rows are read then. metrics: gets an observation for each stage, which
    the next action over the report fills in passing.
    """

    def counted(rows: DataFrame, stage: str) -> DataFrame:
        if metrics is None:
            return rows
        metrics[stage] = Observation()
        return rows.observe(metrics[stage], *(c.alias(k) for k, c in _counts(stage).items()))

    flagged = postings.withColumn("__scopes", F.array(in_scope_city(F.col("location"), F.col("description")), in_scope_remote(F.col("location"), F.col("description"))))
    narrow = counted(flagged, "scanned").select("url", "source_id", "ord", title_matches(F.col("title"), terms).alias("hit"), F.posexplode("__scopes").alias("scope", "in")).where("in")
    placed = narrow.withColumn("pos", F.struct("scope", "ord"))
    # Which row counts is settled without the texts; only the rows that are left are fetched with theirs.
    last = placed.groupBy("url").agg(F.max_by(F.struct("source_id", "hit", "ord"), "pos").alias("last"), F.min("pos").alias("pos")).where("last.hit")
    matched = counted(last.select("url", F.col("last.source_id").alias("source_id"), F.col("last.ord").alias("row"), "pos", job_id(F.col("last.source_id"), F.col("url")).alias("job_id")), "matched")
    # The table is asked for the matched rows only, so those are worked out first.
    left = seen.unseen(staged(matched, "matched")) if isinstance(seen, SeenTable) else unseen(matched, seen)
    winners = staged(left.select(F.col("url").alias("__url"), F.col("source_id").alias("__source"), "row", "pos", "job_id"), "winners")
    same = (F.col("ord") == F.col("row")) & F.col("url").eqNullSafe(F.col("__url")) & F.col("source_id").eqNullSafe(F.col("__source"))
    fetched = postings.join(winners, same).select(*(c for c in postings.columns if c != "ord"), F.col("pos").alias("ord"), "job_id")
    return counted(fetched.withColumn("german", german_required(F.col("description"))), "new")


def run(postings: DataFrame, seen: SeenTable, send: Callable[[str], None], day: Column | None = None, terms: list[str] | None = None, dry_run: bool = False, outbox: Outbox | None = None, name: str | None = None) -> list[str]:
    """Sends the report and marks what was sent, of which the job_ids are returned; a dry run only hands the messages to send and leaves the table alone.

    outbox, name: where the run is kept, and its name. A run of a name that broke off sends what is left of it
    and marks all it has sent; one that is done does nothing. Without an outbox, a scratch folder keeps it.
    """
    box = Outbox(postings.sparkSession, scratch(postings.sparkSession, "outbox")) if outbox is None or dry_run else outbox
    name = "run" if name is None else name
    state = box.state(name)
    if state.get("done"):
        return []
    if not state:
        rows = build_report(postings, seen, terms).persist()
        try:
            parts = messages.chunks(messages.blocks(rows, F.current_date() if day is None else day))
            box.put(name, parts.select("chunk", "text", "job_ids", "oversize"), rows.select("job_id", "title", "company"))
        finally:
            rows.unpersist()
    if not box.deliver(name, send):
        box.close(name)
        return []
    if not dry_run:
        seen.mark(box.rows(name).join(box.sent_ids(name), "job_id", "left_semi"))
    box.close(name)
    return [r["job_id"] for r in box.sent_ids(name).collect()]  # of one report
