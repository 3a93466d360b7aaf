import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import dedup, report
from tidemill.operators.dedup import SEEN_SCHEMA, SeenTable
from tidemill.plans.report import build_report, run


def ids(frame):
    return [r["url"].rsplit("/", 1)[-1] for r in frame.orderBy("ord").collect()]


def test_build_report(spark, postings):
    seen = spark.createDataFrame([], SEEN_SCHEMA)
    rows = postings({"location": "München"}, {"title": "Baker", "location": "Munich"}, {"location": "Munich (Remote)", "description": "gute Deutschkenntnisse"}, {"location": "Ulm"}, {"location": "remote"})
    out = build_report(rows, seen)
    assert ids(out) == ["0", "2", "4"]
    assert [r["german"] for r in out.orderBy("ord").collect()] == [False, True, False]
    marked = out.select("job_id", "title", "company", F.current_timestamp().alias("first_seen_at"))
    assert build_report(rows, marked).count() == 0


def test_merge_keeps_last_value_at_first_place(spark, postings):
    rows = postings({"url": "u/1", "location": "Munich", "title": "QA Engineer"}, {"url": "u/2", "location": "Munich"}, {"url": "u/1", "location": "Munich", "title": "Baker"})
    assert ids(build_report(rows, spark.createDataFrame([], SEEN_SCHEMA))) == ["2"]
    merged = dedup.last_value_first_position(rows, ["url"], "ord").orderBy("ord").collect()
    assert [(r["url"], r["title"], r["ord"]) for r in merged] == [("u/1", "Baker", 0), ("u/2", "Test Engineer", 1)]
    assert [r["title"] for r in dedup.first_wins(rows, ["url"], "ord").orderBy("ord").collect()] == ["QA Engineer", "Test Engineer"]


def test_seen_table(spark, postings, tmp_path):
    table = SeenTable(spark, str(tmp_path / "seen"))
    rows = postings({}, {}, {"url": "https://example.test/0", "source_id": "other"}).withColumn("job_id", dedup.job_id(F.col("source_id"), F.col("url")))
    table.mark(rows.limit(0))
    assert not (tmp_path / "seen").exists() and table.read().count() == 0
    table.mark(rows.where("ord = 0"), F.lit("2020-01-01"))
    assert sorted(r["ord"] for r in dedup.unseen(rows, table.read()).collect()) == [1, 2]
    table.mark(rows.unionByName(rows), F.lit("2021-01-01"))
    assert sorted(r["first_seen_at"].year for r in table.read().collect()) == [2020, 2021, 2021]
    table.create()


def blocks_of(spark, n, size=10):
    rows = spark.range(n).select(F.lit("s").alias("source_id"), F.repeat(F.lit("t"), size).alias("title"), F.lit("c").alias("company"), F.lit("l").alias("location"), F.concat(F.lit("u"), "id").alias("url"), F.col("id").cast("string").alias("job_id"), (F.col("id") % 2 == 1).alias("german"), F.col("id").alias("ord"))
    return report.blocks(rows, F.lit(datetime.date(2024, 3, 9)))


def test_messages(spark):
    assert [r["text"] for r in report.chunks(blocks_of(spark, 0)).collect()] == ["No new QA jobs today."]
    text = report.chunks(blocks_of(spark, 3, 1)).collect()[0]["text"]
    assert text.split("\n\n") == ["📅 09.03.2024 — New QA jobs", "🇬🇧 English-speaking (2)", "1. t — c (l)\n   u0", "2. t — c (l)\n   u2", "🇩🇪 German-speaking (1)", "1. t — c (l)\n   u1"]
    chunks = report.chunks(blocks_of(spark, 60, 200)).orderBy("chunk").collect()
    assert len(chunks) > 1 and all(len(c["text"]) <= 4096 and not c["oversize"] for c in chunks)
    assert sorted(int(i) for c in chunks for i in c["job_ids"]) == list(range(60))
    assert report.chunks(blocks_of(spark, 1, 5000)).where("oversize").count() == 1


def test_delivery_stops_at_the_first_failure(spark):
    chunks, calls = report.chunks(blocks_of(spark, 60, 200)), []

    def send(text):
        if calls:
            raise OSError
        calls.append(text)

    assert report.deliver(chunks, send) == chunks.orderBy("chunk").first()["job_ids"]


def test_run_marks_what_was_sent(spark, postings, tmp_path):
    seen, out = SeenTable(spark, str(tmp_path / "seen")), []
    rows = postings({"location": "Munich"}, {"location": "remote"})
    run(rows, seen, out.append, dry_run=True)
    assert len(out) == 1 and seen.read().count() == 0
    assert len(run(rows, seen, out.append)) == 2 and seen.read().count() == 2
    run(rows, seen, out.append)
    assert out[-1] == "No new QA jobs today."


def test_stream(spark, postings, tmp_path):
    from tidemill.streaming.reports import report_available

    out = []
    postings({"location": "Munich"}).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        report_available(spark, str(tmp_path / "in"), str(tmp_path / "cp"), str(tmp_path / "seen"), out.append)
    assert len(out) == 1


def test_resolution_summary(spark):
    rows = [("a", "lever", 0), ("b", "", 1), ("c", "custom", 2), ("d", "lever", 3), ("e", None, 4), ("f", "ashby", 5)]
    rows = spark.createDataFrame([(n, f"https://{n}.test", a, "https://c.test/jobs" if n == "c" else None, i) for n, a, i in rows], "name string, url string, ats string, careers_url string, ord long")
    text = report.resolution_summary(rows).first()[0]
    assert "Total companies: 6" in text and "- Resolved (real vendor): 3 (50.0%)" in text and "- New (never attempted): 2 (33.3%)" in text
    assert "- lever: 2\n- ashby: 1" in text and "scraper)\n\n- c — https://c.test/jobs\n" in text and "found nothing)\n\n(none)\n" in text and text.endswith("- b — https://b.test\n- e — https://e.test\n")
    assert report.shares(report.bucket_counts(rows.limit(0), "ats")).first()["resolved_percent"] == 0.0


def marks(spark, ids, title="t"):
    return spark.createDataFrame([(i, title, "c") for i in ids], "job_id string, title string, company string")


def test_seen_table_reads_only_partitions_asked_for(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path / "seen"))
    ids = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("job_id"), F.lit("t").alias("title"), F.lit("c").alias("company"))
    table.mark(ids)
    asked = ids.where("job_id like 'a%'").select("job_id").unionAll(spark.createDataFrame([("a" * 64,), ("b" * 64,), (None,)], "job_id string"))
    left = table.unseen(asked)
    assert sorted((r["job_id"] for r in left.collect()), key=str) == sorted(["a" * 64, "b" * 64, None], key=str)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and "= a)" in plan  # b is in no bitmap, so its partition is not read
    assert not table.unseen(spark.createDataFrame([("c" * 64,)], "job_id string"))._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_two_marks_at_once_leave_one_row_an_id(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    ids = [f"{i:064x}" for i in range(40)]
    tables = [SeenTable(spark, str(tmp_path / "seen")) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: tables[k].mark(marks(spark, ids[k * 5 : k * 5 + 30], f"run {k}"), F.lit("2024-01-01")), range(3)))
    rows = tables[0].read().collect()
    assert sorted(r["job_id"] for r in rows) == ids and tables[0].versions.number() in (2, 3)  # the middle run may find nothing new


def test_versions_are_taken_once(spark, tmp_path, monkeypatch):
    from tidemill.operators.versions import Versions

    log = Versions(spark, str(tmp_path / "table"))
    assert (log.number(), log.entry()) == (0, {}) and log.commit(1, {"a": 1}) and not log.commit(1, {"a": 2}) and log.entry() == {"a": 1}
    tried = []

    def work(entry):
        tried.append(entry)
        if len(tried) == 1:
            assert log.commit(2, {"a": "other"})
        return {"a": [entry["a"], "mine"]}

    assert log.change(work) == 3 and tried == [{"a": 1}, {"a": "other"}] and log.entry(3) == {"a": ["other", "mine"]}
    assert log.change(lambda entry: None) == 3 and sorted(p.name for p in (tmp_path / "table" / "_log").glob("[!.]*")) == [f"{i:010d}.json" for i in (1, 2, 3)]


def test_versions_in_a_store_that_only_spark_reads(spark):
    from tidemill.operators.staging import scratch
    from tidemill.operators.versions import Versions

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.versions.link./shared", scratch(spark, "linked").rsplit("/", 1)[0])
    log = Versions(spark, f"viewfs://versions/shared/{scratch(spark, 'table').rsplit('/', 1)[1]}")
    assert log.commit(1, {"a": 1}) and not log.commit(1, {"a": 2}) and log.entry() == {"a": 1}


def test_young_folders_are_merged(spark, tmp_path):
    table = SeenTable(spark, str(tmp_path / "seen"))
    table.MOST_FOLDERS = 2
    for k in range(5):
        table.mark(marks(spark, [f"{i:064x}" for i in range(k * 10, k * 10 + (30 if k == 0 else 11))]))
    entry = table.versions.entry()
    assert table.read().count() == table.read().distinct().count() == 51 and len(entry["rows"]) <= 2 and sum(entry["counts"]) == 51
    assert table.unseen(marks(spark, [f"{i:064x}" for i in range(60)])).count() == 9


def packed_plainly(sizes, limit, gap):
    out, chunk, used = [], -1, 0
    for size in sizes:
        new = chunk < 0 or used + size + gap > limit
        chunk, used = chunk + new, size + gap if new else used + size + gap
        out.append(chunk)
    return out


@pytest.mark.parametrize(("limit", "gap", "most"), [(100, 2, 30), (100, 2, 160), (10, 1, 3), (50, 0, 60)])
def test_packing_over_ranges(spark, limit, gap, most):
    import random

    r = random.Random(limit + most)
    sizes = [r.randrange(0 if gap else 1, most) for _ in range(900)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(7)
    plain = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = sorted(map(tuple, report.packed(rows, "size", ["id"], limit, gap).select("id", "i", "chunk").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", plain[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", plain[1])
    assert out == [(i, i, c) for i, c in enumerate(packed_plainly(sizes, limit, gap))]
    assert report.packed(rows.limit(0), "size", ["id"], limit, gap).count() == 0


def test_numbers_and_chunks_have_no_window_and_no_single_task(spark):
    rows = spark.range(50).select((F.col("id") % 2 == 0).alias("german"), F.col("id").alias("ord"), F.lit(5).cast("long").alias("size"))
    plans = [report.numbered(rows, "german", "ord")._jdf.queryExecution().executedPlan().toString(), report.packed(rows, "size", ["ord"])._jdf.queryExecution().executedPlan().toString()]
    assert all("Window" not in p and "SinglePartition" not in p for p in plans)


def test_a_run_that_broke_off_sends_nothing_twice(spark, postings, tmp_path):
    from tidemill.operators.outbox import Outbox

    seen, box, out = SeenTable(spark, str(tmp_path / "seen")), Outbox(spark, str(tmp_path / "box")), []
    rows = postings(*({"location": "Munich", "title": "QA Engineer " + "x" * 2000} for _ in range(5)))

    class Broken(SeenTable):
        def mark(self, rows, at=None):
            raise RuntimeError("no disk")

    with pytest.raises(RuntimeError, match="no disk"):
        run(rows, Broken(spark, str(tmp_path / "seen")), out.append, outbox=box, name="monday")
    first = len(out)
    assert first > 2 and seen.read().count() == 0 and box.state("monday")["sent"] == first and not box.state("monday")["done"]
    assert len(run(rows, seen, out.append, outbox=box, name="monday")) == 5 and len(out) == first and seen.read().count() == 5
    assert run(rows, seen, out.append, outbox=box, name="monday") == [] and len(out) == first  # it is done
    run(rows, seen, out.append, outbox=box, name="tuesday")
    assert out[first:] == ["No new QA jobs today."]


def test_a_run_that_dies_while_sending_goes_on(spark, postings, tmp_path):
    from tidemill.operators.outbox import Outbox

    seen, box, out = SeenTable(spark, str(tmp_path / "seen")), Outbox(spark, str(tmp_path / "box")), []
    rows = postings(*({"location": "Munich", "title": "QA Engineer " + "x" * 2000} for _ in range(5)))

    def send(text):
        if len(out) == 2:
            raise KeyboardInterrupt
        out.append(text)

    with pytest.raises(KeyboardInterrupt):
        run(rows, seen, send, outbox=box, name="monday")
    assert len(out) == 2 and box.state("monday")["sent"] == 2
    assert len(run(rows, seen, out.append, outbox=box, name="monday")) == 5 and len(set(out)) == len(out) > 2
    some = []

    def full(text):
        if some:
            raise OSError
        some.append(text)

    more = postings(*({"location": "Munich", "title": "QA Engineer " + "y" * 2000, "url": f"https://more.test/{i}"} for i in range(4)))
    sent = run(more, seen, full, outbox=box, name="tuesday")
    assert len(some) == 1 and 0 < len(sent) < 4 and seen.read().count() == 5 + len(sent) and box.state("tuesday")["done"]


def test_acknowledging_costs_the_same_whatever_was_sent_before(spark, tmp_path, monkeypatch):
    from tidemill.operators import versions
    from tidemill.operators.outbox import Outbox

    box, out, asked = Outbox(spark, str(tmp_path / "box")), [], []
    rows = spark.range(40).select(F.lit("T").alias("title"), F.lit("C").alias("company"), F.col("id").cast("string").alias("job_id"))
    number = versions.Versions.number
    monkeypatch.setattr(versions.Versions, "number", lambda self: asked.append(1) or number(self))
    messages = spark.range(40).select(F.col("id").cast("int").alias("chunk"), F.concat(F.lit("m"), "id").alias("text"), F.array(F.col("id").cast("string")).alias("job_ids"), F.lit(False).alias("oversize"))
    box.put("monday", messages, rows)

    def send(text):
        if len(out) == 30:
            raise OSError
        out.append(text)

    assert box.deliver("monday", send) == 30 == box.state("monday")["sent"] and box.sent_ids("monday").count() == 30
    assert box.deliver("monday", out.append) == 40 and out == [f"m{i}" for i in range(40)]
    box.close("monday")
    box.close("monday")
    assert box.state("monday")["sent"] == 40 and box.state("monday")["done"] and not (tmp_path / "box" / "monday" / "sent").exists()
    assert len(asked) < 20  # the log isn't asked for each message


def test_texts_stay_where_they_are_until_rows_are_chosen(spark, postings):
    rows = postings({"location": "Munich"}, {"location": "Munich", "url": "https://example.test/0", "title": "QA Engineer"})
    plan = build_report(rows, spark.createDataFrame([], SEEN_SCHEMA))
    assert [(r["title"], r["ord"]["ord"]) for r in plan.collect()] == [("QA Engineer", 0)]
    assert all("description" not in line for line in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in line)


def test_a_run_that_is_put_already_is_not_worked_out_again(spark, tmp_path):
    from tidemill.operators.outbox import MESSAGE, Outbox

    box, out = Outbox(spark, str(tmp_path / "box")), []
    messages = spark.createDataFrame([(i, f"m{i}", [f"j{i}"], False) for i in range(3)], MESSAGE)
    box.put("day", messages, messages.select("chunk"))
    folders = sorted(p.name for p in (tmp_path / "box" / "day").glob("data-*"))
    broken = messages.withColumn("text", F.raise_error(F.lit("worked out")).cast("string"))
    box.put("day", broken, broken)
    assert sorted(p.name for p in (tmp_path / "box" / "day").glob("data-*")) == folders and len(folders) == 2
    assert box.deliver("day", out.append) == 3 and out == ["m0", "m1", "m2"]
    assert sorted(p.name for p in (tmp_path / "box" / "day" / "sent").iterdir()) == [f"{i:010d}" for i in range(3)]  # no checksums beside them
    box.close("day")
    assert box.deliver("day", out.append) == 3 and len(out) == 3 and box.sent_ids("day").count() == 3
