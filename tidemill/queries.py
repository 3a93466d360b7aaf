"""The engine's operators as queries over the driver's tables, each with DuckDB SQL for the same rows.

The tables hold no postings, so rules that would select nothing there get literals that fit their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .functions.text import collapse, names_match, phrase_not_waived, phrase_without, strip_tags
from .operators import dedup, lookups, paging, report, resolve
from .operators.predicates import CountryPolicy, in_scope_city, mostly_german, title_matches

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""SELECT p_partkey, p_name FROM part
WHERE regexp_matches(p_name, '(?i)(^|[^\p{L}\p{N}_])(ring|bolt|hot gear)($|[^\p{L}\p{N}_])')""")
def q_title_match(spark, sf_dir):
    """whole-word terms in a title."""
    parts = table(spark, sf_dir, "part")
    return parts.where(title_matches(F.col("p_name"), ["ring", "bolt", "hot gear"])).select("p_partkey", "p_name")


@query("""SELECT doc_id, source FROM documents
WHERE CASE WHEN regexp_matches(source, '(?i)src1|tion of') THEN true WHEN lower(trim(source)) IN ('', 'src0') THEN regexp_matches(text, '(?i)src1|tion of') ELSE false END""")
def q_scope_fallback(spark, sf_dir):
    """the structured field decides; free text only where that says nothing."""
    return table(spark, sf_dir, "documents").where(in_scope_city(F.col("source"), F.col("text"), "src1|tion of", ["", "src0"])).select("doc_id", "source")


_BEFORE = """WITH d AS (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM documents WHERE regexp_matches(text, '{p}')),
w AS (SELECT doc_id, list_transform(range(1, len(m) + 1), lambda i: regexp_extract(
  right(array_to_string(list_transform(range(1, i), lambda k: g[k] || m[k]), '') || g[i], {n}), '[^.;<]*$')) AS ws FROM d)
SELECT doc_id FROM w WHERE len(list_filter(ws, lambda x: NOT regexp_matches(x, '{neg}'))) > 0"""


@query(_BEFORE.format(p="(?i)tion with", n=30, neg=r"(?i)\b(the|of)\b"))
def q_negated_phrase(spark, sf_dir):
    """A phrase counts unless the clause before it negates it."""
    return table(spark, sf_dir, "documents").where(phrase_without(F.col("text"), "tion with", r"\b(the|of)\b", 30)).select("doc_id")


_AFTER = """WITH d AS (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM documents WHERE regexp_matches(text, '{p}')),
w AS (SELECT doc_id, list_transform(range(1, len(m) + 1), lambda i: regexp_extract(
  left(array_to_string(list_transform(range(i + 1, len(m) + 2), lambda k: g[k] || coalesce(m[k], '')), ''), {n}), '^[^.;<]*')) AS ws FROM d)
SELECT doc_id FROM w WHERE len(list_filter(ws, lambda x: NOT regexp_matches(x, '{waive}') OR regexp_matches(string_split_regex(x, '{waive}')[1], '{unless}'))) > 0"""


@query(_AFTER.format(p="(?i)ing the", n=60, waive="(?i)and", unless="(?i)of|is"))
def q_disclaimer(spark, sf_dir):
    """A statement counts unless the clause after it waives it for itself."""
    return table(spark, sf_dir, "documents").where(phrase_not_waived(F.col("text"), "ing the", "and", "of|is", 60)).select("doc_id")


_DE, _EN = (", ".join(f"'{w}'" for w in words) for words in (rules.GERMAN_WORDS, rules.ENGLISH_WORDS))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '[a-zA-ZäöüÄÖÜß]+') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: list_contains([{_DE}], x))) AS de, len(list_filter(ws, lambda x: list_contains([{_EN}], x))) AS en FROM w)
SELECT doc_id, de >= 15 AND de / greatest(de + en, 1) >= 0.6 AS german FROM c""")
def q_stopword_bucket(spark, sf_dir):
    """German prose by its function words."""
    return table(spark, sf_dir, "documents").select("doc_id", mostly_german(F.col("text")).alias("german"))


@query("SELECT text, arg_max(source, doc_id) AS source, arg_max(lang, doc_id) AS lang, min(doc_id) AS pos FROM documents GROUP BY text")
def q_merge_by_url(spark, sf_dir):
    """Per key the last row's values at the first row's place."""
    rows = table(spark, sf_dir, "documents").select("text", "source", "lang", F.col("doc_id").alias("pos"))
    return dedup.last_value_first_position(rows, ["text"], "pos")


@query("SELECT text, arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM documents GROUP BY text")
def q_first_wins(spark, sf_dir):
    """U4: per key the first row."""
    return dedup.first_wins(table(spark, sf_dir, "documents").select("text", "source", "doc_id"), ["text"], "doc_id")


@query("""SELECT d.doc_id, sha256(d.source || ':' || d.doc_id) AS job_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents e ON e.doc_id = l.doc_id WHERE sha256(e.source || ':' || e.doc_id) = sha256(d.source || ':' || d.doc_id))""")
def q_unseen(spark, sf_dir):
    """What the seen set lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", dedup.job_id(F.col("source"), F.col("doc_id")).alias("job_id"))
    seen = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return dedup.unseen(docs, seen).select("doc_id", "job_id")


@query("SELECT user_id, min(ts) AS first_seen_at, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY user_id")
def q_insert_ignore(spark, sf_dir):
    """K2: the first insert of a key stays."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("first_seen_at"), F.struct("ts", "event_id").alias("at"))
    return dedup.first_wins(rows, ["user_id"], "at").select("user_id", "first_seen_at", "event_type")


@query("""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS n, count(*) OVER (PARTITION BY lang) AS section_size FROM documents""")
def q_split_report(spark, sf_dir):
    """Numbers restart in each section; headers hold its size."""
    return report.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS k, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations),
r AS (SELECT i, conv_id, turn, 0 AS chunk, k + 2 AS used FROM o WHERE i = 1 UNION ALL
  SELECT o.i, o.conv_id, o.turn, CASE WHEN r.used + o.k + 2 > 4096 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + o.k + 2 > 4096 THEN o.k + 2 ELSE r.used + o.k + 2 END
  FROM r JOIN o ON o.i = r.i + 1)
SELECT chunk::INTEGER AS chunk, count(*) AS n_blocks, min(i) - 1 AS first_block FROM r GROUP BY chunk""")
def q_pack_chunks(spark, sf_dir):
    """C4, K6: blocks in order, greedily packed under a length limit."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("k"))
    rows = report.packed(turns, "k", ["conv_id", "turn"])
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("i").alias("first_block"))


@query("""WITH c AS (SELECT coalesce(nullif(CASE source WHEN 'src0' THEN '' WHEN 'src1' THEN 'custom' WHEN 'src2' THEN 'unresolved' ELSE source END, ''), 'new') AS bucket FROM documents),
t AS (SELECT count(*) AS total, count(*) FILTER (bucket NOT IN ('custom', 'unresolved', 'new')) AS resolved, count(*) FILTER (bucket = 'custom') AS custom,
  count(*) FILTER (bucket = 'unresolved') AS unresolved, count(*) FILTER (bucket = 'new') AS "new" FROM c)
SELECT total, resolved, round(100.0::DOUBLE * resolved / total, 1) AS resolved_percent, custom, round(100.0::DOUBLE * custom / total, 1) AS custom_percent,
  unresolved, round(100.0::DOUBLE * unresolved / total, 1) AS unresolved_percent, "new", round(100.0::DOUBLE * "new" / total, 1) AS new_percent FROM t""")
def q_bucket_summary(spark, sf_dir):
    """A1, A2: counts by bucket and their percentages."""
    docs = table(spark, sf_dir, "documents")
    ats = F.when(F.col("source") == "src0", "").when(F.col("source") == "src1", "custom").when(F.col("source") == "src2", "unresolved").otherwise(F.col("source"))
    return report.shares(report.bucket_counts(docs.select(ats.alias("ats")), "ats"))


@query("SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) ::INTEGER AS place FROM documents GROUP BY lang")
def q_ranked_counts(spark, sf_dir):
    """Buckets by count, ties by first appearance."""
    return report.ranked(table(spark, sf_dir, "documents"), "lang", "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_path(spark, sf_dir):
    """Scalars out of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_text FROM pages""")
def q_page_title(spark, sf_dir):
    """Titles and tag-free text of pages."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.length(collapse(strip_tags(F.col("html")))).cast("long").alias("n_text"))


@query(r"""SELECT page_id, array_to_string(list_transform(list_filter(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1), lambda x: regexp_matches(x, '[0-9]')), lambda x: x), ' ') AS links FROM pages""")
def q_links(spark, sf_dir):
    """The links of a page that match a pattern, in order."""
    pages = table(spark, sf_dir, "pages").select("page_id", resolve.page_links(F.col("url"), F.col("html")).alias("links"))
    return pages.select("page_id", F.array_join(F.transform(F.filter("links", lambda x: x["href"].rlike("[0-9]")), lambda x: x["href"]), " ").alias("links"))


@query(r"""SELECT page_id, regexp_extract(regexp_replace(regexp_extract(url, '^[^/?#]*://([^/?#]*)', 1), '^((www|de|en|eu|careers|jobs|m)(\.|$))*', ''), '^[^.]*') AS slug FROM pages""")
def q_slug_host(spark, sf_dir):
    """A company's slug from its host."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.get(resolve.slug_candidates(F.col("url"), F.lit("")), F.lit(0)).alias("slug"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)example\\.com') THEN 'com' WHEN regexp_matches(url, '(?i)example\\.net') THEN 'net'
  WHEN regexp_matches(url, '(?i)([a-z0-9-]+)\\.example\\.org') THEN 'org' WHEN regexp_matches(url, '(?i)://([a-z0-9-]+)') THEN 'host' END AS ats,
  CASE WHEN regexp_matches(url, '(?i)example\\.(com|net)') THEN NULL WHEN regexp_matches(url, '(?i)([a-z0-9-]+)\\.example\\.org') THEN regexp_extract(url, '(?i)([a-z0-9-]+)\\.example\\.org', 1)
  ELSE regexp_extract(url, '(?i)://([a-z0-9-]+)', 1) END AS identifier FROM pages""".replace("\\\\", "\\"))
def q_signature(spark, sf_dir):
    """The first signature that matches a page."""
    signs = [("com", [r"example\.com"]), ("net", [r"example\.net"]), ("org", [r"([a-z0-9-]+)\.example\.org"]), ("host", [r"://([a-z0-9-]+)"])]
    return table(spark, sf_dir, "pages").select("page_id", resolve.first_match(F.col("url"), signs, F.lit("")).alias("m")).select("page_id", "m.ats", "m.identifier")


@query("""SELECT n_name, r_name, (n <> '' AND r <> '' AND (contains(n, r) OR contains(r, n))) AS alike
FROM (SELECT n_name, r_name, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS n, regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') AS r
  FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def q_name_containment(spark, sf_dir):
    """Names that hold one another."""
    both = lookups.looked_up(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, sf_dir, "region"), ["r_regionkey"])
    return both.select("n_name", "r_name", names_match(F.col("n_name"), F.col("r_name")).alias("alike"))


@query("""SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def q_lookup_inner(spark, sf_dir):
    """Lookups along keys."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = lookups.looked_up(orders, table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    return lookups.looked_up(rows, table(spark, sf_dir, "nation"), ["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_lookup_missing(spark, sf_dir):
    """Keys that the other side lacks."""
    return lookups.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT d.doc_id, CASE WHEN d.lang = 'en' AND l.quality = 1 THEN 'good' ELSE d.source END AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_detail_fill(spark, sf_dir):
    """Details fill what was asked for, if they hold anything; every row stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    details = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("source"))
    return lookups.filled(docs, details, ["doc_id"], "source", F.col("lang") == "en").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_drop_foreign(spark, sf_dir):
    """Rows confirmed as foreign go."""
    foreign = table(spark, sf_dir, "labels").where("quality = 0")
    return lookups.without_foreign(table(spark, sf_dir, "documents").select("doc_id"), foreign, ["doc_id"])


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, min(CASE WHEN l_quantity > 45 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS bad,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS want FROM lineitem),
g AS (SELECT *, min(CASE WHEN want <> l_linenumber THEN want END) OVER (PARTITION BY l_orderkey) AS gap FROM p)
SELECT l_orderkey, l_linenumber FROM g WHERE l_linenumber < least(coalesce(bad, 6), coalesce(gap, 6), 6)""")
def q_page_until_empty(spark, sf_dir):
    """L1: pages before the first empty or missing one, capped."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return paging.until_empty(lines, ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 45, 5).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4 AND (l_linenumber = 1 OR (l_linenumber - 1) * 10 < l_quantity)")
def q_page_until_total(spark, sf_dir):
    """L2: pages whose offset lies below the total, capped."""
    return paging.until_total(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", 10, 4).select("l_orderkey", "l_linenumber")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS n, bool_or(l_quantity > 45) AS last FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5 GROUP BY ALL),
g AS (SELECT l_orderkey, least(coalesce(min(n) FILTER (last), 5), coalesce(min(n + 1) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.l_orderkey = p.l_orderkey AND q.n = p.n + 1)), 6) - 1, CASE WHEN min(n) = 1 THEN 5 ELSE 0 END) AS stop FROM p GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN g USING (l_orderkey) WHERE l_linenumber BETWEEN 1 AND stop""")
def q_page_until_last(spark, sf_dir):
    """L1, L2: pages up to the one after which none is asked for, or before a missing one, by bitsets of pages."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return paging.until_last(lines, ["l_orderkey"], "l_linenumber", F.col("l_quantity") > 45, 5)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def q_topk_per_key(spark, sf_dir):
    """L3: a fixed number of rows per key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return paging.first_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, string_agg(event_type || '=' || ids, ';' ORDER BY event_type) AS facets FROM
(SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def q_facet_map(spark, sf_dir):
    """Lists of ids by key."""
    maps = paging.keyed_lists(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id", "event_id")
    entry = lambda k: F.concat(k, F.lit("="), F.array_join(F.transform(F.element_at("lists", k), lambda v: v.cast("string")), ","))
    return maps.select("user_id", F.array_join(F.transform(F.array_sort(F.map_keys("lists")), entry), ";").alias("facets"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment <> '' THEN upper(trim(c_mktsegment)) = 'BUILDING' ELSE false END AS kept FROM customer""")
def q_country_policy(spark, sf_dir):
    """F8: a structured field against its expected value."""
    keeps = CountryPolicy("BUILDING", "upper", "drop").keeps(F.col("c_mktsegment"), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", keeps.alias("kept"))


@query("""SELECT doc_id, source, lang FROM documents WHERE regexp_matches(source, '(?i)src1') OR regexp_matches(lang, 'de')""")
def q_scope_union(spark, sf_dir):
    """Two scopes, a row of both once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = docs.where(F.col("source").rlike("(?i)src1")).withColumn("pos", F.struct(F.lit(0), "doc_id"))
    second = docs.where(F.col("lang").rlike("de")).withColumn("pos", F.struct(F.lit(1), "doc_id"))
    return dedup.last_value_first_position(first.unionByName(second), ["doc_id"], "pos").select("doc_id", "source", "lang")


@query("""SELECT page_id, CASE WHEN ats IS NULL OR ats IN ('unresolved', 'custom') THEN true ELSE identifier IS NULL AND ats NOT IN ('rexx', 'dvinci', 'jazzhr') END AS pending FROM
(SELECT page_id, [NULL, 'unresolved', 'custom', 'lever', 'rexx'][page_id % 5 + 1] AS ats, CASE WHEN page_id % 2 = 0 THEN url END AS identifier FROM pages)""")
def q_needs_resolution(spark, sf_dir):
    """which companies are to be resolved."""
    ats = F.get(F.array(*map(F.lit, (None, "unresolved", "custom", "lever", "rexx"))), (F.col("page_id") % 5).cast("int"))
    identifier = F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", resolve.needs_resolution(ats, identifier).alias("pending"))
