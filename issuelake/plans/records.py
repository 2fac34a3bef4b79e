"""Queries of records: search, pages with totals, fallbacks, audits, citations, derived names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuelake.functions import text as tx
from issuelake.functions.sql import register
from issuelake.operators import chunking, evaluate
from issuelake.plans.analysis import LABELS, confusion_matrix
from issuelake.plans.registry import query
from issuelake.session import table


@query("SELECT evidence_id, title, repo_full_name FROM issue_evidence WHERE contains(lower(title), 'regression') OR contains(lower(repo_full_name), 'lattice')")
def search_issues(spark, d):
    """A case-insensitive part of a title or of a repository's name."""
    hit = F.lower("title").contains("regression") | F.lower("repo_full_name").contains("lattice")
    return table(spark, d, "issue_evidence").where(hit).select("evidence_id", "title", "repo_full_name")


@query("""
    WITH f AS (SELECT evidence_id, comments_count, count(*) OVER () AS total FROM issue_evidence WHERE comments_count > 10)
    SELECT evidence_id, comments_count, total FROM f ORDER BY comments_count DESC, evidence_id LIMIT 10 OFFSET 20
""")
def page_with_total(spark, d):
    """One page and the size of the whole result: a top-k and a count, not one window over all rows."""
    f = table(spark, d, "issue_evidence").where("comments_count > 10").select("evidence_id", "comments_count")
    page = f.orderBy(F.desc("comments_count"), "evidence_id").offset(20).limit(10)
    return page.join(F.broadcast(f.agg(F.count("*").alias("total"))))


@query("""
    SELECT evidence_id FROM issue_evidence
    WHERE len(labels) > 0 AND len(list_filter(labels, lambda x: lower(x) NOT IN ('documentation', 'question', 'duplicate'))) = 0
""")
def labels_within(spark, d):
    """Issues that have labels, all of them from a given set."""
    allowed = F.array(*[F.lit(x) for x in ("documentation", "question", "duplicate")])
    lower = F.transform("labels", F.lower)
    return table(spark, d, "issue_evidence").where((F.size("labels") > 0) & (F.size(F.array_except(lower, allowed)) == 0)).select("evidence_id")


@query("""
    SELECT record_id, coalesce(nullif(title, ''), nullif(body, ''), 'untitled') AS headline, CASE WHEN length(body) > 140 THEN substr(body, 1, 140) || '...' ELSE coalesce(body, '') END AS preview,
        coalesce(len(comments), 0)::int AS n_comments, coalesce(len(list_filter(labels, lambda x: x.name = 'bug')) > 0, false) AS is_bug FROM dataset_record
""")
def record_view(spark, d):
    """Records with fallbacks, previews and fields of nested values."""
    b = F.col("body")
    return table(spark, d, "dataset_record").select(
        "record_id", tx.filled(F.col("title"), b, F.lit("untitled")).alias("headline"), F.when(F.length(b) > 140, F.concat(F.substring(b, 1, 140), F.lit("..."))).otherwise(F.coalesce(b, F.lit(""))).alias("preview"),
        F.coalesce(F.when(F.col("comments").isNotNull(), F.size("comments")), F.lit(0)).alias("n_comments"), F.coalesce(F.exists("labels", lambda x: x["name"] == "bug"), F.lit(False)).alias("is_bug"),
    )


@query("""
    SELECT repo_name, count(*) AS runs, count(*) FILTER (WHERE status = 'FAILED') AS failed, coalesce(sum(epoch(completed_at) - epoch(started_at)), 0)::bigint AS seconds, arg_max(snapshot_id, started_at) FILTER (WHERE status = 'ACTIVE') AS active_id
    FROM repo_snapshot GROUP BY repo_name
""")
def run_audit(spark, d):
    """Runs, failures and time spent per repository, and its active run."""
    s = table(spark, d, "repo_snapshot")
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    active = F.max(F.when(F.col("status") == "ACTIVE", F.struct("started_at", "snapshot_id")))["snapshot_id"]
    return s.groupBy("repo_name").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"), active.alias("active_id"))


@query("""
    SELECT user_id, arg_max((props::json ->> 'k')::int, event_id) AS k FROM events WHERE event_type = 'purchase' AND (props::json ->> 'k') IS NOT NULL GROUP BY user_id
""")
def last_payload(spark, d):
    """The newest row of a kind that has a field, per key."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")
    return e.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k"))


PATH = r"[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+\.(?:py|js|ts|go|rs|java|c)"


@query(rf"""
    WITH c AS (SELECT evidence_id, list_distinct(regexp_extract_all(body, '{PATH}')) AS cited, list_distinct(regexp_extract_all(title, '{PATH}')) AS known FROM issue_evidence WHERE body IS NOT NULL AND title IS NOT NULL),
    h AS (SELECT evidence_id, len(cited) AS n, len(list_filter(cited, lambda x: len(list_filter(known, lambda k: k = x OR ends_with(k, '/' || x) OR ends_with(x, '/' || k))) > 0)) AS ok FROM c)
    SELECT evidence_id, n::int AS citations, round(CASE WHEN n = 0 THEN 100 ELSE 100.0 * ok / n END::double, 4) AS verified_pct, round(CASE WHEN n = 0 THEN 0 ELSE 100 - 100.0 * ok / n END::double, 4) AS unverified_pct FROM h
""")
def citation_check(spark, d):
    """The share of the cited paths that are known ones."""
    cited, known = tx.mentioned_paths(F.col("body")), tx.mentioned_paths(F.col("title"))
    c = table(spark, d, "issue_evidence").where("body is not null and title is not null").select("evidence_id", cited.alias("cited"), known.alias("known"))
    ok = F.size(F.filter("cited", lambda x: F.exists("known", lambda k: evaluate.path_matches(k, x))))
    pct = F.when(F.size("cited") == 0, 100.0).otherwise(100.0 * ok / F.size("cited"))
    return c.select("evidence_id", F.size("cited").alias("citations"), F.round(pct, 4).alias("verified_pct"), F.round(F.greatest(F.lit(0.0), 100.0 - pct), 4).alias("unverified_pct"))


@query(f"""
    WITH m AS ({LABELS}), a AS (SELECT truth AS label, avg((truth = predicted)::int) AS recall FROM m GROUP BY 1), b AS (SELECT truth AS label, avg((truth = 'MEDIUM_FIT')::int) AS recall FROM m GROUP BY 1)
    SELECT label, round(a.recall, 4) AS recall, round(b.recall, 4) AS baseline, round(a.recall - b.recall, 4) AS delta FROM a JOIN b USING (label)
""")
def metric_delta(spark, d):
    """A measure against that of a constant prediction, label by label."""
    m = confusion_matrix(spark, d).groupBy(F.col("truth").alias("label")).agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    base = F.when(F.col("label") == "MEDIUM_FIT", 1.0).otherwise(0.0)
    return m.select("label", F.round("r", 4).alias("recall"), F.round(base, 4).alias("baseline"), F.round(F.col("r") - base, 4).alias("delta"))


@query("""
    SELECT DISTINCT chunk_id, format('[File: {} | {}: {} (Lines {}-{})]', file_path, upper(substr(symbol_type, 1, 1)) || lower(substr(symbol_type, 2)), qualified_symbol_name, start_line, end_line) AS header
    FROM code_chunk WHERE file_path IS NOT NULL AND symbol_type IS NOT NULL AND NOT contains(symbol_type, '_') AND qualified_symbol_name IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL
""")
def context_headers(spark, d):
    """The line above a chunk that says where it is from."""
    c = table(spark, d, "code_chunk").where("file_path is not null and symbol_type is not null and not contains(symbol_type, '_') and qualified_symbol_name is not null and start_line is not null and end_line is not null")
    return c.select("chunk_id", chunking.context_header(F.col("file_path"), F.col("symbol_type"), F.col("qualified_symbol_name"), F.col("start_line"), F.col("end_line")).alias("header")).distinct()


@query("""
    WITH t AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders),
    s AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS before FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_orderkey, round(o_totalprice - coalesce(before, o_totalprice), 4) AS change FROM s
""")
def order_changes(spark, d):
    """Each order against the one before of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.coalesce(F.lag("o_totalprice").over(w), F.col("o_totalprice")), 4).alias("change"))


@query("""
    WITH h AS (SELECT evidence_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(html_url)) AS h FROM issue_evidence WHERE html_url IS NOT NULL)
    SELECT evidence_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%x', ('0x' || h[17:17])::int % 4 + 8) || h[18:20] || '-' || h[21:32] AS uuid FROM h
""")
def issue_uuids(spark, d):
    """The stable id of every issue, from its address."""
    return table(spark, d, "issue_evidence").where("html_url is not null").select("evidence_id", tx.uuid5(F.col("html_url")).alias("uuid"))


@query("""
    SELECT doc_id, greatest(1, length(text) // 4)::int AS estimate, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9_]+')), 0)::int AS words, round((length(text) + 2) / (sqrt(length(text)::double * length(text) + 1) * sqrt(5.0::double)), 6) AS similarity FROM documents
""")
def sql_functions(spark, d):
    """Functions registered with the session, called from SQL."""
    register(spark)
    table(spark, d, "documents").createOrReplaceTempView("issuelake_documents")
    return spark.sql("SELECT doc_id, token_estimate(text) AS estimate, size(words_of(text)) AS words, round(cosine_similarity(array(CAST(length(text) AS DOUBLE), 1D), array(1D, 2D)), 6) AS similarity FROM issuelake_documents")
