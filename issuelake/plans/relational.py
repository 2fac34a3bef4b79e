"""Queries of the relational core: feeds, lookups, joins, merges, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelake.functions import text as tx
from issuelake.operators import relational as rel
from issuelake.plans.registry import query
from issuelake.session import table


@query("""
    SELECT i.evidence_id, i.repo_full_name, coalesce(i.title, '') AS title, coalesce(m.language, 'Other') AS language, coalesce(m.stars, 0)::bigint AS stars
    FROM issue_evidence i JOIN repo_metrics m ON i.repo_full_name = m.full_name
    WHERE lower(i.state) = 'open' AND m.stars >= 100
    ORDER BY m.stars DESC NULLS LAST, i.evidence_id LIMIT 50
""")
def feed_ranked(spark, d):
    """Open issues of well-known repositories, the best known first."""
    repos = table(spark, d, "repo_metrics").where("stars >= 100").select("full_name", "language", "stars")
    issues = table(spark, d, "issue_evidence").where(rel.same_text("state", "OPEN")).select("evidence_id", "repo_full_name", "title")
    joined = issues.join(repos, issues["repo_full_name"] == repos["full_name"])
    top = rel.page(joined, [F.desc_nulls_last("stars"), F.col("evidence_id")], 50)
    return top.select("evidence_id", "repo_full_name", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("language", F.lit("Other")).alias("language"), F.coalesce("stars", F.lit(0)).cast("bigint").alias("stars"))


@query("""
    SELECT full_name, stars::bigint AS stars, language FROM repo_metrics
    WHERE lower(language) = 'python' AND stars >= 10 ORDER BY stars DESC NULLS LAST, full_name LIMIT 20 OFFSET 2
""")
def feed_filtered(spark, d, language="PYTHON", min_stars=10, topic=None):
    """Repositories by optional conditions, one page."""
    wanted = [rel.same_text("language", language), None if min_stars is None else F.col("stars") >= min_stars, None if topic is None else F.array_contains("topics", topic)]
    rows = table(spark, d, "repo_metrics").where(rel.all_of(wanted))
    return rel.page(rows, [F.desc_nulls_last("stars"), F.col("full_name")], 20, 2).select("full_name", F.col("stars").cast("bigint").alias("stars"), "language")


@query("""
    SELECT evidence_id, repo_full_name, github_issue_number FROM issue_evidence
    WHERE list_contains(labels, 'good first issue') AND lower(state) = 'open' AND comments_count < 5
""")
def issues_with_label(spark, d):
    """Membership in an array column together with scalar conditions."""
    wanted = [F.array_contains("labels", "good first issue"), rel.same_text("state", "open"), F.col("comments_count") < 5]
    return table(spark, d, "issue_evidence").where(rel.all_of(wanted)).select("evidence_id", "repo_full_name", "github_issue_number")


@query("""
    SELECT full_name, 'https://forge.example/' || full_name AS url, language, stars::bigint AS stars FROM repo_metrics
    WHERE full_name = (SELECT min(full_name) FROM repo_metrics)
""")
def repo_lookup(spark, d):
    """One row by its key, with a computed column."""
    repos = table(spark, d, "repo_metrics")
    key = repos.agg(F.min("full_name").alias("key"))
    return repos.join(F.broadcast(key), F.col("full_name") == F.col("key")).select("full_name", F.concat(F.lit("https://forge.example/"), "full_name").alias("url"), "language", F.col("stars").cast("bigint").alias("stars"))


@query("""
    SELECT count(*) AS issues, count(*) FILTER (WHERE lower(state) = 'open') AS open_issues, count(DISTINCT repo_full_name) AS repos,
        count(*) FILTER (WHERE body IS NULL OR body = '') AS without_body, count(DISTINCT (repo_full_name, github_issue_number)) AS distinct_issues FROM issue_evidence
""")
def platform_stats(spark, d):
    """Conditional and distinct counts in one pass."""
    return table(spark, d, "issue_evidence").agg(
        F.count("*").alias("issues"), F.count_if(F.lower("state") == "open").alias("open_issues"), F.count_distinct("repo_full_name").alias("repos"),
        F.count_if(F.col("body").isNull() | (F.col("body") == "")).alias("without_body"), F.count_distinct(F.struct("repo_full_name", "github_issue_number")).alias("distinct_issues"),
    )


@query("""
    SELECT full_name, stars::bigint AS stars FROM repo_metrics m
    WHERE stars >= 50 AND NOT EXISTS (SELECT 1 FROM repo_snapshot s WHERE s.repo_name = m.full_name AND s.status = 'ACTIVE' AND s.parser_version = 'p2')
    ORDER BY stars DESC, full_name LIMIT 100
""")
def index_candidates(spark, d):
    """Repositories without an active snapshot of the new parser, the best known 100."""
    active = table(spark, d, "repo_snapshot").where("status = 'ACTIVE' and parser_version = 'p2'").select(F.col("repo_name").alias("full_name"))
    return rel.delete_keys(table(spark, d, "repo_metrics").where("stars >= 50"), active, ["full_name"]).orderBy(F.desc("stars"), "full_name").limit(100).select("full_name", F.col("stars").cast("bigint").alias("stars"))


@query("""
    WITH w AS (SELECT snapshot_id, repo_name FROM repo_snapshot WHERE status = 'ACTIVE'),
    c AS (SELECT DISTINCT c.chunk_id, c.repo_name, c.file_path, c.start_line FROM code_chunk c WHERE c.snapshot_id IN (SELECT snapshot_id FROM w) AND c.info_class = 'SOURCE_CODE')
    SELECT chunk_id, repo_name, file_path, CASE WHEN row_number() OVER (PARTITION BY repo_name ORDER BY file_path, start_line, chunk_id) = 1 THEN 'primary' ELSE 'related' END AS role FROM c
""")
def active_chunks(spark, d):
    """Source chunks of active snapshots by a semi join, with a role by their order."""
    active = table(spark, d, "repo_snapshot").where("status = 'ACTIVE'").select("snapshot_id")
    chunks = table(spark, d, "code_chunk").where("info_class = 'SOURCE_CODE'").join(active, "snapshot_id", "left_semi").select("chunk_id", "repo_name", "file_path", "start_line").distinct()
    place = F.struct("file_path", "start_line", "chunk_id")
    first = chunks.groupBy("repo_name").agg(F.min(place).alias("first"))
    return chunks.join(first, "repo_name").select("chunk_id", "repo_name", "file_path", F.when(place == F.col("first"), "primary").otherwise("related").alias("role"))


KEY = "regexp_extract(lower(dataset_id), '[0-9a-f]{12}')"


@query(f"""
    WITH r AS (SELECT DISTINCT {KEY} AS k FROM dataset_record WHERE {KEY} <> ''), a AS (SELECT DISTINCT {KEY} AS k FROM annotation)
    SELECT (SELECT count(*) FROM r JOIN a USING (k)) AS joined, (SELECT count(*) FROM r ANTI JOIN a USING (k)) AS without_annotation, (SELECT count(*) FROM a ANTI JOIN r USING (k)) AS without_record
""")
def dataset_join_audit(spark, d):
    """How many keys join and how many are left on either side: one full outer join."""
    key = F.regexp_extract(F.lower("dataset_id"), "([0-9a-f]{12})", 1).alias("k")
    r = table(spark, d, "dataset_record").select(key).where("k <> ''").distinct().withColumn("r", F.lit(1))
    a = table(spark, d, "annotation").select(key).distinct().withColumn("a", F.lit(1))
    return r.join(a, "k", "full").agg(F.count_if(F.col("r").isNotNull() & F.col("a").isNotNull()).alias("joined"), F.count_if(F.col("a").isNull()).alias("without_annotation"), F.count_if(F.col("r").isNull()).alias("without_record"))


@query("""
    SELECT i.evidence_id, coalesce(s.snapshot_id, 'NOT_INDEXED') AS snapshot_id, s.snapshot_id IS NOT NULL AND s.parser_version = 'p2' AS hit
    FROM issue_evidence i LEFT JOIN repo_snapshot s ON s.repo_name = i.repo_full_name AND s.status = 'ACTIVE'
""")
def cache_lookup_default(spark, d):
    """A left join with a default and a hit flag."""
    s = table(spark, d, "repo_snapshot").where("status = 'ACTIVE'").select(F.col("repo_name").alias("repo_full_name"), "snapshot_id", "parser_version")
    j = table(spark, d, "issue_evidence").select("evidence_id", "repo_full_name").join(s, "repo_full_name", "left")
    return j.select("evidence_id", F.coalesce("snapshot_id", F.lit("NOT_INDEXED")).alias("snapshot_id"), (F.col("snapshot_id").isNotNull() & F.coalesce(F.col("parser_version") == "p2", F.lit(False))).alias("hit"))


@query("""
    SELECT evidence_id, repo_full_name, github_issue_number FROM issue_evidence i
    WHERE NOT EXISTS (SELECT 1 FROM dataset_record r WHERE lower(r.repo_name) = lower(i.repo_full_name) AND r.issue_number = i.github_issue_number)
""")
def ban_list_anti(spark, d):
    """Issues that the collection does not hold yet, repositories compared without case."""
    key = F.lower("repo_full_name").alias("k")
    known = table(spark, d, "dataset_record").select(F.lower("repo_name").alias("k"), F.col("issue_number").alias("github_issue_number"))
    return rel.delete_keys(table(spark, d, "issue_evidence").select("evidence_id", "repo_full_name", "github_issue_number", key), known, ["k", "github_issue_number"]).drop("k")


@query(r"""
    WITH f AS (SELECT document_id, repo_full_name, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') AS whole, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') AS p FROM repo_document)
    SELECT a.document_id, b.document_id AS same_as FROM f a JOIN f b ON a.repo_full_name = b.repo_full_name AND (a.whole = b.p OR ends_with(a.whole, '/' || b.p) OR ends_with(b.p, '/' || a.whole))
""")
def path_suffix_join(spark, d):
    """Files of a repository that are the same by their paths, whole or relative, in any notation."""
    f = table(spark, d, "repo_document").select("document_id", "repo_full_name", tx.plain_path(F.col("file_path")).alias("whole"), tx.plain_path(F.col("relative_path")).alias("p"))
    other = f.select(F.col("document_id").alias("same_as"), "repo_full_name", F.col("p").alias("q"))
    return rel.suffix_join(f, other, F.col("whole"), F.col("q"), ["repo_full_name"]).select("document_id", "same_as")


@query(r"""
    WITH f AS (SELECT document_id, repo_full_name, list_distinct(regexp_extract_all(lower(relative_path), '[a-z0-9]+')) AS pw FROM repo_document WHERE lower(language) = 'python'),
    v AS (SELECT evidence_id, repo_full_name, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS tw FROM issue_evidence WHERE title IS NOT NULL)
    SELECT v.evidence_id, f.document_id, len(list_intersect(f.pw, v.tw))::bigint AS shared FROM v JOIN f USING (repo_full_name) WHERE len(list_intersect(f.pw, v.tw)) >= 2
""")
def vocab_overlap(spark, d):
    """Words that a title shares with the path of a file of its repository, two at least: joined by the shared word, not by the repository."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    f = table(spark, d, "repo_document").where("lower(language) = 'python'").select("document_id", "repo_full_name", F.explode(words(F.col("relative_path"))).alias("w"))
    v = table(spark, d, "issue_evidence").where("title is not null").select("evidence_id", "repo_full_name", F.explode(words(F.col("title"))).alias("w"))
    return v.join(f, ["repo_full_name", "w"]).groupBy("evidence_id", "document_id").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("""
    WITH s AS (SELECT DISTINCT repo_full_name AS r, CASE length(repo_full_name) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM issue_evidence WHERE repo_full_name IS NOT NULL)
    SELECT a.split AS left_split, b.split AS right_split, count(CASE WHEN x.r IS NOT NULL THEN 1 END) AS shared
    FROM (SELECT DISTINCT split FROM s) a JOIN (SELECT DISTINCT split FROM s) b ON a.split < b.split
    LEFT JOIN (SELECT p.r, p.split AS ps, q.split AS qs FROM s p JOIN s q ON p.r = q.r) x ON x.ps = a.split AND x.qs = b.split GROUP BY 1, 2
""")
def leakage_check(spark, d):
    """Repositories that any two splits share; all counts have to be 0. One aggregation, no pairwise joins."""
    n = F.length("repo_full_name") % 3
    held = table(spark, d, "issue_evidence").where("repo_full_name is not null").select("repo_full_name", F.when(n == 0, "train").when(n == 1, "validation").otherwise("test").alias("split"))
    sets = held.groupBy("repo_full_name").agg(F.collect_set("split").alias("in"))  # three members at most
    names = ("test", "train", "validation")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = sets.agg(*[F.count_if(F.array_contains("in", a) & F.array_contains("in", b)).alias(f"{a}|{b}") for a, b in pairs])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"`{a}|{b}`").alias("shared")) for a, b in pairs])).alias("x")).select("x.*")


@query("""
    WITH u AS (SELECT full_name, stars + 1 AS stars, language FROM repo_metrics WHERE stars > 1000 UNION ALL SELECT full_name || '-fork', 0, language FROM repo_metrics WHERE forks > 100),
    t AS (SELECT full_name, stars, language FROM repo_metrics)
    SELECT coalesce(t.full_name, u.full_name) AS full_name, coalesce(u.stars, t.stars)::bigint AS stars, CASE WHEN u.full_name IS NOT NULL THEN u.language ELSE t.language END AS language
    FROM t FULL JOIN u ON t.full_name = u.full_name
""")
def merge_upsert(spark, d):
    """Updates and insertions merged into a keyed table."""
    repos = table(spark, d, "repo_metrics")
    t = repos.select("full_name", F.col("stars").cast("bigint").alias("stars"), "language")
    new = repos.where("forks > 100").select(F.concat("full_name", F.lit("-fork")).alias("full_name"), F.lit(0).cast("bigint").alias("stars"), "language")
    return rel.upsert(t, t.where("stars > 1000").withColumn("stars", F.col("stars") + 1).union(new), ["full_name"])


@query("""
    SELECT t.full_name, (CASE WHEN t.stars > 1000 THEN t.stars + 1 ELSE t.stars END)::bigint AS stars, t.language FROM repo_metrics t
""")
def merge_partial_columns(spark, d):
    """A merge that touches some columns only."""
    t = table(spark, d, "repo_metrics").select("full_name", F.col("stars").cast("bigint").alias("stars"), "language")
    source = t.where("stars > 1000").select("full_name", (F.col("stars") + 1).alias("stars"), F.lit("ignored").alias("language"))
    return rel.upsert(t, source, ["full_name"], update=["stars"])


@query("""
    SELECT evidence_id, repo_full_name, github_issue_number, state FROM issue_evidence
    QUALIFY row_number() OVER (PARTITION BY repo_full_name, github_issue_number ORDER BY fetched_at DESC NULLS LAST, evidence_id DESC) = 1
""")
def latest_evidence(spark, d):
    """The last fetch of every issue."""
    rows = table(spark, d, "issue_evidence").select("evidence_id", "repo_full_name", "github_issue_number", "state", "fetched_at")
    return rel.first_of(rows, ["repo_full_name", "github_issue_number"], [F.desc_nulls_last("fetched_at"), F.desc("evidence_id")]).drop("fetched_at")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def batch_delete_anti(spark, d):
    """Rows that stay when those of a key list are deleted."""
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return rel.delete_keys(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


CHOSEN = "SELECT repo_name, snapshot_id AS chosen_id FROM repo_snapshot WHERE status = 'STAGING' AND completed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY completed_at DESC, snapshot_id) = 1"


@query(f"""
    WITH c AS ({CHOSEN}), m AS (
        SELECT s.snapshot_id, s.repo_name, s.is_evaluation, c.chosen_id, CASE WHEN s.snapshot_id = c.chosen_id THEN 'ACTIVE' WHEN c.chosen_id IS NOT NULL AND s.status = 'ACTIVE' THEN 'RETIRED' ELSE s.status END AS status
        FROM repo_snapshot s LEFT JOIN c USING (repo_name))
    SELECT snapshot_id, repo_name, status FROM m WHERE NOT (chosen_id IS NOT NULL AND status IN ('RETIRED', 'FAILED') AND NOT coalesce(is_evaluation, false))
""")
def snapshot_activate(spark, d):
    """The newest finished staging snapshot of each repository becomes the active one."""
    s = table(spark, d, "repo_snapshot")
    chosen = rel.first_of(s.where("status = 'STAGING' and completed_at is not null"), ["repo_name"], [F.desc("completed_at"), F.col("snapshot_id")]).select("repo_name", F.col("snapshot_id").alias("chosen_id"))
    return rel.activate(s, chosen).select("snapshot_id", "repo_name", "status")


@query("""
    SELECT evidence_id, CASE WHEN coalesce(lower(state) = 'closed', false) OR coalesce(len(assignees) > 0, false) THEN 'closed' ELSE coalesce(state, 'open') END AS state FROM issue_evidence
""")
def soft_unpublish(spark, d):
    """An update in place by a condition over several columns."""
    rows = table(spark, d, "issue_evidence").select("evidence_id", "state", "assignees")
    gone = F.coalesce(F.lower("state") == "closed", F.lit(False)) | F.coalesce(F.size("assignees") > 0, F.lit(False))
    return rel.rewrite(rows.withColumn("state", F.coalesce(F.when(~gone, F.col("state")), F.when(gone, F.lit("closed")), F.lit("open"))), gone, {"state": F.lit("closed")}).select("evidence_id", "state")


@query("""
    SELECT event_id, (props::json ->> 'k')::int AS k, coalesce(props::json ->> 'missing', 'none') AS missing FROM events WHERE (props::json ->> 'k')::int >= 90
""")
def json_payload_fields(spark, d):
    """Fields of a JSON text with defaults."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int, missing string").alias("p"))
    return e.where("p.k >= 90").select("event_id", "p.k", F.coalesce("p.missing", F.lit("none")).alias("missing"))


@query("""
    SELECT 'both' AS side, count(*) AS n FROM (SELECT repo_full_name FROM issue_evidence INTERSECT SELECT repo_full_name FROM repo_document)
    UNION ALL SELECT 'issues', count(*) FROM (SELECT repo_full_name FROM issue_evidence EXCEPT SELECT repo_full_name FROM repo_document)
    UNION ALL SELECT 'documents', count(*) FROM (SELECT repo_full_name FROM repo_document EXCEPT SELECT repo_full_name FROM issue_evidence)
    UNION ALL SELECT 'either', count(*) FROM (SELECT repo_full_name FROM issue_evidence UNION SELECT repo_full_name FROM repo_document)
""")
def set_algebra(spark, d):
    """Intersection, differences and union of two key sets."""
    a, b = table(spark, d, "issue_evidence").select("repo_full_name").distinct(), table(spark, d, "repo_document").select("repo_full_name").distinct()
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "issues")).union(count(b.subtract(a), "documents")).union(count(a.union(b).distinct(), "either"))
