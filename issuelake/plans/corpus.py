"""Queries of collecting and indexing: file selection, discovery, caches, traces, packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelake.functions import text as tx
from issuelake.operators import allocate, records, relational as rel, sourcefiles as sf
from issuelake.plans.registry import query
from issuelake.session import table


def _sql(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


P = r"regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '')"
EXTENSIONS = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(' ' || lang || ' ', ' {p[1:]} ')" if p.startswith("=") else f"contains(lang, '{p}')" for p in parts) + f" THEN {_sql(e)}" for parts, e in sf.LANGUAGES
) + f" ELSE {_sql(sf.ANY_LANGUAGE)} END"
FILES = f"SELECT document_id, repo_full_name, size_bytes, {P} AS path, lower({P}) AS p, lower(coalesce(language, '')) AS lang FROM repo_document WHERE relative_path IS NOT NULL"
REASON = f"""
    CASE WHEN len(list_filter({_sql(sf.EXCLUDED_DIRS)}, lambda x: contains(p, x))) > 0 THEN trim(list_filter({_sql(sf.EXCLUDED_DIRS)}, lambda x: contains(p, x))[1], '/')
        WHEN len(list_filter({_sql(sf.NON_SOURCE)}, lambda x: ends_with(p, x))) > 0 THEN 'non_source_ext' WHEN len(list_filter({EXTENSIONS}, lambda x: ends_with(p, x))) = 0 THEN 'wrong_ext' ELSE 'kept' END
"""


def _files(spark, d):
    return table(spark, d, "repo_document").where("relative_path is not null").select("document_id", "repo_full_name", "size_bytes", "language", tx.plain_path(F.col("relative_path")).alias("path"))


@query(f"SELECT document_id, {EXTENSIONS} AS extensions FROM ({FILES})")
def extension_dispatch(spark, d):
    """The extensions that the language of a file stands for."""
    return _files(spark, d).select("document_id", sf.extensions_for(F.col("language")).alias("extensions"))


@query(f"SELECT repo_full_name, reason, count(*) AS n FROM (SELECT *, {REASON} AS reason FROM ({FILES})) GROUP BY 1, 2")
def source_filter_counts(spark, d):
    """How many files of each repository are kept, and how many are left out for which reason."""
    reason = F.coalesce(sf.source_reason(F.col("path"), sf.extensions_for(F.col("language"))), F.lit("kept"))
    return _files(spark, d).groupBy("repo_full_name", reason.alias("reason")).agg(F.count("*").alias("n"))


IGNORE = ["# local", "*.log", "/web/", "assets/**/*.js", "!assets/keep.js"]


@query(f"""
    WITH f AS (SELECT *, string_split(p, '/') AS parts FROM ({FILES})), g AS (SELECT *, parts[-1] AS name, parts[:len(parts) - 1] AS dirs, regexp_extract(parts[-1], '^.+([.][^.]*)$', 1) AS ext FROM f)
    SELECT document_id, CASE WHEN len(list_intersect(dirs, {_sql(sf.IGNORED_DIRS)})) > 0 THEN 'directory' WHEN list_contains({_sql(sf.IGNORED_EXTENSIONS)}, ext) THEN 'extension'
        WHEN len(list_filter({_sql(sf.GENERATED_ENDS)}, lambda x: ends_with(name, x))) > 0 THEN 'generated' WHEN len(list_intersect(dirs, ['generated', 'drift'])) > 0 AND name LIKE 'schema\\_v%' ESCAPE '\\' THEN 'schema'
        WHEN len(list_intersect(dirs, {_sql(sf.DATA_DIRS)})) > 0 AND list_contains({_sql(sf.DATA_EXTENSIONS)}, ext) AND (coalesce(size_bytes > {sf.DATA_BYTES}, false) OR len(list_intersect(dirs, {_sql(sf.TEST_DIRS)})) > 0) THEN 'fixture'
        WHEN (regexp_matches(path, '(^|/)[^/]*[.]log(/|$)') OR regexp_matches(path, '^web/') OR regexp_matches(path, '^assets/(.*/)?[^/]*[.]js(/|$)')) AND NOT regexp_matches(path, '^assets/keep[.]js(/|$)') THEN 'ignored' ELSE 'kept' END AS reason FROM g
""")
def file_filter(spark, d):
    """Which files the corpus takes, and why it leaves the others out, an ignore file included."""
    return _files(spark, d).select("document_id", F.coalesce(sf.filter_reason(F.col("path"), F.col("size_bytes"), sf.gitignore(IGNORE)), F.lit("kept")).alias("reason"))


SCORE = f"""
    (CASE WHEN len(list_intersect(string_split(p, '/'), {_sql(sf.SOURCE_ROOTS)})) > 0 THEN 15 ELSE 0 END) + (CASE WHEN string_split(p, '/')[1] = lower(string_split(repo_full_name, '/')[2]) THEN 12 ELSE 0 END)
    + (CASE WHEN len(list_filter({_sql(sf.KEYWORDS)}, lambda x: contains(p, x))) > 0 THEN 5 ELSE 0 END) - 3 * (length(path) - length(replace(path, '/', ''))) - (CASE WHEN len(list_filter({_sql(sf.PERIPHERAL)}, lambda x: contains(p, x))) > 0 THEN 8 ELSE 0 END)
"""
TERMS = ["cache", "panel", "route", "buffer", "snapshot"]
MENTIONED = r"list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+\.(?:py|js|ts|go|rs|java|c)'))"


@query(f"""
    WITH f AS (SELECT DISTINCT repo_full_name, path, p FROM ({FILES}) WHERE {REASON} = 'kept'),
    t AS (SELECT DISTINCT repo_full_name, unnest({MENTIONED}) AS path FROM issue_evidence),
    s AS (SELECT f.*, t.path IS NOT NULL AS traced, len(list_filter({_sql(TERMS)}, lambda x: contains(p, x))) AS hits, {SCORE} AS structure FROM f LEFT JOIN t USING (repo_full_name, path)),
    r AS (SELECT *, CASE WHEN traced THEN 1 WHEN hits > 0 THEN 2 ELSE 3 END AS tier FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY repo_full_name ORDER BY tier, CASE tier WHEN 2 THEN hits WHEN 3 THEN structure ELSE 0 END DESC, path) AS place FROM r)
    SELECT repo_full_name, path, tier::int AS tier, structure::int AS structure, place::int AS place FROM n WHERE place <= 20
""")
def tiered_files(spark, d):
    """Twenty files of every repository: those that issues point to, those with words in question, and those that stand well in the tree."""
    files = _files(spark, d)
    kept = files.where(sf.source_reason(F.col("path"), sf.extensions_for(F.col("language"))).isNull()).select("repo_full_name", "path").distinct()
    traced = table(spark, d, "issue_evidence").select("repo_full_name", F.explode(tx.mentioned_paths(F.col("body"))).alias("path")).distinct().withColumn("t", F.lit(True))
    p = F.lower("path")
    hits = F.size(F.filter(F.array(*[F.lit(x) for x in TERMS]), lambda x: p.contains(x)))
    rows = kept.join(traced, ["repo_full_name", "path"], "left").select("repo_full_name", "path", F.coalesce("t", F.lit(False)).alias("traced"), hits.alias("hits"), sf.structural_score(F.col("path"), F.substring_index("repo_full_name", "/", -1)).alias("structure"))
    return sf.selected(rows, ["repo_full_name"], 20).select("repo_full_name", "path", "tier", "structure", "place")


@query("""
    SELECT i.repo_full_name AS full_name, min(i.evidence_id) AS first_seen FROM issue_evidence i
    WHERE coalesce(i.repo_full_name, '') <> '' AND i.repo_full_name NOT IN (SELECT repo_name FROM repo_snapshot WHERE status = 'ACTIVE' AND parser_version = 'p2' AND repo_name IS NOT NULL) AND NOT coalesce(list_contains(i.labels, 'wontfix'), false)
    GROUP BY 1
""")
def discovery_filter(spark, d):
    """Repositories not known yet, each where it was first seen; rows without a name or ruled out are passed over."""
    seen = table(spark, d, "issue_evidence").where((F.coalesce("repo_full_name", F.lit("")) != "") & ~F.coalesce(F.array_contains("labels", "wontfix"), F.lit(False))).groupBy(F.col("repo_full_name").alias("full_name")).agg(F.min("evidence_id").alias("first_seen"))
    known = table(spark, d, "repo_snapshot").where("status = 'ACTIVE' and parser_version = 'p2'").select(F.col("repo_name").alias("full_name"))
    return rel.delete_keys(seen, known, ["full_name"])


@query("SELECT coalesce(language, 'Other') AS pool, count(*) AS found, count(DISTINCT full_name) AS n_unique, count(DISTINCT full_name) FILTER (WHERE stars >= 100) AS known FROM repo_metrics GROUP BY 1")
def pool_counts(spark, d):
    """The sizes of the pools and how many of each are distinct."""
    return table(spark, d, "repo_metrics").groupBy(F.coalesce("language", F.lit("Other")).alias("pool")).agg(F.count("*").alias("found"), F.count_distinct("full_name").alias("n_unique"), F.count_distinct(F.when(F.col("stars") >= 100, F.col("full_name"))).alias("known"))


@query("""
    SELECT s.snapshot_id, s.repo_name, s.status FROM repo_snapshot s
    WHERE NOT EXISTS (SELECT 1 FROM repo_snapshot a WHERE a.status = 'ACTIVE' AND a.repo_name = s.repo_name AND a.commit_sha = s.commit_sha AND s.status <> 'ACTIVE')
""")
def purge_same_commit(spark, d):
    """Snapshots that stay when those of an active commit that are not active are deleted."""
    s = table(spark, d, "repo_snapshot").select("snapshot_id", "repo_name", "commit_sha", "status")
    gone = s.where("status = 'ACTIVE' and commit_sha is not null").select("repo_name", "commit_sha").distinct().withColumn("other", F.lit(True))
    j = s.withColumn("other", F.col("status") != "ACTIVE")
    return rel.delete_keys(j, gone, ["repo_name", "commit_sha", "other"]).select("snapshot_id", "repo_name", "status")


LAST = "SELECT * FROM issue_evidence QUALIFY row_number() OVER (PARTITION BY repo_full_name, github_issue_number ORDER BY fetched_at DESC NULLS LAST, evidence_id DESC) = 1"


@query(f"""
    WITH c AS ({LAST}) SELECT i.evidence_id, c.evidence_id AS cached_id, coalesce(c.updated_at = i.updated_at AND coalesce(c.body, '') <> '', false) AS hit
    FROM issue_evidence i LEFT JOIN c ON c.repo_full_name = i.repo_full_name AND c.github_issue_number = i.github_issue_number
""")
def fast_path_cache(spark, d):
    """Whether what is stored of an issue may be used again: the same state of it, with a text."""
    rows = table(spark, d, "issue_evidence").select("evidence_id", "repo_full_name", "github_issue_number", "updated_at", "body", "fetched_at")
    last = rel.first_of(rows, ["repo_full_name", "github_issue_number"], [F.desc_nulls_last("fetched_at"), F.desc("evidence_id")])
    cached = last.select("repo_full_name", "github_issue_number", F.col("evidence_id").alias("cached_id"), F.col("updated_at").alias("u"), (F.coalesce("body", F.lit("")) != "").alias("text"))
    j = rows.drop("body", "fetched_at").join(cached, ["repo_full_name", "github_issue_number"], "left")
    return j.select("evidence_id", "cached_id", F.coalesce((F.col("u") == F.col("updated_at")) & F.col("text"), F.lit(False)).alias("hit"))


@query("""
    WITH a AS (SELECT dataset_id, reasoning, fit_label, confidence FROM annotation QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY annotated_at DESC, coalesce(reasoning, '')) = 1)
    SELECT r.record_id, coalesce(a.fit_label IS NOT NULL AND coalesce(a.confidence >= 0.5, false) AND coalesce(a.reasoning, '') <> '', false) AS hit FROM dataset_record r LEFT JOIN a ON a.dataset_id = r.dataset_id
""")
def explanation_cache(spark, d):
    """Whether the newest explanation of a record may be used again: labelled, sure enough, with a text."""
    a = rel.first_of(table(spark, d, "annotation").select("dataset_id", "reasoning", "fit_label", "confidence", "annotated_at"), ["dataset_id"], [F.desc("annotated_at"), F.coalesce("reasoning", F.lit(""))])
    good = F.col("fit_label").isNotNull() & F.coalesce(F.col("confidence") >= 0.5, F.lit(False)) & (F.coalesce("reasoning", F.lit("")) != "")
    return table(spark, d, "dataset_record").select("record_id", "dataset_id").join(a.select("dataset_id", good.alias("good")), "dataset_id", "left").select("record_id", F.coalesce("good", F.lit(False)).alias("hit"))


@query("""
    WITH f AS (SELECT evidence_id, md5(coalesce(updated_at, '')) AS etag, lag(md5(coalesce(updated_at, ''))) OVER (PARTITION BY repo_full_name, github_issue_number ORDER BY fetched_at, evidence_id) AS held FROM issue_evidence)
    SELECT evidence_id, etag, coalesce(etag = held, false) AS not_modified FROM f
""")
def etag_cache(spark, d):
    """Which fetches bring nothing new: the tag is that of the fetch before."""
    rows = table(spark, d, "issue_evidence").select("evidence_id", "repo_full_name", "github_issue_number", "fetched_at", F.md5(F.coalesce("updated_at", F.lit(""))).alias("etag"))
    return records.not_modified(rows, ["repo_full_name", "github_issue_number"], [F.col("fetched_at"), F.col("evidence_id")], "etag").select("evidence_id", "etag", "not_modified")


@query("""
    WITH f AS (SELECT evidence_id, title FROM issue_evidence WHERE lower(state) = 'open' AND list_contains(labels, 'no such label')), a AS (SELECT evidence_id, title FROM issue_evidence ORDER BY evidence_id LIMIT 10)
    SELECT * FROM f UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM f)
""")
def category_feed(spark, d):
    """The feed of a category, or any ten rows where the category has none."""
    rows = table(spark, d, "issue_evidence").select("evidence_id", "title", "state", "labels")
    wanted = rows.where((F.lower("state") == "open") & F.array_contains("labels", "no such label")).select("evidence_id", "title")
    return records.or_else(wanted, rows.orderBy("evidence_id").limit(10).select("evidence_id", "title"))


@query("""
    SELECT count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error' AND value > 10) AS limited, round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS mean_latency, round(avg((props::json ->> 'k')::int), 4) AS mean_tokens FROM events
""")
def scale_test_summary(spark, d):
    """Successes, refusals and means of a run of calls."""
    e = table(spark, d, "events").select("event_type", "value", F.from_json("props", "k int")["k"].alias("k"))
    failed = F.col("event_type") == "error"
    return e.agg(F.count("*").alias("calls"), F.count_if(~failed).alias("succeeded"), F.count_if(failed & (F.col("value") > 10)).alias("limited"), F.round(F.avg(F.when(~failed, F.col("value"))), 4).alias("mean_latency"), F.round(F.avg("k"), 4).alias("mean_tokens"))


def _traces(spark, d):
    """Nested traces of issues: a stage that did not happen is null."""
    i = table(spark, d, "issue_evidence")
    blank = F.coalesce("body", F.lit("")) == ""
    stage = lambda when, **f: F.when(when, F.struct(*[c.alias(n) for n, c in f.items()]))
    return i.select(
        F.col("evidence_id").cast("string").alias("trace_id"), F.coalesce("repo_full_name", F.lit("")).alias("repo"),
        stage(F.col("title").isNotNull(), decision=F.when(blank, "REJECT").otherwise("PASS"), reason=F.when(blank, "no body")).alias("prefilter"),
        stage(F.col("title").isNotNull() & ~blank, decision=F.lit("PASS"), files=F.array_sort(tx.mentioned_paths(F.col("body"))), hits=F.size(tx.mentioned_paths(F.col("body"))), reused=F.size("assignees") > 0).alias("retrieval"),
    )


@query(rf"""
    WITH t AS (SELECT *, title IS NOT NULL AS one, title IS NOT NULL AND coalesce(body, '') <> '' AS two FROM issue_evidence)
    SELECT evidence_id::varchar AS trace_id, coalesce(repo_full_name, '') AS repo, CASE WHEN NOT one THEN 'SKIPPED' WHEN two THEN 'PASS' ELSE 'REJECT' END AS prefilter_decision, CASE WHEN one AND NOT two THEN 'no body' ELSE '' END AS prefilter_reason,
        CASE WHEN two THEN 'PASS' ELSE 'SKIPPED' END AS retrieval_decision, CASE WHEN two THEN coalesce(array_to_string(list_sort({MENTIONED}), '; '), '') ELSE '' END AS retrieval_files, CASE WHEN two THEN len({MENTIONED})::int ELSE 0 END AS retrieval_hits, CASE WHEN two THEN coalesce(len(assignees) > 0, false) ELSE false END AS retrieval_reused FROM t
""")
def trace_rows(spark, d):
    """Nested traces as flat rows, with what stands for stages that did not happen."""
    return records.flat_rows(_traces(spark, d))


@query(rf"""
    WITH t AS (SELECT *, title IS NOT NULL AS one, title IS NOT NULL AND coalesce(body, '') <> '' AS two FROM issue_evidence)
    SELECT * FROM (SELECT 'prefilter' AS stage, CASE WHEN NOT one THEN 'SKIPPED' WHEN two THEN 'PASS' ELSE 'REJECT' END AS decision, count(*) AS n FROM t GROUP BY 2) UNION ALL SELECT * FROM (SELECT 'retrieval', CASE WHEN two THEN 'PASS' ELSE 'SKIPPED' END, count(*) FROM t GROUP BY 2)
""")
def trace_summary(spark, d):
    """How many traces took which decision at each stage."""
    return records.decisions(records.flat_rows(_traces(spark, d)))


@query(r"""
    SELECT record_id, 'Title: ' || coalesce(title, '') || chr(10) || 'Body: ' || substr(coalesce(body, ''), 1, 1200) || chr(10) || 'Comments: ' || array_to_string(list_transform(coalesce(comments, [])[1:2], lambda c: substr(c, 1, 150)), ' | ')
        || chr(10) || 'Labels: ' || array_to_string(list_transform(coalesce(labels, [])[1:5], lambda l: l.name), ', ') AS prompt FROM dataset_record
""")
def prompt_rows(spark, d):
    """Records as texts for a model: bounded body, two comments, five labels."""
    c = F.transform(F.slice(F.coalesce("comments", F.array().cast("array<string>")), 1, 2), lambda x: F.substring(x, 1, 150))
    labels = F.coalesce(F.transform(F.slice("labels", 1, 5), lambda x: x["name"]), F.array().cast("array<string>"))
    text = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nBody: "), F.substring(F.coalesce("body", F.lit("")), 1, 1200), F.lit("\nComments: "), F.array_join(c, " | "), F.lit("\nLabels: "), F.array_join(labels, ", "))
    return table(spark, d, "dataset_record").select("record_id", text.alias("prompt"))


#: The fold that packs evidence, once for the code and once for the tests: what fits its share is taken, or is among the first two; each chunk costs fifty tokens more.
PACKED = """
    c AS (SELECT DISTINCT repo_name, chunk_id, coalesce(contains(lower(file_path), 'test'), false) OR coalesce(info_class = 'TESTS', false) AS test, greatest(1, length(raw_content) // 4)::bigint AS tokens FROM code_chunk WHERE raw_content IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY repo_name, test ORDER BY tokens DESC, chunk_id) AS pos FROM c),
    walk(repo_name, test, pos, spent, taken, took) AS (
        SELECT repo_name, test, 0::bigint, 0::bigint, 0, false FROM (SELECT DISTINCT repo_name, test FROM o)
        UNION ALL SELECT x.repo_name, x.test, x.at, CASE WHEN ok THEN x.spent + x.tokens + 50 ELSE x.spent END, CASE WHEN ok THEN x.taken + 1 ELSE x.taken END, ok
        FROM (SELECT w.*, o.tokens, o.pos AS at, w.spent + o.tokens + 50 <= (CASE WHEN o.test THEN 4200 ELSE 9800 END) OR w.taken < 2 AS ok FROM walk w JOIN o ON o.repo_name IS NOT DISTINCT FROM w.repo_name AND o.test = w.test AND o.pos = w.pos + 1) x
    ), packed AS (SELECT o.repo_name, o.test, o.chunk_id, o.tokens, o.pos FROM walk w JOIN o ON o.repo_name IS NOT DISTINCT FROM w.repo_name AND o.test = w.test AND o.pos = w.pos WHERE w.took)
"""


def _packed(spark, d):
    path, info = F.lower("file_path"), F.col("info_class")
    test = F.coalesce(path.contains("test"), F.lit(False)) | F.coalesce(info == "TESTS", F.lit(False))
    c = table(spark, d, "code_chunk").where("raw_content is not null").select("repo_name", "chunk_id", test.alias("test"), tx.token_estimate(F.col("raw_content")).cast("bigint").alias("tokens")).distinct()
    return allocate.pack_in_order(c, ["repo_name", "test"], [F.desc("tokens"), F.col("chunk_id")], F.when(F.col("test"), 4_200).otherwise(9_800))


@query(f"WITH RECURSIVE {PACKED} SELECT repo_name, chunk_id, test FROM packed")
def evidence_pack(spark, d):
    """The chunks of every repository, the largest first, that go into a package of 14,000 tokens: seven tenths for code, the rest for tests."""
    return _packed(spark, d).select("repo_name", "chunk_id", "test")


@query(f"""
    WITH RECURSIVE {PACKED}, t AS (SELECT repo_name, coalesce(sum(tokens) FILTER (WHERE test), 0) AS tests FROM packed GROUP BY 1),
    r AS (SELECT p.*, row_number() OVER w AS rn, sum(p.tokens) OVER (w ROWS UNBOUNDED PRECEDING) + t.tests AS cum FROM packed p JOIN t ON t.repo_name IS NOT DISTINCT FROM p.repo_name WHERE NOT p.test WINDOW w AS (PARTITION BY p.repo_name ORDER BY p.pos))
    SELECT repo_name, chunk_id, test FROM r WHERE rn = 1 OR cum <= 6000 UNION ALL SELECT repo_name, chunk_id, test FROM packed WHERE test
""")
def evidence_reduced(spark, d):
    """The package cut to 6,000 tokens: the last of the code goes first, the best of it and the tests stay."""
    return allocate.reduced(_packed(spark, d), ["repo_name"], 6_000).select("repo_name", "chunk_id", "test")
