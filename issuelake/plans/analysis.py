"""Queries of profiling, evaluation, chunking, allocation, traces and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelake.functions import text as tx
from issuelake.operators import allocate, chunking, evaluate, learn, profile, ranking
from issuelake.plans.registry import query
from issuelake.session import table

WORDS = "len(list_filter(regexp_split_to_array(body, '[ \\t\\r\\n]+'), lambda x: x <> ''))"


@query(f"""
    WITH w AS (SELECT *, coalesce({WORDS}, 0) AS n FROM issue_evidence)
    SELECT count(*) AS total, count(DISTINCT repo_full_name) AS repos, count(*) FILTER (WHERE title IS NULL OR title = '') AS missing_title, count(*) FILTER (WHERE body IS NULL OR body = '') AS missing_body,
        round(100.0 * count(*) FILTER (WHERE comments_count > 0) / count(*), 2)::double AS with_comments_pct, round(avg(n), 4) AS avg_words, (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] FROM w)::bigint AS median_words,
        count(*) FILTER (WHERE n < 20) AS short_bodies, count(*) FILTER (WHERE n > 150) AS long_bodies FROM w
""")
def corpus_profile(spark, d):
    """One row about the whole collection."""
    w = table(spark, d, "issue_evidence").select("repo_full_name", "title", "comments_count", F.col("body").isNull().alias("nb"), (F.col("body") == "").alias("eb"), tx.word_count(F.col("body")).cast("bigint").alias("n"))
    one = w.agg(
        F.count("*").alias("total"), F.count_distinct("repo_full_name").alias("repos"), F.count_if(F.col("title").isNull() | (F.col("title") == "")).alias("missing_title"), F.count_if(F.col("nb") | F.col("eb")).alias("missing_body"),
        F.round(100.0 * F.count_if(F.col("comments_count") > 0) / F.count("*"), 2).cast("double").alias("with_comments_pct"), F.round(F.avg("n"), 4).alias("avg_words"), F.count_if(F.col("n") < 20).alias("short_bodies"), F.count_if(F.col("n") > 150).alias("long_bodies"),
    )
    return one.join(F.broadcast(profile.upper_median(w, "n").withColumnRenamed("median", "median_words")))


@query("SELECT coalesce(lang, '(none)') AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::double AS pct FROM documents GROUP BY lang")
def group_distribution(spark, d):
    """Languages with their counts and shares."""
    return profile.distribution(table(spark, d, "documents"), F.coalesce("lang", F.lit("(none)"))).withColumn("pct", F.col("pct").cast("double"))


@query("""
    WITH r AS (SELECT repo_full_name AS value, count(*) AS n FROM issue_evidence GROUP BY 1), l AS (SELECT lower(state) AS value, count(*) AS n FROM issue_evidence GROUP BY 1)
    SELECT * FROM (SELECT 'repository' AS dimension, value, n, round(n / (SELECT sum(n) FROM r), 4)::double AS share, round(n / (SELECT sum(n) FROM r), 4) > 0.15 AS warning FROM r WHERE value IS NOT NULL ORDER BY n DESC, value LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'state', value, n, round(n / (SELECT sum(n) FROM l), 4)::double, round(n / (SELECT sum(n) FROM l), 4) > 0.5 FROM l WHERE value IS NOT NULL ORDER BY n DESC, value LIMIT 1)
""")
def concentration_warnings(spark, d):
    """The largest share of any repository and of any state, and whether it is too large."""
    return profile.shares_above(table(spark, d, "issue_evidence"), {"repository": (F.col("repo_full_name"), 0.15), "state": (F.lower("state"), 0.5)})


@query("""
    WITH t AS (SELECT repo_full_name, state, comments_count, coalesce(try_strptime(created_at, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(created_at, '%Y-%m-%d %H:%M:%S')) AS c, coalesce(try_strptime(updated_at, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(updated_at, '%Y-%m-%d %H:%M:%S')) AS u FROM issue_evidence)
    SELECT repo_full_name, count(*) FILTER (WHERE lower(state) = 'closed') AS closed, count(*) FILTER (WHERE c >= TIMESTAMP '2026-01-01') AS recent, round(avg(datesub('day', c, u)) FILTER (WHERE u >= c), 4) AS mean_days, max(datesub('day', c, u))::bigint AS most_days,
        (list_sort(list(datesub('day', c, u)) FILTER (WHERE lower(state) = 'closed' AND u >= c)))[count(*) FILTER (WHERE lower(state) = 'closed' AND u >= c) // 2 + 1]::bigint AS median_close_days FROM t GROUP BY 1
""")
def activity_rollup(spark, d):
    """Conditional counts and whole elapsed days per repository."""
    c, u = tx.iso_time(F.col("created_at")), tx.iso_time(F.col("updated_at"))
    t = table(spark, d, "issue_evidence").select("repo_full_name", F.lower("state").alias("s"), c.alias("c"), u.alias("u")).withColumn("days", F.expr("timestampdiff(DAY, c, u)"))
    return t.groupBy("repo_full_name").agg(
        F.count_if(F.col("s") == "closed").alias("closed"), F.count_if(F.col("c") >= F.lit("2026-01-01").cast("timestamp")).alias("recent"),
        F.round(F.avg(F.when(F.col("u") >= F.col("c"), F.col("days"))), 4).alias("mean_days"), F.max("days").alias("most_days"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY if(s = 'closed' and u >= c, days, null) DESC)").cast("bigint").alias("median_close_days"),
    )


@query(r"""
    WITH p AS (SELECT repo_full_name, loc, language, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') AS p FROM repo_document)
    SELECT repo_full_name, count(*) AS files, count(DISTINCT CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END) AS directories, max(length(p) - length(replace(p, '/', '')))::bigint AS depth,
        coalesce(sum(loc), 0)::bigint AS loc, coalesce(sum(loc) FILTER (WHERE lower(language) = 'python'), 0)::bigint AS python_loc FROM p GROUP BY 1
""")
def structural_metrics(spark, d):
    """Files, directories, depth and lines of every repository."""
    p = table(spark, d, "repo_document").select("repo_full_name", "loc", "language", tx.plain_path(F.col("relative_path")).alias("p"))
    folder = F.when(F.col("p").contains("/"), F.regexp_replace("p", "/[^/]*$", "")).when(F.col("p").isNotNull(), "").otherwise("")
    return p.groupBy("repo_full_name").agg(
        F.count("*").alias("files"), F.count_distinct(folder).alias("directories"), F.max(F.length("p") - F.length(F.replace("p", F.lit("/"), F.lit("")))).cast("bigint").alias("depth"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum(F.when(F.lower("language") == "python", F.col("loc"))), F.lit(0)).alias("python_loc"),
    )


@query("""
    SELECT info_class, parser_strategy, count(*) AS chunks, min(token_estimate)::bigint AS least, round(avg(token_estimate), 4) AS mean, max(token_estimate)::bigint AS most FROM code_chunk GROUP BY 1, 2
""")
def chunk_summary(spark, d):
    """Chunks and their sizes by class and parser."""
    return table(spark, d, "code_chunk").groupBy("info_class", "parser_strategy").agg(
        F.count("*").alias("chunks"), F.min("token_estimate").cast("bigint").alias("least"), F.round(F.avg("token_estimate"), 4).alias("mean"), F.max("token_estimate").cast("bigint").alias("most")
    )


@query("""
    SELECT count(*) AS discovered, count(DISTINCT user_id) AS actors, count(*) FILTER (WHERE event_type = 'view') AS viewed, count(*) FILTER (WHERE event_type = 'click') AS clicked, count(*) FILTER (WHERE event_type = 'purchase') AS accepted,
        count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'error' AND value > 10) AS failed_large FROM events
""")
def funnel_counts(spark, d):
    """The stages of a funnel in one pass."""
    t = F.col("event_type")
    return table(spark, d, "events").agg(
        F.count("*").alias("discovered"), F.count_distinct("user_id").alias("actors"), F.count_if(t == "view").alias("viewed"), F.count_if(t == "click").alias("clicked"), F.count_if(t == "purchase").alias("accepted"),
        F.count_if(t == "error").alias("failed"), F.count_if((t == "error") & (F.col("value") > 10)).alias("failed_large"),
    )


@query("""
    SELECT reason, count(*) AS n FROM (
        SELECT unnest(list_filter([CASE WHEN title IS NULL OR title = '' THEN 'no_title' END, CASE WHEN body IS NULL OR body = '' THEN 'no_body' END, CASE WHEN lower(state) = 'closed' THEN 'closed' END, CASE WHEN len(assignees) > 0 THEN 'assigned' END], lambda x: x IS NOT NULL)) AS reason FROM issue_evidence
    ) GROUP BY reason
""")
def rejection_breakdown(spark, d):
    """How often each reason to reject an issue holds."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reasons = F.array_compact(F.array(F.when(blank("title"), "no_title"), F.when(blank("body"), "no_body"), F.when(F.lower("state") == "closed", "closed"), F.when(F.size("assignees") > 0, "assigned")))
    return table(spark, d, "issue_evidence").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
    SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'PUBLISHED' ELSE 'LAST_' || upper(arg_max(event_type, event_id)) END AS final_state, count(*) AS steps FROM events GROUP BY user_id
""")
def trace_final_states(spark, d):
    """The last state of every trace, unless one step decides."""
    e = table(spark, d, "events")
    last = F.concat(F.lit("LAST_"), F.upper(F.max_by("event_type", "event_id")))
    return e.groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "purchase"), "PUBLISHED").otherwise(last).alias("final_state"), F.count("*").alias("steps"))


@query("""
    SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1
""")
def latency_percentiles(spark, d):
    """Interpolated percentiles per kind of event."""
    return profile.percentiles(table(spark, d, "events"), ["event_type"], "value", (0.5, 0.95, 0.99))


LABELS = "SELECT upper(fit_label) AS truth, CASE WHEN confidence >= 0.8 THEN 'HIGH_FIT' WHEN confidence >= 0.5 THEN 'MEDIUM_FIT' ELSE 'LOW_FIT' END AS predicted FROM annotation WHERE fit_label IS NOT NULL"


def _labels(spark, d):
    c = F.col("confidence")
    return table(spark, d, "annotation").where("fit_label is not null").select(F.upper("fit_label").alias("truth"), F.when(c >= 0.8, "HIGH_FIT").when(c >= 0.5, "MEDIUM_FIT").otherwise("LOW_FIT").alias("predicted"))


@query(f"SELECT truth, predicted, count(*) AS n FROM ({LABELS}) GROUP BY 1, 2")
def confusion_matrix(spark, d):
    """Real against predicted labels."""
    return evaluate.confusion(_labels(spark, d), F.col("truth"), F.col("predicted"))


@query(f"""
    WITH m AS ({LABELS}), l AS (SELECT truth AS label FROM m UNION SELECT predicted FROM m),
    s AS (SELECT label, (SELECT count(*) FROM m WHERE truth = label) AS support, (SELECT count(*) FROM m WHERE predicted = label) AS said, (SELECT count(*) FROM m WHERE truth = label AND predicted = label) AS hit FROM l),
    q AS (SELECT label, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s)
    SELECT label, support::bigint AS support, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM q
""")
def class_f1(spark, d):
    """Precision, recall and F1 of each label."""
    return evaluate.class_scores(confusion_matrix(spark, d))


@query(f"SELECT truth || ' -> ' || predicted AS transition, count(*) AS n FROM ({LABELS}) WHERE truth <> predicted GROUP BY 1")
def error_transitions(spark, d):
    """What is taken for what."""
    return confusion_matrix(spark, d).where("truth <> predicted").select(F.concat_ws(" -> ", "truth", "predicted").alias("transition"), "n")


@query("""
    WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND text <> ''), s AS (SELECT doc_id, l, unnest(range(0, len(l), 35)) AS s FROM t)
    SELECT doc_id, (s + 1)::int AS start_line, least(s + 40, len(l))::int AS end_line, length(array_to_string(l[s + 1:s + 40], chr(10)))::int AS chars FROM s
""")
def line_windows_40_5(spark, d):
    """Windows of forty lines that share five."""
    return ranking.line_windows(table(spark, d, "documents").select("doc_id", "text"), F.col("text")).select("doc_id", "start_line", "end_line", F.length("content").alias("chars"))


@query(r"""
    WITH l AS (SELECT document_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM repo_document WHERE content IS NOT NULL AND content <> '' AND lower(relative_path) LIKE '%.md'),
    s AS (SELECT *, sum(regexp_matches(l, '^#{1,4} ')::int) OVER (PARTITION BY document_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM l)
    SELECT document_id, section::int AS section, min(line)::int AS start_line, max(line)::int AS end_line, max(CASE WHEN regexp_matches(l, '^#{1,4} ') THEN trim(regexp_replace(l, '^#{1,4} ', '')) END) AS heading, length(string_agg(l, chr(10) ORDER BY line))::int AS chars FROM s GROUP BY 1, 2
""")
def md_sections(spark, d):
    """The sections of Markdown files."""
    docs = table(spark, d, "repo_document").where("lower(relative_path) like '%.md'")
    return ranking.heading_sections(docs, ["document_id"], F.col("content")).select("document_id", "section", "start_line", "end_line", "heading", F.length("content").alias("chars"))


@query(r"""
    SELECT DISTINCT chunk_id, substr(sha256(coalesce(repo_name, '') || ':' || coalesce(file_path, '') || ':' || coalesce(start_line::varchar, '') || ':' || coalesce(end_line::varchar, '') || ':' || coalesce(qualified_symbol_name, '')), 1, 16) AS derived_id,
        sha256(raw_content) AS content_hash FROM code_chunk
""")
def chunk_ids(spark, d):
    """Ids and digests derived from what a chunk is."""
    c = table(spark, d, "code_chunk")
    return c.select("chunk_id", chunking.chunk_id(*[F.col(x) for x in ("repo_name", "file_path", "start_line", "end_line", "qualified_symbol_name")]).alias("derived_id"), F.sha2("raw_content", 256).alias("content_hash")).distinct()


@query(r"""
    SELECT DISTINCT chunk_id, lower(trim(regexp_replace(regexp_replace(translate(qualified_symbol_name, '_-', '  '), '([a-z])([A-Z])', '\1 \2', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS words FROM code_chunk
""")
def split_identifiers(spark, d):
    """Symbol names as words."""
    return table(spark, d, "code_chunk").select("chunk_id", tx.split_identifiers(F.col("qualified_symbol_name")).alias("words")).distinct()


CLASS = r"""CASE WHEN regexp_matches(lower(p), '(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*$|[._-](test|spec)\.[a-z]+$') THEN 'TESTS' WHEN regexp_matches(lower(p), '\.(md|rst|txt|adoc)$|(^|/)docs?/') THEN 'DOCUMENTATION'
    WHEN regexp_matches(lower(p), '\.(ya?ml|toml|json|ini|cfg|lock)$') THEN 'CONFIGURATION' ELSE 'SOURCE_CODE' END"""
REASON = r"""CASE WHEN regexp_matches(lower(p), '(^|/)(node_modules|vendor|third_party|dist|build|\.git)/') THEN 'directory' WHEN regexp_matches(lower(p), '\.(png|jpe?g|gif|svg|ico|lock|map|css|html|md|txt)$|\.min\.js$') THEN 'not_source'
    WHEN NOT regexp_matches(lower(p), '\.(py|js|ts|go|rs|java|c)$') THEN 'extension' END"""


@query(rf"SELECT document_id, {CLASS} AS info_class, coalesce({REASON}, 'kept') AS reason FROM (SELECT document_id, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') AS p FROM repo_document)")
def info_class(spark, d):
    """What kind of file a path names, and why it would be left out."""
    p = tx.plain_path(F.col("relative_path"))
    return table(spark, d, "repo_document").select("document_id", chunking.information_class(p).alias("info_class"), F.coalesce(chunking.kept_or_reason(p), F.lit("kept")).alias("reason"))


@query()
def ast_chunks(spark, d):
    """Symbols of the Python files that parse, windows of all other files and of large symbols."""
    docs = table(spark, d, "repo_document").select("document_id", "relative_path", "content")
    return chunking.symbol_chunks(docs, "document_id", "relative_path", "content")


@query()
def two_stage_budget(spark, d):
    """Chunks admitted per file within the token budget of a repository."""
    c = table(spark, d, "code_chunk").where("file_path is not null").select("repo_name", "file_path", "info_class", "start_line", "chunk_id", tx.token_estimate(F.col("raw_content")).alias("tokens")).where("tokens is not null").distinct()
    return allocate.two_stage_budget(c, 20_000)


@query()
def balanced_select(spark, d):
    """Forty repositories, as evenly as the languages allow."""
    return allocate.balanced_select(table(spark, d, "repo_metrics").select("full_name", "language", "stars"), "language", [F.desc_nulls_last("stars"), F.col("full_name")], 40)


@query()
def holdout_split(spark, d):
    """Repositories held out for validation and test within each language."""
    rows = table(spark, d, "repo_document").select("document_id", "repo_full_name", F.coalesce("language", F.lit("Other")).alias("language"))
    return allocate.holdout_split(rows, "repo_full_name", "language", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query()
def quota_simulation(spark, d):
    """How long each event waits for the rate limits of its user."""
    return allocate.quota_simulation(table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("c", F.col("value").cast("bigint")), "user_id", "t", "c")


@query()
def tfidf_lr(spark, d):
    """Labels predicted from the reasoning of annotations: fitted on three quarters of the datasets, counted on the rest."""
    rows = table(spark, d, "annotation").where("fit_label is not null and reasoning is not null").select(F.upper("fit_label").alias("truth"), "reasoning", (F.pmod(F.xxhash64("dataset_id"), F.lit(4)) == 0).alias("held"))
    code = F.when(F.col("truth") == "HIGH_FIT", 0.0).when(F.col("truth") == "MEDIUM_FIT", 1.0).otherwise(2.0)
    rows = rows.withColumn("y", code)
    model = learn.fit(rows.where("not held"), "reasoning", "y")
    return model.transform(rows.where("held")).groupBy("truth", F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))
