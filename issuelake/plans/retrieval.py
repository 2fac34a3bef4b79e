"""Queries of retrieval: vectors, words, fusion, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelake.functions import text as tx
from issuelake.operators import ranking, relational as rel, retrieval as ret
from issuelake.plans.registry import query
from issuelake.session import table

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
WEIGHTS = {"readme": 1.1, "issue_thread": 1.0, "review_comment": 0.9}
SIM = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"


@query(f"SELECT e.vec_id, {SIM} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY similarity DESC, vec_id LIMIT 20")
def knn_topk(spark, d):
    """The vectors nearest to one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ret.nearest(e, e.where("vec_id = 7"), 20).withColumn("similarity", F.round("similarity", 6))


@query(f"""
    SELECT query_id, vec_id, similarity, rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, {SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, e.vec_id) AS rank
        FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 10
""")
def knn_topk_multi(spark, d):
    """The ten nearest of every vector whose id is divisible by 20, among all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ret.nearest_each(e, e.where("vec_id % 20 = 0"), 10).withColumnRenamed("id", "vec_id")


LEX = f"SELECT doc_id, len(list_filter(t, lambda x: x IN ('cache', 'panel')))::int AS rank_score FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE list_contains(t, 'cache') AND list_contains(t, 'panel')"


@query(f"{LEX} ORDER BY rank_score DESC, doc_id LIMIT 20")
def lexical_and_topk(spark, d):
    """Documents with all words, by frequency."""
    return ret.matching_all(table(spark, d, "documents"), ["cache", "panel"], "doc_id", F.col("text"), 20)


# of two words, the minimal covers are the neighbouring hits of different words
@query(f"""
    WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w, generate_subscripts({TOKENS}, 1) AS p FROM documents), h AS (SELECT * FROM t WHERE w IN ('cache', 'panel')),
    n AS (SELECT *, lag(w) OVER o AS w0, lag(p) OVER o AS p0 FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p))
    SELECT doc_id, round(coalesce(sum(0.1::double / (p - p0)) FILTER (WHERE w <> w0), 0), 6) AS rank_score FROM n GROUP BY doc_id HAVING count(DISTINCT w) = 2 ORDER BY rank_score DESC, doc_id LIMIT 20
""")
def lexical_cover_density(spark, d):
    """Documents with all words, by how close together these stand."""
    return ret.cover_density(table(spark, d, "documents"), ["cache", "panel"], "doc_id", F.col("text"), 20)


RANKED = f"""
    v AS (SELECT e.vec_id AS doc_id, row_number() OVER (ORDER BY {SIM} DESC, e.vec_id) AS vrank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q QUALIFY vrank <= 60),
    l AS (SELECT doc_id, row_number() OVER (ORDER BY rank_score DESC, doc_id) AS lrank FROM ({LEX}) QUALIFY lrank <= 60),
    r AS (SELECT coalesce(v.doc_id, l.doc_id) AS doc_id, vrank, lrank, coalesce(1.0::double / (60 + vrank), 0) + coalesce(1.0::double / (60 + lrank), 0) AS raw_rrf_score FROM v FULL JOIN l ON v.doc_id = l.doc_id)
"""


def _fused(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    docs = table(spark, d, "documents")
    w = ranking.Window
    vector = ret.nearest(e, e.where("vec_id = 7"), 60).withColumn("similarity", F.round("similarity", 6)).select(F.col("vec_id").alias("doc_id"), F.row_number().over(w.orderBy(F.desc("similarity"), "vec_id")).alias("vrank"))
    lexical = ret.matching_all(docs, ["cache", "panel"], "doc_id", F.col("text"), 60).select("doc_id", F.row_number().over(w.orderBy(F.desc("rank_score"), "doc_id")).alias("lrank"))
    return docs, ret.fuse(vector, lexical, "doc_id")


@query(f"WITH {RANKED} SELECT doc_id, coalesce(vrank, 0)::int AS vrank, coalesce(lrank, 0)::int AS lrank, round(raw_rrf_score, 6) AS raw_rrf_score FROM r")
def rrf_fuse(spark, d):
    """Two ranked lists fused by reciprocal ranks; a rank is 0 where a list does not have the document."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _fused(spark, d)[1].select("doc_id", zero("vrank"), zero("lrank"), F.round("raw_rrf_score", 6).alias("raw_rrf_score"))


HYBRID = f"""
    WITH {RANKED}, c AS (
        SELECT r.*, d.text, d.source, round(raw_rrf_score * CASE coalesce(d.source, 'issue_thread') WHEN 'readme' THEN 1.1 WHEN 'review_comment' THEN 0.9 ELSE 1.0 END::double, 9) AS rrf_score,
            greatest(1, length(d.text) // 4) AS tokens FROM r JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL AND d.text <> ''
    ), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY rrf_score DESC, doc_id) = 1),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY rrf_score DESC, doc_id) <= 3),
    s AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, doc_id) AS pos, sum(tokens) OVER (ORDER BY rrf_score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum_tokens FROM f)
"""


def _hybrid(spark, d):
    docs, fused = _fused(spark, d)
    # two lists of 60 rows: the documents stay where they are
    joined = docs.select("doc_id", "text", "source").where("text is not null and text <> ''").join(F.broadcast(fused), "doc_id")
    scored = ret.weighted(joined, F.col("source"), WEIGHTS, "issue_thread").withColumn("rrf_score", F.round("rrf_score", 9))
    return ret.assemble(scored, [F.desc("rrf_score"), F.col("doc_id")], "text", "source", 3, 15000)


@query(HYBRID + "SELECT pos, doc_id, source, rrf_score, tokens::bigint AS tokens, cum_tokens::bigint AS cum_tokens FROM s WHERE pos = 1 OR cum_tokens <= 15000")
def retrieval_hybrid(spark, d):
    """The flagship: vector and word ranks fused, weighted, without repeats, capped per source, within a token budget."""
    return _hybrid(spark, d).select("pos", "doc_id", "source", "rrf_score", F.col("tokens").cast("bigint").alias("tokens"), F.col("cum_tokens").cast("bigint").alias("cum_tokens"))


@query(HYBRID + r"""
    SELECT 'all' AS scope, string_agg('SOURCE: ' || source || chr(10) || text, chr(10) ORDER BY pos) AS context FROM s WHERE pos = 1 OR cum_tokens <= 15000
""")
def context_string(spark, d):
    """The retrieved texts under their headers as one text."""
    rows = _hybrid(spark, d).withColumn("scope", F.lit("all"))
    return ret.context_text(rows, ["scope"], "pos", F.concat(F.lit("SOURCE: "), "source"), F.col("text"))


@query("""
    WITH a AS (SELECT repo_name, min(commit_sha) AS sha FROM repo_snapshot WHERE status = 'ACTIVE' GROUP BY repo_name),
    c AS (SELECT DISTINCT c.chunk_id, c.repo_name, s.commit_sha, a.sha FROM code_chunk c JOIN repo_snapshot s USING (snapshot_id) LEFT JOIN a ON a.repo_name = c.repo_name),
    e AS (SELECT *, coalesce(commit_sha = sha, false) AS exact FROM c)
    SELECT chunk_id, repo_name FROM e QUALIFY exact OR NOT max(exact::int)::boolean OVER (PARTITION BY repo_name)
""".replace("max(exact::int)::boolean OVER (PARTITION BY repo_name)", "(max(exact::int) OVER (PARTITION BY repo_name) = 1)"))
def retrieval_commit_fallback(spark, d):
    """Chunks of the active commit, or all of a repository where that has none."""
    s = table(spark, d, "repo_snapshot")
    active = s.where("status = 'ACTIVE'").groupBy("repo_name").agg(F.min("commit_sha").alias("sha"))
    chunks = table(spark, d, "code_chunk").select("chunk_id", "snapshot_id", "repo_name").join(s.select("snapshot_id", "commit_sha"), "snapshot_id").join(active, "repo_name", "left").select("chunk_id", "repo_name", "commit_sha", "sha").distinct()
    return ret.prefer_exact(chunks, F.col("commit_sha") == F.col("sha"), ["repo_name"]).select("chunk_id", "repo_name")


@query("""
    WITH t AS (SELECT doc_id, source, greatest(1, length(text) // 4) AS tokens FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, sum(tokens) OVER w AS cum, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
    SELECT source, doc_id, cum::bigint AS cum FROM s WHERE rn = 1 OR cum <= 15000
""")
def budget_prefix(spark, d):
    """Per source, documents in order until the budget is spent."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "source", tx.token_estimate(F.col("text")).alias("tokens"))
    return ranking.budget_prefix(t, ["source"], [F.col("doc_id")], "tokens", 15000).select("source", "doc_id", F.col("cum").cast("bigint").alias("cum"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_first(spark, d):
    """The first document of every text: aggregated by a digest, not by the text itself."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""
    SELECT DISTINCT chunk_id, file_path FROM (SELECT DISTINCT chunk_id, repo_name, file_path, start_line FROM code_chunk)
    QUALIFY row_number() OVER (PARTITION BY repo_name, file_path ORDER BY start_line, chunk_id) <= 3
""")
def file_cap(spark, d):
    """Three chunks a file at most."""
    c = table(spark, d, "code_chunk").select("chunk_id", "repo_name", "file_path", "start_line").distinct()
    return rel.first_of(c, ["repo_name", "file_path"], [F.col("start_line"), F.col("chunk_id")], 3).select("chunk_id", "file_path")


@query("""
    SELECT chunk_id, (start_line // 20)::int AS bucket FROM (SELECT DISTINCT chunk_id, repo_name, file_path, start_line FROM code_chunk WHERE start_line IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY repo_name, file_path, start_line // 20 ORDER BY start_line, chunk_id) = 1
""")
def bucket_dedup(spark, d):
    """One chunk for every twenty lines of a file."""
    c = table(spark, d, "code_chunk").where("start_line is not null").select("chunk_id", "repo_name", "file_path", "start_line", F.expr("cast(start_line div 20 as int)").alias("bucket")).distinct()
    return rel.first_of(c, ["repo_name", "file_path", "bucket"], [F.col("start_line"), F.col("chunk_id")]).select("chunk_id", "bucket")


RING = "SELECT full_name, coalesce(language, 'Other') AS grp, row_number() OVER (PARTITION BY coalesce(language, 'Other') ORDER BY stars DESC NULLS LAST, full_name) AS depth FROM repo_metrics"


@query(f"SELECT full_name, grp, row_number() OVER (ORDER BY depth, grp) - 1 AS pos FROM ({RING})")
def rotation_ring(spark, d):
    """Languages take turns, each with its best known repository that is left."""
    return ranking.rotation_ring(table(spark, d, "repo_metrics"), F.coalesce("language", F.lit("Other")), [F.desc_nulls_last("stars"), F.col("full_name")]).select("full_name", "grp", "pos")


@query(f"""
    WITH r AS (SELECT full_name, row_number() OVER (ORDER BY depth, grp) - 1 AS pos, count(*) OVER () AS total FROM ({RING}))
    SELECT full_name, (pos - 25 + total) % total AS turn FROM r WHERE (pos - 25 + total) % total < 12
""")
def rotation_slice(spark, d):
    """Twelve of the ring from position 25 on, around its end."""
    return ranking.ring_slice(rotation_ring(spark, d), 25, 12).select("full_name", "turn")


@query("SELECT ((25 + 12) % count(*))::bigint AS next_offset FROM repo_metrics")
def rotation_cursor(spark, d):
    """Where the next slice of the ring begins."""
    return ranking.next_offset(table(spark, d, "repo_metrics"), 25, 12)


@query("""
    SELECT evidence_id, repo_full_name FROM issue_evidence QUALIFY row_number() OVER (PARTITION BY repo_full_name ORDER BY comments_count DESC NULLS LAST, evidence_id) <= 5
""")
def per_repo_cap(spark, d):
    """The five most discussed issues of every repository."""
    return rel.first_of(table(spark, d, "issue_evidence").select("evidence_id", "repo_full_name", "comments_count"), ["repo_full_name"], [F.desc_nulls_last("comments_count"), F.col("evidence_id")], 5).drop("comments_count")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_per_group(spark, d):
    """The largest order of every customer: one aggregation with partial results, no sort."""
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("x")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", (-F.col("x.k")).alias("o_orderkey"))


@query(r"""
    WITH p AS (SELECT document_id, repo_full_name, regexp_replace(replace(relative_path, '\', '/'), '^(\./)+', '') AS p FROM repo_document WHERE relative_path IS NOT NULL),
    s AS (SELECT document_id, repo_full_name, p, (CASE WHEN p LIKE 'src/%' OR p LIKE 'lib/%' THEN 15 ELSE 0 END) - 3 * (length(p) - length(replace(p, '/', ''))) - (CASE WHEN regexp_matches(p, '(^|/)(tests?|docs?)/') THEN 8 ELSE 0 END) AS score FROM p)
    SELECT document_id, repo_full_name, score::int AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_full_name ORDER BY score DESC, p, document_id) AS rank FROM s) WHERE rank <= 10
""")
def structural_rank(spark, d):
    """Files of a repository by their place in its tree, ten each."""
    p = table(spark, d, "repo_document").where("relative_path is not null").select("document_id", "repo_full_name", tx.plain_path(F.col("relative_path")).alias("p"))
    score = F.when(F.col("p").like("src/%") | F.col("p").like("lib/%"), 15).otherwise(0) - 3 * (F.length("p") - F.length(F.replace("p", F.lit("/"), F.lit("")))) - F.when(F.col("p").rlike("(^|/)(tests?|docs?)/"), 8).otherwise(0)
    w = ranking.Window.partitionBy("repo_full_name").orderBy(F.desc("score"), "p", "document_id")
    return p.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("document_id", "repo_full_name", "score", "rank")
