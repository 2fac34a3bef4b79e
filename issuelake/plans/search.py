"""Queries of search within repositories, and of what it finds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuelake.functions import text as tx
from issuelake.operators import embedding, evaluate, retrieval as ret, search
from issuelake.plans.registry import query
from issuelake.session import stored, table

#: Makes the embedder whose vectors are the plain counts.
COUNTS = partial(embedding.HashedWords, unit=False)
REPO, TITLE, BODY = "aldermoor/lattice-core", "fn option", "panel"

# the SQL of the embedder: signed counts of words in 768 dimensions, both told by the MD5 of the word
DIMS = """
    SELECT {id}, ('0x' || substr(md5(w), 1, 6))::int % 768 AS d, sum(1 - 2 * (('0x' || substr(md5(w), 7, 1))::int % 2)) AS v
    FROM (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS w FROM {source}) GROUP BY 1, 2
"""
CHUNK_TEXT = "substr(concat_ws(chr(10), contextual_header, raw_content), 1, 4000)"
CORPUS = f"""
    corpus AS (
        SELECT c.*, s.commit_sha FROM code_chunk c JOIN repo_snapshot s USING (snapshot_id) WHERE s.status = 'ACTIVE' AND c.repo_name = '{REPO}'
        QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY c.snapshot_id) = 1
    ), question AS (SELECT 1 AS one, '{TITLE} {BODY}' AS q),
    cd AS ({DIMS.format(id="chunk_id", text=CHUNK_TEXT, source="corpus")}), qd AS ({DIMS.format(id="one", text="q", source="question")}),
    cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM cd GROUP BY 1 HAVING sum(v * v) > 0),
    sim AS (SELECT chunk_id, round(coalesce(sum(cd.v * qd.v), 0) / (any_value(cn.n) * (SELECT sqrt(sum(v * v)) FROM qd)), 6) AS similarity FROM cn JOIN cd USING (chunk_id) LEFT JOIN qd USING (d) GROUP BY chunk_id),
    vec AS (SELECT chunk_id, similarity, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS vrank FROM sim QUALIFY vrank <= 20),
    words AS (SELECT chunk_id, regexp_extract_all(lower(raw_content), '[a-z0-9_]+') AS t FROM corpus),
    lex AS (
        SELECT chunk_id, len(list_filter(t, lambda x: x IN ('fn', 'option', 'panel')))::int AS rank_score, row_number() OVER (ORDER BY len(list_filter(t, lambda x: x IN ('fn', 'option', 'panel'))) DESC, chunk_id) AS lrank
        FROM words WHERE list_contains(t, 'fn') AND list_contains(t, 'option') AND list_contains(t, 'panel') QUALIFY lrank <= 20
    )
"""


def _fused(vector: str, lexical: str) -> str:
    """The SQL of what is kept of two lists."""
    return f"""
    WITH {CORPUS}, f AS (SELECT coalesce(v.chunk_id, l.chunk_id) AS chunk_id, coalesce(1.0::double / (60 + vrank), 0) + coalesce(1.0::double / (60 + lrank), 0) AS raw FROM {vector} v FULL JOIN {lexical} l ON v.chunk_id = l.chunk_id),
    w AS (SELECT c.*, round(raw * CASE coalesce(info_class, 'SOURCE_CODE') WHEN 'SOURCE_CODE' THEN 1.1 WHEN 'TESTS' THEN 0.9 ELSE 1.0 END::double, 9) AS score FROM f JOIN corpus c USING (chunk_id)),
    o AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY raw_content ORDER BY score DESC, chunk_id) = 1),
    p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) <= 3),
    kept AS (
        SELECT *, row_number() OVER a AS pos, sum(floor(len(regexp_extract_all(raw_content, '\\S+')) * 1.3)::bigint) OVER (a ROWS UNBOUNDED PRECEDING)::bigint AS cum_tokens FROM p
        WINDOW a AS (ORDER BY score DESC, chunk_id) QUALIFY pos = 1 OR cum_tokens <= 2500
    )
    """


NONE = "(SELECT NULL::varchar AS chunk_id, NULL::bigint AS {0} WHERE false)"
SELECT = "SELECT pos::int AS pos, chunk_id, file_path, score, cum_tokens FROM kept"


def _tables(spark, d):
    chunks = table(spark, d, "code_chunk").select("chunk_id", "snapshot_id", "repo_name", "file_path", "info_class", "symbol_name", "symbol_type", "start_line", "end_line", "contextual_header", "raw_content")
    return chunks, table(spark, d, "repo_snapshot").select("snapshot_id", "repo_name", "status", "commit_sha")


def _kept(spark, d, mode):
    rows = search.Retriever(*_tables(spark, d)).chunks_for(REPO, TITLE, BODY, mode=mode)
    return rows.select("pos", "chunk_id", "file_path", "score", "cum_tokens")


@query(f"WITH {CORPUS} SELECT chunk_id, similarity, vrank::int AS vrank FROM vec")
def knn_isolated(spark, d):
    """The chunks of one repository's active snapshots nearest to a question."""
    return search.match_chunks_vector(search.isolated(*_tables(spark, d), REPO), f"{TITLE} {BODY}")


@query(f"WITH {CORPUS} SELECT chunk_id, rank_score, lrank::int AS lrank FROM lex")
def lexical_isolated(spark, d):
    """The chunks of one repository's active snapshots that hold every word of a question."""
    return search.match_chunks_lexical(search.isolated(*_tables(spark, d), REPO), f"{TITLE} {BODY}")


@query(_fused("vec", NONE.format("lrank")) + SELECT)
def retrieval_vector_only(spark, d):
    """What is kept of the vector list alone."""
    return _kept(spark, d, "vector_only")


@query(_fused(NONE.format("vrank"), "lex") + SELECT)
def retrieval_lexical_only(spark, d):
    """What is kept of the word list alone."""
    return _kept(spark, d, "lexical_only")


@query(_fused("vec", "lex") + SELECT)
def retrieval_issue(spark, d):
    """What is kept of both lists."""
    return _kept(spark, d, "hybrid")


@query(_fused("vec", "lex") + r"""
    SELECT string_agg('--- ' || coalesce(nullif(contextual_header, ''), 'SOURCE FILE: ' || coalesce(file_path, '') || ' (Lines ' || coalesce(start_line::varchar, '?') || '-' || coalesce(end_line::varchar, '?') || ')'
            || CASE WHEN coalesce(symbol_name, '') <> '' THEN ' in ' || symbol_name ELSE '' END) || ' ---' || chr(10) || raw_content || chr(10), chr(10) ORDER BY pos) AS context,
        list(chunk_id ORDER BY pos) AS chunk_ids, count(*)::int AS n FROM kept
""")
def retrieval_context(spark, d):
    """The text for a prompt, and the ids of its chunks."""
    return search.Retriever(*_tables(spark, d)).context_for(REPO, TITLE, BODY)


TWENTIETH = "('0x' || substr(chunk_id, 1, 6))::int % 20 = 0 AND "
#: Every active chunk with a symbol whose leading hexadecimal digits are divisible by 20 asks for its symbol among the active chunks of its own repository; the file it stands in is the truth, its test file a half.
ROLLING = f"""
    active AS (SELECT c.* FROM code_chunk c JOIN repo_snapshot s USING (snapshot_id) WHERE s.status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY c.snapshot_id) = 1),
    asked AS (SELECT chunk_id AS query_id, repo_name, symbol_name || ' ' || coalesce(symbol_type, '') AS title, [lower(file_path)] AS want FROM active WHERE {TWENTIETH}coalesce(symbol_name, '') <> '' AND file_path IS NOT NULL),
    ad AS ({DIMS.format(id="chunk_id", text=CHUNK_TEXT, source="active")}), qd AS ({DIMS.format(id="query_id", text="title", source="asked")}),
    an AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM ad GROUP BY 1 HAVING sum(v * v) > 0), qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qd GROUP BY 1 HAVING sum(v * v) > 0),
    dots AS (SELECT query_id, chunk_id, sum(ad.v * qd.v) AS dot FROM asked a JOIN qd USING (query_id) JOIN active c USING (repo_name) JOIN ad USING (chunk_id, d) GROUP BY 1, 2),
    hits AS (
        SELECT a.query_id, c.chunk_id, c.file_path, c.repo_name AS hit_repo, a.repo_name AS asked_repo, round(coalesce(dot, 0) / (qn.n * an.n), 6) AS similarity
        FROM asked a JOIN qn USING (query_id) JOIN active c USING (repo_name) JOIN an USING (chunk_id) LEFT JOIN dots ON dots.query_id = a.query_id AND dots.chunk_id = c.chunk_id
        QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(dot, 0) / (qn.n * an.n), 6) DESC, c.chunk_id) <= 10
    ),
    files AS (SELECT query_id, lower(file_path) AS f, row_number() OVER (PARTITION BY query_id ORDER BY max(similarity) DESC, min(chunk_id)) AS r FROM hits WHERE file_path IS NOT NULL GROUP BY 1, 2),
    lists AS (SELECT query_id, any_value(want) AS want, coalesce(list(f ORDER BY r) FILTER (WHERE f IS NOT NULL), []) AS got FROM asked LEFT JOIN files USING (query_id) GROUP BY 1)
"""


def _hits(spark, d):
    chunks, snapshots = _tables(spark, d)
    active = chunks.join(snapshots.where("status = 'ACTIVE'").select("snapshot_id"), "snapshot_id", "left_semi").dropDuplicates(["chunk_id"])
    twentieth = F.conv(F.substring("chunk_id", 1, 6), 16, 10).cast("int") % 20 == 0
    asked = active.where(twentieth & (F.coalesce("symbol_name", F.lit("")) != "") & F.col("file_path").isNotNull())
    questions = embedding.embedded(asked.withColumnRenamed("chunk_id", "id"), ["id", "repo_name"], F.concat("symbol_name", F.lit(" "), F.coalesce("symbol_type", F.lit(""))))
    base = embedding.embedded(active.withColumnRenamed("chunk_id", "id"), ["id", "repo_name"], embedding.embedding_text(F.col("contextual_header"), F.col("raw_content")))
    found = ret.nearest_each(base, questions, 10, "id", "embedding", "repo_name")
    place = active.select(F.col("chunk_id").alias("id"), "file_path", F.col("repo_name").alias("hit_repo"))
    hits = found.join(place, "id").select("query_id", F.col("id").alias("chunk_id"), "file_path", "hit_repo", "similarity", "rank")
    return asked.select(F.col("chunk_id").alias("query_id"), F.col("repo_name").alias("asked_repo"), F.array(F.lower("file_path")).alias("want")), hits


def _lists(spark, d):
    asked, hits = _hits(spark, d)
    best = hits.where("file_path is not null").groupBy("query_id", F.lower("file_path").alias("f")).agg(F.max("similarity").alias("s"), F.min("chunk_id").alias("c"))
    # ten files a question at most
    got = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "c", "f"))), lambda x: x["f"]).alias("got"))
    return asked.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))


SCORES = ROLLING + """, scored AS (
    SELECT query_id, round(len(list_intersect(want, got[1:1])) / len(want), 4) AS recall_1, round(len(list_intersect(want, got[1:5])) / len(want), 4) AS recall_5, round(len(list_intersect(want, got[1:10])) / len(want), 4) AS recall_10,
        round(coalesce(1.0::double / nullif(list_position(list_transform(got[1:10], lambda f: list_contains(want, f)), true), 0), 0), 4) AS mrr_10, CASE WHEN len(list_intersect(want, got[1:10])) > 0 THEN 1.0 ELSE 0.0 END::double AS hit_10
    FROM lists WHERE len(want) > 0)
"""


@query("WITH " + SCORES + "SELECT * FROM scored")
def exact_metrics(spark, d):
    """Recall, reciprocal rank and hit of each question, files compared exactly."""
    rows = _lists(spark, d).where("size(want) > 0")
    return rows.select("query_id", *evaluate.exact_metrics(F.col("got"), F.col("want")))


@query("WITH " + SCORES + """
    SELECT count(*) AS questions, count(*) FILTER (WHERE hit_10 > 0) AS successes, round(avg(recall_1), 4) AS recall_1, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(mrr_10), 4) AS mrr_10, round(avg(hit_10), 4) AS hit_10 FROM scored
""")
def rolling_evaluation(spark, d):
    """The means of the metrics over all questions, and how many succeeded."""
    m = exact_metrics(spark, d)
    names = ("recall_1", "recall_5", "recall_10", "mrr_10", "hit_10")
    return m.agg(F.count("*").alias("questions"), F.count_if(F.col("hit_10") > 0).alias("successes"), *[F.round(F.avg(c), 4).alias(c) for c in names])


MATCH = "(f = t OR ends_with(f, '/' || t) OR ends_with(t, '/' || f))"


@query("WITH " + ROLLING + f"""
    , g AS (SELECT query_id, want AS prim, [regexp_replace(want[1], '^src/', 'tests/')] AS supp, unnest(got) AS f, generate_subscripts(got, 1) AS rank FROM lists WHERE len(want) > 0)
    SELECT query_id, rank::int AS rank, f AS file_path, CASE WHEN len(list_filter(prim, lambda t: {MATCH})) > 0 THEN 1.0 WHEN len(list_filter(supp, lambda t: {MATCH})) > 0 THEN 0.5 ELSE 0.0 END::double AS relevance FROM g
""")
def graded_relevance(spark, d):
    """The grade of every retrieved file: 1 for the file of the truth, a half for its test file, else 0."""
    rows = _lists(spark, d).where("size(want) > 0")
    flat = rows.select("query_id", F.col("want").alias("prim"), F.array(F.regexp_replace(F.col("want")[0], "^src/", "tests/")).alias("supp"), F.posexplode("got").alias("p", "file_path"))
    return flat.select("query_id", (F.col("p") + 1).alias("rank"), "file_path", evaluate.relevance(F.col("file_path"), F.col("prim"), F.col("supp")).alias("relevance"))


@query("WITH " + ROLLING + "SELECT count(*) AS hits, count(*) FILTER (WHERE hit_repo <> asked_repo) AS violations, count(DISTINCT query_id) AS questions FROM hits")
def isolation_violations(spark, d):
    """How many hits are of another repository than the question; it has to be none."""
    asked, hits = _hits(spark, d)
    j = hits.join(asked.select("query_id", "asked_repo"), "query_id")
    return j.agg(F.count("*").alias("hits"), F.count_if(F.col("hit_repo") != F.col("asked_repo")).alias("violations"), F.count_distinct("query_id").alias("questions"))


@query(_fused("vec", "lex") + "SELECT list_sort(list_distinct(list(lower(file_path)))) AS files, list_sort(list_distinct(list(lower(symbol_name)) FILTER (WHERE symbol_name IS NOT NULL AND symbol_name <> ''))) AS symbols, count(DISTINCT lower(file_path)) AS n_files FROM kept")
def retrieval_sets(spark, d):
    """The distinct files and symbols of what was retrieved."""
    rows = search.Retriever(*_tables(spark, d)).chunks_for(REPO, TITLE, BODY)
    symbol = F.when(F.col("symbol_name") != "", F.lower("symbol_name"))
    return rows.agg(F.array_sort(F.collect_set(F.lower("file_path"))).alias("files"), F.array_sort(F.collect_set(symbol)).alias("symbols"), F.count_distinct(F.lower("file_path")).alias("n_files"))


@query(r"""
    WITH e AS (SELECT evidence_id AS id, repo_full_name, body FROM issue_evidence WHERE evidence_id % 20 = 0 AND body IS NOT NULL),
    m AS (SELECT id, repo_full_name, list_distinct(regexp_extract_all(body, '[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+\.(?:py|js|ts|go|rs|java|c)')) AS paths FROM e),
    x AS (SELECT id, repo_full_name, unnest(paths) AS path FROM m),
    c AS (SELECT DISTINCT chunk_id, repo_name, file_path, start_line, end_line FROM code_chunk),
    h AS (SELECT x.id, c.file_path AS path, c.start_line AS first_line, c.end_line AS last_line, c.chunk_id FROM x JOIN c ON c.repo_name = x.repo_full_name AND c.file_path = x.path)
    SELECT * FROM h UNION ALL SELECT id, path, 1, 30, NULL FROM x WHERE id NOT IN (SELECT id FROM h)
""")
def code_explorer(spark, d):
    """The places that issues point to: chunks of the files they mention, else the first thirty lines of these."""
    issues = table(spark, d, "issue_evidence").where("evidence_id % 20 = 0 and body is not null").select(F.col("evidence_id").alias("id"), F.col("repo_full_name").alias("repo_name"), tx.mentioned_paths(F.col("body")).alias("paths"))
    chunks = table(spark, d, "code_chunk").select("chunk_id", "repo_name", "file_path", "start_line", "end_line").distinct()
    linked = issues.select("id", "repo_name", F.explode("paths").alias("file_path")).join(chunks, ["repo_name", "file_path"]).groupBy("id").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    locations = F.transform("paths", lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("lines")))
    return search.explore(issues.join(linked, "id", "left").select("id", "repo_name", "chunk_ids", locations.alias("locations")), chunks)


RANKS = "WITH " + ROLLING + ", c AS (SELECT * FROM lists WHERE len(want) > 0)"
EITHER = "(r = t OR ends_with(r, '/' || t) OR ends_with(t, '/' || r))"


@query(RANKS + f"""
    , k AS (SELECT k, query_id, want, list_slice(got, 1, k) AS top FROM c, (SELECT unnest([1, 3, 5, 10]) AS k)),
    h AS (SELECT k, len(want) AS n, len(top) AS m, len(list_filter(want, lambda t: len(list_filter(top, lambda r: {EITHER})) > 0)) AS hits FROM k)
    SELECT k, round(avg(hits / n), 6) AS recall, round(avg(CASE WHEN m > 0 THEN hits / m ELSE 0 END), 6) AS precision, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END)::double, 6) AS hit FROM h GROUP BY k
""")
def recall_at_k(spark, d):
    """Mean recall, precision and hit rate of the retrieved files at several depths, paths compared by their ends."""
    c = _lists(spark, d).where("size(want) > 0")
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), evaluate.recall_at(F.col("got"), F.col("want"), k).alias("r"), evaluate.precision_at(F.col("got"), F.col("want"), k).alias("p")) for k in (1, 3, 5, 10)])).alias("x")).select("x.*")
    return rows.groupBy("k").agg(F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), 6).alias("hit"))


def _all_lists(spark, d):
    """As _lists, of every active chunk with a symbol: the files that the ten chunks nearest to its symbol stand in.

    Symbols of one repository that have the same vector find the same chunks, so
    each such vector is searched once. Vectors are counts: their cosines are the SQL's to the last digit.
    """
    chunks, snapshots = _tables(spark, d)
    active = snapshots.where("status = 'ACTIVE'").select("snapshot_id")
    # a chunk counts in its least snapshot; the texts move once, by a key that is null nowhere
    least = chunks.select("chunk_id", "snapshot_id").join(active, "snapshot_id", "left_semi").groupBy("chunk_id").agg(F.min("snapshot_id").alias("snapshot_id"))
    key = F.struct("chunk_id", "snapshot_id").alias("key")
    kept = ("repo_name", "file_path", "symbol_name", "symbol_type")
    one = chunks.select(key, F.col("chunk_id").alias("id"), *kept, "contextual_header", "raw_content").join(least.select(key), "key", "left_semi").dropDuplicates(["key"])
    base = stored(embedding.embedded(one, ["id", *kept], embedding.embedding_text(F.col("contextual_header"), F.col("raw_content")), COUNTS))
    named = base.where("id is not null and repo_name is not null")
    symbol = F.concat("symbol_name", F.lit(" "), F.coalesce("symbol_type", F.lit(""))).alias("title")
    asks = (F.coalesce("symbol_name", F.lit("")) != "") & F.col("file_path").isNotNull()
    titles = named.where(asks).groupBy("repo_name", symbol).agg(F.min("id").alias("id"))
    vectors = embedding.embedded(titles, ["id", "repo_name", "title"], F.col("title"), COUNTS)
    # the hash spares the sort nearly all comparisons of vectors
    same = Window.partitionBy("repo_name", F.xxhash64("embedding"), "embedding")
    shared = stored(vectors.withColumn("query_id", F.min("id").over(same)))
    found = ret.nearest_each(named, shared.where("id = query_id"), 10, "id", "embedding", "repo_name")
    # ten hits a question at most
    hit = F.struct((-F.col("similarity")).alias("s"), F.col("id").alias("c"), F.lower("file_path").alias("f"))
    hits = found.join(named.where("file_path is not null").select("id", "file_path"), "id").groupBy("query_id").agg(F.collect_list(hit).alias("hits"))
    of = lambda f: F.filter("hits", lambda h: h["f"] == f)
    files = F.transform(F.array_distinct(F.col("hits")["f"]), lambda f: F.struct(F.array_min(of(f)["s"]).alias("s"), F.array_min(of(f)["c"]).alias("c"), f.alias("f")))
    got = hits.select("query_id", F.array_sort(files)["f"].alias("got"))
    lists = shared.select("repo_name", "title", "query_id").join(got, "query_id").drop("query_id")
    asked = base.where(asks).select(F.col("id").alias("query_id"), "repo_name", symbol, F.array(F.lower("file_path")).alias("want"))
    return asked.join(lists, ["repo_name", "title"], "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))


# every symbol asks
@query(RANKS.replace(TWENTIETH, "") + f"""
    , r AS (SELECT query_id, list_position(list_transform(list_slice(got, 1, 10), lambda r: len(list_filter(want, lambda t: {EITHER})) > 0), true) AS p FROM c)
    SELECT count(*) AS cases, round(avg(CASE WHEN coalesce(p, 0) > 0 THEN 1.0::double / p ELSE 0 END), 6) AS mrr FROM r
""")
def mrr(spark, d):
    """Mean reciprocal rank of the file that a symbol stands in."""
    rr = evaluate.reciprocal_rank(F.col("got"), F.col("want"), 10)
    # 2520 is a multiple of every rank up to ten: whole numbers have one sum, in whatever order
    total = F.sum(F.round(rr * 2520).cast("bigint"))
    return _all_lists(spark, d).where("size(want) > 0").agg(F.count("*").alias("cases"), F.round(F.try_divide(total, F.count("*") * 2520), 6).alias("mrr"))
