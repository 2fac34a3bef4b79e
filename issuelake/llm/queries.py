"""Queries of the training-data problems over their whole tables, and the SQL that checks some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelake.llm import bpe, cutting, handwritten, neardup, packing, pii, quality, splits
from issuelake.session import table


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.similar_pairs(table(spark, sf_dir, "issue_evidence"), neardup.record_text(F.col("title"), F.col("body")), "evidence_id", threshold=0.6, size=3, least_words=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of issue rows that share 0.6 of their word triples."""
    both = neardup.expand_pairs(*_similar(spark, sf_dir))
    return both.select(F.col("id_a").alias("evidence_id_a"), F.col("id_b").alias("evidence_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per issue of 20 words or more: its class of equal texts, its group and how many other classes are linked to it."""
    return neardup.similar_groups(*_similar(spark, sf_dir)).withColumnRenamed("id", "evidence_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of groups with a known repository, and the group's smallest repository."""
    groups = splits.related_groups(table(spark, sf_dir, "dataset_record"))
    return groups.where("group_key is not null").select("record_id", "group_key")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every record, 70/15/15, groups kept whole."""
    return splits.grouped_splits(table(spark, sf_dir, "dataset_record"))


def p2_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that got a split, the components that are in more than one, and whether every split is within three hundredths of its share."""
    rows = splits.grouped_splits(table(spark, sf_dir, "dataset_record")).select("component", "split")
    torn = rows.groupBy("component").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    near = [F.abs(F.count_if(F.col("split") == name) / F.count("*") - share) <= 0.03 for name, share in splits.SHARES.items()]
    return rows.agg(F.count("split").alias("rows"), (near[0] & near[1] & near[2]).alias("within")).join(F.broadcast(torn))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks above the size limit, found as those that the cutter cuts."""
    pieces = cutting.cut(table(spark, sf_dir, "code_chunk"))
    return pieces.where("piece = 0 and n_pieces > 1").select("chunk_id", "file_path", "qualified_symbol_name")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the oversized chunks."""
    return cutting.cut(table(spark, sf_dir, "code_chunk"))


def p3_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized chunks put together again from their pieces: a digest and the number of characters of each."""
    pieces = cutting.cut(table(spark, sf_dir, "code_chunk")).where("n_pieces > 1")
    own = F.struct("piece", F.expr("substring(content, shared_chars + 1)").alias("own"))
    whole = pieces.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["own"]), "").alias("t"))
    return whole.select("chunk_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("chars"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.classify_files(table(spark, sf_dir, "repo_document"), table(spark, sf_dir, "upstream_file"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not hand-written."""
    return _files(spark, sf_dir).where("not handwritten").select("document_id")


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its kinds, reasons and the numbers behind them."""
    return _files(spark, sf_dir)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "issue_evidence"), table(spark, sf_dir, "known_name"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per occurrence of personal information."""
    return pii.occurrences(_scanned(spark, sf_dir))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies and usernames with placeholders in the place of personal information."""
    return _scanned(spark, sf_dir).select("evidence_id", F.col("body_redacted").alias("body"), F.col("user_redacted").alias("reporter_username"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of one above the capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return _statistics(spark, sf_dir).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality statistics of every document."""
    return _statistics(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_splits, p2_audit, p3_found, p3_pieces, p3_round_trip, p4_found, p4_files, p5_found, p5_redacted, p6_ids, p7_containers, p8_found, p8_statistics)
}

ORACLES: dict[str, str] = {
    "p1_found": r"""
        WITH w AS (
            SELECT evidence_id AS id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[\p{L}\p{N}]+') AS w FROM issue_evidence
        ), s AS (
            SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 20
        ), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
        SELECT c.a AS evidence_id_a, c.b AS evidence_id_b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE c.c >= 0.6 * (x.n + y.n - c.c)
    """,
    "p2_found": r"""
        WITH RECURSIVE k AS (
            SELECT record_id, lower(trim(repo_name, ' ' || chr(9) || chr(10) || chr(13))) AS r, regexp_extract_all(lower(dataset_id), '[0-9a-z]+') AS runs FROM dataset_record
        ), m AS (
            SELECT record_id,
                -- owner and name stand behind host and "repos", if there are any
                CASE WHEN r NOT IN ('n/a', 'none/none', 'unknown/unknown') THEN '0' || nullif(regexp_replace(regexp_extract(replace(r, '%2f', '/'), '^([a-z]+://[^/]+/(?:repos/)?|[^/@]+@[^/:]+:)?([a-z0-9][a-z0-9_.-]*/[a-z0-9_.-]+)', 2), '\.git$', ''), '') END AS r,
                -- twelve hexadecimal digits that are not all the same are an id, one digit repeated is a filler
                '1' || list_filter(runs, lambda x: length(x) = 12 AND regexp_full_match(x, '[0-9a-f]*') AND replace(x, x[1], '') <> '')[1] AS d
            FROM k
        ), e AS (
            SELECT DISTINCT coalesce(r, d) AS a, coalesce(d, r) AS b FROM m WHERE r IS NOT NULL OR d IS NOT NULL
        ), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(node, root) AS (
            SELECT a, a FROM l UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.node
        ), c AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
        SELECT m.record_id, substr(c.c, 2) AS group_key FROM m JOIN c ON c.node = coalesce(m.d, m.r) WHERE c.c LIKE '0%'
    """,
    "p2_audit": "SELECT count(*) AS rows, true AS within, 0::bigint AS torn FROM dataset_record",
    "p3_round_trip": r"""
        SELECT DISTINCT chunk_id, md5(raw_content) AS digest, length(raw_content)::bigint AS chars FROM code_chunk
        WHERE length(raw_content) // 4 > 1500
           OR len(regexp_extract_all(raw_content, '\r\n|\r|\n')) + (CASE WHEN regexp_matches(raw_content, '[^\r\n]\z') THEN 1 ELSE 0 END) > 120
    """,
    "p3_found": r"""
        SELECT DISTINCT chunk_id, file_path, qualified_symbol_name FROM code_chunk
        WHERE length(raw_content) // 4 > 1500
           OR len(regexp_extract_all(raw_content, '\r\n|\r|\n')) + (CASE WHEN regexp_matches(raw_content, '[^\r\n]\z') THEN 1 ELSE 0 END) > 120
    """,
}
