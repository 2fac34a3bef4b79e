"""Search in the chunks of one repository: active snapshots only, by vectors, by words or by both, and what is made of the hits."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelake.functions.text import line_range
from issuelake.operators import retrieval as ret
from issuelake.operators.embedding import Embedder, HashedWords, embedded, embedding_text
from issuelake.operators.relational import all_of

MODES = ("hybrid", "vector_only", "lexical_only")
#: How much a class of information counts.
CLASS_WEIGHTS = {"SOURCE_CODE": 1.10, "DOCUMENTATION": 1.00, "CONFIGURATION": 1.00, "TESTS": 0.90}
#: Characters of a question that the search by words looks at.
LEXICAL_CHARS = 500


def isolated(chunks: DataFrame, snapshots: DataFrame, repo: str | None, commit: str | None = None) -> DataFrame:
    """The distinct chunks of the active snapshots of one repository, with their commit. A search without a repository is refused: it would mix repositories."""
    if repo is None or not repo.strip():
        raise ValueError("a search needs a repository")
    active = snapshots.where(all_of([F.col("status") == "ACTIVE", F.col("repo_name") == repo, None if commit is None else F.col("commit_sha") == commit])).select("snapshot_id", "commit_sha")
    return chunks.where(F.col("repo_name") == repo).join(F.broadcast(active), "snapshot_id").dropDuplicates(["chunk_id"])


def match_chunks_vector(corpus: DataFrame, question: str, k: int = 20, make: Callable[[], Embedder] = HashedWords) -> DataFrame:
    """chunk_id, similarity, vrank: the k chunks of `corpus` nearest to the question. Chunks and questions without words are near to nothing and left out."""
    vector = make().embed_batch([question])[0].tolist()
    near = embedded(corpus, ["chunk_id"], embedding_text(F.col("contextual_header"), F.col("raw_content")), make)
    scored = near.select("chunk_id", F.round(ret.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in vector])), 6).alias("similarity")).where("similarity is not null")
    top = scored.orderBy(F.desc("similarity"), "chunk_id").limit(k)
    return top.withColumn("vrank", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id")))  # k rows


def match_chunks_lexical(corpus: DataFrame, question: str, k: int = 20) -> DataFrame:
    """chunk_id, rank_score, lrank: the k chunks that hold every word of the question, by how often they hold them."""
    words = sorted(set("".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in question[:LEXICAL_CHARS].lower()).split()))
    top = ret.matching_all(corpus, words, "chunk_id", F.col("raw_content"), k)
    return top.withColumn("lrank", F.row_number().over(Window.orderBy(F.desc("rank_score"), "chunk_id")))


def retrieve(
    chunks: DataFrame, snapshots: DataFrame, repo: str, title: str | None, body: str | None, commit: str | None = None, mode: str = "hybrid", k: int = 20, budget: int = 2500, cap: int = 3,
    weights: Mapping[str, float] = CLASS_WEIGHTS, make: Callable[[], Embedder] = HashedWords,
) -> DataFrame:
    """pos, score, cum_tokens and the columns of the chunks found for an issue, the best first.

    The lists of the mode are fused by reciprocal ranks and weighted by class;
    equal contents count once, `cap` chunks a file, until the token budget (1.3
    a word) is spent, one chunk at least. If a commit is asked for and has no
    active chunk, the repository's other active chunks are searched. An issue
    without a word finds nothing.
    """
    if mode not in MODES:
        raise ValueError(f"the mode is one of {', '.join(MODES)}")
    corpus = isolated(chunks, snapshots, repo, commit)
    if commit is not None and corpus.isEmpty():
        corpus = isolated(chunks, snapshots, repo)
    question = f"{title or ''} {body or ''}".strip()
    if not question:
        corpus = corpus.limit(0)
    vector = match_chunks_vector(corpus if mode != "lexical_only" else corpus.limit(0), question, k, make)
    lexical = match_chunks_lexical(corpus if mode != "vector_only" else corpus.limit(0), question, k)
    fused = ret.fuse(vector, lexical, "chunk_id")  # 2 k rows at most
    rows = ret.weighted(corpus.join(F.broadcast(fused), "chunk_id"), F.col("info_class"), weights, "SOURCE_CODE").withColumn("score", F.round("rrf_score", 9))
    order = [F.desc("score"), F.col("chunk_id")]
    numbered = lambda df, *keys: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered(numbered(rows, "raw_content").where("__n = 1"), "file_path").where(F.col("__n") <= cap)
    cost = F.floor(F.size(F.filter(F.split("raw_content", r"\s+"), lambda w: w != "")) * 1.3).cast("bigint")
    summed = kept.withColumn("cum_tokens", F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    return summed.where((F.col("pos") == 1) | (F.col("cum_tokens") <= budget)).drop("__n")


def block_header() -> Column:
    """The chunk's own header, or file, lines and symbol."""
    lines = F.concat(F.lit("SOURCE FILE: "), F.coalesce("file_path", F.lit("")), F.lit(" (Lines "), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")), F.lit(")"))
    symbol = F.when(F.coalesce("symbol_name", F.lit("")) != "", F.concat(F.lit(" in "), "symbol_name")).otherwise("")
    own = F.nullif(F.col("contextual_header"), F.lit(""))
    return F.concat(F.lit("--- "), F.coalesce(own, F.concat(lines, symbol)), F.lit(" ---"))


class Retriever:
    """Searches over one pair of chunk and snapshot tables."""

    def __init__(self, chunks: DataFrame, snapshots: DataFrame, make: Callable[[], Embedder] = HashedWords):
        self.chunks, self.snapshots, self.make = chunks, snapshots, make

    def chunks_for(self, repo: str, title: str | None, body: str | None, **options) -> DataFrame:
        return retrieve(self.chunks, self.snapshots, repo, title, body, make=self.make, **options)

    def context_for(self, repo: str, title: str | None, body: str | None, **options) -> DataFrame:
        """One row: context, chunk_ids, n; an empty text and no ids where nothing is found."""
        rows = self.chunks_for(repo, title, body, **options)
        part = F.struct("pos", "chunk_id", F.concat(block_header(), F.lit("\n"), "raw_content", F.lit("\n")).alias("t"))
        held = rows.agg(F.array_sort(F.collect_list(part)).alias("xs"))  # within the token budget
        return held.select(F.array_join(F.transform("xs", lambda x: x["t"]), "\n").alias("context"), F.transform("xs", lambda x: x["chunk_id"]).alias("chunk_ids"), F.size("xs").alias("n"))


def explore(explanations: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, path, first_line, last_line, chunk_id: the places an explanation points to, by the chunks stored with it, else by its locations.

    `explanations` has id, repo_name, chunk_ids array<string>, locations
    array<struct<path, lines>>. A range is read from "a-b", 1 to 30 without one.
    """
    stored_ids = explanations.select("id", "repo_name", F.explode("chunk_ids").alias("chunk_id"))
    c = chunks.select("chunk_id", "repo_name", F.col("file_path").alias("path"), F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line")).dropDuplicates(["chunk_id"])
    by_id = stored_ids.join(c, ["chunk_id", "repo_name"]).select("id", "path", "first_line", "last_line", "chunk_id")
    rest = explanations.join(by_id.select("id").distinct(), "id", "left_anti").select("id", F.explode("locations").alias("x"))
    lines = line_range(F.col("x.lines"))
    return by_id.unionByName(rest.select("id", F.col("x.path").alias("path"), lines["first"].alias("first_line"), lines["last"].alias("last_line"), F.lit(None).cast("string").alias("chunk_id")))

