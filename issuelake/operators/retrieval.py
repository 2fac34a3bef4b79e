"""Dense and lexical retrieval, fusion, and assembly of a context."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelake.functions.text import token_estimate, tokens
from issuelake.operators.relational import all_of

#: Vectors of a block on either side of the all-queries search.
BASE_BLOCK, QUERY_BLOCK = 4096, 512


def dot(x: Column, y: Column) -> Column:
    """The sum of the products of two arrays of numbers."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity of two arrays of numbers; null if either is null, of another length or of length zero. `norm_b` is the norm of b, where it is known."""
    norm = F.sqrt(dot(a, a)) * (F.sqrt(dot(b, b)) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(base: DataFrame, query: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of `base` most similar to the one vector of `query` (a single row); an exact scan and a top-k. Zero vectors come last."""
    one = query.select(F.col(vec_col).alias("__q"), F.sqrt(dot(F.col(vec_col), F.col(vec_col))).alias("__n")).limit(1)
    scored = base.join(F.broadcast(one)).select(id_col, cosine(F.col(vec_col), F.col("__q"), F.col("__n")).alias("similarity"))
    return scored.orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)


def rounded_half_up(s: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as SQL does, halves away from zero; infinite ones stay."""
    # the zero added makes one zero of both
    return np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5), s) / 10.0**digits + 0.0


def nearest_each(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", group: str | None = None, dims: int | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k rows most similar to each query, the query's own row left out. Exact.

    With `group`, a column of both sides, a query meets the rows of its group
    alone; then ids of either side may be of different kinds and no row is left
    out for its id. Vectors are compared with those of their own length, those of `dims` numbers alone if that
    is given; null, empty and zero vectors are near to nothing.

    The vectors are put into blocks on both sides; every base block meets every
    query block once, as one matrix product, and hands on no more than k rows a
    query. Nothing is broadcast or collected, and no pair of rows is emitted
    that is not among the best of its block.
    """
    kinds, query_kinds = base.schema[id_col].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    grp = F.lit("") if group is None else F.coalesce(F.col(group).cast("string"), F.lit(""))

    def blocked(df: DataFrame, size: int, own: str) -> tuple[DataFrame, DataFrame]:
        rows = df.where(F.size(vec_col) > 0 if dims is None else F.size(vec_col) == dims).select(grp.alias("grp"), F.size(vec_col).alias("dims"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
        return rows, rows.groupBy("grp", "dims").agg(F.ceil(F.count("*") / size).cast("int").alias(own))

    (b, nb), (q, nq) = blocked(base, BASE_BLOCK, "nb"), blocked(queries, QUERY_BLOCK, "nq")
    blocks = nb.join(nq, ["grp", "dims"])
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = b.join(blocks, ["grp", "dims"]).withColumn("bb", part("nb")).withColumn("qb", every("nq")).drop("nb", "nq")
    right = q.join(blocks, ["grp", "dims"]).withColumn("qb", part("nq")).withColumn("bb", every("nb")).drop("nb", "nq")
    same = group is None

    def unit(t):
        m = np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(t.num_rows, -1)
        n = np.sqrt((m * m).sum(axis=1))
        return m, n

    def pairs(base_rows, query_rows, r, c, s):
        # ids are taken from their columns, so that none at all are of their kind too
        taken = lambda t, at: t.column("id").take(pa.array(at, pa.int64()))
        return pa.table({"query_id": taken(query_rows, r), "id": taken(base_rows, c), "similarity": pa.array(s, pa.float64())})

    def best(base_rows, query_rows):
        if not base_rows.num_rows or not query_rows.num_rows:
            return pairs(base_rows, query_rows, [], [], [])
        (x, nx), (y, ny) = unit(base_rows), unit(query_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (y @ x.T) / (ny[:, None] * nx[None, :])
        ids, qs = base_rows.column("id").to_numpy(), query_rows.column("id").to_numpy()
        s[~np.isfinite(s)] = -np.inf
        if same:
            s[qs[:, None] == ids[None, :]] = -np.inf
        # all above the k-th of the rounded similarities, and of those equal to it the least ids: ties are settled by the same numbers as in the end
        s = rounded_half_up(s)
        keep = min(len(ids), k)
        order = np.argsort(ids, kind="stable")
        s = s[:, order]
        kth = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
        above, equal = s > kth, s == kth
        r, c = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= keep - above.sum(axis=1, keepdims=True))))
        ok = np.isfinite(s[r, c])
        return pairs(base_rows, query_rows, r[ok], order[c[ok]], s[r[ok], c[ok]])

    cell = ["grp", "dims", "bb", "qb"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(best, f"query_id {query_kinds}, id {kinds}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matching_all(docs: DataFrame, terms: Sequence[str], id_col: str, text: Column, k: int | None = 20) -> DataFrame:
    """Rows that hold every term, ranked by how often they hold them; a narrow scan and a top-k."""
    wanted = sorted(set(terms))
    if not wanted:
        return docs.select(id_col, F.lit(0).alias("rank_score")).limit(0)
    t = tokens(text)
    # a substring test on the plain text spares most rows the cutting into words
    near = docs.where(all_of([F.lower(text).contains(w) for w in wanted]))
    held = near.select(id_col, t.alias("__t")).where(F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains("__t", w)))
    scored = held.select(id_col, F.size(F.filter("__t", lambda x: x.isin(wanted))).alias("rank_score"))
    return scored if k is None else scored.orderBy(F.desc("rank_score"), id_col).limit(k)


def cover_density(docs: DataFrame, terms: Sequence[str], id_col: str, text: Column, k: int = 20, weight: float = 0.1) -> DataFrame:
    """As matching_all, ranked by minimal spans that hold all terms: each adds weight / (1 + words in it that are no terms)."""
    wanted = sorted(set(terms))
    held = matching_all(docs, wanted, id_col, text, None).select(id_col)
    source = docs.join(held, id_col, "left_semi").select(F.col(id_col).alias("k"), tokens(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [cover_score(t, wanted, weight) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[id_col, "rank_score"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, rank_score double").orderBy(F.desc("rank_score"), id_col).limit(k)


def cover_score(words: Sequence[str], wanted: Sequence[str], weight: float) -> float:
    """The sum over all minimal covers, found with one sliding window."""
    hits = [(i, w) for i, w in enumerate(words) if w in set(wanted)]
    counts: dict[str, int] = {}
    low, score = 0, 0.0
    for at, w in hits:
        counts[w] = counts.get(w, 0) + 1
        if len(counts) < len(wanted):
            continue
        while counts[hits[low][1]] > 1:
            counts[hits[low][1]] -= 1
            low += 1
        start = hits[low][0]
        score += weight / (1 + (at - start + 1 - len(wanted)))
        del counts[hits[low][1]]
        low += 1
    return round(score, 6)


def fuse(vector: DataFrame, lexical: DataFrame, id_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists with `vrank` and `lrank`: id, vrank, lrank, raw_rrf_score."""
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return vector.select(id_col, "vrank").join(lexical.select(id_col, "lrank"), id_col, "full").withColumn("raw_rrf_score", part("vrank") + part("lrank"))


def weighted(df: DataFrame, class_col: Column, weights: Mapping[str, float], default_class: str) -> DataFrame:
    """rrf_score: raw_rrf_score by the weight of the class; a null class counts as the default one, an unknown one as 1."""
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.coalesce(class_col, F.lit(default_class)) == name, F.lit(float(value))).otherwise(w)
    return df.withColumn("rrf_score", F.col("raw_rrf_score") * w)


def assemble(df: DataFrame, order: Sequence[Column], content: str, file: str, cap: int = 3, budget: int = 2500) -> DataFrame:
    """Of a short ranked list: equal contents once, at most `cap` rows a file, then the longest prefix within the token budget (one row at least).

    `df` is the result of top-k lists, so the one partition that the running sum
    needs is small by construction.
    """
    once = df.withColumn("__n", F.row_number().over(Window.partitionBy(content).orderBy(*order))).where("__n = 1")
    capped = once.withColumn("__n", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where(F.col("__n") <= cap)
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = capped.withColumn("tokens", token_estimate(F.col(content))).withColumn("cum_tokens", F.sum("tokens").over(run)).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    return summed.where((F.col("pos") == 1) | (F.col("cum_tokens") <= budget)).drop("__n")


def prefer_exact(df: DataFrame, exact: Column, keys: Sequence[str]) -> DataFrame:
    """Per key, the rows for which `exact` holds if there are any, else all of them."""
    marked = df.withColumn("__e", F.coalesce(exact, F.lit(False)))
    found = marked.where("__e").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct().withColumn("__any", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return marked.join(found, on, "left").where(F.col("__e") | F.col("__any").isNull()).select(*df.columns)


def context_text(df: DataFrame, keys: Sequence[str], pos: str, header: Column, content: Column) -> DataFrame:
    """One text per key: headers and contents in the order of `pos`, a line feed apart."""
    part = F.struct(F.col(pos).alias("p"), F.concat_ws("\n", header, content).alias("t"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("context"))
