"""Measures of retrieval and of classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_matches(a: Column, b: Column) -> Column:
    """Equal, or either ends with a slash and the other."""
    slash = F.lit("/")
    return (a == b) | a.endswith(F.concat(slash, b)) | b.endswith(F.concat(slash, a))


def recall_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Share of the truth among the first k distinct items; null without a truth."""
    top = F.slice(F.array_distinct(retrieved), 1, k)
    return F.when(F.size(truth) > 0, F.size(F.filter(truth, lambda t: F.exists(top, lambda r: path_matches(r, t)))) / F.size(truth))


def precision_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Truths found among the first k distinct items, by the number of these; 0 if nothing was retrieved."""
    top = F.slice(F.array_distinct(retrieved), 1, k)
    hits = F.size(F.filter(truth, lambda t: F.exists(top, lambda r: path_matches(r, t))))
    return F.when(F.size(top) > 0, hits / F.size(top)).otherwise(0.0)


def reciprocal_rank(retrieved: Column, truth: Column, k: int) -> Column:
    """One by the rank of the first hit among the first k distinct items, 0 without one; null without a truth."""
    top = F.slice(F.array_distinct(retrieved), 1, k)
    first = F.array_position(F.transform(top, lambda r: F.exists(truth, lambda t: path_matches(r, t))), True)
    return F.when(F.size(truth) > 0, F.when(first > 0, 1.0 / first).otherwise(0.0))


def relevance(path: Column, primary: Column, supporting: Column) -> Column:
    """1 for a primary file, 0.5 for a supporting one, else 0."""
    held = lambda files: F.exists(files, lambda t: path_matches(path, t))
    return F.when(held(primary), 1.0).when(held(supporting), 0.5).otherwise(0.0)


def exact_metrics(retrieved: Column, truth: Column, depths: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """recall_k for each depth, mrr_k and hit_k for the last: items compared exactly, rounded to four digits. `truth` is not empty and has no repeats."""
    most = depths[-1]
    shared = lambda k: F.size(F.array_intersect(truth, F.slice(retrieved, 1, k)))
    first = F.array_position(F.transform(F.slice(retrieved, 1, most), lambda f: F.array_contains(truth, f)), True)
    return [
        *[F.round(shared(k) / F.size(truth), 4).alias(f"recall_{k}") for k in depths],
        F.round(F.when(first > 0, 1.0 / first).otherwise(0.0), 4).alias(f"mrr_{most}"), F.when(shared(most) > 0, 1.0).otherwise(0.0).alias(f"hit_{most}"),
    ]


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """truth, predicted, n."""
    return df.groupBy(truth.alias("truth"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of each class from a confusion matrix; 0 where a denominator is."""
    both = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("real"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("real"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("right")),
            )
        ).alias("x")
    ).select("x.*")
    s = both.groupBy("label").agg(F.sum("real").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("hit"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = ratio("hit", "said"), ratio("hit", "support")
    return s.select("label", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))
