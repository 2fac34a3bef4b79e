"""Counts, shares, profiles and percentiles of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, key: Column) -> DataFrame:
    """value, n, pct (two digits): how often each value occurs. The total is one row, joined to the counts."""
    counts = df.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(100.0 * F.col("n") / F.col("__all"), 2).alias("pct"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the element number n div 2, from 0, of the sorted values; an aggregate over counts of equal values."""
    return df.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").cast(df.schema[value].dataType).alias("median"))


def shares_above(df: DataFrame, keys: dict[str, tuple[Column, float]]) -> DataFrame:
    """dimension, value, n, share, warning: the most frequent value of each dimension and whether its share passes the limit."""
    parts = []
    for name, (key, limit) in keys.items():
        counts = df.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
        top = counts.where("value is not null").orderBy(F.desc("n"), "value").limit(1)
        whole = top.join(F.broadcast(df.agg(F.count("*").alias("__all")))).withColumn("share", F.round(F.col("n") / F.col("__all"), 4))
        parts.append(whole.select(F.lit(name).alias("dimension"), "value", "n", "share", (F.col("share") > limit).alias("warning")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Interpolated percentiles p50, p95, ... per key, exact: from counts of equal values, with partial aggregation."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.percentile(value, p), 4).alias(f"p{int(p * 100)}") for p in at])
