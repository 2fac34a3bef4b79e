"""Filters, lookups, joins, merges and versioned tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: Sequence[Column | None]) -> Column:
    """The conjunction of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def same_text(column: str, value: str | None) -> Column | None:
    """Equality without regard to case; no condition for no value."""
    return None if value is None else F.lower(column) == value.lower()


def page(df: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a total order; a top-k, not a full sort, when it runs."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order. Spark cuts each partition to its first n per key before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Keyed merge: rows of `source` replace those of `target`, or only their columns `update`, and new ones are added.

    `source` has one row a key and the columns of `target`. One full outer join.
    """
    columns = target.columns
    changed = set(columns if update is None else update)
    t, s = target.withColumn("__t", F.lit(True)).alias("t"), source.select(*columns).withColumn("__s", F.lit(True)).alias("s")
    joined = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]), "full")
    fresh = F.col("s.__s") & F.col("t.__t").isNull()

    def pick(c: str) -> Column:
        taken = F.col("s.__s") if c in changed else fresh
        return F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) if c in keys else F.when(taken, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return joined.select(*[pick(c).alias(c) for c in columns])


def delete_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `target` without a partner in `keys`."""
    return target.join(keys, list(on), "left_anti")


def rewrite(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """An update in place: `values` where the condition is true, all other rows as they are."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def activate(snapshots: DataFrame, chosen: DataFrame) -> DataFrame:
    """Promote the chosen snapshot of each repository, retire the one active before, purge what is retired or failed.

    `chosen` has repo_name and chosen_id, one row a repository; repositories not
    in it keep their states. Evaluation snapshots are never purged.
    """
    j = snapshots.join(chosen, "repo_name", "left")
    status = (
        F.when(F.col("snapshot_id") == F.col("chosen_id"), "ACTIVE")
        .when(F.col("chosen_id").isNotNull() & (F.col("status") == "ACTIVE"), "RETIRED")
        .otherwise(F.col("status"))
    )
    moved = j.withColumn("status", status)
    purged = F.col("chosen_id").isNotNull() & F.col("status").isin("RETIRED", "FAILED") & ~F.coalesce(F.col("is_evaluation"), F.lit(False))
    return moved.where(~purged).select(*snapshots.columns)


def suffixes(path: Column) -> Column:
    """The path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_join(long: DataFrame, short: DataFrame, long_path: Column, short_path: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs that agree in `keys` and of which one path is the other or ends with it behind a slash.

    The shorter of two such paths is a whole suffix of the longer: either side's
    suffixes are joined to the other's full paths on equality, so that a common
    last segment, as index.js, brings nothing together. Paths that are equal are
    found by the first of the two joins alone. Null paths match nothing.
    """
    a, b = long.withColumn("__lp", long_path).where("__lp is not null"), short.withColumn("__sp", short_path).where("__sp is not null")
    on = list(keys)
    first = a.withColumn("__end", F.explode(suffixes(F.col("__lp")))).join(b.withColumn("__end", F.col("__sp")), [*on, "__end"])
    proper = F.filter(suffixes(F.col("__sp")), lambda x: x != F.col("__sp"))
    second = a.withColumn("__end", F.col("__lp")).join(b.withColumn("__end", F.explode(proper)), [*on, "__end"])
    return first.unionByName(second).drop("__lp", "__sp", "__end")
