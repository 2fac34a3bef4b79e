"""Orders within and across groups: rotation, caps, budgets, first occurrences, windows of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelake.session import cut_lineage


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str | None = None) -> DataFrame:
    """df with rn, the number of each row within its key from 1, and with `value` also cum, the sum up to it.

    A key may hold a third of all rows: rows are partitioned by ranges of key
    and order, numbered within each part, and one tally of the parts gives what
    precedes each. The order has to be total within a key.
    """
    placed = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__pid", F.spark_partition_id()))
    sums = [F.count("*").alias("__c"), *([F.sum(value).alias("__s")] if value else [])]
    before = Window.partitionBy(*keys).orderBy("__pid")
    parts = placed.groupBy(*keys, "__pid").agg(*sums)
    begins = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__pid").alias("__q"), *[(F.sum(c).over(before) - F.col(c)).alias(f"{c}b") for c in (["__c", "__s"] if value else ["__c"])])
    inside = Window.partitionBy("__pid", *keys).orderBy(*order)
    rows = placed.withColumn("__n", F.row_number().over(inside))
    if value:
        rows = rows.withColumn("__v", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col("__pid") == F.col("__q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(begins, on).withColumn("rn", F.col("__n") + F.col("__cb"))
    if value:
        joined = joined.withColumn("cum", F.col("__v") + F.col("__sb"))
    return joined.select(*df.columns, "rn", *(["cum"] if value else []))


def rotation_ring(df: DataFrame, group: Column, order: Sequence[Column]) -> DataFrame:
    """pos: the groups take turns, each with its best row that is left."""
    depth = running(df.withColumn("grp", group), ["grp"], order).withColumnRenamed("rn", "depth")
    return running(depth, [], [F.col("depth"), F.col("grp")]).withColumn("pos", F.col("rn") - 1).drop("rn")


def ring_slice(ring: DataFrame, offset: int, n: int) -> DataFrame:
    """n rows of a ring from `offset` on, past the end from its beginning again."""
    total = ring.agg(F.count("*").alias("total"))
    turned = ring.join(F.broadcast(total)).withColumn("turn", F.pmod(F.col("pos") - offset, F.col("total")))
    return turned.where(F.col("turn") < n).drop("total")


def next_offset(ring: DataFrame, offset: int, n: int) -> DataFrame:
    """One row: next_offset, where the slice after this one begins; 0 for an empty ring."""
    return ring.agg(F.coalesce(F.pmod(F.lit(offset + n), F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("bigint").alias("next_offset"))


def budget_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Per key, rows in order until the budget is passed; the first one always."""
    return running(df, keys, order, cost).where((F.col("rn") == 1) | (F.col("cum") <= budget))


def line_windows(df: DataFrame, text: Column, size: int = 40, overlap: int = 5) -> DataFrame:
    """start_line, end_line, content: windows of `size` lines, the next `size - overlap` further on, a tail window included."""
    lines = F.split(text, "\n")
    step = size - overlap
    return (
        df.where(text.isNotNull() & (text != ""))
        .withColumn("lines", lines)
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("lines") - 1, F.lit(step))))
        .withColumn("start_line", F.col("start") + 1)
        .withColumn("end_line", F.least(F.col("start") + size, F.size("lines")))
        .withColumn("content", F.array_join(F.slice("lines", F.col("start") + 1, F.lit(size)), "\n"))
        .drop("lines", "start")
    )


def heading_sections(df: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """section, start_line, end_line, heading, content: a section starts at a line with one to four # and a blank; what comes before is section 0."""
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = df.where(text.isNotNull() & (text != "")).select(*keys, F.posexplode(F.split(text, "\n")).alias("p", "l")).withColumn("line", F.col("p") + 1)
    marked = lines.withColumn("head", F.when(F.col("l").rlike("^#{1,4} "), 1).otherwise(0)).withColumn("section", F.sum("head").over(w).cast("int"))
    return marked.groupBy(*keys, "section").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"),
        F.max(F.when(F.col("head") == 1, F.trim(F.regexp_replace("l", "^#{1,4} ", "")))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "l"))), lambda x: x["l"]), "\n").alias("content"),
    )
