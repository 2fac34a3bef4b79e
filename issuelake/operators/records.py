"""Fallbacks, caches and traces as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StructType


def or_else(wanted: DataFrame, other: DataFrame) -> DataFrame:
    """`wanted`, or `other` where it has no row. One row tells; neither side is collected."""
    none = wanted.limit(1).agg((F.count("*") == 0).alias("__none"))
    return wanted.unionByName(other.join(F.broadcast(none)).where("__none").drop("__none"))


def not_modified(fetches: DataFrame, keys: Sequence[str], order: Sequence[Column], tag: str) -> DataFrame:
    """fetches with not_modified: whether the tag is that of the fetch of the same key before."""
    before = F.lag(tag).over(Window.partitionBy(*keys).orderBy(*order))
    return fetches.withColumn("not_modified", F.coalesce(F.col(tag) == before, F.lit(False)))


def flat_rows(traces: DataFrame, skipped: str = "SKIPPED") -> DataFrame:
    """Fields of struct columns as columns of their own, named column_field; nulls become '', 0 or false, a null decision `skipped`, and lists one text parted by '; '."""
    out = []
    for f in traces.schema.fields:
        if not isinstance(f.dataType, StructType):
            out.append(F.col(f.name))
            continue
        for g in f.dataType.fields:
            c = F.col(f"`{f.name}`.`{g.name}`")
            if isinstance(g.dataType, ArrayType):
                c = F.coalesce(F.array_join(c, "; "), F.lit(""))
            elif isinstance(g.dataType, BooleanType):
                c = F.coalesce(c, F.lit(False))
            elif isinstance(g.dataType, NumericType):
                c = F.coalesce(c, F.lit(0).cast(g.dataType))
            else:
                c = F.coalesce(c.cast("string"), F.lit(skipped if g.name == "decision" else ""))
            out.append(c.alias(f"{f.name}_{g.name}"))
    return traces.select(*out)


def decisions(rows: DataFrame) -> DataFrame:
    """stage, decision, n of flat_rows: counts of every column that ends in _decision, in one pass."""
    stages = [c.removesuffix("_decision") for c in rows.columns if c.endswith("_decision")]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_decision").alias("decision")) for s in stages]))
    return rows.select(each.alias("x")).groupBy("x.stage", "x.decision").agg(F.count("*").alias("n"))
