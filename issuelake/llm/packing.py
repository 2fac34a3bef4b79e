"""Filling containers of fixed capacity by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from issuelake.llm.bpe import PATTERN, VOCABULARY, token_counts
from issuelake.session import stored

CAPACITY = 2048
#: Items of one size that are numbered in one part; a size has as many parts as it needs.
PART = 500_000


class OpenBins:
    """A segment tree over remaining capacities 0..capacity; a leaf counts the open bins that have it left."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, left: int, bins: int) -> None:
        i = left + self.leaves
        while i:
            self.count[i] += bins
            i //= 2

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least `size` with an open bin, or -1: logarithmic in the capacity."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not self.count[i]:
                        i += 1
                return i - self.leaves
            i //= 2
        return -1


def plan_bins(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (size, count) pairs, all items of a size at a time.

    Returns (size, first, until, per_bin, base): the items number first..until-1
    of that size, `per_bin` to a bin, go to bins base, base + 1, ... This is
    the very packing that best-fit decreasing makes item by item: the bin that
    just took an item is the tightest one for the next of equal size for as
    long as it has room, then the next bin with the same rest follows. Bins
    with an equal rest are kept as runs of consecutive numbers. Each step
    closes a run or ends a size, and at most one run is cut per size, so there
    are at most 3 runs for each size and the plan has a number of rows that
    depends on the capacity alone (in practice two or three for each size).
    """
    tree = OpenBins(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # rest -> runs of (base, bins)
    plan: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def open_(left: int, base: int, bins: int) -> None:
        if left > 0 and bins > 0:
            runs.setdefault(left, []).append((base, bins))
            tree.add(left, bins)

    for size, count in sorted(histogram, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit a container of {capacity}")
        done = 0
        while done < count:
            left = tree.tightest(size)
            if left < 0:
                left, base, bins = capacity, fresh, -(-(count - done) // (capacity // size))
                fresh += bins
            else:
                base, bins = runs[left].pop()
                tree.add(left, -bins)
            per = left // size
            full, rest = divmod(min(count - done, per * bins), per)
            taken = full * per + rest
            plan.append((size, done, done + taken, per, base))
            open_(left - per * size, base, full)
            if rest:
                open_(left - rest * size, base + full, 1)
            used = full + (1 if rest else 0)
            open_(left, base + used, bins - used)
            done += taken
    return plan


PLAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n", "first", "until", "per_bin", "base")])


def pack_sizes(items: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """id, piece, first_token, n_tokens, container_id: best-fit decreasing over all rows of `items`.

    An item above the capacity is split into pieces of exactly the capacity
    and a rest; nothing else is split. Items of size null, zero or less need
    no place and are left out. Only the histogram of sizes, at most `capacity`
    rows whatever the input, reaches the driver; the plan it gives is bounded
    by the capacity too and is broadcast. Items are numbered within their
    size in parts of about PART items each, so a size that a third of the rows
    share is no single task; the tally of the parts, a row for each PART items
    and one for each size at most, is broadcast. Ties are broken by id; equal rows are interchangeable, each
    gets a place of its own. Repeated ids with other sizes are other items.
    """
    sized = items.select(F.col(id_col).alias("rid"), F.col(size_col).cast("long").alias("size")).where("size > 0")
    pieces = sized.select(
        "rid",
        F.explode(
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}")),
                lambda i: F.struct(i.cast("int").alias("piece"), F.least(F.lit(capacity), F.col("size") - i * capacity).cast("long").alias("n")),
            )
        ).alias("x"),
    ).select("rid", "x.piece", "x.n")
    pieces = stored(pieces)
    spark = pieces.sparkSession
    histogram = sorted((r["n"], r["c"]) for r in pieces.groupBy("n").agg(F.count("*").alias("c")).collect())
    plan = spark.createDataFrame(plan_bins(histogram, capacity), PLAN)
    parts = F.broadcast(spark.createDataFrame([(n, -(-c // PART)) for n, c in histogram], "n bigint, parts bigint"))
    salted = pieces.join(parts, "n").withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.col("parts"))).drop("parts")
    counts = salted.groupBy("n", "salt").agg(F.count("*").alias("c"))
    offsets = counts.select("n", "salt", (F.sum("c").over(Window.partitionBy("n").orderBy("salt")) - F.col("c")).alias("offset"))
    numbered = salted.withColumn("k", F.row_number().over(Window.partitionBy("n", "salt").orderBy("rid", "piece")) - 1)
    placed = (
        numbered.join(F.broadcast(offsets), ["n", "salt"])
        .withColumn("at", F.col("offset") + F.col("k"))
        .join(F.broadcast(plan.withColumnRenamed("n", "plan_n")), F.expr("n = plan_n and at >= first and at < until"))
    )
    return placed.select(
        F.col("rid").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.col("n").alias("n_tokens"),
        F.expr("base + (at - first) div per_bin").alias("container_id"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """pack_sizes over texts measured in tokens. Null and empty texts need no place."""
    return pack_sizes(token_counts(docs, id_col, text_col, path, pattern), capacity, id_col, "n_tokens")
