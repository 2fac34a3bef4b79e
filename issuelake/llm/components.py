"""Connected components by hash-to-min, kept as rows instead of per-node sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelake.session import cut_lineage

#: A node with this fraction of all rows or more is joined by a broadcast; at most so many nodes are.
HEAVY = 1_000


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the least node of its component.

    `edges` has two columns `a`, `b` of one orderable type; a node without a
    partner is given as (v, v). Nulls on either side drop the edge. Returns
    `node`, `component`, one row per distinct node.

    In hash-to-min each node v holds a cluster, sends the whole cluster to its
    least member m and sends m to every other member, until nothing changes.
    The clusters are rows (node, member), so the cluster of a least node may
    hold a third of all rows and still is spread over tasks: no round collects
    a cluster, and its minimum is a partially aggregated `min`. The minimum is
    handed back without moving the rows of a node that holds a HEAVY-th of all
    rows or more: there are at most HEAVY of these, whatever the input, and
    they are broadcast; the other nodes join on their key. Rounds grow with the
    logarithm of the diameter. Each round is cut by a reliable checkpoint, and
    the change test is one aggregated row.
    """
    pairs = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    state = cut_lineage(
        pairs.select(F.col("a").alias("node"), F.col("b").alias("member"))
        .union(pairs.select(F.col("b"), F.col("a")))
        .union(pairs.select(F.col("a"), F.col("a")))
        .union(pairs.select(F.col("b"), F.col("b")))
        .distinct()
    )
    seen = _fingerprint(state)
    for _ in range(max_rounds):
        least = state.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("held"))
        # nodes with a share of 1 / HEAVY of the rows: HEAVY of them at most
        heavy = least.where(F.col("held") * HEAVY >= F.lit(seen[0])).select(F.col("node").alias("big"), F.col("least").alias("of_big"))
        marked = state.join(F.broadcast(heavy), F.col("node") == F.col("big"), "left")
        rest = marked.where("big is null").select("node", "member").join(least.where(F.col("held") * HEAVY < F.lit(seen[0])), "node")
        held = marked.where("big is not null").select("node", "member", F.col("of_big").alias("least")).union(rest.select("node", "member", "least"))
        state = cut_lineage(
            held.select(
                F.explode(
                    F.array(
                        F.struct(F.col("least").alias("node"), F.col("member").alias("member")),
                        F.struct(F.col("member").alias("node"), F.col("least").alias("member")),
                    )
                ).alias("x")
            )
            .select("x.node", "x.member")
            .distinct()
        )
        now = _fingerprint(state)
        if now == seen:
            return state.groupBy("node").agg(F.min("member").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _fingerprint(state: DataFrame) -> tuple:
    """Row count and two order-free checksums of the cluster rows."""
    h = F.xxhash64("node", "member")
    return tuple(state.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
