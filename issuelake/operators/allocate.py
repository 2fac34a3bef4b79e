"""Allocations that depend on order: budgets in two stages, balanced selection, packing of evidence, rate limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the token budget by class, and the order of the second stage.
SHARES = {"SOURCE_CODE": 0.65, "TESTS": 0.15, "DOCUMENTATION": 0.15, "CONFIGURATION": 0.05}
SECOND = ("SOURCE_CODE", "TESTS", "DOCUMENTATION", "CONFIGURATION")


def admit(files: Sequence[tuple[str, str, Sequence[int]]], budget: int, shares: Mapping[str, float], most_files: int) -> dict[int, int]:
    """File number -> chunks admitted. files: (class, name, token counts of its chunks) in order.

    First each class has its share: of each file the leading chunks that fit
    are taken. Then files that got none are tried in class order against what is
    left of the whole budget.
    """
    taken: dict[int, int] = {}
    spent_all = 0
    spent = dict.fromkeys(shares, 0)
    for stage in (1, 2):
        order = range(len(files)) if stage == 1 else sorted((i for i in range(len(files)) if i not in taken), key=lambda i: (SECOND.index(files[i][0]) if files[i][0] in SECOND else len(SECOND), i))
        for i in order:
            if len(taken) >= most_files:
                break
            kind, _, costs = files[i]
            n = 0
            for c in costs:
                over = spent_all + c > budget or (stage == 1 and spent.get(kind, 0) + c > budget * shares.get(kind, 0.0))
                if over:
                    break
                spent_all += c
                spent[kind] = spent.get(kind, 0) + c
                n += 1
            if n:
                taken[i] = n
    return taken


def two_stage_budget(chunks: DataFrame, budget: int = 150_000, shares: Mapping[str, float] = SHARES, most_files: int = 100) -> DataFrame:
    """repo_name, file_path, admitted: the allocation of every repository.

    `chunks` has repo_name, file_path, info_class, start_line, chunk_id, tokens.
    The chunk list of a file is aggregated first, and files that come after
    `most_files` whole budgets of smaller ones cannot be admitted; so a group
    holds one short row a file, not its chunks' texts.
    """
    files = chunks.groupBy("repo_name", "file_path").agg(F.min("info_class").alias("info_class"), F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", "tokens"))).alias("c"))
    rows = files.select("repo_name", "file_path", "info_class", F.transform("c", lambda x: x["tokens"]).alias("costs"))

    def run(pdf):
        pdf = pdf.sort_values("file_path", kind="stable")
        got = admit([(k, f, list(c)) for k, f, c in zip(pdf["info_class"], pdf["file_path"], pdf["costs"])], budget, shares, most_files)
        keep = sorted(got)
        return pd.DataFrame({"repo_name": pdf["repo_name"].iloc[keep].to_numpy(), "file_path": pdf["file_path"].iloc[keep].to_numpy(), "admitted": [got[i] for i in keep]})

    return rows.groupBy("repo_name").applyInPandas(run, "repo_name string, file_path string, admitted int")


def balanced_quotas(sizes: Mapping[str, int], budget: int) -> dict[str, int]:
    """How many each pool gives when they share a budget round by round, those that run dry dropping out."""
    left, quota = dict(sorted(sizes.items())), dict.fromkeys(sorted(sizes), 0)
    while budget > 0 and any(left.values()):
        live = [p for p in left if left[p] > 0]
        share = max(1, budget // len(live))
        for p in live:
            n = min(share, left[p], budget)
            quota[p] += n
            left[p] -= n
            budget -= n
    return quota


def balanced_select(rows: DataFrame, pool: str, order: Sequence[Column], budget: int, most_pools: int = 10_000) -> DataFrame:
    """The first rows of every pool, as many as its quota; rows of a null pool are one. Only the sizes of the pools reach the driver; more pools than `most_pools` are refused. Each partition is cut to the largest quota before rows move."""
    keyed = rows.withColumn("__pool", F.coalesce(F.col(pool).cast("string"), F.lit("\0")))
    sizes = keyed.groupBy("__pool").agg(F.count("*").alias("n")).limit(most_pools + 1).collect()
    if len(sizes) > most_pools:
        raise ValueError(f"more than {most_pools} pools")
    quotas = balanced_quotas({r[0]: r["n"] for r in sizes}, budget)
    q = rows.sparkSession.createDataFrame(list(quotas.items()), "__pool string, quota int")
    # the constant bound is what lets each partition be cut; the quota of the pool follows
    ranked = keyed.withColumn("__rn", F.row_number().over(Window.partitionBy("__pool").orderBy(*order))).where(F.col("__rn") <= max(quotas.values(), default=0))
    return ranked.join(F.broadcast(q), "__pool").where(F.col("__rn") <= F.col("quota")).drop("__rn", "quota", "__pool")


def pack_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], budget: Column, at_least: int = 2, extra: int = 50) -> DataFrame:
    """The rows of each key, with `pos`, that a package takes: in their order, each that fits the budget with `extra` tokens more, or is among the first `at_least` taken; what does not fit is passed over.

    The fold is by nature one pass over a key in its order; it reads sorted
    batches and holds two numbers, so that a key of any size fits a task.
    """
    ordered = rows.withColumn("__budget", budget.cast("bigint")).withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.drop("__budget").schema.fields)
    names = [c for c in ordered.columns if c != "__budget"]
    spread = ordered.repartition(*keys).sortWithinPartitions(*keys, "pos")

    def run(batches):
        spent = taken = 0
        for pdf in batches:
            keep = []
            for pos, tokens, limit in zip(pdf["pos"].tolist(), pdf["tokens"].tolist(), pdf["__budget"].tolist()):
                if pos == 1:
                    spent = taken = 0
                ok = spent + tokens + extra <= limit or taken < at_least
                keep.append(ok)
                if ok:
                    spent, taken = spent + tokens + extra, taken + 1
            yield pdf.loc[keep, names]

    return spread.mapInPandas(run, schema)


def reduced(packed: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Of pack_in_order's rows with a boolean `test`: all tests, and of the rest the first and those within what the tests leave of the budget. A package is small by construction."""
    w = Window.partitionBy(*keys)
    tests = F.sum(F.when(F.col("test"), F.col("tokens")).otherwise(0)).over(w)
    ranked = w.orderBy(F.col("test"), "pos")
    rows = packed.withColumn("__t", tests).withColumn("__n", F.row_number().over(ranked)).withColumn("__c", F.sum("tokens").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("test") | (F.col("__n") == 1) | (F.col("__t") + F.col("__c") <= budget)).drop("__t", "__n", "__c")


def limiter(times: Sequence[float], costs: Sequence[int], gap: float, per_window: int, tokens: int, window: float = 60.0, held: tuple | None = None, carry: bool = False):
    """When each request may start: `gap` seconds after the one before, and within the requests and tokens of a window that begins anew when it has passed.

    `held` is what an earlier run left: last start, begin of the window,
    requests and tokens in it. With `carry` what this run leaves is returned too.
    """
    out: list[float] = []
    last, opened, n, spent = held or (float("-inf"), float("-inf"), 0, 0)
    for t, c in zip(times, costs):
        at = max(t, last + gap)
        if at - opened >= window:
            opened, n, spent = at, 0, 0
        if n and (n + 1 > per_window or spent + c > tokens):
            at = opened + window
            opened, n, spent = at, 0, 0
        n, spent, last = n + 1, spent + c, at
        out.append(at)
    return (out, (last, opened, n, spent)) if carry else out


def quota_simulation(events: DataFrame, key: str, time: str, cost: str, gap: float = 4.6, per_window: int = 13, tokens: int = 1_000_000) -> DataFrame:
    """key, event_id, wait: seconds that each request waits for the limits of its key. A key's requests stand in one fold by nature; keys run side by side."""

    def run(pdf):
        pdf = pdf.sort_values(["t", "event_id"])
        at = limiter(pdf["t"].tolist(), pdf["c"].tolist(), gap, per_window, tokens)
        return pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "wait": [round(a - t, 3) for a, t in zip(at, pdf["t"])]})

    rows = events.select(F.col(key).cast("bigint").alias("key"), "event_id", F.col(time).cast("double").alias("t"), F.col(cost).cast("bigint").alias("c"))
    return rows.groupBy("key").applyInPandas(run, "key bigint, event_id bigint, wait double")


def hold_out(sizes: Sequence[tuple[str, int]], shares: Mapping[str, float]) -> dict[str, str]:
    """Group -> split, groups in their order: the first split besides 'train' whose share the group still fits, else train."""
    total = sum(n for _, n in sizes)
    room = {s: w * total for s, w in shares.items() if s != "train"}
    out = {}
    for name, n in sizes:
        out[name] = next((s for s in room if room[s] >= n), "train")
        if out[name] != "train":
            room[out[name]] -= n
    return out


def holdout_split(rows: DataFrame, group: str, stratum: str, shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """rows with `split`: whole groups are held out within each stratum, in the order of a seeded digest. Only sizes of groups meet in a task."""
    sizes = rows.groupBy(stratum, group).agg(F.count("*").alias("n")).withColumn("o", F.sha2(F.concat(F.lit(f"{seed}"), F.coalesce(group, F.lit(""))), 256))

    def run(pdf):
        pdf = pdf.sort_values("o")
        got = hold_out(list(zip(pdf[group], pdf["n"])), shares)
        return pd.DataFrame({"__s": pdf[stratum], "__g": pdf[group], "split": [got[g] for g in pdf[group]]})

    plan = sizes.groupBy(stratum).applyInPandas(run, "__s string, __g string, split string")
    return rows.join(plan, rows[stratum].eqNullSafe(plan["__s"]) & rows[group].eqNullSafe(plan["__g"])).drop("__s", "__g")
