"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelake.llm.components import hash_to_min
from issuelake.session import cut_lineage, stored

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
#: Values that stand for "nothing known".
FILLERS = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "nan", "unknown", "undefined", "unspecified", "missing", "tbd", "todo", "none/none", "null/null", "unknown/unknown", "n/a/n/a"]


def bare_repository(value: Column) -> Column:
    """What follows host and scheme in any notation of a repository: surrounding white space, percent-encoded slashes, web, API and git addresses with any user, host or port, scp-like git@host:owner/name, queries and fragments are undone."""
    v = F.lower(F.trim(F.regexp_replace(value, r"[\s\u00a0\u200b\ufeff]+", " ")))
    v = F.regexp_replace(F.translate(F.replace(v, F.lit("%2f"), F.lit("/")), "\\", "/"), r"[?#].*$", "")
    # a scheme with its host, a scp-like address, or a bare host before owner/name; then the API's prefix
    v = F.regexp_replace(v, r"^(?:(?:git\+)?(?:[a-z][a-z0-9+.-]*:)?//[^/]*/+|[^/@\s]+@[^/:\s]+[:/]/*|(?:www\.|api\.)?[a-z0-9-]+\.(?:example|com|org|io|net|dev)/(?=[^/]+/[^/]+))", "")
    return F.regexp_replace(v, r"^/*repos/+(?=[^/]+/+[^/]+)", "")


def owner_and_name(bare: Column) -> Column:
    """owner/name at the start of what bare_repository leaves, without a final .git and whatever lies deeper; null for fillers and junk."""
    pair = F.regexp_extract(bare, r"^/*([a-z0-9][a-z0-9_.-]*/+[a-z0-9_.-]+)", 1)
    tidy = F.regexp_replace(F.regexp_replace(pair, "/+", "/"), r"(?:\.git)+$", "")
    return F.when((tidy != "") & ~bare.isin(FILLERS) & ~tidy.isin(FILLERS) & ~tidy.endswith("/"), tidy)


def repository_key(value: Column) -> Column:
    """owner/name in lower case for every notation that leads to the repository; null for fillers and junk."""
    return owner_and_name(bare_repository(value))


def dataset_key(value: Column) -> Column:
    """The twelve hexadecimal digits of a dataset id in lower case, whatever surrounds them; null without exactly one such run, or where all its digits are the same, which is a filler."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"(?<![0-9a-z])([0-9a-f]{12})(?![0-9a-z])"), F.lit(1)))
    only = F.when(F.size(runs) == 1, runs[0])
    return F.when(~only.rlike(r"^(.)\1*$"), only)


def related_groups(records: DataFrame, id_col: str = "record_id", repo_col: str = "repo_name", dataset_col: str = "dataset_id") -> DataFrame:
    """One row per input row: id, `component`, `group_key`, `size` is left to the caller.

    Repositories and dataset ids are the nodes, a record joins the two it
    names. Node names start with 0 for repositories and 1 for dataset ids, so
    that the least node of a component with any repository is its smallest
    repository: `group_key` is that, null if the component has none. A record
    naming neither is alone: its component is "2" and its id (null ids share
    one). Repeated rows stay repeated; an empty table gives an empty result;
    columns besides the three are not read.
    """
    bare = records.select(F.col(id_col).alias("rid"), bare_repository(F.col(repo_col)).alias("bare"), F.concat(F.lit("1"), dataset_key(F.col(dataset_col))).alias("data_node"))
    keyed = stored(bare.select("rid", F.concat(F.lit("0"), owner_and_name(F.col("bare"))).alias("repo_node"), "data_node"))
    edges = keyed.where("repo_node is not null or data_node is not null").select(
        F.coalesce("repo_node", "data_node").alias("a"), F.coalesce("data_node", "repo_node").alias("b")
    ).distinct()
    comp = hash_to_min(edges)
    anchored = keyed.withColumn("node", F.coalesce("data_node", "repo_node"))
    out = anchored.join(comp, "node", "left").select(
        F.col("rid").alias(id_col),
        F.coalesce("component", F.concat(F.lit("2"), F.coalesce(F.col("rid").cast("string"), F.lit("")))).alias("component"),
    )
    return out.withColumn("group_key", F.when(F.col("component").startswith("0"), F.substring("component", 2, 1_000_000)))


def rendezvous(key: Column, weights: Mapping[str, Column], seed: int = 7) -> Column:
    """The split that wins the weighted rendezvous for `key`: the largest of -weight / ln(u), u hashed from key and split; splits without a positive weight do not bid."""
    bids = []
    for name, w in sorted(weights.items()):
        u = (F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 52)) + F.lit(1.0)) / F.lit(float((1 << 52) + 2))
        bids.append(F.when(w > 0, F.struct((-w / F.log(u)).alias("bid"), F.lit(name).alias("split"))))
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["split"]


def grouped_splits(records: DataFrame, shares: Mapping[str, float] = SHARES, seed: int = 7, id_col: str = "record_id", repo_col: str = "repo_name", dataset_col: str = "dataset_id") -> DataFrame:
    """id, component, group_key, split: every component goes to one split as a whole.

    One rule holds for all components: weighted rendezvous hashing, so that a
    component moves only if the weights change, and then no more of them move
    than the change asks for. Rendezvous meets given shares over many
    components alone; therefore components are taken by the powers of two of
    their sizes, the largest first, the weight of a split is the room that the
    larger ones left in it, and a split bids only for what it has room for;
    where none has, the splits bid with their shares. Components of one power
    of two bid at once, so their own chance is not made up for by each other
    but by the smaller ones. There is one small aggregate for each power of two
    that occurs, at most the logarithm of the number of rows.
    """
    whole = float(sum(w for w in shares.values() if w > 0))
    if not whole:
        raise ValueError("no split has a positive share")
    groups = cut_lineage(related_groups(records, id_col, repo_col, dataset_col))
    sizes = stored(groups.groupBy("component").agg(F.count("*").alias("n")).withColumn("power", F.floor(F.log2("n")).cast("int")))
    powers = {r["power"]: r["n"] for r in sizes.groupBy("power").agg(F.sum("n").alias("n")).collect()}
    room = {k: max(w, 0.0) / whole * sum(powers.values()) for k, w in sorted(shares.items())}
    chosen = F.lit(None).cast("string")
    for power in sorted(powers, reverse=True):
        fits = {k: F.when(F.col("n") <= F.lit(room[k]), F.lit(room[k])).otherwise(0.0) for k in room}
        split = F.coalesce(rendezvous(F.col("component"), fits, seed), rendezvous(F.col("component"), {k: F.lit(float(max(w, 0.0))) for k, w in shares.items()}, seed))
        chosen = F.when(F.col("power") == power, split).otherwise(chosen)
        if power:
            for r in sizes.where(F.col("power") == power).groupBy(split.alias("split")).agg(F.sum("n").alias("n")).collect():
                room[r["split"]] -= r["n"]
    return groups.join(sizes.select("component", chosen.alias("split")), "component").select(id_col, "component", "group_key", "split")
