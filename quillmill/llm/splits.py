"""Splits that keep related records together (problem 6).

Records are related by a shared key (their domain, their passage), directly or through others.
Only keys are linked, never records: a passage seen under two domains is one edge, so the graph
is as large as the distinct keys and a key that holds a third of all rows stays one node.
Distributed union-find (`components`) gives the groups; groups are then assigned largest first
to the split furthest below its target. The greedy runs over the histogram of group sizes, which
has at most sqrt(2 * records) rows, and a distributed rank tells each group its place there.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm import sql
from quillmill.llm.registry import register
from quillmill.operators.ranking import global_rank
from quillmill.session import materialize, table

#: Runs of an assignment that are broadcast; more are joined by shuffle.
BROADCAST_RUNS = 100_000


def dataset_name(c: Column) -> Column:
    """One spelling of a source dataset: lower case, ``-`` as ``_``, no ``.jsonl`` ending."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "-", "_"), r"\.jsonl$", "")


def domain_words(c: Column) -> Column:
    """Letter-only words in order: what makes two spellings of a domain one; null if there is none."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^\p{L}+$"))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def passage_words(c: Column) -> Column:
    """A passage up to case and white space; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.when(t != "", t)


def _digest(kind: str, c: Column) -> Column:
    """128-bit digest of a key, null for null."""
    return F.unhex(F.md5(F.concat(F.lit(kind), c.cast("string"))))


def related_groups(records: DataFrame) -> DataFrame:
    """(record, root) where ``records`` has (record: bigint, domain: string, passage: string).

    Records with equal, non-null domain or passage are in one group, also through others. Null
    records are dropped; a record with neither key is its own group. Repeated records and keys
    count once. ``root`` is an arbitrary but stable digest of the group.
    """
    r = records.where("record is not null").select("record", _digest("d", F.col("domain")).alias("dk"), _digest("p", F.col("passage")).alias("pk"))
    edges = r.where("dk is not null and pk is not null").groupBy("dk", "pk").agg(F.lit(1)).select(F.col("pk").alias("a"), F.col("dk").alias("b"))
    # a passage under one domain only links nothing new: its root is the domain's
    by_passage = materialize(edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")), "passages")
    several = edges.join(by_passage.where("lo < hi").select("a", "lo"), "a").where("b <> lo").select("b", "lo")  # domains that share a passage
    nodes = materialize(several.select(F.col("b").alias("key")).union(several.select("lo")).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    numbered = several.join(nodes.select(F.col("key").alias("b"), F.col("id").alias("x")), "b").join(nodes.select(F.col("key").alias("lo"), F.col("id").alias("y")), "lo")
    comp = connected_components(numbered.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = comp.join(nodes.withColumnRenamed("id", "node"), "node").join(nodes.select(F.col("id").alias("root"), F.col("key").alias("top")), "root").select(F.col("key").alias("node"), "top")
    key = F.coalesce("dk", "lo", "pk", _digest("r", F.col("record")))
    keyed = r.join(by_passage.select(F.col("a").alias("pk"), "lo"), "pk", "left").select("record", key.alias("node"))
    return keyed.join(roots, "node", "left").select("record", F.coalesce("top", "node").alias("root")).groupBy("record").agg(F.min("root").alias("root"))


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(root, n, split): greedy largest-first assignment of whole groups.

    ``groups`` has (root, n). Each group goes to the split furthest below its share of all
    records; equal shortfalls go to the split named first. Groups of equal size can be taken in
    any order: they are lined up by a seeded hash, and each split gets as many of them as the
    greedy gives it, side by side. Shares are weights and need not add up to 1; no groups give no
    rows.
    """
    if not shares or min(shares.values()) < 0 or sum(shares.values()) <= 0:
        raise ValueError("shares must be weights of at least 0, not all 0")
    groups = groups.select("root", "n")
    hist = groups.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()  # at most sqrt(2 * records) rows
    runs = place_runs([(int(h["n"]), int(h["c"])) for h in hist], shares)
    spark = groups.sparkSession
    ranked = global_rank(groups, [F.desc("n"), F.xxhash64(F.lit(seed), "root"), F.col("root")], "place")
    plan = spark.createDataFrame(runs or [(0, 0, 0, "")], "n long, first long, last long, split string")
    # at most a row per size and split
    plan = F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan
    return ranked.join(plan, (ranked.n == plan.n) & ranked.place.between(plan["first"] + 1, plan["last"])).select("root", ranked.n, "split")


def place_runs(hist: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """Runs (size, first, last, split) over the groups in order, sizes largest first: the groups
    after place ``first`` up to ``last`` have that size and go to ``split``; at most one run a size
    and split.

    A split takes its k-th group of a size while its shortfall is still x - (k - 1) * size, so of c
    groups each split gets those of its offers that are among the c largest of all offers.
    """
    total, names = sum(n * c for n, c in hist), list(shares)
    weight = {s: Fraction(shares[s]) for s in names}
    per = total / sum(weight.values(), Fraction(0))
    unit = math.lcm(*[(per * w).denominator for w in weight.values()])
    short = {s: int(per * weight[s] * unit) for s in names}  # exact, in parts of a record
    out: list[tuple[int, int, int, str]] = []
    at = 0
    for n, c in hist:
        step = n * unit
        low, high = min(short.values()) - c * step, max(short.values())  # the c-th largest offer lies between
        while low < high:
            mid = (low + high + 1) // 2
            if sum(max(0, (x - mid) // step + 1) for x in short.values()) >= c:
                low = mid
            else:
                high = mid - 1
        got = {s: max(0, (short[s] - low - 1) // step + 1) for s in names}
        left = c - sum(got.values())
        for s in names:  # offers equal to the last one taken: first come
            if left and short[s] >= low and (short[s] - low) % step == 0:
                got[s] += 1
                left -= 1
        for s in names:
            if got[s]:
                out.append((n, at, at + got[s], s))
                at += got[s]
                short[s] -= got[s] * step
    return out


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "domain_seed").select(
        "seed_no", dataset_name(F.col("source_dataset")).alias("ds"), F.col("id").alias("domain_id"), domain_words(F.col("domain_text")).alias("words")
    )


def task_keys(spark: SparkSession, d: str) -> DataFrame:
    """(record, domain, passage) of every task that has a source row."""
    by_id = _seeds(spark, d).groupBy("ds", "domain_id").agg(F.min("words").alias("seed_words"))
    row = F.col("metadata.source_row")
    t = table(spark, d, "sft_task").where(row.isNotNull() & F.col("task_no").isNotNull()).select(
        F.col("task_no").alias("record"), dataset_name(F.col("source_dataset")).alias("ds"), row["domain_index"].alias("domain_id"),
        domain_words(row["domain_seed"]).alias("own"), F.md5(passage_words(row["content"])).alias("passage"),
    )
    return t.join(by_id, ["ds", "domain_id"], "left").select(
        "record", F.coalesce("seed_words", "own").alias("domain"), "passage"
    )


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(record, root) and (root, group_no), the latter only of groups with a domain."""
    keys = materialize(task_keys(spark, d), "keys")
    member = materialize(related_groups(keys), "groups")
    first_seed = _seeds(spark, d).where("words is not null").groupBy(F.col("words").alias("domain")).agg(F.min("seed_no").alias("seed_no"))
    named = keys.where("domain is not null").join(member, "record").groupBy("root", "domain").agg(F.lit(1)).select("root", "domain")
    return member, named.join(first_seed, "domain").groupBy("root").agg(F.min("seed_no").alias("group_no"))


@register("p6_found", sql.P6)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Group of every task that is related to a known domain."""
    member, number = _groups(spark, d)
    return member.join(number, "root").select(F.col("record").alias("task_no"), "group_no")


@register("p6_split")
def p6_split(spark: SparkSession, d: str) -> DataFrame:
    """Split of every task with a source row, in the shares of ``split_target``."""
    member, _ = _groups(spark, d)
    shares = {r["split"]: float(r["split_percent"]) for r in table(spark, d, "split_target").orderBy(F.desc("split_percent"), "split").collect()}
    sized = materialize(member.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    return member.join(assign_splits(sized, shares), "root").select(F.col("record").alias("task_no"), "split", F.col("n").alias("group_size"))
