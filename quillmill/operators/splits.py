"""Sampling, splitting, sharding and interleaving, reproducible by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import stable_u32
from quillmill.operators.ranking import global_rank, top_by
from quillmill.session import materialize


def seeded_order(seed: int, key: str) -> list[Column]:
    """Order by a seeded hash of the key, the key itself between equal hashes."""
    return [stable_u32(seed, F.col(key)).asc(), F.col(key).asc()]


def stratified_split(df: DataFrame, strata: str, key: str, holdout: int, seed: int) -> DataFrame:
    """``df`` with column ``split``: of each stratum ``holdout`` rows (all, if there are fewer)
    drawn for val, the rest train. The draw keeps ``holdout`` keys a stratum, so no window is large."""
    val = top_by(df.select(strata, key), [strata], seeded_order(seed, key), holdout).select(F.col(key).alias("_val")).distinct() if holdout > 0 else df.select(F.col(key).alias("_val")).limit(0)
    return df.join(val, F.col(key) == F.col("_val"), "left").withColumn("split", F.when(F.col("_val").isNotNull(), "val").otherwise("train")).drop("_val")


def hash_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows drawn without replacement; all if there are fewer."""
    return df.orderBy(*seeded_order(seed, key)).limit(k)


def sample_per_group(df: DataFrame, groups: list[str], key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of every group drawn without replacement."""
    return top_by(df, groups, seeded_order(seed, key), k)


def group_split(df: DataFrame, group: Column, key: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with column ``split``: whole groups go to val, in seeded order, until it holds
    int(rows * ratio) rows (at least 1 for a ratio above 0). The running sum is over groups, by a
    distributed rank; rows never meet in one window."""
    keyed = df.withColumn("_group", group)
    total = df.count()
    target = int(total * ratio) or (1 if ratio > 0 and total else 0)
    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    val = _head_until(sizes, [stable_u32(seed, F.col("_group")).asc(), F.col("_group").asc()], "_n", target)
    j = keyed.join(val.select(F.col("_group").alias("_v")), F.col("_group") == F.col("_v"), "left")
    return j.withColumn("split", F.when(F.col("_v").isNotNull(), "val").otherwise("train")).drop("_v", "_group")


def _head_until(df: DataFrame, order: list[Column], size: str, target: int) -> DataFrame:
    """First rows under ``order`` until their sizes reach ``target``: sums per block of ranks pick
    the blocks, only the block that crosses is summed row by row."""
    ranked = materialize(global_rank(df, order, "_k"), "ranked")
    block = F.floor(F.col("_k") / 4096)
    sums = ranked.groupBy(block.alias("b")).agg(F.sum(size).alias("s")).orderBy("b").collect()  # a row per 4096 groups
    before = 0
    for r in sums:
        if before + r["s"] >= target:
            w = Window.partitionBy(block).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
            last = ranked.where(block == r["b"]).withColumn("_s", F.coalesce(F.sum(size).over(w), F.lit(0)) + before).where(F.col("_s") < target).drop("_s")
            return ranked.where(block < r["b"]).union(last)
        before += r["s"]
    return ranked


def shard_range(df: DataFrame, order: list[Column], shard: int, shards: int) -> DataFrame:
    """Contiguous shard: places from floor(n * i / t) up to floor(n * (i + 1) / t)."""
    n = df.count()
    lo, hi = n * shard // shards, n * (shard + 1) // shards
    return global_rank(df, order, "_k").where(F.col("_k").between(lo + 1, hi)).drop("_k")


def shard_mod(df: DataFrame, index: Column, shard: int, shards: int) -> DataFrame:
    """Rows whose index modulo the number of shards is the shard."""
    return df.where(F.pmod(index, F.lit(shards)) == shard)


def round_robin(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """``df`` with column ``place``: one row per group in turn, groups in name order, rows within
    a group in seeded order. The turn of a row is its rank within its group, taken from one
    distributed sort."""
    ranked = global_rank(df, [F.col(group).asc(), *seeded_order(seed, key)], "_k")
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_k").alias("_first"))
    turned = ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_turn", F.col("_k") - F.col("_first")).drop("_k", "_first", "_g")
    return global_rank(turned, [F.col("_turn").asc(), F.col(group).asc(), F.col(key).asc()], "place").drop("_turn")


def interleave(df: DataFrame, group: str, key: str, seed: int, exhaust_all: bool = True) -> DataFrame:
    """``df`` drawn from its groups with equal chances until all groups are exhausted (short ones
    start over, so rows repeat) or the first one is; column ``place`` counts the draws from 0.

    The group of a draw is a seeded hash of its place, so draws are made in parallel; where the
    last group is exhausted is found from distributed ranks. The driver holds a row per group.
    """
    spark = df.sparkSession
    ranked = materialize(_within(df, group, key, "_i"), "interleave")
    sizes = {r[0]: r[1] for r in ranked.groupBy(group).agg(F.count(F.lit(1))).collect()}
    names = sorted(sizes)
    if not names:
        return df.withColumn("place", F.lit(0).cast("long"))
    numbered = spark.createDataFrame([(g, i, sizes[g]) for i, g in enumerate(names)], f"`{group}` {dict(df.dtypes)[group]}, _g long, _n long")
    draws = 64 + int(1.2 * len(names) * max(sizes.values()))
    while True:
        drawn = spark.range(draws).select(F.col("id").alias("place"), F.pmod(stable_u32(seed, F.col("id")), F.lit(len(names))).cast("long").alias("_g"))
        turns = materialize(_within(drawn, "_g", "place", "_t").join(F.broadcast(numbered), "_g"), "draws")
        ends = [r[0] for r in turns.where("_t = _n - 1").select("place").collect()]  # one per group
        if len(ends) == len(names) or ends and not exhaust_all:
            break
        draws *= 2
    stop = max(ends) if exhaust_all else min(ends)
    taken = turns.where(F.col("place") <= stop).withColumn("_i", F.col("_t") % F.col("_n")).select(group, "_i", "place")
    return taken.join(ranked, [group, "_i"]).drop("_i")


def _within(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """``df`` with the 0-based place of each row within its group by key, from one distributed sort."""
    ranked = global_rank(df, [F.col(group).asc(), F.col(key).asc()], "_k")
    first = ranked.groupBy(F.col(group).alias("_f")).agg(F.min("_k").alias("_first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_f"))).withColumn(name, F.col("_k") - F.col("_first")).drop("_k", "_first", "_f")


def unique_key(*parts: Column) -> Column:
    """Parts joined by colons."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def natural_step(path: Column) -> Column:
    """Step number of a checkpoint path; a very large one if it has none, so that it sorts last."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"checkpoint-(\d+)", 1), F.lit("")).try_cast("double"), F.lit(1e18))
