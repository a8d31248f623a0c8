"""Joins by id: matching, lookups, updates and example pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import text_or_empty
from quillmill.operators.dedup import keep_last
from quillmill.operators.ranking import top_by


def match_last(left: DataFrame, right: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Inner match on the key, the last row of each side; blank keys match nothing. The right
    side's other columns get the prefix ``right_``."""

    def last(df: DataFrame) -> DataFrame:
        return keep_last(df.where(text_or_empty(F.col(key).cast("string")) != ""), [key], pos).drop(pos)

    r = last(right)
    return last(left).join(r.select(key, *[F.col(c).alias("right_" + c) for c in r.columns if c != key]), key)


def lookup_last(df: DataFrame, table: DataFrame, keys: list[str], value: str, pos: str = "pos") -> DataFrame:
    """``df`` with the value of the last matching row; empty where there is none. Column
    ``matched`` tells which."""
    t = keep_last(table, keys, pos).select(*keys, F.col(value), F.lit(True).alias("_m"))
    return df.join(t, keys, "left").withColumn("matched", F.coalesce("_m", F.lit(False))).withColumn(value, F.coalesce(value, F.lit(""))).drop("_m")


def update_rows(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the listed columns taken from ``new`` where its key occurs there with a value."""
    n = new.select(F.col(key), *[F.col(c).alias("_new_" + c) for c in columns])
    j = df.join(n, key, "left")
    return j.withColumns({c: F.coalesce("_new_" + c, c) for c in columns}).drop(*["_new_" + c for c in columns])


def example_pool(items: DataFrame, pool: DataFrame, group: str, key: str, order: list[str], k: int) -> DataFrame:
    """(key, example, place): the first ``k`` pool rows of an item's group, by the columns
    ``order``, that are not the item itself. Only k + 1 rows of each group take part, so the join
    stays linear in the items."""
    first = top_by(pool, [group], [F.col(c) for c in order], k + 1)
    named = first.select(group, F.col(key).alias("example"), F.struct(*order).alias("_order"))
    j = items.select(group, key).join(named, group).where(F.col(key) != F.col("example"))
    return top_by_place(j, [key], [F.col("_order")], k).select(key, "example", "place")


def top_by_place(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key with their ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
