"""Keep-first and keep-last deduplication, and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.ranking import top_by


def keep_first(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """First row of each key by position. Null keys form one key; no rows give no rows."""
    return top_by(df, keys, [F.col(pos).asc()], 1)


def keep_last(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Last row of each key by position."""
    return top_by(df, keys, [F.col(pos).desc()], 1)


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key of a table whose repeated deliveries are equal in the columns at hand."""
    return df.dropDuplicates([key])


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not done yet; a null key is never done."""
    return items.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def group_cap(df: DataFrame, keys: list[str], pos: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key in load order; 0 keeps all."""
    return df if most <= 0 else top_by(df, keys, [F.col(pos).asc()], most)


def signatures(df: DataFrame, sig: Column) -> DataFrame:
    """(signature, n) of signatures that occur more than once."""
    return df.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
