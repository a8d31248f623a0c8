"""Ranks over a whole table without gathering it into one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with its 1-based place under ``order`` as column ``name``.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the
    number of rows before it; only one count per partition reaches the driver. ``order`` has to
    be total (end it with a key), or equal rows get their places in any order. Empty in, empty out.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = materialize(sorted_.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = {r["p"]: r["c"] for r in numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    shift, at = [], 0
    for p in sorted(counts):
        shift.append((p, at))
        at += counts[p]
    offsets = spark.createDataFrame(shift or [(0, 0)], "_p long, _before long")
    return (
        numbered.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_id", "_p", "_before")
    )


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key under ``order``; Spark cuts each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
