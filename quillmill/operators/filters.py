"""Row filters: required fields, candidate checks, ranked drops and rollout filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.scores import HIGHER_IS_BETTER
from quillmill.functions.text import text_or_empty
from quillmill.operators.ranking import global_rank


def has_fields(*cs: str) -> Column:
    """Whether none of the columns is null or blank."""
    return reduce(lambda a, b: a & b, [text_or_empty(F.col(c)) != "" for c in cs])


def valid_candidate(content: Column, question: Column, answer: Column) -> Column:
    """Candidate with its parts stripped and its question ending in a question mark; null if a
    part is missing or shorter than 20, 8 and 3 characters."""
    c, q, a = (text_or_empty(x) for x in (content, question, answer))
    asked = F.when(q.contains("?"), q).otherwise(F.concat(F.rtrim(q, F.lit(".")), F.lit("?")))
    ok = (F.length(c) >= 20) & (F.length(q) >= 8) & (F.length(a) >= 3)
    return F.when(ok, F.struct(c.alias("content"), asked.alias("question"), a.alias("answer")))


def passes_threshold(score: Column, threshold: float, field: str) -> Column:
    """Keep at or beyond the threshold in the field's better direction; unscored rows stay."""
    better = score >= threshold if field in HIGHER_IS_BETTER else score <= threshold
    return F.coalesce(better, F.lit(True))


def _worst_first(field: str, pos: str) -> list[Column]:
    """Drops come from one end of the order by score and position: its start, or its end read backwards."""
    if field in HIGHER_IS_BETTER:
        return [F.col("score").asc(), F.col(pos).asc()]
    return [F.col("score").desc(), F.col(pos).desc()]


def drop_bottom(df: DataFrame, percent: float, field: str, pos: str = "pos") -> DataFrame:
    """Drop the worst ``percent`` of all rows by ``score``: int(percent / 100 * n) rows; of equal
    scores the first go where higher is better, else the last. The rank is distributed; no window
    holds the table."""
    n = df.count()
    ranked = global_rank(df, _worst_first(field, pos), "_worst")
    return ranked.where(F.col("_worst") > int(percent / 100.0 * n)).drop("_worst")


def drop_bottom_per_group(df: DataFrame, percent: float, field: str, group: str, pos: str = "pos") -> DataFrame:
    """Drop the worst ``percent`` of every group. Ranks come from one distributed sort by group
    and score, so a group that holds a third of the table is ranked by many tasks."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(df, [F.col(group).asc_nulls_first(), *_worst_first(field, pos)], "_place")
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_place").alias("_first"))
    bounds = first.join(sizes, F.col("_g").eqNullSafe(F.col(group))).select("_g", "_first", F.floor(F.lit(percent / 100.0) * F.col("_n")).alias("_drop"))
    j = ranked.join(bounds, F.col(group).eqNullSafe(F.col("_g")))
    return j.where(F.col("_place") - F.col("_first") >= F.col("_drop")).drop("_place", "_first", "_drop", "_g")


def drop_thresholds(df: DataFrame, percent: float, field: str, group: str, pos: str = "pos") -> DataFrame:
    """(group, threshold, dropped): score of the best row that `drop_bottom_per_group` drops, only of
    groups that lose any."""
    worst = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).select(F.col(group).alias("_g"), F.floor(F.lit(percent / 100.0) * F.col("_n")).alias("_drop")).where("_drop > 0")
    ranked = global_rank(df.select(group, "score", pos), [F.col(group).asc_nulls_first(), *_worst_first(field, pos)], "_place")
    first = ranked.groupBy(F.col(group).alias("_f")).agg(F.min("_place").alias("_first"))
    last = worst.join(first, F.col("_g").eqNullSafe(F.col("_f"))).select("_g", "_drop", (F.col("_first") + F.col("_drop") - 1).alias("_at"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_place") == F.col("_at"))
    return ranked.join(last, same).select(group, F.col("score").alias("threshold"), F.col("_drop").alias("dropped"))


def rollout_outcomes(rollouts: DataFrame, row: str, ok: str) -> DataFrame:
    """(row, n_yes, n_total, reason): easy if all rollouts pass, hard if none does."""
    g = rollouts.groupBy(row).agg(F.count_if(F.col(ok)).alias("n_yes"), F.count(F.lit(1)).alias("n_total"))
    return g.withColumn("reason", outcome_reason(F.col("n_yes"), F.col("n_total")))


def outcome_reason(yes: Column, total: Column) -> Column:
    """easy, hard or empty; a generation error counts -1 passes and is neither."""
    return F.when((total > 0) & (yes == total), "easy").when((total > 0) & (yes == 0), "hard").otherwise("")


def early_stop(rollouts: DataFrame, row: str, place: str, ok: str, chunk: int, mixed: bool) -> DataFrame:
    """(row, n_yes, n_judged): counts as of the chunk at which judging stops: the first with both
    outcomes seen (``mixed``), or with any failure in the chunk; else the last. Made of partial
    aggregates, so a prompt with a tenth of all rollouts needs no task of its own."""
    c = F.floor(F.col(place) / chunk)
    by = rollouts.groupBy(row, c.alias("chunk")).agg(F.count_if(F.col(ok)).alias("y"), F.count(F.lit(1)).alias("n"))
    passed, failed = F.min(F.when(F.col("y") > 0, F.col("chunk"))), F.min(F.when(F.col("y") < F.col("n"), F.col("chunk")))
    both = F.when(passed.isNotNull() & failed.isNotNull(), F.greatest(passed, failed))
    stop = by.groupBy(F.col(row).alias("_row")).agg(F.coalesce(both if mixed else failed, F.max("chunk")).alias("_stop"))
    seen = by.join(stop, F.col(row).eqNullSafe(F.col("_row"))).where(F.col("chunk") <= F.col("_stop"))
    return seen.groupBy(row).agg(F.sum("y").alias("n_yes"), F.sum("n").alias("n_judged"))
