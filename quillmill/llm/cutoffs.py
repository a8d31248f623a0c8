"""Score cutoffs that keep a target share of each source (problem 1).

Sketch-bracketed exact selection. A mergeable quantile sketch with a guaranteed rank error
(Greenwald-Khanna, ``percentile_approx``) gives each source a low and a high bound around its
target rank. One counting pass finds how many records lie above and inside the bracket; only
records inside are ordered, and ties are counted before they are ordered. A bracket that the
counts show to miss the target rank is opened to the whole source, so the cutoff is always the
exact one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm.registry import register
from quillmill.session import materialize, table

#: Relative rank error of the sketch is 1 / ACCURACY; the bracket leaves twice that on each side.
ACCURACY = 2000


def plain_name(c: Column) -> Column:
    """Lower case, every stretch of other characters than a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def usable_scores(audits: DataFrame) -> DataFrame:
    """One row per task: the score of its usable audit with the highest attempt.

    Usable: ``score_valid`` is true and ``prob_yes`` lies within 0..1. Repeated deliveries are
    equal in attempt and score and so count once; of different scores under one attempt the
    higher counts. Rows without a task are left out.
    """
    ok = F.col("score_valid") & ~F.isnan("prob_yes") & F.col("prob_yes").between(0.0, 1.0)
    return (
        audits.where(ok & F.col("task_no").isNotNull())
        .groupBy("task_no")
        .agg(F.max(F.struct(F.coalesce("attempt", F.lit(-1)).alias("a"), F.col("prob_yes").alias("p"))).alias("m"))
        .select("task_no", F.col("m.p").alias("score"))
    )


def task_sections(tasks: DataFrame) -> DataFrame:
    """One row per task that has metadata: (task_no, section); a missing section is null."""
    return (
        tasks.where(F.col("metadata").isNotNull() & F.col("task_no").isNotNull())
        .select("task_no", plain_name(F.coalesce("metadata.section", "metadata.source_row.section")).alias("section"))
        .groupBy("task_no")
        .agg(F.min("section").alias("section"))
    )


def exact_cutoffs(scored: DataFrame, targets: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Cutoff of each source: the highest score such that at least ``pct`` per cent of the
    source's records score as high or higher.

    ``scored`` has (source, score), ``targets`` (source, pct) with pct a whole number. ``scored``
    is read three times and should be a written table. Result: source, n, pct, cutoff, kept.

    * Null and NaN scores are not records; a source without targets or records gives no row.
    * pct of 0 or less keeps nothing (cutoff null, kept 0); 100 or more keeps everything.
    * Ties at the cutoff are all kept, so ``kept`` can exceed the share.
    * A source repeated in ``targets`` takes its highest pct.
    """
    scored = scored.select("source", "score").where(F.col("score").isNotNull() & ~F.isnan("score"))
    targets = targets.where(F.col("pct").isNotNull() & F.col("source").isNotNull()).groupBy("source").agg(F.max("pct").alias("pct"))
    # every distinct percentage is a parameter of the sketch, so at most 100 of them are asked for
    grid = [x / 100.0 for x in range(101)]
    slack = 2.0 / accuracy
    lows = [max(0.0, 1 - q - slack) for q in grid]
    highs = [min(1.0, 1 - q + slack) for q in grid]
    at = F.greatest(F.least(F.ceil("pct"), F.lit(100)), F.lit(0)) + 1
    bracket = (
        scored.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("score", lows + highs, accuracy).alias("q"),
        )
        .join(targets, "source")
        .withColumn("want", F.greatest(F.least(F.expr("(n * pct + 99) div 100"), F.col("n")), F.lit(0)))
        .select("source", "n", "pct", "want", F.element_at("q", at.cast("int")).alias("lo"), F.element_at("q", (at + len(grid)).cast("int")).alias("hi"))
    )
    counts = (
        scored.join(bracket, "source")
        .groupBy("source", "n", "pct", "want", "lo", "hi")
        .agg(F.count_if(F.col("score") > F.col("hi")).alias("above"), F.count_if(F.col("score").between(F.col("lo"), F.col("hi"))).alias("inside"))
        .withColumn("held", (F.col("above") < F.col("want")) & (F.col("above") + F.col("inside") >= F.col("want")))
        .select(
            "source", "n", "pct", "want",
            F.when(F.col("held"), F.col("above")).otherwise(F.lit(0)).alias("above"),
            F.when(F.col("held"), F.col("lo")).otherwise(F.lit(float("-inf"))).alias("lo"),
            F.when(F.col("held"), F.col("hi")).otherwise(F.lit(float("inf"))).alias("hi"),
        )
    )
    counts = materialize(counts, "brackets")
    ties = (
        scored.join(counts, "source")
        .where(F.col("score").between(F.col("lo"), F.col("hi")))
        .groupBy("source", "want", "above", "score")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    run = F.col("above") + F.sum("c").over(Window.partitionBy("source").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    best = (
        ties.withColumn("kept", run)
        .where((F.col("kept") >= F.col("want")) & (F.col("want") > 0))
        .groupBy("source")
        .agg(F.max_by("score", "score").alias("cutoff"), F.min("kept").alias("kept"))
    )
    return counts.join(best, "source", "left").select("source", "n", "pct", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = usable_scores(table(spark, d, "audit_result")).join(task_sections(table(spark, d, "sft_task")), "task_no")
    return materialize(s.select("task_no", F.col("section").alias("source"), "score"), "scored")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keep_target").select(plain_name(F.col("section")).alias("source"), F.col("keep_percent").alias("pct"))


_SQL = """
with a as (
  select task_no, arg_max(prob_yes, attempt) as score from audit_result
  where score_valid and not isnan(prob_yes) and prob_yes between 0 and 1 group by task_no),
t as (
  select task_no, min(trim(regexp_replace(lower(coalesce(metadata.section, metadata.source_row.section)), '[^a-z0-9]+', ' ', 'g'))) as section
  from sft_task where metadata is not null group by task_no),
s as (select t.section, t.task_no, a.score, k.keep_percent as pct from a join t using (task_no) join keep_target k on k.section = t.section),
r as (select *, count(*) over (partition by section) as n, count(*) over (partition by section order by score desc) as at_least from s),
c as (select section, n, pct, max(score) as cutoff from r where at_least * 100 >= pct * n group by all)
"""


@register("p1_cutoffs", _SQL + "select c.section, c.n, c.pct as keep_percent, c.cutoff, count(*) as kept from c join s on s.section = c.section and s.score >= c.cutoff group by all")
def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff and kept size of every section."""
    return exact_cutoffs(_scored(spark, d), _targets(spark, d)).select(
        F.col("source").alias("section"), "n", F.col("pct").alias("keep_percent"), "cutoff", "kept"
    )


@register("p1_found", _SQL + "select s.section, s.task_no from c join s on s.section = c.section and s.score >= c.cutoff")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Kept tasks."""
    scored = _scored(spark, d)
    cut = exact_cutoffs(scored, _targets(spark, d)).select("source", "cutoff")
    return scored.join(cut, "source").where(F.col("score") >= F.col("cutoff")).select(F.col("source").alias("section"), "task_no")
