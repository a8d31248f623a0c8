"""Queries on counts, rates, spreads and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.scores import mean_std, mean_stderr, rate
from quillmill.functions.text import canonical_section, contains_close, fmt_mean_err, stable_u32
from quillmill.operators import metrics
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, JUDGE, QA, ROLLOUT, TASK, u32_sql
from quillmill.session import table

PHENOMENA = ["Maxims", "Humour", "Irony", "Metaphor", "Deceit", "IndirectSpeech", "Absent"]
_SECTION = "trim(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', ' ', 'g'))"
#: Evaluation records: model, seed, part and whether the decision was to keep.
EVAL = f"{TASK}, {AUDIT}, eval as (select audit_no, backend as model, attempt as seed, {_SECTION} as part, coalesce(decision = 'keep', false) as correct, decision from audit left join task using (task_no))"


def _eval(spark: SparkSession, d: str) -> DataFrame:
    t = v.tasks(spark, d).select("task_no", "section")
    a = v.audits(spark, d).select("audit_no", "task_no", F.col("backend").alias("model"), F.col("attempt").alias("seed"), "decision")
    return a.join(t, "task_no", "left").select("audit_no", "model", "seed", canonical_section(F.col("section")).alias("part"), F.coalesce(F.col("decision") == "keep", F.lit(False)).alias("correct"), "decision")


@register("group_counts", "select b.phenomenon, count(i.item_id) as n from (select unnest(['Maxims','Humour','Irony','Metaphor','Deceit','IndirectSpeech','Absent']) as phenomenon) b left join bench_item i using (phenomenon) group by 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items of a fixed list of phenomena, 0 where there are none."""
    return metrics.count_filled(table(spark, d, "bench_item"), "phenomenon", PHENOMENA)


@register("audit_section_stats", f"with {EVAL} select part as section, count(*) as total, count(*) filter (decision = 'keep') as kept, count(*) filter (decision = 'drop') as dropped from eval group by 1")
def audit_section_stats(spark: SparkSession, d: str) -> DataFrame:
    """Keep, drop and total per section."""
    return _eval(spark, d).groupBy(F.col("part").alias("section")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"))


@register("audit_summary", f"""with {QA} select count(*) as total, count(log_odds) as scored, count(*) - count(log_odds) as unscored,
 round(sum(coalesce(prob_yes, 0.0)::decimal(18,6))::double / count(*), 9) as avg_prob_yes, round(sum(coalesce(log_odds, -20.0)::decimal(18,6))::double / count(*), 9) as avg_log_odds,
 round(sum((1 - coalesce(prob_yes, 0.0))::decimal(18,6))::double / count(*), 9) as avg_prob_drop from qa""")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals and means over all items, unscored ones at 0 and -20."""

    def mean(c):
        return v.r9(F.sum(c.cast("decimal(18,6)")).cast("double") / F.count(F.lit(1)))

    p, o = F.coalesce("prob_yes", F.lit(0.0)), F.coalesce("log_odds", F.lit(-20.0))
    n = F.count(F.lit(1))
    return v.qa(spark, d).agg(
        n.alias("total"), F.count("log_odds").alias("scored"), (n - F.count("log_odds")).alias("unscored"),
        mean(p).alias("avg_prob_yes"), mean(o).alias("avg_log_odds"), mean(1 - p).alias("avg_prob_drop"),
    )


@register("accuracy_rollup", f"""with {EVAL} select model, seed, part, grouping(part) as overall, count(*) as n, round(100.0::double * count(*) filter (correct) / count(*), 9) as accuracy
 from eval group by grouping sets ((model, seed, part), (model, seed))""")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per model and seed, overall and by section."""
    return metrics.accuracy_rollup(_eval(spark, d), "model", "seed", "part", F.col("correct")).withColumn("accuracy", v.r9(F.col("accuracy")))


_ACC = f"with {EVAL}, s as (select model, seed, 100.0::double * count(*) filter (correct) / count(*) as acc from eval group by 1, 2)"


def _acc(spark: SparkSession, d: str) -> DataFrame:
    return _eval(spark, d).groupBy("model", "seed").agg((100.0 * F.count_if("correct") / F.count(F.lit(1))).alias("acc"))


@register("mean_stderr", _ACC + " select model, round(avg(acc), 9) as mean, round(coalesce(stddev_samp(acc) / sqrt(count(acc)), 0), 9) as stderr from s group by 1")
def mean_stderr_(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracy over seeds and its standard error."""
    m, e = mean_stderr(F.col("acc"))
    return _acc(spark, d).groupBy("model").agg(v.r9(m).alias("mean"), v.r9(e).alias("stderr"))


@register("mean_std", _ACC + " select model, round(avg(acc), 9) as mean, round(coalesce(stddev_samp(acc), 0), 9) as std from s group by 1")
def mean_std_(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracy over seeds and its sample deviation."""
    m, e = mean_std(F.col("acc"))
    return _acc(spark, d).groupBy("model").agg(v.r9(m).alias("mean"), v.r9(e).alias("std"))


@register("fmt_mean_err", _ACC + " select model, printf('%.2f±%.2f', avg(acc), coalesce(stddev_samp(acc) / sqrt(count(acc)), 0)) as text from s group by 1")
def fmt_mean_err_(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and error as text."""
    m, e = mean_stderr(F.col("acc"))
    return _acc(spark, d).groupBy("model").agg(m.alias("m"), e.alias("e")).select("model", fmt_mean_err(F.col("m"), F.col("e")).alias("text"))


@register("rate_metrics", f"""with {AUDIT} select backend, round(100.0::double * count(*) filter (decision = '' or decision is null) / count(*), 9) as undecided_rate,
 round(100.0::double * count(*) filter (not score_valid) / count(*), 9) as invalid_rate, round(100.0::double * count(*) filter (scoring_mode = 'generation') / count(*), 9) as generation_rate from audit group by 1""")
def rate_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates of undecided, invalid and generated scores."""
    return v.audits(spark, d).groupBy("backend").agg(
        v.r9(rate((F.col("decision") == "") | F.col("decision").isNull())).alias("undecided_rate"), v.r9(rate(~F.col("score_valid"))).alias("invalid_rate"), v.r9(rate(F.col("scoring_mode") == "generation")).alias("generation_rate")
    )


@register("score_distribution", f"""with {JUDGE} select backend, count(confidence) as n, round(avg(confidence), 9) as mean, round(coalesce(stddev_pop(confidence), 0), 9) as std,
 min(confidence) as least, max(confidence) as most, quantile_cont(confidence, 0.5)::double as median, round(100.0::double * count(*) filter (passed) / count(*), 9) as pass_rate,
 round(100.0::double * count(*) filter (passed and confidence is not null) / nullif(count(confidence), 0), 9) as pass_rate_scored from judge group by 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Judge confidence by backend, and pass rates over all and over scored rows."""
    g = v.judges(spark, d).groupBy("backend").agg(
        *metrics.score_distribution(F.col("confidence")), v.r9(rate(F.col("passed"))).alias("pass_rate"), v.r9(100.0 * F.count_if(F.col("passed") & F.col("confidence").isNotNull()) / F.count("confidence")).alias("pass_rate_scored")
    )
    return g.withColumns({"mean": v.r9(F.col("mean")), "std": v.r9(F.col("std"))})


#: Pairwise verdicts: the judge's choice and whether the sides were swapped, from rollouts.
PAIRS = f"""{ROLLOUT}, pairs as (select log_no, task_type, row_idx % 5 as category, case when judge_token is null then 'Invalid' when lower(trim(judge_token)) = 'yes' then '1' else '2' end as choice,
 {u32_sql(42, 'log_no')} % 2 = 0 as swapped from rollout), won as (select *, case when choice = '1' then case when swapped then 'right' else 'left' end when choice = '2' then case when swapped then 'left' else 'right' end else 'invalid' end as winner from pairs)"""


def _won(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.trim("judge_token"))
    choice = F.when(t.isNull(), "Invalid").when(t == "yes", "1").otherwise("2")
    swapped = stable_u32(42, F.col("log_no")) % 2 == 0
    return v.rollouts(spark, d).select("log_no", (F.col("row_idx") % 5).alias("category"), choice.alias("choice"), swapped.alias("swapped"), metrics.winner(choice, swapped).alias("winner"))


@register("ab_swap", f"with {PAIRS} select log_no, swapped, winner from won")
def ab_swap(spark: SparkSession, d: str) -> DataFrame:
    """Seeded side of every pair and its winner."""
    return _won(spark, d).select("log_no", "swapped", "winner")


@register("pairwise_summary", f"""with {PAIRS} select category, count(*) as n, count(*) filter (winner = 'left') as left_wins, count(*) filter (winner = 'right') as right_wins, count(*) filter (winner = 'invalid') as invalid,
 round(count(*) filter (winner = 'left') / count(*), 9) as left_rate_all, round(coalesce(count(*) filter (winner = 'left') / nullif(count(*) filter (winner in ('left', 'right')), 0), 0), 9) as left_rate_decided from won group by 1""")
def pairwise_summary(spark: SparkSession, d: str) -> DataFrame:
    """Win rates by category."""
    g = _won(spark, d).groupBy("category").agg(*metrics.win_rates(F.col("winner")))
    return g.withColumns({c: v.r9(F.col(c)) for c in ("left_rate_all", "left_rate_decided")})


@register("group_mean_filled", "select b.phenomenon, round(coalesce(avg(i.gold_index), 0), 9) as mean from (select unnest(['Maxims','Humour','Irony','Metaphor','Deceit','IndirectSpeech','Absent']) as phenomenon) b left join bench_item i using (phenomenon) group by 1")
def group_mean_filled(spark: SparkSession, d: str) -> DataFrame:
    """Mean gold index of a fixed list of phenomena, 0 where there are none."""
    return metrics.mean_filled(table(spark, d, "bench_item"), "phenomenon", F.col("gold_index"), PHENOMENA).withColumn("mean", v.r9(F.col("mean")))


@register("reward_by_type", f"with {ROLLOUT} select task_type, round(avg(case when confident_yes then 1.0::double else 0.0 end), 9) as reward from rollout group by 1")
def reward_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Mean reward by task type."""
    return v.rollouts(spark, d).groupBy("task_type").agg(v.r9(F.avg(F.when(F.col("confident_yes"), 1.0).otherwise(0.0))).alias("reward"))


@register("filter_rollup", f"""with {ROLLOUT}, g as (select row_idx, count(*) filter (confident_yes) as y, count(*) as n from rollout group by 1)
select count(*) as prompts, count(*) filter (y = n) as easy, count(*) filter (y = 0) as hard, count(*) filter (y > 0 and y < n) as kept from g""")
def filter_rollup(spark: SparkSession, d: str) -> DataFrame:
    """How many prompts are easy, hard and kept."""
    from quillmill.operators.filters import rollout_outcomes

    return rollout_outcomes(v.rollouts(spark, d), "row_idx", "confident_yes").agg(
        F.count(F.lit(1)).alias("prompts"), F.count_if(F.col("reason") == "easy").alias("easy"), F.count_if(F.col("reason") == "hard").alias("hard"), F.count_if(F.col("reason") == "").alias("kept")
    )


@register("judge_summary", f"""with {JUDGE}, g as (select task_no, bool_or(passed) as passed, count(*) as rounds, arg_min(passed, judge_round::bigint * 1000000000 + judge_no) as first_passed, coalesce(bool_or(not passed and coalesce(corrected_answer, '') <> ''), false) as righted, bool_and(coalesce(raw_output, '') = '') as blank from judge group by 1)
select count(*) as tasks, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (passed and not first_passed) as recovered, sum(rounds)::bigint as rounds, count(*) filter (not passed and righted) as rationalized, count(*) filter (not passed and not righted) as dropped, count(*) filter (blank) as empty from g""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Tasks passed, failed, and recovered in a later round; of those failed, the ones with a right
    answer to go on from and the ones dropped; and those without any output."""
    first = F.min_by("passed", F.struct("judge_round", "judge_no"))
    righted = F.coalesce(F.bool_or(~F.col("passed") & (F.coalesce("corrected_answer", F.lit("")) != "")), F.lit(False))
    g = v.judges(spark, d).groupBy("task_no").agg(
        F.bool_or("passed").alias("passed"), F.count(F.lit(1)).alias("rounds"), first.alias("first_passed"), righted.alias("righted"), F.bool_and(F.coalesce("raw_output", F.lit("")) == "").alias("blank")
    )
    lost = ~F.col("passed")
    return g.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("passed").alias("passed"), F.count_if(lost).alias("failed"), F.count_if(F.col("passed") & ~F.col("first_passed")).alias("recovered"), F.sum("rounds").alias("rounds"),
        F.count_if(lost & F.col("righted")).alias("rationalized"), F.count_if(lost & ~F.col("righted")).alias("dropped"), F.count_if("blank").alias("empty"),
    )


@register("prob_mass", f"""with {JUDGE}, e as (select judge_no, 'yes' as class, yes_logprob as lp from judge union all select judge_no, 'no', no_logprob from judge)
select judge_no, round(sum(case when class = 'yes' and isfinite(lp) then exp(lp) else 0 end), 9) as p_yes, round(sum(case when class = 'no' and isfinite(lp) then exp(lp) else 0 end), 9) as p_no from e group by 1""")
def prob_mass(spark: SparkSession, d: str) -> DataFrame:
    """Probability per class over its token variants, unusable log-probabilities skipped."""
    long = v.judges(spark, d).select("judge_no", F.explode(F.create_map(F.lit("yes"), F.col("yes_logprob"), F.lit("no"), F.col("no_logprob"))).alias("class", "lp"))
    ok = F.col("lp").isNotNull() & ~F.isnan("lp") & (F.abs("lp") < float("inf"))
    mass = lambda c: v.r9(F.sum(F.when(ok & (F.col("class") == c), F.exp("lp")).otherwise(0.0)))
    return long.groupBy("judge_no").agg(mass("yes").alias("p_yes"), mass("no").alias("p_no"))


@register("budget_states", f"""with {AUDIT} select case when regexp_matches(raw_output, '\\}}\\s*$') then 'finished' when regexp_matches(raw_output, '(?i)</think>') then 'think_done' else 'budget_forced' end as state, count(*) as n
 from audit where raw_output is not null group by 1""")
def budget_states(spark: SparkSession, d: str) -> DataFrame:
    """How far outputs got: finished, thinking done, or out of budget."""
    o = F.col("raw_output")
    s = F.when(o.rlike(r"\}\s*$"), "finished").when(contains_close(o), "think_done").otherwise("budget_forced")
    return v.audits(spark, d).where("raw_output is not null").groupBy(s.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@register("pivot_metrics", f"""with {TASK}, {AUDIT} select backend, {', '.join(f"round(100.0::double * count(*) filter (decision = 'keep' and section = '{s}') / nullif(count(*) filter (section = '{s}'), 0), 9) as m{i}" for i, s in enumerate(['Metaphor', 'Social Pragmatics', 'Irony and Banter']))}
 from audit left join task using (task_no) group by 1""")
def pivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Keep rate of three sections, one row per backend."""
    names = ["Metaphor", "Social Pragmatics", "Irony and Banter"]
    t = v.tasks(spark, d).select("task_no", "section")
    g = v.audits(spark, d).join(t, "task_no", "left").groupBy("backend", "section").agg(v.r9(rate(F.col("decision") == "keep")).alias("rate"))
    wide = metrics.pivot_metric(g, ["backend"], "section", names, "rate")
    return wide.select("backend", *[F.col(f"`{s}`").alias(f"m{i}") for i, s in enumerate(names)])
