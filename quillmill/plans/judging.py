"""Queries on judges, rewards and the composite judging filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import answers, scores, text
from quillmill.operators import reshape
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, JUDGE, ROLLOUT, TASK, strip_sql

@register("margin_judge", f"with {ROLLOUT} select log_no, coalesce(p_yes - p_no > 0.8, false) as strict, coalesce(p_yes - p_no >= 0.8, false) as loose from rollout")
def margin_judge(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts that lead by the margin, strictly and at least."""
    y, n = F.col("p_yes"), F.col("p_no")
    return v.rollouts(spark, d).select("log_no", scores.margin_passes(y, n, 0.8, True).alias("strict"), scores.margin_passes(y, n, 0.8, False).alias("loose"))


_TOP = [(" Yes", "yes_logprob"), ("no ", "no_logprob"), ("YES", "yes_logprob - 1"), ("maybe", "-0.1::double"), ("no", "null")]


@register("yes_no_mass", f"""with {JUDGE} select judge_no, case when judge_no % 5 = 0 then 0.0::double else round(coalesce(exp(yes_logprob), 0) + coalesce(exp(yes_logprob - 1), 0), 9) end as p_yes, case when judge_no % 5 = 0 then 0.0::double else round(coalesce(exp(no_logprob), 0), 9) end as p_no from judge""")
def yes_no_mass(spark: SparkSession, d: str) -> DataFrame:
    """Mass of yes and no in responses written as JSON, each fifth cut short."""
    top = F.array(*[F.struct(F.lit(w).alias("token"), F.expr(x.replace("::double", "D")).cast("double").alias("logprob")) for w, x in _TOP])
    choice = F.struct(F.struct(F.array(F.struct(top.alias("top_logprobs"))).alias("content")).alias("logprobs"))
    whole = F.to_json(F.struct(F.array(choice).alias("choices")))
    response = F.when(F.col("judge_no") % 5 == 0, F.substr(whole, F.lit(1), F.lit(40))).otherwise(whole)
    return v.judges(spark, d).select("judge_no", scores.response_mass(response).alias("m")).select("judge_no", v.r9(F.col("m.p_yes")).alias("p_yes"), v.r9(F.col("m.p_no")).alias("p_no"))


_LAST = "regexp_replace(raw_output, '(?is)^.*(</think>|\\[/think\\]|<channel\\|>)', '')"
_FENCE = "```(?:json)?\\s*([\\s\\S]*?)\\s*```"
_TRIES = [strip_sql("t"), f"regexp_extract(t, '{_FENCE}', 1)", r"regexp_extract(t, '(?s)\{.*\}')", r"replace(regexp_extract(t, '(?s)\{.*\}'), chr(39), '\"')"]
_JSON = f"""{JUDGE}, raw as (select judge_no, {_LAST} as t from judge),
 obj as (select judge_no, case {' '.join(f"when json_valid({x}) and {x} <> '' then {x}" for x in _TRIES)} end as j from raw),
 parsed as (select judge_no, case when starts_with(ltrim(j), '{{') then j end as j from obj),
 said as (select judge_no, j is not null as readable, lower({strip_sql("coalesce(j->>'$.judgment', j->>'$.verdict', '')")}) as word,
  case when try_cast(coalesce(j->>'$.confidence', j->>'$.confidence_score') as int) is not null then least(10, greatest(1, try_cast(coalesce(j->>'$.confidence', j->>'$.confidence_score') as int))) end as confidence,
  {strip_sql("coalesce(j->>'$.explanation', j->>'$.feedback', j->>'$.rationale', '')")} as why,
  {strip_sql("coalesce(j->>'$.corrected_answer', j->>'$.ideal_answer', j->>'$.target_answer', '')")} as corrected_answer from parsed)"""


@register("confidence_judge", f"""with {_JSON}, v as (select *, case when word in ('yes', 'no') then word end as judgment from said)
select judge_no, judgment, confidence, coalesce(judgment = 'yes' and confidence >= 5, false) as passed, corrected_answer,
 case when not readable then 'Judge output was not parseable JSON.' when judgment = 'yes' and confidence < 5 then {strip_sql("'Judge returned yes with confidence ' || confidence || ', below threshold 5. ' || why")}
  when judgment is null or confidence is null then coalesce(nullif(why, ''), 'Judge output lacked a valid yes/no judgment or confidence score.') else why end as feedback from v""")
def confidence_judge(spark: SparkSession, d: str) -> DataFrame:
    """Every judgement: yes with a confidence of 5 or more passes; an output that cannot be read does not."""
    read = v.judges(spark, d).select("judge_no", answers.json_object(text.strip_think_last(F.coalesce("raw_output", F.lit("")))).alias("v"))
    return read.select("judge_no", answers.judgement_of(F.col("v"), 5).alias("j")).select("judge_no", "j.*")


@register("judge_json", f"""with {JUDGE}, x as (select judge_no, {strip_sql("case when starts_with(raw_output, '```') then regexp_replace(regexp_replace(raw_output, '^```(?:json)?\\s*', '', 'i'), '\\s*```\\s*$', '') else coalesce(raw_output, '') end")} as t from judge),
 o as (select judge_no, t, case when json_valid(t) and starts_with(t, '{{') then replace(replace(t, '"judgment": "yes"', '"choice": "1"'), '"judgment": "no"', '"choice": "2"') end as j from x)
select judge_no, case when trim(j->>'$.choice') in ('1', '2', 'Invalid') then trim(j->>'$.choice') else 'Invalid' end as choice,
 case when trim(j->>'$.confidence') in ('1', '2', '3', 'Invalid') then trim(j->>'$.confidence') else 'Invalid' end as category,
 case when j is null then 'judge_parse_error: ' || coalesce(nullif(t[1:120], ''), 'EMPTY') else {strip_sql("coalesce(j->>'$.explanation', '')")} end as reason from o""")
def judge_json(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise verdicts read from the judges' outputs: a yes as the first choice, the confidence as
    the category; anything unexpected is invalid."""
    r = F.replace(F.replace("raw_output", F.lit('"judgment": "yes"'), F.lit('"choice": "1"')), F.lit('"judgment": "no"'), F.lit('"choice": "2"'))
    named = F.replace(F.replace(r, F.lit('"confidence":'), F.lit('"category":')), F.lit('"explanation":'), F.lit('"reason":'))
    got = answers.pairwise_verdict(named)
    raw = answers.pairwise_verdict(F.col("raw_output"))["reason"]
    return v.judges(spark, d).select("judge_no", got.alias("g"), raw.alias("raw")).select("judge_no", "g.choice", "g.category", F.when(F.col("g.readable"), F.col("g.reason")).otherwise(F.col("raw")).alias("reason"))


_SOLUTION = f"""case when log_no % 2 = 0 then candidate else '<think>why</think> ' || coalesce(candidate, '') end"""
_AFTER = f"case when contains(s, '</think>') then {strip_sql("regexp_replace(s, '(?s)^.*</think>', '')")} else s end"


@register("reward_score", f"""with {ROLLOUT}, {TASK}, x as (select r.*, coalesce({_SOLUTION}, '') as s, t.content, t.question from rollout r left join task t on t.task_no = r.row_idx),
 y as (select *, case when contains({_AFTER}, '\\boxed{{') then nullif({strip_sql(v.balanced_sql(f"string_split({_AFTER}, '{chr(92)}boxed{{')[-1]"))}, '') end as answer,
  case when not contains(s, '<think>') or not contains(s, '</think>') then 0.0::double when contains({_AFTER}, '\\boxed{{') and nullif({strip_sql(v.balanced_sql(f"string_split({_AFTER}, '{chr(92)}boxed{{')[-1]"))}, '') is not null then 1.0 else 0.5 end as form from x),
 z as (select *, answer is not null and coalesce(trim(content), '') <> '' and coalesce(trim(question), '') <> '' and coalesce(trim(reference), '') <> '' and coalesce(p_yes - p_no > margin_threshold, false) as sure from y)
select log_no, form + case when sure then 1 else 0 end as score, sure::int as acc, form as format_reward, case when sure then 1.0::double else 0.0 end as correctness_reward from z""")
def reward_score(spark: SparkSession, d: str) -> DataFrame:
    """Reward of every rollout, each second one with its thinking before it: form, plus correctness
    by margin where an answer came out and the judge had all it needs."""
    solution = F.coalesce(F.when(F.col("log_no") % 2 == 0, F.col("candidate")).otherwise(F.concat(F.lit("<think>why</think> "), F.coalesce("candidate", F.lit("")))), F.lit(""))
    t = v.tasks(spark, d).select(F.col("task_no").alias("row_idx"), "content", "question")
    r = v.rollouts(spark, d).select("log_no", "row_idx", solution.alias("s"), "reference", "p_yes", "p_no", "margin_threshold").join(t, "row_idx", "left")
    got = scores.total_reward(answers.format_reward(F.col("s")), answers.boxed_last(F.col("s")), [F.col(c) for c in ("content", "question", "reference")], F.col("p_yes"), F.col("p_no"), F.col("margin_threshold"))
    return r.select("log_no", got.alias("g")).select("log_no", "g.*")


@register("judge_drop", f"""with {JUDGE}, g as (select task_no, bool_or(passed) as passed, arg_max(corrected_answer, judge_no) as final from judge group by 1)
select task_no from g where passed or coalesce({strip_sql('final')}, '') <> ''""")
def judge_drop(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that passed, or hold a corrected answer to fall back on."""
    g = v.judges(spark, d).groupBy("task_no").agg(F.bool_or("passed").alias("passed"), F.max_by(F.col("corrected_answer"), F.when(F.col("corrected_answer").isNotNull(), F.col("judge_no"))).alias("final"))
    return g.where(F.col("passed") | (text.text_or_empty(F.col("final")) != "")).select("task_no")


@register("judge_one", f"""with {ROLLOUT}, x as (select log_no, p_yes, p_no, margin_threshold, nullif({strip_sql("regexp_extract(candidate, '(?s)\\\\boxed\\{(.*)\\}', 1)")}, '') is not null as has from rollout),
 y as (select log_no, has, margin_threshold, case when has then coalesce(p_yes, 0) else 0.0::double end as p_yes, case when has then coalesce(p_no, 0) else 0.0::double end as p_no from x)
select log_no, has as format_ok, has as logged, p_yes, p_no, p_yes - p_no as margin, has and coalesce(p_yes - p_no > margin_threshold, false) as confident_yes from y""")
def judge_one(spark: SparkSession, d: str) -> DataFrame:
    """One rollout's judgement: without an answer zeros, no format and no log line; a judge that gave
    no probabilities counts as zeros, but the format holds and the call is logged."""
    has = F.col("has")
    r = v.rollouts(spark, d).select("log_no", "margin_threshold", answers.boxed_last(F.col("candidate")).isNotNull().alias("has"), "p_yes", "p_no")
    p = {c: F.when(has, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("p_yes", "p_no")}
    z = r.select("log_no", "has", "margin_threshold", *[x.alias(c) for c, x in p.items()])
    margin = F.col("p_yes") - F.col("p_no")
    return z.select("log_no", has.alias("format_ok"), has.alias("logged"), "p_yes", "p_no", margin.alias("margin"), (has & F.coalesce(margin > F.col("margin_threshold"), F.lit(False))).alias("confident_yes"))


@register("audit_logged", f"with {AUDIT} select audit_no, round(log_p_yes - log_p_no, 6) as margin from audit where log_p_yes is not null and log_p_no is not null and not isnan(log_p_yes) and not isnan(log_p_no)")
def audit_logged(spark: SparkSession, d: str) -> DataFrame:
    """Log margin of every audit that recorded both sides."""
    y, n = F.col("log_p_yes"), F.col("log_p_no")
    return v.audits(spark, d).where("log_p_yes is not null and log_p_no is not null and not isnan(log_p_yes) and not isnan(log_p_no)").select("audit_no", F.round(y - n, 6).alias("margin"))


_VARIANTS = {"p_yes": ["yes", " yes", "Yes", " Yes"], "p_no": ["no", " no", "No", " No"]}


@register("continuation_mass", f"""with {JUDGE}, w as (select unnest(['yes', ' yes', 'Yes', ' Yes', 'no', ' no', 'No', ' No']) as w), x as (select judge_no, lower(trim(w)) as c, case when lower(trim(w)) = 'yes' then yes_logprob else no_logprob end - length(w) * 0.25 as lp from judge, w)
select judge_no, round(coalesce(sum(exp(lp)) filter (c = 'yes'), 0), 9) as p_yes, round(coalesce(sum(exp(lp)) filter (c = 'no'), 0), 9) as p_no from x group by 1""")
def continuation_mass(spark: SparkSession, d: str) -> DataFrame:
    """Every judgement with eight continuations, scored and summed per class again."""
    rows = reshape.continuations(v.judges(spark, d).select("judge_no", "yes_logprob", "no_logprob"), _VARIANTS)
    lp = F.when(F.col("class") == "p_yes", F.col("yes_logprob")).otherwise(F.col("no_logprob")) - F.length("continuation") * 0.25
    wide = reshape.class_mass(rows.withColumn("logprob", lp), "judge_no", ["p_yes", "p_no"])
    return wide.select("judge_no", *[v.r9(F.col(c)).alias(c) for c in ("p_yes", "p_no")])


@register("loose_judge", f"with {JUDGE} select judge_no, coalesce(lower(trim(judgment)) in ('yes', 'pass', 'correct', 'true', '1'), false) as passed from judge")
def loose_judge(spark: SparkSession, d: str) -> DataFrame:
    """Judgements that mean a pass in any wording."""
    from quillmill.functions.models import loose_pass

    return v.judges(spark, d).select("judge_no", loose_pass(F.col("judgment")).alias("passed"))
