"""Queries on filters, ranked drops, deduplication and the flagship audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.scores import clamp_confidence, score_field, sigmoid
from quillmill.functions.text import canonical_section, clean_domain, coerce_bool, fallback_chain, first_filled, int_eq, normalize_text, signature
from quillmill.operators import dedup, filters
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, JUDGE, QA, ROLLOUT, TASK, strip_sql
from quillmill.session import table

_FILLED = " and ".join(f"coalesce({strip_sql(c)}, '') <> ''" for c in ("section", "content", "question", "answer"))
_PARTS = ("section", "content", "question", "answer")


@register("audit_flagship", f"""with {QA}, e as (select *, {_FILLED} as filled from qa),
 r as (select *, row_number() over (partition by section order by -log_odds desc, pos desc) as k, count(*) over (partition by section) as n
   from e where filled and log_odds is not null),
 keep as (select section, pos from r where k > floor(0.5 * n) union all select section, pos from e where filled and log_odds is null)
select e.section, count(*) as total, count(keep.pos) as kept, count(*) - count(keep.pos) as dropped from e left join keep on keep.pos = e.pos group by e.section""")
def audit_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Items with missing parts go, the worse half of each section goes by drop minus keep,
    unscored items stay; totals per section."""
    items = v.qa(spark, d).withColumn("filled", filters.has_fields(*_PARTS)).withColumn("score", score_field("drop_minus_keep", F.col("prob_yes"), F.col("log_odds")))
    narrow = items.select("pos", "section", "filled", "score")
    ranked = filters.drop_bottom_per_group(narrow.where("filled and score is not null"), 50, "drop_minus_keep", "section")
    kept = ranked.select("pos").union(narrow.where("filled and score is null").select("pos")).withColumn("keep", F.lit(1))
    return narrow.join(kept, "pos", "left").groupBy("section").agg(
        F.count(F.lit(1)).alias("total"), F.count("keep").alias("kept"), (F.count(F.lit(1)) - F.count("keep")).alias("dropped")
    )


@register("required_fields", f"with {QA} select pos from qa where {_FILLED}")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Items with all parts filled."""
    return v.qa(spark, d).where(filters.has_fields(*_PARTS)).select("pos")


_S = {c: f"coalesce({strip_sql(c)}, '')" for c in ("content", "question", "answer")}


@register("validate_candidate", f"""with {TASK} select task_no, {_S['content']} as content,
 case when contains({_S['question']}, '?') then {_S['question']} else rtrim({_S['question']}, '.') || '?' end as question, {_S['answer']} as answer
 from task where length({_S['content']}) >= 20 and length({_S['question']}) >= 8 and length({_S['answer']}) >= 3""")
def validate_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Candidates long enough, their questions ending in a question mark."""
    c = filters.valid_candidate(F.col("content"), F.col("question"), F.col("answer"))
    return v.tasks(spark, d).select("task_no", c.alias("c")).where("c is not null").select("task_no", "c.*")


@register("coerce_bool", f"""with {ROLLOUT} select log_no, case when lower({strip_sql('judge_token')}) in ('1','true','yes','y','on') then true
 when lower({strip_sql('judge_token')}) in ('0','false','no','n','off') then false else false end as flag from rollout""")
def coerce_bool_(spark: SparkSession, d: str) -> DataFrame:
    """Judge tokens as booleans."""
    return v.rollouts(spark, d).select("log_no", coerce_bool(F.col("judge_token")).alias("flag"))


@register("int_eq", """select item_id, coalesce(gold_index = try_cast(regexp_extract(bench_id, '-([0-9]+)$', 1) as bigint) % 4 + 1, false) as same from bench_item""")
def int_eq_(spark: SparkSession, d: str) -> DataFrame:
    """Whether the gold index equals a number read from text."""
    got = (F.regexp_extract("bench_id", "-([0-9]+)$", 1).try_cast("bigint") % 4 + 1).cast("string")
    return table(spark, d, "bench_item").select("item_id", int_eq(F.col("gold_index"), F.concat(F.lit(" "), got)).alias("same"))


@register("clamp_confidence", f"with {JUDGE} select judge_no, case when confidence is null then null else least(10, greatest(1, confidence)) end as confidence from judge")
def clamp_confidence_(spark: SparkSession, d: str) -> DataFrame:
    """Judge confidences within 1 to 10."""
    return v.judges(spark, d).select("judge_no", clamp_confidence(F.col("confidence")).alias("confidence"))


@register("score_fields", f"with {QA} select pos, log_odds as s1, log_odds as s2, -log_odds as s3, prob_yes as s4, prob_yes as s5, 1.0::double - prob_yes as s6 from qa")
def score_fields(spark: SparkSession, d: str) -> DataFrame:
    """All named scores of every item."""
    names = ["log_odds", "keep_minus_drop", "drop_minus_keep", "prob_yes", "prob_keep", "prob_drop"]
    p, o = F.col("prob_yes"), F.col("log_odds")
    return v.qa(spark, d).select("pos", *[score_field(n, p, o).alias(f"s{i + 1}") for i, n in enumerate(names)])


@register("sigmoid", f"with {QA} select pos, round(1 / (1 + exp(-greatest(least(log_odds * 30, 60), -60))), 9) as p from qa where log_odds is not null")
def sigmoid_(spark: SparkSession, d: str) -> DataFrame:
    """Log-odds as probabilities."""
    return v.qa(spark, d).where("log_odds is not null").select("pos", v.r9(sigmoid(F.col("log_odds") * 30)).alias("p"))


@register("canonical_section", f"with {TASK} select trim(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', ' ', 'g')) as section, count(*) as n from task group by 1")
def canonical_section_(spark: SparkSession, d: str) -> DataFrame:
    """Tasks by canonical section."""
    return v.tasks(spark, d).groupBy(canonical_section(F.col("section")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@register("fallback_chain", f"""with {TASK} select task_no, coalesce(reference, answer, '') as present, coalesce(nullif({strip_sql('reference')}, ''), nullif({strip_sql('answer')}, '')) as filled from task""")
def fallback_chain_(spark: SparkSession, d: str) -> DataFrame:
    """Reference answer by presence, and by being filled."""
    t = v.tasks(spark, d)
    return t.select("task_no", fallback_chain(F.col("reference"), F.col("answer"), F.lit("")).alias("present"), first_filled(F.col("reference"), F.col("answer")).alias("filled"))


@register("threshold_filter", f"with {QA} select pos from qa where -log_odds <= 0.2 or log_odds is null")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    """Items at or below a drop score; unscored items stay."""
    s = score_field("drop_minus_keep", F.col("prob_yes"), F.col("log_odds"))
    return v.qa(spark, d).where(filters.passes_threshold(s, 0.2, "drop_minus_keep")).select("pos")


@register("drop_bottom_global", f"""with {QA}, r as (select pos, log_odds, row_number() over (order by log_odds, pos) as k, count(*) over () as n from qa where log_odds is not null)
select pos, log_odds as score from r where k > floor(0.29 * n)""")
def drop_bottom_global(spark: SparkSession, d: str) -> DataFrame:
    """All scored items but the worst 29 per cent."""
    s = v.qa(spark, d).where("log_odds is not null").select("pos", F.col("log_odds").alias("score"))
    return filters.drop_bottom(s, 29, "log_odds")


@register("drop_bottom_per_section", f"""with {QA}, r as (select pos, section, row_number() over (partition by section order by log_odds, pos) as k, count(*) over (partition by section) as n
 from qa where log_odds is not null) select pos, section from r where k > floor(0.5 * n)""")
def drop_bottom_per_section(spark: SparkSession, d: str) -> DataFrame:
    """Per section, all scored items but the worse half."""
    s = v.qa(spark, d).where("log_odds is not null").select("pos", "section", F.col("log_odds").alias("score"))
    return filters.drop_bottom_per_group(s, 50, "log_odds", "section").select("pos", "section")


@register("drop_bottom_lower", f"""with {QA}, r as (select pos, section, round(prob_yes, 1) as score, row_number() over (partition by section order by round(prob_yes, 1) desc, pos desc) as k, count(*) over (partition by section) as n
 from qa where prob_yes is not null) select pos, section, score from r where k > floor(0.25 * n)""")
def drop_bottom_lower(spark: SparkSession, d: str) -> DataFrame:
    """Per section, all scored items but the worst quarter by a tied score for which less is better."""
    s = v.qa(spark, d).where("prob_yes is not null").select("pos", "section", F.round("prob_yes", 1).alias("score"))
    return filters.drop_bottom_per_group(s, 25, "prob_drop", "section")


@register("drop_thresholds", f"""with {QA}, r as (select section, -log_odds as score, row_number() over (partition by section order by -log_odds desc, pos desc) as k, count(*) over (partition by section) as n from qa where log_odds is not null)
select section, score as threshold, k as dropped from r where k = floor(0.25 * n)""")
def drop_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Score at which each section was cut, where it lost any item."""
    s = v.qa(spark, d).where("log_odds is not null").select("pos", "section", (-F.col("log_odds")).alias("score"))
    return filters.drop_thresholds(s, 25, "drop_minus_keep", "section")


_NORM = f"regexp_replace(lower({strip_sql('domain_text')}), '\\s+', ' ', 'g')"


@register("dedup_first", f"select min_by(domain_text, seed_no) as domain_text, min(seed_no) as seed_no from domain_seed group by {_NORM}")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """First spelling of every domain text."""
    s = table(spark, d, "domain_seed").select("seed_no", "domain_text", normalize_text(F.col("domain_text")).alias("k"))
    return dedup.keep_first(s, ["k"], "seed_no").select("domain_text", "seed_no")


@register("dedup_last", f"with {AUDIT} select task_no, max(audit_no) as audit_no from audit group by 1")
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    """Last audit of every task."""
    return dedup.keep_last(v.audits(spark, d).select("task_no", "audit_no"), ["task_no"], "audit_no")


@register("group_cap", f"with {TASK}, r as (select task_no, coalesce(section, '') as section, row_number() over (partition by coalesce(section, '') order by task_no) as k from task) select section, task_no from r where k <= 3")
def group_cap(spark: SparkSession, d: str) -> DataFrame:
    """First three examples of every section."""
    return dedup.group_cap(v.tasks(spark, d).select(F.coalesce("section", F.lit("")).alias("section"), "task_no"), ["section"], "task_no", 3)


@register("resume_anti", f"with {TASK}, {AUDIT} select task_no from task where task_no not in (select task_no from audit)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that were never audited."""
    return dedup.pending(v.tasks(spark, d).select("task_no"), v.audits(spark, d), "task_no")


@register("clean_domain", f"""with a as (select seed_no, regexp_replace({strip_sql('domain_text')}, '^[-*]+\\s*', '') as s from domain_seed),
 b as (select seed_no, {strip_sql("regexp_replace(s, '^[0-9]+[.)]' || chr(92) || 's*', '')")} as s from a)
select seed_no, {strip_sql("regexp_replace(trim(trim(s, '\"'), chr(39)), chr(92) || 's+', ' ', 'g')")} as domain from b""")
def clean_domain_(spark: SparkSession, d: str) -> DataFrame:
    """Domain texts without list marks and quotes."""
    return table(spark, d, "domain_seed").select("seed_no", clean_domain(F.col("domain_text")).alias("domain"))


@register("signature_dups", f"""with {TASK}, s as (select regexp_replace(lower({strip_sql("coalesce(section, '') || ' || ' || coalesce(content, '') || ' || ' || coalesce(question, '') || ' || ' || coalesce(answer, '')")}), '\\s+', ' ', 'g') as signature from task)
select signature, count(*) as n from s group by 1 having count(*) > 1""")
def signature_dups(spark: SparkSession, d: str) -> DataFrame:
    """Signatures that occur more than once."""
    return dedup.signatures(v.tasks(spark, d), signature(*[F.col(c) for c in _PARTS]))


@register("easy_hard_filter", f"""with {ROLLOUT}, g as (select row_idx, count(*) filter (confident_yes) as y, count(*) as n from rollout group by 1)
select row_idx, y as n_yes, n as n_total from g where not (n > 0 and y = n) and not (n > 0 and y = 0)""")
def easy_hard_filter(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that are neither easy nor hard."""
    return filters.rollout_outcomes(v.rollouts(spark, d), "row_idx", "confident_yes").where("reason = ''").drop("reason")


@register("filter_stats", f"""with {ROLLOUT}, g as (select row_idx, case when count(*) filter (p_yes is null) = count(*) then -1 else count(*) filter (confident_yes) end as y, count(*) as n from rollout group by 1)
select row_idx, y as n_correct, n as n_total, y / n as correct_rate, n > 0 and (y = n or y = 0) as filtered_out, case when y = n then 'easy' when y = 0 then 'hard' else '' end as filter_reason from g""")
def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every prompt; one without any score counts as a generation error (-1)."""
    g = v.rollouts(spark, d).groupBy("row_idx").agg(
        F.when(F.count_if(F.col("p_yes").isNull()) == F.count(F.lit(1)), F.lit(-1).cast("long")).otherwise(F.count_if("confident_yes")).alias("n_correct"), F.count(F.lit(1)).alias("n_total")
    )
    reason = filters.outcome_reason(F.col("n_correct"), F.col("n_total"))
    return g.select("row_idx", "n_correct", "n_total", (F.col("n_correct") / F.col("n_total")).alias("correct_rate"), (reason != "").alias("filtered_out"), reason.alias("filter_reason"))


_STOP = """with {r}, c as (select row_idx, rollout_idx // 4 as chunk, count(*) filter (confident_yes) as y, count(*) as n from rollout group by 1, 2),
 s as (select row_idx, chunk, y, n, sum(y) over w as ys, sum(n) over w as ns from c window w as (partition by row_idx order by chunk rows between unbounded preceding and current row)),
 t as (select *, {stop} as stop from s), l as (select row_idx, coalesce(min(chunk) filter (stop), max(chunk)) as chunk from t group by 1)
select t.row_idx, t.ys::bigint as n_yes, t.ns::bigint as n_judged from t join l using (row_idx, chunk)"""


@register("early_stop", _STOP.format(r=ROLLOUT, stop="ys > 0 and ns > ys"))
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Counts as of the chunk of four rollouts at which both outcomes were seen."""
    return filters.early_stop(v.rollouts(spark, d), "row_idx", "rollout_idx", "confident_yes", 4, True)


@register("early_stop_easy", _STOP.format(r=ROLLOUT, stop="y < n"))
def early_stop_easy(spark: SparkSession, d: str) -> DataFrame:
    """Counts as of the first chunk with a failure."""
    return filters.early_stop(v.rollouts(spark, d), "row_idx", "rollout_idx", "confident_yes", 4, False)
