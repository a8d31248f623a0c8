"""Queries on joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.answers import label_normalize, option_index
from quillmill.functions.text import int_eq, normalize_text, text_or_empty
from quillmill.operators import joins, reshape
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, JUDGE, ROLLOUT, TASK, strip_sql
from quillmill.session import table

_SIDE = "select user_id as id, event_id as pos, value from events where event_type = '{t}'"


@register("pairwise_match", f"""with l as ({_SIDE.format(t='click')}), r as ({_SIDE.format(t='view')}), ll as (select id, arg_max(value, pos) as value from l group by 1), rr as (select id, arg_max(value, pos) as value from r group by 1)
select ll.id, ll.value, rr.value as right_value from ll join rr using (id)""")
def pairwise_match(spark: SparkSession, d: str) -> DataFrame:
    """Last result of either side, matched by id."""
    e = table(spark, d, "events")
    side = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), "value")
    return joins.match_last(side("click"), side("view"), "id")


@register("explanation_lookup", f"""with {TASK}, {JUDGE}, f as (select task_no, arg_max(feedback, judge_no) as feedback, true as m from judge group by 1)
select task.task_no, coalesce(f.feedback, '') as feedback, coalesce(m, false) as matched from task left join f using (task_no)""")
def explanation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Last feedback of every task, empty where there is none."""
    t = v.tasks(spark, d).select("task_no")
    # a null feedback in the last row counts as no text, as an empty one
    fb = v.judges(spark, d).where("feedback is not null").select("task_no", "feedback", F.col("judge_no").alias("pos"))
    any_ = v.judges(spark, d).select("task_no").distinct().withColumn("seen", F.lit(True))
    return joins.lookup_last(t, fb, ["task_no"], "feedback").drop("matched").join(any_, "task_no", "left").select("task_no", "feedback", F.coalesce("seen", F.lit(False)).alias("matched"))


@register("drop_easy", f"""with {TASK}, {ROLLOUT}, easy as (select row_idx from rollout group by 1 having count(*) filter (confident_yes) = count(*)) select task_no from task where task_no not in (select row_idx from easy)""")
def drop_easy(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose rollouts did not all pass."""
    from quillmill.operators.filters import rollout_outcomes

    easy = rollout_outcomes(v.rollouts(spark, d), "row_idx", "confident_yes").where(F.lower("reason") == "easy")
    return v.tasks(spark, d).select("task_no").join(easy.select(F.col("row_idx").alias("task_no")), "task_no", "left_anti")


@register("spec_grid", """with s as (select section, row_number() over (order by section) - 1 as s from keep_target)
select seed_no as domain_no, section, i::int as i, 7 + seed_no * 1000003 + s * 1009 + i * 17 as seed from domain_seed, s, (select unnest([0, 1]) as i)""")
def spec_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every domain with every section, two items each, and their seeds."""
    sections = [r["section"] for r in table(spark, d, "keep_target").select("section").orderBy("section").collect()]
    dom = table(spark, d, "domain_seed").select(F.col("seed_no").alias("domain_no"))
    return reshape.spec_grid(dom, sections, 2, 7).select("domain_no", "section", "i", "seed")


@register("fewshot_attach", f"""with {TASK}, x as (select trim(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', ' ', 'g')) as section, task_no from task),
 r as (select *, row_number() over (partition by section order by task_no) as k from x), f as (select section, string_agg(task_no::varchar, ',' order by task_no) as examples from r where k <= 3 group by 1)
select k.section, keep_percent, coalesce(examples, '') as examples from keep_target k left join f using (section)""")
def fewshot_attach(spark: SparkSession, d: str) -> DataFrame:
    """First three tasks of each section as its examples."""
    from quillmill.functions.text import canonical_section
    from quillmill.operators.dedup import group_cap

    few = group_cap(v.tasks(spark, d).select(canonical_section(F.col("section")).alias("section"), "task_no"), ["section"], "task_no", 3)
    few = few.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("task_no")).cast("array<string>"), ",").alias("examples"))
    return table(spark, d, "keep_target").join(few, "section", "left").select("section", "keep_percent", F.coalesce("examples", F.lit("")).alias("examples"))


@register("pred_vs_gold", f"with {AUDIT}, {TASK} select audit_no, lower(model_answer) = lower(answer) as correct from audit join task using (task_no) where model_answer is not null and answer is not null")
def pred_vs_gold(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model's answer is the reference, case aside."""
    g = v.tasks(spark, d).select("task_no", "answer")
    a = v.audits(spark, d).select("audit_no", "task_no", "model_answer")
    return a.join(g, "task_no").where("model_answer is not null and answer is not null").select("audit_no", (F.lower("model_answer") == F.lower("answer")).alias("correct"))


@register("second_pass_merge", f"""with {AUDIT}, f as (select task_no, arg_min(model_answer, audit_no) as answer from audit group by 1), {JUDGE},
 n as (select task_no, arg_max(corrected_answer, judge_no) as new from judge where not passed and corrected_answer is not null group by 1)
select f.task_no, case when coalesce({strip_sql('f.answer')}, '') = '' then coalesce(n.new, f.answer) else f.answer end as answer from f left join n using (task_no)""")
def second_pass_merge(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a first pass, taken from the second where the first gave none."""
    first = v.audits(spark, d).groupBy("task_no").agg(F.min_by("model_answer", F.when(F.col("model_answer").isNotNull(), F.col("audit_no"))).alias("answer"))
    second = v.judges(spark, d).where("not passed and corrected_answer is not null").groupBy("task_no").agg(F.max_by("corrected_answer", "judge_no").alias("answer"))
    need = first.where(text_or_empty(F.col("answer")) == "").select("task_no")
    return joins.update_rows(first, second.join(need, "task_no", "left_semi"), "task_no", ["answer"])


@register("fewshot_pool", """with p as (select benchmark, item_id from bench_item where bench_split = 'dev'), j as (select i.item_id, p.item_id as example, row_number() over (partition by i.item_id order by p.item_id) as place from bench_item i join p on p.benchmark = i.benchmark and p.item_id <> i.item_id)
select item_id, example, place::int as place from j where place <= 3""")
def fewshot_pool(spark: SparkSession, d: str) -> DataFrame:
    """Three development items of the same benchmark for every item, never the item itself."""
    b = table(spark, d, "bench_item").withColumn("o", F.col("item_id"))
    return joins.example_pool(b, b.where("bench_split = 'dev'"), "benchmark", "item_id", ["o"], 3)


@register("union_splits", f"with {TASK} select split, count(*) as n from task group by 1")
def union_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits read one by one and put together."""
    t = v.tasks(spark, d).select("task_no", "split")
    parts = [t.where(F.col("split") == s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("id_intersect", "select distinct task_no from audit_result intersect select distinct task_no from judge_result")
def id_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Tasks both audited and judged."""
    return table(spark, d, "audit_result").select("task_no").intersect(table(spark, d, "judge_result").select("task_no"))


@register("id_except", "select distinct task_no from sft_task except select distinct task_no from judge_result")
def id_except(spark: SparkSession, d: str) -> DataFrame:
    """Tasks never judged."""
    return table(spark, d, "sft_task").select("task_no").subtract(table(spark, d, "judge_result").select("task_no"))


@register("label_normalize", f"with {ROLLOUT} select log_no, case when starts_with(lower(trim(judge_token)), 'yes') then 'yes' else 'no' end as label from rollout where starts_with(lower(trim(judge_token)), 'yes') or starts_with(lower(trim(judge_token)), 'no')")
def label_normalize_(spark: SparkSession, d: str) -> DataFrame:
    """Rollouts with a usable label."""
    return v.rollouts(spark, d).select("log_no", label_normalize(F.col("judge_token")).alias("label")).where("label is not null")


_GOLD = "case when item_id % 7 = 0 then 'NaN' when item_id % 7 = 1 then 'no such option' else choices[gold_index] end"


@register("option_index", f"""with g as (select *, lower(trim({_GOLD})) as gold from bench_item), p as (select *, case when gold not in ('', 'nan', 'none', 'null') then coalesce(list_position(list_transform(choices, lambda x: lower(trim(x))), gold), 0)::int end as place from g)
select item_id, place, coalesce(place = gold_index, false) as same from p""")
def option_index_(spark: SparkSession, d: str) -> DataFrame:
    """Place of the gold option among the choices: null for an invalid one, 0 for one that is none of them."""
    n = F.col("item_id") % 7
    gold = F.when(n == 0, "NaN").when(n == 1, "no such option").otherwise(F.element_at("choices", F.col("gold_index")))
    i = option_index(F.col("choices"), F.concat(F.lit(" "), gold), normalize_text)
    return table(spark, d, "bench_item").select("item_id", i.alias("place"), int_eq(i, F.col("gold_index")).alias("same"))
