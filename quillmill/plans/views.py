"""Inputs of the queries: the pipeline's tables, each record once, and the same as SQL.

Redelivered rows are equal in all columns but ``written_at``, so a record is taken once by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.session import table

AUDIT_COLUMNS = "audit_no task_no attempt backend decision prob_yes log_odds log_p_yes log_p_no model_answer scoring_mode score_valid raw_output".split()
JUDGE_COLUMNS = "judge_no task_no judge_round backend passed feedback corrected_answer raw_output judgment confidence yes_logprob no_logprob yes_prob no_prob".split()
ROLLOUT_COLUMNS = "log_no row_idx rollout_idx task_type candidate reference judge_token p_yes p_no margin margin_threshold confident_yes".split()

#: SQL of the views, to stand after ``with``.
TASK = """task as (select distinct task_no, task_id, split, source_dataset, sft_messages, metadata.section as section,
  metadata.section_description as section_description, metadata.reference_answer as reference, metadata.source_row.section as row_section,
  metadata.source_row.content as content, metadata.source_row.question as question, metadata.source_row.answer as answer,
  metadata.source_row.domain_seed as domain_seed, metadata.source_row.domain_index as domain_index from sft_task)"""
AUDIT = f"audit as (select distinct {', '.join(AUDIT_COLUMNS)} from audit_result)"
JUDGE = f"judge as (select distinct {', '.join(JUDGE_COLUMNS)} from judge_result)"
ROLLOUT = f"rollout as (select distinct {', '.join(ROLLOUT_COLUMNS)} from rollout_log)"
QA = f"""{TASK}, {AUDIT}, qa as (select audit_no as pos, task_no, attempt, coalesce(section, '') as section, content, question, answer,
  case when isnan(prob_yes) or prob_yes < 0 or prob_yes > 1 then null else prob_yes end as prob_yes,
  case when isnan(log_odds) then null else log_odds end as log_odds from audit left join task using (task_no))"""

#: Python's white space, to trim with in SQL.
SPACES_SQL = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {SPACES_SQL})"


def u32_sql(seed: int, *parts: str) -> str:
    """SQL of ``stable_u32``."""
    return f"('0x' || substr(sha256(concat_ws(chr(31), '{seed}', {', '.join(parts)})), 1, 8))::bigint"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    m, r = F.col("metadata"), F.col("metadata.source_row")
    return (
        table(spark, d, "sft_task")
        .select(
            "task_no", "task_id", "split", "source_dataset", "sft_messages", m["section"].alias("section"),
            m["section_description"].alias("section_description"), m["reference_answer"].alias("reference"), r["section"].alias("row_section"),
            r["content"].alias("content"), r["question"].alias("question"), r["answer"].alias("answer"),
            r["domain_seed"].alias("domain_seed"), r["domain_index"].alias("domain_index"),
        )
        .dropDuplicates(["task_no"])
    )


def audits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_result").select(*AUDIT_COLUMNS).dropDuplicates(["audit_no"])


def judges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_result").select(*JUDGE_COLUMNS).dropDuplicates(["judge_no"])


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rollout_log").select(*ROLLOUT_COLUMNS).dropDuplicates(["log_no"])


def qa(spark: SparkSession, d: str) -> DataFrame:
    """Audited question and answer items: position, raw section, parts and scores."""
    p, o = F.col("prob_yes"), F.col("log_odds")
    a = audits(spark, d).select(
        F.col("audit_no").alias("pos"), "task_no", "attempt",
        F.when(~F.isnan(p) & p.between(0.0, 1.0), p).alias("prob_yes"), F.when(~F.isnan(o), o).alias("log_odds"),
    )
    t = tasks(spark, d).select("task_no", F.coalesce("section", F.lit("")).alias("section"), "content", "question", "answer")
    return a.join(t, "task_no", "left").withColumn("section", F.coalesce("section", F.lit("")))


def r9(c: Column) -> Column:
    """Rounded to nine decimals: sums in another order give the same."""
    return F.round(c, 9)


def balanced_sql(tail: str) -> str:
    """SQL of ``balanced``: up to where one more brace has closed than opened."""
    at = f"list_position(list_transform(range(1, length({tail}) + 1), lambda i: length(replace(({tail})[1:i], '}}', '')) + 1 = length(replace(({tail})[1:i], '{{', ''))), true)"
    return f"(case when {at} > 0 then ({tail})[1:{at} - 1] end)"


def after_think_sql(x: str) -> str:
    """SQL of ``strip_think_last``."""
    return strip_sql(f"regexp_replace({x}, '(?is)^.*(</think>|\\[/think\\]|<channel\\|>)', '')")
