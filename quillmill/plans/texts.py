"""Queries on text functions and answer extraction.

The inputs are the pipeline's own outputs; where these lack a form (nested boxes, other thinking
tags), it is composed around them, the same way in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import answers, text
from quillmill.functions.parsers import json_text, last_json_span
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, JUDGE, ROLLOUT, TASK, strip_sql
from quillmill.session import table

#: Outputs in the forms a model leaves them in, by the record's number.
OUT = f"""{AUDIT}, out as (select audit_no, case audit_no % 6
 when 0 then coalesce(raw_output, '') when 1 then '<think>' || coalesce(raw_output, '') || '</think> ' || coalesce(model_answer, '')
 when 2 then 'a <THINK> b </think> c [/THINK] ' || coalesce(model_answer, '') || ' ' when 3 then coalesce(model_answer, '') || '\\boxed{{x {{y}} z}} and \\boxed{{' || '{{' || attempt || '}} no' || '}} end'
 when 4 then '```json ' || coalesce(model_answer, '') || ' ``` tail' else 'Answer: ' || attempt || ') yes' end as t from audit)"""


def _out(spark: SparkSession, d: str) -> DataFrame:
    raw, ans = F.coalesce("raw_output", F.lit("")), F.coalesce("model_answer", F.lit(""))
    n = F.col("audit_no") % 6
    a = F.col("attempt").cast("string")
    t = (
        F.when(n == 0, raw)
        .when(n == 1, F.concat(F.lit("<think>"), raw, F.lit("</think> "), ans))
        .when(n == 2, F.concat(F.lit("a <THINK> b </think> c [/THINK] "), ans, F.lit(" ")))
        .when(n == 3, F.concat(ans, F.lit("\\boxed{x {y} z} and \\boxed{{"), a, F.lit("} no} end")))
        .when(n == 4, F.concat(F.lit("```json "), ans, F.lit(" ``` tail")))
        .otherwise(F.concat(F.lit("Answer: "), a, F.lit(") yes")))
    )
    return v.audits(spark, d).select("audit_no", t.alias("t"))


def _query(name: str, expr: str, f, doc: str) -> None:
    """File a query that applies one function to every output."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _out(spark, d).select("audit_no", f(F.col("t")).alias("value"))

    run.__doc__, run.__name__ = doc, name
    register(name, f"with {OUT} select audit_no, {expr} as value from out" if expr else None)(run)


_WS = r"[\s\x0b]"
_AFTER = r"regexp_replace(t, '(?is)^.*(</think>|\[/think\]|<channel\|>)', '')"
_EXACT = "case when contains(t, '</think>') then " + strip_sql("regexp_replace(t, '(?s)^.*</think>', '')") + " else t end"
_FENCE = "```(?:json)?\\s*([\\s\\S]*?)\\s*```"
_FENCED = f"case when regexp_matches({strip_sql('t')}, '{_FENCE}') then {strip_sql(f'''regexp_extract({strip_sql('t')}, '{_FENCE}', 1)''')} else {strip_sql('t')} end"

_query("normalize_text", f"regexp_replace(lower({strip_sql('t')}), '\\s+', ' ', 'g')", text.normalize_text, "Stripped, lower case, single blanks.")
_query("strip_think_last", strip_sql(_AFTER), text.strip_think_last, "What follows the last closing tag of any kind.")
_query("strip_think_exact", _EXACT, text.strip_think_exact, "What follows the last </think>.")
_query(
    "strip_think_prefix",
    f"case when regexp_matches(ltrim(lower(t), {v.SPACES_SQL}), '^(<think>|\\[think\\]|<\\|channel>thought)') and contains(lower(t), '</think>') then {strip_sql('regexp_replace(t, $$(?is)^.*?</think>$$, $$$$)')} else {strip_sql('t')} end",
    text.strip_think_prefix,
    "A thinking block at the start taken off.",
)
_query(
    "think_text",
    "case when regexp_matches(t, '(?i)<think>') and regexp_matches(t, '(?i)(</think>|\\[/think\\])') then regexp_extract(t, '(?is)<think>(.*?)(</think>|\\[/think\\])', 1)"
    " when regexp_matches(t, '(?i)(</think>|\\[/think\\])') then regexp_extract(t, '(?is)^(.*?)(</think>|\\[/think\\])', 1) when regexp_matches(t, '(?i)<think>') then regexp_extract(t, '(?is)<think>(.*)$', 1) else '' end",
    text.think_text,
    "The thinking itself.",
)
_query("boxed_greedy", f"case when regexp_matches({_AFTER}, '(?s)\\\\boxed\\{{(.+)\\}}') then {strip_sql(f'''regexp_extract({_AFTER}, '(?s)\\\\boxed\\{{(.+)\\}}', 1)''')} else {strip_sql(_AFTER)} end", answers.boxed_greedy, "From the first box to the last brace.")
_query("boxed_int", "try_cast(coalesce(nullif(regexp_extract(t, '(?i)\\\\boxed\\{\\s*(\\d+)(?:\\s*[).][^}]*)?\\s*\\}', 1), ''), nullif(regexp_extract(t, '(?i)Answer:\\s*(\\d+)', 1), '')) as bigint)", answers.boxed_int, "Number in a box or after a label.")
_query("boxed_1to4", "try_cast(coalesce(nullif(regexp_extract(t, '\\\\boxed\\{\\s*([1-4])\\s*\\}', 1), ''), nullif(regexp_extract(t, '\\b([1-4])\\b', 1), '')) as int)", answers.boxed_1to4, "Option in a box, else any bare one.")
_query("option_digit", "try_cast(nullif(regexp_extract(t, '\\b([1-5])\\b', 1), '') as int)", answers.option_digit, "First bare option.")
_query("code_fence", _FENCED, text.code_fence, "Inside of the first code fence.")
_query("truncate_marker", f"case when length({strip_sql('t')}) > 200 then rtrim({strip_sql('t')}[1:168], {v.SPACES_SQL}) || chr(10) || '...[truncated]' else {strip_sql('t')} end", lambda c: text.truncate_marker(c, 200), "Cut to 200 characters with a mark.")
_query("token_count_ws", f"case when {strip_sql('t')} = '' then 0 else len(regexp_split_to_array({strip_sql('t')}, '\\s+'))::int end", text.token_count_ws, "Number of words.")
_query("safe_name", f"coalesce(nullif(trim(regexp_replace({strip_sql('t')}, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'model')", text.safe_name, "Text as a file name.")
_query("explanation_text", f"case when contains(t, '</think>') and length({strip_sql('''regexp_replace(regexp_replace(t, '(?s)^.*</think>', ''), '(?s)\\\\boxed\\{.*$', '')''')}) > 10 then {strip_sql('''regexp_replace(regexp_replace(t, '(?s)^.*</think>', ''), '(?s)\\\\boxed\\{.*$', '')''')} else '' end", text.explanation_text, "Explanation between thinking and box.")
_TAIL = f"string_split({_EXACT}, '\\boxed{{')[-1]"
_BODY = "case when regexp_matches(t, '(?i)</think>') then regexp_replace(t, '(?is)^.*?</think>', '') else t end"
_BARE = f"(case when regexp_matches({strip_sql(_BODY)}, '{_FENCE}') then {strip_sql(f"regexp_extract({strip_sql(_BODY)}, '{_FENCE}', 1)")} else {strip_sql(_BODY)} end)"
_query("boxed_last", f"case when contains({_EXACT}, '\\boxed{{') then nullif({strip_sql(v.balanced_sql(_TAIL))}, '') end", answers.boxed_last, "Last box after the thinking, braces balanced.")
_BOXES = "list_filter(list_transform(range(2, len(string_split(m, chr(1))) + 1), lambda k: {b}), lambda x: x is not null)".format(b=v.balanced_sql("array_to_string(string_split(m, chr(1))[k:], '\\boxed{')"))
_FIRST = f"(select coalesce({strip_sql(f'({_BOXES})[1]')}, '') from (select regexp_replace(t, '(?i){chr(92)}{chr(92)}boxed{chr(92)}s*{chr(92)}{{', chr(1), 'g') as m))"
_query("boxed_first", _FIRST, answers.boxed_first, "First box that closes, braces balanced.")
_query("yes_no", f"lower(coalesce(nullif(regexp_extract({_FIRST}, '(?i)\\b(yes|no)\\b', 1), ''), nullif(regexp_extract(t, '(?i)\\b(yes|no)\\b', 1), '')))", answers.yes_no, "Yes or no in the first box, else anywhere.")
_query("final_int", "try_cast(coalesce(nullif(regexp_extract(t, '(?i)\\\\boxed\\{\\s*(\\d+)(?:\\s*[).][^}]*)?\\s*\\}', 1), ''), nullif(regexp_extract(t, '(?i)Answer:\\s*(\\d+)', 1), ''), nullif(regexp_extract(t, '(?im)^(\\d+)\\)?\\s*$', 1), ''), nullif(regexp_extract(t, '(?i)option\\s*(\\d+)', 1), '')) as bigint)", answers.final_int, "Number in a box, after a label, alone on a line or after option.")
_query("open_answer", f"case when not regexp_matches(t, '(?i)</think>') and contains(lower(t), '<think>') then null else nullif(case when regexp_matches({_BARE}, '(?s)\\\\boxed\\{{(.*?)\\}}') then {strip_sql(f"regexp_extract({_BARE}, '(?s)\\\\boxed\\{{(.*?)\\}}', 1)")} else {_BARE} end, '') end", answers.open_answer, "Open answer after the first </think>.")
_query("json_loose", None, json_text, "JSON value in a text, by a ladder of attempts.")
_query("json_last_span", None, last_json_span, "Last JSON span of a text.")


@register("verdict", f"""with {JUDGE}, x as (select judge_no, upper({strip_sql("case judge_no % 4 when 0 then 'It is incorrect.' when 1 then 'Correct: ' || coalesce(judgment, '') when 2 then 'true' else coalesce(judgment, 'false') end")}) as u from judge)
select judge_no, case when contains(u, 'INCORRECT') then false when regexp_matches(u, '\\bCORRECT\\b') then true when regexp_matches(u, '\\bTRUE\\b') then true when regexp_matches(u, '\\bFALSE\\b') then false end as value from x""")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether a judge's words say correct."""
    n = F.col("judge_no") % 4
    t = F.when(n == 0, "It is incorrect.").when(n == 1, F.concat(F.lit("Correct: "), F.coalesce("judgment", F.lit("")))).when(n == 2, "true").otherwise(F.coalesce("judgment", F.lit("false")))
    return v.judges(spark, d).select("judge_no", answers.verdict(t).alias("value"))


@register("maxim_extract", """with x as (select item_id, case when item_id % 3 = 0 then 'This flouts the maxim of ' || ['RELATION','quality','Quantity','manner'][item_id % 4 + 1] || '.' when item_id % 3 = 1 then 'It does not flout any maxim' else question end as t from bench_item)
select item_id, case when regexp_matches(t, '(?i)does not flout any maxim') then 'None' when regexp_matches(t, '(?i)flouts the maxim of\\s+(relation|quality|quantity|manner)')
 then upper(regexp_extract(t, '(?i)flouts the maxim of\\s+(relation|quality|quantity|manner)', 1)[1]) || lower(regexp_extract(t, '(?i)flouts the maxim of\\s+(relation|quality|quantity|manner)', 1)[2:]) end as maxim from x""")
def maxim_extract(spark: SparkSession, d: str) -> DataFrame:
    """Maxim a text says is flouted."""
    names = F.array(*[F.lit(x) for x in ("RELATION", "quality", "Quantity", "manner")])
    i = F.col("item_id")
    t = F.when(i % 3 == 0, F.concat(F.lit("This flouts the maxim of "), F.element_at(names, (i % 4 + 1).cast("int")), F.lit("."))).when(i % 3 == 1, F.lit("It does not flout any maxim")).otherwise(F.col("question"))
    return table(spark, d, "bench_item").select("item_id", answers.maxim_extract(t).alias("maxim"))


@register("format_reward", f"""with {ROLLOUT}, x as (select log_no, case log_no % 5 when 0 then candidate when 1 then '<think>r</think> ' || coalesce(candidate, '') when 2 then '<think></think>\\boxed{{a}}' when 3 then '<think>a</think></think>\\boxed{{a}}' else '<think>why</think> \\boxed{{a{{b}}}}' end as t from rollout)
select log_no, case when not contains(t, '<think>') or not contains(t, '</think>') then 0.0::double when log_no % 5 = 4 then 1.0 when log_no % 5 = 1 and regexp_matches(t, '\\\\boxed\\{{.*[^\\s}}].*\\}}') then 1.0 else 0.5 end as reward from x where t is not null""")
def format_reward(spark: SparkSession, d: str) -> DataFrame:
    """Reward for the form of an answer."""
    n = F.col("log_no") % 5
    t = (
        F.when(n == 0, F.col("candidate")).when(n == 1, F.concat(F.lit("<think>r</think> "), F.coalesce("candidate", F.lit("")))).when(n == 2, F.lit("<think></think>\\boxed{a}"))
        .when(n == 3, F.lit("<think>a</think></think>\\boxed{a}")).otherwise(F.lit("<think>why</think> \\boxed{a{b}}"))
    )
    return v.rollouts(spark, d).select("log_no", t.alias("t")).where("t is not null").select("log_no", answers.format_reward(F.col("t")).alias("reward"))


@register("jsonl_in_text", """select event_id, json_extract_string(props, '$.k')::int as k from events where json_extract_string(props, '$.k') is not null""")
def jsonl_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Records with a required key in lines of a text, numbering taken off."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("1. "), F.col("props"), F.lit("\n\nnot json")).alias("t"))
    lines = e.select("event_id", F.explode(F.split("t", "\n")).alias("line"))
    rec = F.from_json(F.regexp_replace("line", r"^\s*\d+[.)]\s*", ""), "k int")
    return lines.select("event_id", rec.alias("r")).where("r.k is not null").select("event_id", "r.k")


_LABELLED = "'Content: ' || coalesce(content, '') || chr(10) || ' Question: ' || coalesce(question, '') || chr(10) || 'ANSWER: ' || coalesce(answer, '')"


@register("parse_labeled", f"""with {TASK}, x as (select task_no, {_LABELLED} as t from task),
 y as (select task_no, regexp_extract(t, '(?is)\\bcontent\\s*:\\s*(.+?)\\s*\\n\\s*question\\s*:', 1) as content, regexp_extract(t, '(?is)\\bquestion\\s*:\\s*(.+?)\\s*\\n\\s*answer\\s*:', 1) as question, regexp_extract(t, '(?is)\\banswer\\s*:\\s*(.+?)\\s*$', 1) as answer from x)
select task_no, {strip_sql('content')} as content, {strip_sql('question')} as question, {strip_sql('answer')} as answer from y where content <> '' and question <> '' and answer <> ''""")
def parse_labeled(spark: SparkSession, d: str) -> DataFrame:
    """Content, question and answer read back from labelled text."""
    t = F.concat(F.lit("Content: "), F.coalesce("content", F.lit("")), F.lit("\n Question: "), F.coalesce("question", F.lit("")), F.lit("\nANSWER: "), F.coalesce("answer", F.lit("")))
    return v.tasks(spark, d).select("task_no", answers.labelled_qa(t).alias("r")).where("r is not null").select("task_no", "r.*")


@register("tuple_text", f"with {TASK} select task_no, '(' || to_json(coalesce(content, '')) || ', ' || to_json(coalesce(question, '')) || ', ' || to_json(coalesce(answer, '')) || ')' as value from task")
def tuple_text(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a quoted tuple."""
    return v.tasks(spark, d).select("task_no", text.tuple_text(F.col("content"), F.col("question"), F.col("answer")).alias("value"))
