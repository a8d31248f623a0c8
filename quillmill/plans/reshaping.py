"""Queries on prompts, turns, examples and token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import prompts
from quillmill.functions.answers import boxed_greedy
from quillmill.functions.prompts import USER, fill_sql
from quillmill.functions.text import canonical_section, clamped_int, clean_list, contains_close, render_template, section_text, strip_suffix, subsequence_at, text_or_empty, token_count_ws, truncate_tokens_ws
from quillmill.operators import reshape
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, ROLLOUT, TASK, strip_sql
from quillmill.session import scratch_path, table
from quillmill.sources import writers

SYSTEM = "You answer questions about short scenes."


_USER = "'Scene:' || chr(10) || coalesce(content, '') || chr(10) || chr(10) || 'Question:' || chr(10) || coalesce(question, '')"


@register("build_prompts", f"""with {TASK} select task_no, 0 as turn, 'system' as role, '{SYSTEM}' as content, coalesce(reference, answer, '') as ground_truth, coalesce(section, 'unknown') as section from task
 union all select task_no, 1, 'user', {_USER}, coalesce(reference, answer, ''), coalesce(section, 'unknown') from task""")
def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of every task's chat prompt with its ground truth."""
    user = F.concat(F.lit("Scene:\n"), F.coalesce("content", F.lit("")), F.lit("\n\nQuestion:\n"), F.coalesce("question", F.lit("")))
    p = v.tasks(spark, d).select("task_no", reshape.chat(F.lit(SYSTEM), user).alias("prompt"), F.coalesce("reference", "answer", F.lit("")).alias("ground_truth"), F.coalesce("section", F.lit("unknown")).alias("section"))
    return p.select("task_no", F.posexplode("prompt").alias("turn", "m"), "ground_truth", "section").select("task_no", "turn", "m.role", "m.content", "ground_truth", "section")


@register("strip_suffix", f"with {TASK} select task_no, rtrim(regexp_replace(coalesce(question, '') || chr(10) || 'Answer: ', 'Answer:\\s*$', ''), {v.SPACES_SQL}) as prompt from task")
def strip_suffix_(spark: SparkSession, d: str) -> DataFrame:
    """Prompts without their closing label."""
    return v.tasks(spark, d).select("task_no", strip_suffix(F.concat(F.coalesce("question", F.lit("")), F.lit("\nAnswer: "))).alias("prompt"))


_PART = "item_id, {i} as source_candidate, choices[{i}] as candidate, choices[{j}] as other from bench_item where coalesce(trim(choices[{i}]), '') <> ''"


@register("unpivot_swap", f"select {_PART.format(i=1, j=2)} union all select {_PART.format(i=2, j=1)}")
def unpivot_swap(spark: SparkSession, d: str) -> DataFrame:
    """Two rows per item, each choice once in front."""
    b = table(spark, d, "bench_item").select("item_id", F.get("choices", F.lit(0)).alias("a"), F.get("choices", F.lit(1)).alias("b"))
    return reshape.unpivot_swap(b, "a", "b").select("item_id", "source_candidate", "candidate", "other")


@register("turns_to_text", f"""with {TASK} select task_no, array_to_string(list_transform(list_filter(sft_messages, lambda m: coalesce({strip_sql('m.content')}, '') <> ''), lambda m: m.role || ': ' || {strip_sql('m.content')}), chr(10)) as text from task""")
def turns_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Messages as lines."""
    return v.tasks(spark, d).select("task_no", reshape.turns_to_text(F.col("sft_messages")).alias("text"))


@register("render_chat", f"""with {TASK} select task_no, array_to_string(list_transform(sft_messages, lambda m: '<|' || m.role || '|>' || chr(10) || {strip_sql('m.content')} || chr(10)), '') || '<|assistant|>' || chr(10) as text from task""")
def render_chat(spark: SparkSession, d: str) -> DataFrame:
    """Messages between turn markers."""
    return v.tasks(spark, d).select("task_no", reshape.render_chat(F.col("sft_messages")).alias("text"))


@register("render_inst", f"""with {TASK}, m as (select task_no, list_transform(coalesce(sft_messages, []), lambda m: {{'role': lower({strip_sql("coalesce(m.role, '')")}), 'content': {strip_sql("coalesce(m.content, '')")}}}) as m from task where sft_messages is not null),
 p as (select task_no, m, list_filter(m, lambda x: x.role <> 'system') as t, array_to_string(list_filter(list_transform(list_filter(m, lambda x: x.role = 'system'), lambda x: x.content), lambda x: x <> ''), chr(10) || chr(10)) as s from m)
select task_no, array_to_string(list_transform(range(1, len(t) + 1), lambda i: case when t[i].role = 'user' then '<s>[INST] ' || case when s <> '' and len(list_filter(t[1:i], lambda x: x.role = 'user')) = 1 then '<<SYS>>' || chr(10) || s || chr(10) || '<</SYS>>' || chr(10) || chr(10) else '' end || t[i].content || ' [/INST]'
 when t[i].role = 'assistant' and i > 1 and t[i - 1].role = 'user' then ' ' || t[i].content || ' </s>' else '' end), '') as text from p where len(t) > 0""")
def render_inst(spark: SparkSession, d: str) -> DataFrame:
    """Messages between instruction brackets."""
    t = v.tasks(spark, d).where("sft_messages is not null and exists(sft_messages, m -> lower(trim(m.role)) <> 'system')")
    return t.select("task_no", reshape.render_inst(F.col("sft_messages")).alias("text"))


@register("truncate_tokens", f"""with {TASK}, w as (select task_no, content, regexp_split_to_array({strip_sql("coalesce(content, '')")}, '\\s+') as w from task)
select task_no, case when len(w) > 12 then array_to_string(w[1:12], ' ') else content end as head, case when len(w) > 12 then array_to_string(w[len(w) - 11:], ' ') else content end as tail from w""")
def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """First and last twelve words of every scene."""
    c = F.col("content")
    return v.tasks(spark, d).select("task_no", truncate_tokens_ws(c, 12).alias("head"), truncate_tokens_ws(c, 12, "left").alias("tail"))


@register("clean_list", f"""select item_id, list_filter(list_transform(list_concat(choices, ['none', ' N/A ', '-', ' x ']), lambda x: {strip_sql('x')}), lambda x: x <> '' and lower(x) not in ('none', 'no', 'null', 'n/a', 'na', '[]', '-')) as kept, least(greatest(gold_index * 3, 2), 5)::bigint as clamped from bench_item""")
def clean_list_(spark: SparkSession, d: str) -> DataFrame:
    """Choices and other entries without those that stand for none, and a clamped number."""
    more = F.array(*[F.lit(x) for x in ("none", " N/A ", "-", " x ")])
    return table(spark, d, "bench_item").select("item_id", clean_list(F.concat("choices", more)).alias("kept"), clamped_int(F.col("gold_index") * 3, 2, 5).alias("clamped"))


@register("fewshot_block", """with r as (select phenomenon, item_id, question, row_number() over (partition by phenomenon order by item_id) as k from bench_item where bench_split = 'dev')
select phenomenon, string_agg('Example ' || k || ':' || chr(10) || question, chr(10) || chr(10) order by k) as block from r where k <= 4 group by 1""")
def fewshot_block(spark: SparkSession, d: str) -> DataFrame:
    """Four numbered examples of every phenomenon."""
    from quillmill.operators.dedup import group_cap

    b = group_cap(table(spark, d, "bench_item").where("bench_split = 'dev'").select("phenomenon", "item_id", "question"), ["phenomenon"], "item_id", 4)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "question"))), lambda x: x["question"])
    return b.groupBy("phenomenon").agg(reshape.numbered_block(texts).alias("block"))


TEMPLATE = "Section: {section}\nScene: {content}\nQ: {question}\nA: {answer}"


@register("render_template", f"""with {TASK} select task_no, replace(replace(replace(replace('{TEMPLATE}', '{{section}}', coalesce(section, '')), '{{content}}', coalesce(content, '')), '{{question}}', coalesce(question, '')), '{{answer}}', coalesce(answer, '')) as text from task""".replace("\\n", "\n"))
def render_template_(spark: SparkSession, d: str) -> DataFrame:
    """Template filled part after part."""
    return v.tasks(spark, d).select("task_no", render_template(TEMPLATE, {c: F.col(c) for c in ("section", "content", "question", "answer")}).alias("text"))


#: Token ids of a made-up tokenizer: the lengths of the words.
_IDS = "list_transform(string_split(trim(question), ' '), lambda w: length(w)::int)"


@register("subsequence", f"with {TASK} select task_no, coalesce(list_position(list_transform(range(1, greatest(len({_IDS}) - 1, 1)), lambda i: {_IDS}[i:i+2] = [3, 3, 7]), true), 0)::int - 1 as at from task where question is not null")
def subsequence(spark: SparkSession, d: str) -> DataFrame:
    """Where a run of ids occurs first."""
    ids = F.transform(F.split(F.trim("question"), " "), F.length)
    return v.tasks(spark, d).where("question is not null").select("task_no", subsequence_at(ids, [3, 3, 7]).alias("at"))


_EXAMPLES = f"""{TASK}, i as (select task_no, {_IDS} as ids, (len({_IDS}) // 2 + (task_no % 3) * 8)::int as p from task where question is not null),
 c as (select task_no, ids[1:16] as cut, least(p, 16) as asked from i),
 e as (select task_no, cut as input_ids, list_concat(list_transform(range(least(asked, len(cut) - 1)), lambda x: -100::int), cut[least(asked, len(cut) - 1) + 1:]) as labels from c where len(cut) > asked)"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples of at most 16 ids, some with prompts as long or longer."""
    ids = F.transform(F.split(F.trim("question"), " "), F.length)
    t = v.tasks(spark, d).where("question is not null").select("task_no", ids.alias("ids"))
    prompt = (F.floor(F.size("ids") / 2) + F.col("task_no") % 3 * 8).cast("int")
    return t.select("task_no", F.slice("ids", 1, 16).alias("input_ids"), reshape.label_mask(F.col("ids"), prompt, 16).alias("labels")).where("labels is not null")


@register("label_mask", f"with {_EXAMPLES} select task_no, labels from e")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the prompt masked, at most 16 tokens; examples whose prompt takes them all are left out."""
    return _examples(spark, d).select("task_no", "labels")


@register("collate", f"""with {_EXAMPLES}, b as (select *, (task_no // 32)::bigint as batch, max(len(input_ids)) over (partition by task_no // 32) as m from e)
select task_no, batch, list_concat(input_ids, list_transform(range(m - len(input_ids)), lambda x: 0::int)) as input_ids, list_concat(labels, list_transform(range(m - len(labels)), lambda x: -100::int)) as labels,
 list_concat(list_transform(range(len(input_ids)), lambda x: 1::int), list_transform(range(m - len(input_ids)), lambda x: 0::int)) as attention_mask from b""")
def collate(spark: SparkSession, d: str) -> DataFrame:
    """Batches of examples padded to their longest."""
    return reshape.collate(_examples(spark, d), "task_no", 32, 0)


@register("trainable", f"with {TASK} select task_no, coalesce(len(sft_messages) >= 2 and sft_messages[-1].role = 'assistant', false) as trainable, coalesce(len(sft_messages) >= 1 and sft_messages[-1].role = 'user', false) as asks from task")
def trainable(spark: SparkSession, d: str) -> DataFrame:
    """Whether a task's chat ends with an answer, as its examples must, or still asks."""
    m = F.col("sft_messages")
    return v.tasks(spark, d).select("task_no", reshape.trainable(m).alias("trainable"), F.coalesce(F.element_at(m, -1)["role"] == "user", F.lit(False)).alias("asks"))


_PIECES = {"content": "content", "question": "question", "reference": "coalesce(reference, answer)"}


@register("judge_prompts", f"""with {TASK}, p as (select task_no, 'margin_judge' as kind, {fill_sql(USER['margin_judge'], candidate='answer', **_PIECES)} as text from task
 union all select task_no, 'judge', {fill_sql(USER['judge'], candidate='answer', **_PIECES)} from task
 union all select task_no, 'qa', {fill_sql(USER['qa'], content='content', question='question')} from task
 union all select task_no, 'pragmatic_qa', {fill_sql(USER['pragmatic_qa'], section='section', described=f"case when coalesce({strip_sql('section_description')}, '') <> '' then 'Category Description: ' || {strip_sql('section_description')} || chr(10) else '' end", content='content', question='question')} from task)
select task_no, kind, text from p""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """User turns of the judges and of the two question forms."""
    c = {x: F.col(x) for x in ("content", "question", "section", "answer")}
    known = F.coalesce("reference", "answer")
    made = {
        "margin_judge": F.element_at(prompts.judge_prompt(c["content"], c["question"], known, c["answer"]), -1)["content"],
        "judge": F.element_at(prompts.judge_prompt(c["content"], c["question"], known, c["answer"], margin=False), -1)["content"],
        "qa": prompts.qa_user(c["content"], c["question"]),
        "pragmatic_qa": prompts.qa_user(c["content"], c["question"], c["section"], F.col("section_description")),
    }
    return v.tasks(spark, d).select("task_no", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("text")) for k, x in made.items()])).alias("p")).select("task_no", "p.*")


_BOXED = r"'(?s)\\boxed\{(.+)\}'"
_TAIL = v.after_think_sql("candidate")
_FINAL = f"case when regexp_matches({_TAIL}, {_BOXED}) then {strip_sql(f'regexp_extract({_TAIL}, {_BOXED}, 1)')} else {_TAIL} end"


@register("retry_prompts", f"""with {ROLLOUT}, {TASK}, x as (select log_no, {_FINAL} as previous, coalesce(nullif({strip_sql('judge_token')}, ''), '') as said, {strip_sql("coalesce(t.reference, t.answer, '')")} as reference from rollout r join task t on t.task_no = r.row_idx where not coalesce(confident_yes, false) and t.sft_messages is not null)
select log_no, {fill_sql(USER['refine'], previous='previous', feedback="coalesce(nullif(said, ''), 'Your previous output did not satisfy the task constraints.')", corrected='reference')} as refine,
 {fill_sql(USER['rationalize'], previous="coalesce(nullif(previous, ''), '(empty)')", verifier="case when said <> '' then 'Verifier feedback:' || chr(10) || said || chr(10) || chr(10) else '' end", reference='reference', instruction="''")} as rationalize from x""")
def retry_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a failed rollout is asked next: again with feedback, or for the reasons of the right answer."""
    t = v.tasks(spark, d).where("sft_messages is not null").select(F.col("task_no").alias("row_idx"), "sft_messages", F.coalesce("reference", "answer").alias("right"))
    r = v.rollouts(spark, d).where(~F.coalesce("confident_yes", F.lit(False))).join(t, "row_idx")
    previous, m, said, right = boxed_greedy(F.col("candidate")), F.col("sft_messages"), F.col("judge_token"), F.col("right")
    again = prompts.refine_prompt(m, previous, said, F.lit(None).cast("string"), right)
    why = prompts.rationalize_prompt(m, previous, said, right)
    return r.select("log_no", F.element_at(again, -1)["content"].alias("refine"), F.element_at(why, -1)["content"].alias("rationalize"))


_SYSTEMS = ["You are a careful reader.", "You answer from the scene alone.", "You read between the lines."]


@register("rl_rows", f"""with {TASK}, l as (select content as c, question as q, max(answer) as why from task where content is not null and question is not null and task_no % 2 = 0 group by 1, 2)
select task_no, 'qa' as data_source, ['{"', '".join(_SYSTEMS)}'][{v.u32_sql(5, 'task_no')} % 3 + 1] as system, {fill_sql(USER['qa'], content='content', question='question')} as user, 'model' as style, coalesce(answer, '') as ground_truth,
 coalesce(section, 'unknown') as section, 'qa' as task_type, coalesce(l.why, '') as sft_explanation from task left join l on l.c = coalesce(content, '') and l.q = coalesce(question, '')""")
def rl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with a drawn system prompt, their extra information annotated by lookup."""
    t = v.tasks(spark, d)
    rows = reshape.rl_rows(t, "qa", prompts.qa_user(F.col("content"), F.col("question")), _SYSTEMS, "task_no", 5)
    known = t.where("task_no % 2 = 0 and content is not null and question is not null").groupBy("content", "question").agg(F.max("answer").alias("explanation"))
    e = reshape.annotate(rows, "qa", known)
    return e.select("task_no", "data_source", F.col("prompt")[0]["content"].alias("system"), F.col("prompt")[1]["content"].alias("user"), "reward_model.style", "reward_model.ground_truth", "extra_info.section", "extra_info.task_type", "extra_info.sft_explanation")


_KNOWN = {"metaphor": "Metaphor", "social pragmatics": "Social Pragmatics", "irony and banter": "Irony and Banter"}
_DESCRIBED = {"Metaphor": "Meaning by likeness.", "Social Pragmatics": "Meaning by relation."}
_KEY = "trim(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', ' ', 'g'))"


@register("section_lookup", f"""with {TASK}, c as (select task_no, section_description, case {_KEY} {' '.join(f"when '{k}' then '{x}'" for k, x in _KNOWN.items())} else coalesce({strip_sql('section')}, '') end as section from task)
select task_no, section, coalesce(nullif({strip_sql('section_description')}, ''), case section {' '.join(f"when '{k}' then '{x}'" for k, x in _DESCRIBED.items())} end, '') as description, case section {' '.join(f"when '{k}' then '{x}'" for k, x in _DESCRIBED.items())} else 'By its label.' end as definition from c""")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Listed name of every section, its description, and its definition or the default one."""
    t = v.tasks(spark, d).select("task_no", "section_description", canonical_section(F.col("section"), _KNOWN).alias("section"))
    s = F.col("section")
    return t.select("task_no", "section", section_text(s, F.col("section_description"), _DESCRIBED).alias("description"), section_text(s, F.lit(""), _DESCRIBED, "By its label.").alias("definition"))


@register("second_pass_lengths", f"""with {AUDIT}, x as (select case when {strip_sql('raw_output')} = '' then 0 else len(regexp_split_to_array({strip_sql('raw_output')}, '\\s+')) end as n from audit where raw_output is not null and not regexp_matches(raw_output, '(?i)</think>|\\[/think\\]|<channel\\|>'))
select count(*) as outputs, min(n)::int as least, max(n)::int as most from x""")
def second_pass_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Words of the outputs that need a second pass: how many outputs, fewest and most."""
    o = v.audits(spark, d).where("raw_output is not null").where(~contains_close(F.col("raw_output"))).select(token_count_ws(F.col("raw_output")).alias("n"))
    return o.agg(F.count(F.lit(1)).alias("outputs"), F.min("n").alias("least"), F.max("n").alias("most"))


@register("eval_failures", f"with {AUDIT} select backend, attempt, count(*) as rows, count(*) filter (coalesce({strip_sql('model_answer')}, '') = '') as failures from audit group by 1, 2")
def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    """Results written by model and seed, the failed ones beside them, and both counted as read back."""
    rows = v.audits(spark, d).select("audit_no", F.coalesce("backend", F.lit("")).alias("backend"), "attempt", (text_or_empty(F.col("model_answer")) == "").alias("failed"))
    whole, failed = scratch_path(spark, "results"), scratch_path(spark, "failures")
    writers.write_with_failures(rows, "failed", whole, failed, ["backend", "attempt"])
    of = lambda path, name: spark.read.schema(rows.schema).parquet(path).groupBy("backend", "attempt").agg(F.count(F.lit(1)).alias(name))
    return of(whole, "rows").join(of(failed, "failures"), ["backend", "attempt"], "left").select("backend", "attempt", "rows", F.coalesce("failures", F.lit(0)).alias("failures"))
