"""Queries on reading back what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import models, parsers, text
from quillmill.operators import filters
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, TASK, strip_sql
from quillmill.session import scratch_path, table
from quillmill.sources import readers, writers

BLANK = f"coalesce({strip_sql('question')}, '') <> ''"
SCHEMA = T.StructType([T.StructField("task_no", T.LongType()), T.StructField("question", T.StringType())])


@register("scan_jsonl", f"with {TASK} select task_no, question from task")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines and read back strictly."""
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(v.tasks(spark, d).select("task_no", "question"), path)
    return readers.jsonl_strict(spark, path, SCHEMA)


@register("scan_jsonl_lenient", f"with {TASK} select task_no, question from task where task_no % 5 <> 0 and {BLANK}")
def scan_jsonl_lenient(spark: SparkSession, d: str) -> DataFrame:
    """The same with bad lines in between, skipped."""
    path = scratch_path(spark, "jsonl")
    t = v.tasks(spark, d).select("task_no", "question")
    line = F.when(F.col("task_no") % 5 == 0, F.lit('{"task_no": 1, ')).otherwise(F.to_json(F.struct("task_no", "question")))
    t.select(line.alias("value")).write.text(path)
    return readers.jsonl_lenient(spark, path, SCHEMA, ["question"])


_FIELDS = "select task_no, nullif(coalesce(question, ''), '') as question, nullif(coalesce(content, ''), '') as content from task"


def _as_csv(spark: SparkSession, d: str, path: str) -> None:
    t = v.tasks(spark, d).select(F.col("task_no").cast("string").alias("task_no"), "question", "content")
    t.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(path)


@register("scan_csv", f"with {TASK} {_FIELDS}")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """Questions and scenes written as CSV, quotes and line breaks inside, and read back."""
    path = scratch_path(spark, "csv")
    _as_csv(spark, d, path)
    return readers.csv_file(spark, path).select(F.col("task_no").cast("long").alias("task_no"), "question", "content")


@register("scan_csv_directory", f"with {TASK} {_FIELDS}")
def scan_csv_directory(spark: SparkSession, d: str) -> DataFrame:
    """The same by the name pattern of its files, a file of an excluded name left out."""
    path = scratch_path(spark, "csv")
    _as_csv(spark, d, path)
    return readers.csv_directory(spark, path, "part-*.csv", "no-story").select(F.col("task_no").cast("long").alias("task_no"), "question", "content")


@register("scan_json_array", f"with {TASK} select split, task_no, question from task where question is not null")
def scan_json_array(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON arrays, a file for every 5,000 task numbers, and read back."""
    path = scratch_path(spark, "array")
    item = F.to_json(F.struct("split", "task_no", "question"))
    t = v.tasks(spark, d).where("question is not null")
    arrays = t.groupBy(F.floor(F.col("task_no") / 5000).alias("chunk")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(item), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("chunk").text(path)
    return readers.json_array(spark, path, T.StructType([T.StructField("split", T.StringType()), *SCHEMA.fields])).select("split", "task_no", "question")


@register("scan_splits", f"with {TASK} select split, count(*) as n, min(task_no) as first from task where split in ('train', 'val') group by 1")
def scan_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits written apart and read together with the split they come from."""
    paths = {s: scratch_path(spark, s) for s in ("train", "val")}
    for s, p in paths.items():
        writers.write_parquet(v.tasks(spark, d).where(F.col("split") == s).select("task_no"), p)
    return readers.parquet_by_split(spark, paths).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("task_no").alias("first"))


@register("scan_missing", "select 0::bigint as n")
def scan_missing(spark: SparkSession, d: str) -> DataFrame:
    """A file that is not there has no rows."""
    return readers.jsonl_or_empty(spark, scratch_path(spark, "nowhere"), SCHEMA).agg(F.count(F.lit(1)).alias("n"))


@register("keyword_file", "select distinct lower(trim(phenomenon)) as keyword from bench_item")
def keyword_file(spark: SparkSession, d: str) -> DataFrame:
    """Phenomena written as a list of objects and read back as keywords."""
    path = scratch_path(spark, "keywords")
    names = table(spark, d, "bench_item").select(F.lower(F.trim("phenomenon")).alias("keyword")).distinct()
    names.agg(F.to_json(F.collect_list(F.struct("keyword"))).alias("value")).coalesce(1).write.text(path)  # a fixed table
    return readers.keyword_file(spark, path)


@register("last_rows", f"with {TASK} select task_no from task order by task_no desc limit 25")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    """Last 25 tasks in load order."""
    return readers.last_rows(v.tasks(spark, d).select("task_no"), "task_no", 25)


@register("first_name", f"with {AUDIT} select arg_min(model_answer, audit_no) as name from audit where coalesce({strip_sql('model_answer')}, '') <> ''")
def first_name(spark: SparkSession, d: str) -> DataFrame:
    """First answer that is not blank."""
    return readers.first_name(v.audits(spark, d), "model_answer", "audit_no", "none")


_PARTS3 = " and ".join(f"coalesce({strip_sql(c)}, '') <> ''" for c in ("content", "question", "answer"))


@register("tuple_records", f"with {TASK} select task_no, {', '.join(f'{strip_sql(c)} as {c}' for c in ('content', 'question', 'answer'))} from task where {_PARTS3}")
def tuple_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every item read back from a quoted tuple."""
    t = v.tasks(spark, d).select("task_no", parsers.tuple_records(text.tuple_text(F.col("content"), F.col("question"), F.col("answer"))).alias("r"))
    return t.select("task_no", F.explode("r").alias("x")).select("task_no", "x.*")


@register("qa_candidates", f"with {TASK} select task_no, {', '.join(f'{strip_sql(c)} as {c}' for c in ('content', 'question', 'answer'))} from task where {_PARTS3}")
def qa_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Items read back from labelled text, JSON lines, a JSON list and tuples, a rung each."""
    c, q, a = (F.coalesce(x, F.lit("")) for x in ("content", "question", "answer"))
    item, n = F.to_json(F.struct(c.alias("content"), q.alias("question"), a.alias("answer"))), F.col("task_no") % 4
    t = (
        F.when(n == 0, F.concat(F.lit("<think>x</think>```\nContent: "), c, F.lit("\nQuestion: "), q, F.lit("\nAnswer: "), a, F.lit("\n```")))
        .when(n == 1, F.concat(F.lit("1. "), item, F.lit("\nand no more")))
        .when(n == 2, F.concat(F.lit("Here: ["), item, F.lit("]")))
        .otherwise(text.tuple_text(c, q, a))
    )
    rows = v.tasks(spark, d).where(filters.has_fields("content", "question", "answer")).select("task_no", parsers.qa_candidates(t).alias("r"))
    return rows.select("task_no", F.explode("r").alias("x")).select("task_no", "x.*")


@register("unwrap_answer", f"""with {AUDIT} select audit_no, coalesce(nullif({strip_sql('model_answer')}, ''), nullif({strip_sql("to_json(model_answer)[2:length(to_json(model_answer)) - 1]")}, '')) as intention, case when audit_no % 12 between 1 and 10 then (audit_no % 12)::int end as score, nullif({strip_sql('model_answer')}, '') as content from audit where model_answer is not null""")
def unwrap_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers taken out of an object, a fragment of one, and typed parts; scores out of JSON."""
    key, a = parsers.INTENTION, F.col("model_answer")
    quoted = F.to_json(F.array(a))
    body = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    fragment = F.concat(F.lit(f'"{key}": '), body)
    wrapped = F.when(F.col("audit_no") % 2 == 0, F.concat(F.lit("{"), fragment, F.lit("}"))).otherwise(fragment)
    score = F.concat(F.lit('```json\n{"score": "'), (F.col("audit_no") % 12).cast("string"), F.lit('"}\n```'))
    typed = F.to_json(F.array(F.struct(F.lit("thinking").alias("type"), F.lit("hidden").alias("text")), F.struct(F.lit("text").alias("type"), a.alias("text"))))
    rows = v.audits(spark, d).where("model_answer is not null")
    return rows.select("audit_no", parsers.intention(wrapped).alias("intention"), parsers.judge_score(score).alias("score"), F.nullif(parsers.message_text(typed), F.lit("")).alias("content"))


_WORDS = f"case when {strip_sql('raw_output')} = '' then 0 else len(regexp_split_to_array({strip_sql('raw_output')}, '\\s+')) end"


@register("model_outputs", f"""with {AUDIT} select audit_no, case when contains(raw_output, '</think>') then raw_output[1:instr(raw_output, '</think>') + 7] else rtrim(raw_output, {v.SPACES_SQL}) || ' STOP</think>' end as ended,
 ({_WORDS.replace('raw_output', "(case when contains(lower(raw_output), '<think>') and contains(raw_output, '</think>') then regexp_extract(raw_output, '(?is)<think>(.*?)</think>', 1) when contains(lower(raw_output), '<think>') then regexp_extract(raw_output, '(?is)<think>(.*)$', 1) when contains(raw_output, '</think>') then regexp_extract(raw_output, '(?s)^(.*?)</think>', 1) else '' end)")})::int as words,
 trim(split_part(backend || ' :: lora', '::', 1)) as base, trim(split_part(backend || ' :: lora', '::', 2)) as adapter, [attempt, 0, attempt] as ids, [attempt] as tail from audit where raw_output is not null and attempt > 0""")
def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Thinking ended where it stays open, its words, model specs, ids without padding and behind a token."""
    o, n = F.col("raw_output"), F.col("attempt")
    spec, zero = F.concat("backend", F.lit(" :: lora")), F.lit(0)
    return v.audits(spark, d).where("raw_output is not null and attempt > 0").select(
        "audit_no", models.ended_thinking(o, " STOP</think>", "</think>").alias("ended"), models.think_words(o).alias("words"), models.spec_base(spec).alias("base"), models.spec_adapter(spec).alias("adapter"),
        models.trim_padding(F.array(n, zero, n, zero, zero), 0).alias("ids"), models.after_last(F.array(n, zero, zero, n), 0).alias("tail"),
    )
