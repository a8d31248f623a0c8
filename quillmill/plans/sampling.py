"""Queries on sampling, splitting, sharding and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import first_filled, stable_u32
from quillmill.operators import splits
from quillmill.plans import views as v
from quillmill.plans.registry import register
from quillmill.plans.views import AUDIT, TASK, strip_sql, u32_sql
from quillmill.session import table

_SEC = "coalesce(section, '')"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return v.tasks(spark, d).select("task_no", F.coalesce("section", F.lit("")).alias("section"))


@register("stable_u32", f"with {TASK} select task_no, {u32_sql(42, 'task_no', 'task_id')} as u from task")
def stable_u32_(spark: SparkSession, d: str) -> DataFrame:
    """Seeded number of every task."""
    return v.tasks(spark, d).select("task_no", stable_u32(42, F.col("task_no"), F.col("task_id")).alias("u"))


@register("stratified_split", f"""with {TASK}, r as (select task_no, {_SEC} as section, row_number() over (partition by {_SEC} order by {u32_sql(1, 'task_no')}, task_no) as k from task)
select task_no, section, case when k <= 10 then 'val' else 'train' end as split from r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Ten tasks of every section held out."""
    return splits.stratified_split(_tasks(spark, d), "section", "task_no", 10, 1)


@register("hash_sample", f"with {TASK} select task_no from task order by {u32_sql(3, 'task_no')}, task_no limit 100")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred tasks drawn without replacement."""
    return splits.hash_sample(v.tasks(spark, d).select("task_no"), "task_no", 100, 3)


@register("sample_k", f"with {TASK}, r as (select task_no, {_SEC} as section, row_number() over (partition by {_SEC} order by {u32_sql(5, 'task_no')}, task_no) as k from task) select task_no, section from r where k <= 4")
def sample_k(spark: SparkSession, d: str) -> DataFrame:
    """Four tasks of every section drawn without replacement."""
    return splits.sample_per_group(_tasks(spark, d), ["section"], "task_no", 4, 5)


@register("group_split", f"""with {TASK}, g as (select task_no, coalesce('domain::' || domain_index, 'domain::' || nullif({strip_sql('domain_seed')}, ''), 'record::' || task_no) as grp from task),
 n as (select grp, count(*) as n from g group by 1), r as (select grp, coalesce(sum(n) over (order by {u32_sql(9, 'grp')}, grp rows between unbounded preceding and 1 preceding), 0) as before from n),
 t as (select greatest(floor(count(*) * 0.02), 1) as target from g)
select task_no, case when before < target then 'val' else 'train' end as split from g join r using (grp), t""")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Whole domains held out until two per cent of the tasks are."""
    key = F.coalesce(F.concat(F.lit("domain::"), F.col("domain_index").cast("string")), F.concat(F.lit("domain::"), first_filled(F.col("domain_seed"))), F.concat(F.lit("record::"), F.col("task_no").cast("string")))
    return splits.group_split(v.tasks(spark, d).select("task_no", "domain_index", "domain_seed"), key, "task_no", 0.02, 9).select("task_no", "split")


@register("round_robin", f"""with {TASK}, r as (select task_no, {_SEC} as section, row_number() over (partition by {_SEC} order by {u32_sql(2, 'task_no')}, task_no) as turn from task)
select task_no, section, row_number() over (order by turn, section, task_no) as place from r""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """One task per section in turn."""
    return splits.round_robin(_tasks(spark, d), "section", "task_no", 2)


_DRAWS = f"""with n as (select phenomenon, row_number() over (order by phenomenon) - 1 as g, count(*) as n from bench_item group by 1),
 i as (select phenomenon, item_id, row_number() over (partition by phenomenon order by item_id) - 1 as i from bench_item),
 d as (select place, {u32_sql(7, 'place')} % (select count(*) from n) as g from range(20000) t(place)),
 t as (select place, phenomenon, n, row_number() over (partition by d.g order by place) - 1 as t from d join n on n.g = d.g),
 e as (select {{stop}}(place) as stop from t where t = n - 1) select place, t.phenomenon, item_id from t, e, i where place <= stop and i.phenomenon = t.phenomenon and i.i = t % n"""


@register("interleave_oversample", _DRAWS.format(stop="max"))
def interleave_oversample(spark: SparkSession, d: str) -> DataFrame:
    """Items drawn with equal chances per phenomenon until all phenomena are exhausted."""
    return splits.interleave(table(spark, d, "bench_item").select("phenomenon", "item_id"), "phenomenon", "item_id", 7)


@register("interleave_first", _DRAWS.format(stop="min"))
def interleave_first(spark: SparkSession, d: str) -> DataFrame:
    """The same until the first phenomenon is exhausted."""
    return splits.interleave(table(spark, d, "bench_item").select("phenomenon", "item_id"), "phenomenon", "item_id", 7, exhaust_all=False)


@register("natural_sort", """with p as (select distinct source_dataset || case when task_no % 7 = 0 then '' else '/checkpoint-' || (task_no % 100) end as path from sft_task)
select path, row_number() over (order by coalesce(try_cast(nullif(regexp_extract(path, 'checkpoint-([0-9]+)', 1), '') as double), 1e18), path) as place from p""")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """Paths by step number, those without one last."""
    from quillmill.operators.ranking import global_rank

    step = F.when(F.col("task_no") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("/checkpoint-"), (F.col("task_no") % 100).cast("string")))
    p = table(spark, d, "sft_task").select(F.concat("source_dataset", step).alias("path")).distinct()
    return global_rank(p, [splits.natural_step(F.col("path")), F.col("path")], "place")


@register("prefix_limit", f"with {TASK} select task_no from task order by task_no limit 50")
def prefix_limit(spark: SparkSession, d: str) -> DataFrame:
    """First fifty tasks in load order."""
    return v.tasks(spark, d).select("task_no").orderBy("task_no").limit(50)


@register("shard_range", f"with {TASK}, r as (select task_no, row_number() over (order by task_no) - 1 as i, count(*) over () as n from task) select task_no from r where i >= n * 2 // 7 and i < n * 3 // 7")
def shard_range(spark: SparkSession, d: str) -> DataFrame:
    """Third of seven contiguous shards."""
    return splits.shard_range(v.tasks(spark, d).select("task_no"), [F.col("task_no")], 2, 7)


@register("shard_mod", f"with {TASK} select task_no from task where task_no % 7 = 3")
def shard_mod(spark: SparkSession, d: str) -> DataFrame:
    """Fourth of seven interleaved shards."""
    return splits.shard_mod(v.tasks(spark, d).select("task_no"), F.col("task_no"), 3, 7)


@register("unique_keys", f"with {AUDIT} select audit_no, concat_ws(':', backend, row_number() over (partition by task_no order by audit_no), task_no) as key, row_number() over (partition by task_no order by audit_no)::int as idx from audit")
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key of every audit: backend, its place among the task's audits, task."""
    from pyspark.sql import Window

    a = v.audits(spark, d).select("audit_no", "task_no", "backend").withColumn("idx", F.row_number().over(Window.partitionBy("task_no").orderBy("audit_no")))
    return a.select("audit_no", splits.unique_key(F.col("backend"), F.col("idx"), F.col("task_no")).alias("key"), "idx")
