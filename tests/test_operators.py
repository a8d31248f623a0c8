import random

import pytest
from pyspark.sql import functions as F

from quillmill import provider, rounds
from quillmill.operators import dedup, filters, joins, metrics, ranking, reshape, splits


def test_global_rank_over_many_partitions(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, x int").repartition(7)
    got = {r["k"]: r["n"] for r in ranking.global_rank(df, [F.col("x").desc(), F.col("k")], "n").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert ranking.global_rank(df.limit(0), [F.col("k")]).count() == 0


@pytest.mark.parametrize("percent", [0, 29, 50, 100])
@pytest.mark.parametrize("field", ["log_odds", "drop_minus_keep"])
def test_ranked_drops(spark, percent, field):
    rnd = random.Random(2)
    rows = [(k, rnd.choice(["a", "b", None, "hot", "hot"]), float(rnd.randrange(4))) for k in range(150)]
    df = spark.createDataFrame(rows, "pos long, section string, score double").repartition(5)

    def keep(some):
        n, ordered = int(percent / 100.0 * len(some)), sorted(some, key=lambda r: (r[2], r[0]))
        return {r[0] for r in (ordered[n:] if field == "log_odds" else ordered[: len(some) - n])}

    assert {r["pos"] for r in filters.drop_bottom(df, percent, field).collect()} == keep(rows)
    want = set().union(*[keep([r for r in rows if r[1] == s]) for s in {r[1] for r in rows}])
    assert {r["pos"] for r in filters.drop_bottom_per_group(df, percent, field, "section").collect()} == want


@pytest.mark.parametrize("mixed", [True, False])
def test_early_stop_counts_as_of_the_stop(spark, mixed):
    rnd = random.Random(3)
    cases = {1: [1] * 8, 2: [0] * 8, 3: [1, 0] * 4, 4: [1] * 4 + [0] * 4, 5: [0] * 4 + [1] * 2, 6: [1], 7: [rnd.random() < 0.8 for _ in range(11)]}
    want = {}
    for row, oks in cases.items():
        y = n = 0
        for at in range(0, len(oks), 4):
            part = oks[at : at + 4]
            y, n = y + sum(part), n + len(part)
            if (y and n > y) if mixed else sum(part) < len(part):
                break
        want[row] = (y, n)
    df = spark.createDataFrame([(r, i, bool(o)) for r, oks in cases.items() for i, o in enumerate(oks)], "row int, i int, ok boolean").repartition(3)
    assert {r["row"]: (r["n_yes"], r["n_judged"]) for r in filters.early_stop(df, "row", "i", "ok", 4, mixed).collect()} == want


def test_outcomes_with_generation_errors(spark):
    df = spark.createDataFrame([(4, 4), (0, 4), (2, 4), (-1, 4), (0, 0)], "y int, n int")
    assert [r[0] for r in df.select(filters.outcome_reason(F.col("y"), F.col("n"))).collect()] == ["easy", "hard", "", "", ""]


def test_keep_first_last_and_pending(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "pos long, k string").repartition(3)
    assert sorted(r["pos"] for r in dedup.keep_first(df, ["k"]).collect()) == [1, 2, 4]
    assert sorted(r["pos"] for r in dedup.keep_last(df, ["k"]).collect()) == [2, 3, 5]
    done = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert sorted(r["pos"] for r in dedup.pending(df, done, "k").collect()) == [2, 4, 5]
    assert dedup.group_cap(df, ["k"], "pos", 0).count() == 5 and dedup.group_cap(df, ["k"], "pos", 1).count() == 3


def test_splits_are_disjoint_and_keep_groups_whole(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["hot"] * 5 + list("abcdefgh"))) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(6)
    s = splits.stratified_split(df, "g", "k", 10, 1).collect()
    assert len(s) == 400 and all(sum(r["split"] == "val" for r in s if r["g"] == g) == min(10, sum(x == g for _, x in rows)) for g in {x for _, x in rows})
    for ratio in (0.0, 0.001, 0.2, 1.0):
        s = splits.group_split(df, F.col("g"), "k", ratio, 3).collect()
        side = {}
        for r in s:
            side.setdefault(r["g"], set()).add(r["split"])
        assert all(len(x) == 1 for x in side.values()) and len(s) == 400
        n = sum(r["split"] == "val" for r in s)
        assert n >= int(400 * ratio) and (n > 0) == (ratio > 0)
    assert splits.group_split(df.limit(0), F.col("g"), "k", 0.5, 3).count() == 0


def test_the_same_split_whatever_the_partitioning(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("g"))
    one = {tuple(r) for r in splits.stratified_split(df.repartition(1), "g", "k", 5, 9).collect()}
    assert one == {tuple(r) for r in splits.stratified_split(df.repartition(16), "g", "k", 5, 9).collect()}


def test_round_robin_and_shards(spark):
    rows = [(k, "abc"[k % 3] if k < 9 else "a") for k in range(12)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(4)
    out = [r["g"] for r in splits.round_robin(df, "g", "k", 1).orderBy("place").collect()]
    assert out[:9] == list("abcabcabc") and sorted(out) == sorted(g for _, g in rows)
    parts = [{r["k"] for r in splits.shard_range(df, [F.col("k")], i, 5).collect()} for i in range(5)]
    assert sorted(sum(map(list, parts), [])) == list(range(12)) and [len(p) for p in parts] == [2, 2, 3, 2, 3]


def test_interleave_oversamples_short_groups(spark):
    df = spark.createDataFrame([(k, "a") for k in range(20)] + [(k, "b") for k in range(100, 103)], "k long, g string")
    out = splits.interleave(df, "g", "k", 5).collect()
    assert {r["k"] for r in out if r["g"] == "a"} == set(range(20)) and {r["k"] for r in out if r["g"] == "b"} == {100, 101, 102}
    assert sorted(r["place"] for r in out) == list(range(len(out)))
    assert splits.interleave(df, "g", "k", 5, exhaust_all=False).where("g = 'b'").count() <= 3
    assert splits.interleave(df.limit(0), "g", "k", 5).count() == 0


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, " ", 4), (5, None, 5)], "pos long, id string, x int")
    right = spark.createDataFrame([(1, "a", 7), (2, "a", 8), (3, "c", 9), (4, " ", 10)], "pos long, id string, x int")
    assert [tuple(r) for r in joins.match_last(left, right, "id").collect()] == [("a", 2, 8)]
    t = spark.createDataFrame([(1, "a", "old"), (2, "a", "new"), (3, "b", None)], "pos long, id string, e string")
    got = {r["x"]: (r["e"], r["matched"]) for r in joins.lookup_last(left.drop("pos"), t, ["id"], "e").collect()}
    assert got == {1: ("new", True), 2: ("new", True), 3: ("", True), 4: ("", False), 5: ("", False)}
    new = spark.createDataFrame([("a", 100), ("b", None)], "id string, x int")
    assert sorted(str(r["x"]) for r in joins.update_rows(left.drop("pos"), new, "id", ["x"]).collect()) == ["100", "100", "3", "4", "5"]
    items = spark.createDataFrame([(k, "g") for k in range(5)], "k long, g string").withColumn("o", F.col("k"))
    pool = joins.example_pool(items, items.where("k < 4"), "g", "k", ["o"], 2).collect()
    assert sorted((r["k"], r["example"]) for r in pool) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]


def test_metrics_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    assert {r["k"]: r["n"] for r in metrics.count_filled(df, "k", ["a", "b"]).collect()} == {"a": 1, "b": 0}
    from quillmill.functions.scores import mean_stderr

    m, e = mean_stderr(F.col("x"))
    assert tuple(df.agg(m, e).first()) == (1.0, 0.0)
    w = spark.createDataFrame([("invalid",)], "w string").agg(*metrics.win_rates(F.col("w"))).first()
    assert (w["n"], w["left_rate_all"], w["left_rate_decided"]) == (1, 0.0, 0.0)


def test_label_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 2), ([1, 2], 2), ([1, 2, 3, 4], 0), ([], 0)], "ids array<int>, p int")
    got = [r[0] for r in df.select(reshape.label_mask(F.col("ids"), F.col("p"), 3)).collect()]
    assert got == [[-100, -100, 3], None, [1, 2, 3], None]


def test_refine_freezes_what_passed(spark):
    df = spark.createDataFrame([(k, k) for k in range(6)], "k long, left long")
    seen = []

    def step(todo, k):
        seen.append(todo.count())
        return todo.withColumn("left", F.col("left") - 1)

    out = {r["k"]: r["round"] for r in rounds.refine(df, step, F.col("left") <= 0, 3).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: None, 5: None} and seen == [5, 4, 3]


def test_provider_calls(spark):
    df = spark.createDataFrame([(k, f"prompt {k % 4}") for k in range(12)], "k long, prompt string")
    out = provider.generate(df, lambda: provider.FakeProvider(30), "prompt", "text")
    assert out.count() == 12 and out.select("prompt", "text").distinct().count() == 4
    again = rounds.second_pass(out, F.col("text") == "", lambda need: need.withColumn("text", F.lit("second")), "k", ["text"], F.lit("blank"))
    assert again.where("text = ''").count() == 0 and again.where("reason = 'blank'").count() == out.where("text = ''").count()
    scored = provider.score(out, provider.FakeProvider, "prompt", "text", "lp")
    assert scored.count() == 12 and scored.where("lp is null or lp > 0").count() == 0

    def broken():
        raise OSError

    assert provider.with_retry(broken, 2) is None


def test_collisions_are_retried_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "k long, t string")
    out = rounds.retry_collisions(df, lambda d: d.withColumn("t", F.lit("z")), F.col("t"), "k")
    assert sorted((r["k"], r["t"]) for r in out.collect()) == [(1, "x"), (2, "z"), (3, "y"), (4, "z")]
