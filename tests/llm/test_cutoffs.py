import math
import random

from quillmill.llm.cutoffs import exact_cutoffs, usable_scores


def brute(rows, targets):
    out = {}
    for s, pct in targets.items():
        xs = sorted((x for t, x in rows if t == s and x is not None and not math.isnan(x)), reverse=True)
        if xs:
            want = max(0, min(len(xs), -(-len(xs) * pct // 100)))
            cut = xs[want - 1] if want else None
            out[s] = (cut, sum(x >= cut for x in xs) if want else 0)
    return out


def run(spark, rows, targets, **kw):
    scored = spark.createDataFrame(rows, "source string, score double")
    t = spark.createDataFrame(list(targets.items()), "source string, pct int")
    return {r["source"]: (r["cutoff"], r["kept"]) for r in exact_cutoffs(scored, t, **kw).collect()}


def test_same_as_sorting_with_ties_nulls_and_a_hot_source(spark):
    rnd = random.Random(1)
    rows = [("hot", round(rnd.random(), 2)) for _ in range(3000)]
    rows += [(s, rnd.random()) for s in "abcde" for _ in range(37)] + [("a", None), ("b", float("nan"))]
    rows += [("tied", 0.5)] * 50 + [("one", 0.1)]
    targets = {"hot": 33, "a": 0, "b": 1, "c": 50, "d": 99, "e": 100, "tied": 10, "one": 50, "absent": 50}
    assert run(spark, rows, targets) == brute(rows, targets)


def test_a_coarse_sketch_still_gives_the_exact_cutoff(spark):
    rnd = random.Random(2)
    rows = [("s", rnd.gauss(0, 1)) for _ in range(4000)]
    for pct in (3, 47, 90):
        assert run(spark, rows, {"s": pct}, accuracy=3) == brute(rows, {"s": pct})


def test_empty_tables(spark):
    assert run(spark, [], {"a": 5}) == {} == run(spark, [("a", 0.5)], {})


def test_latest_usable_audit_counts(spark):
    rows = [(1, 1, 0.2, True), (1, 2, 0.9, True), (1, 2, 0.9, True), (1, 3, 0.1, False), (2, 1, 1.5, True), (3, 1, None, True), (4, 1, float("nan"), True), (None, 1, 0.3, True), (5, 1, 0.0, None)]
    df = spark.createDataFrame(rows, "task_no long, attempt int, prob_yes double, score_valid boolean")
    assert [tuple(r) for r in usable_scores(df).collect()] == [(1, 0.9)]
