import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark import cloudpickle

from quillmill.llm import components
from quillmill.llm.components import connected_components
from quillmill.llm.splits import assign_splits, place_runs, related_groups


def brute(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("bound", [10**6, 5])
def test_components_equal_union_find(spark, bound):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(0, k) for k in range(100, 160)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + [(None, 3), (4, 4)], "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in connected_components(df, bound).collect()}
    assert got == brute(edges)
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [600, 20])
def test_components_have_one_root_where_nodes_exceed_the_bound_on_edges(spark, bound, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", bound)
    cloudpickle.register_pickle_by_value(components)  # so that the workers see the bound
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "50")
    try:
        parts = [spark.createDataFrame([(3 * k + 2, 3 * k + x) for k in range(300)], "a long, b long").coalesce(1) for x in (1, 0)]
        got = sorted((r["node"], r["root"]) for r in connected_components(parts[0].union(parts[1]), bound).collect())
    finally:
        spark.conf.set(batch, before)
        cloudpickle.unregister_pickle_by_value(components)
    assert got == [(n, n - n % 3) for n in range(900)]


def test_related_through_others_and_keyless(spark):
    rows = [(1, "x", "p"), (2, "y", "p"), (3, "y", "q"), (4, None, "q"), (5, None, None), (6, None, None), (7, "z", None), (3, "y", "q"), (8, None, "r"), (9, None, "r"), (None, "x", "p")]
    df = spark.createDataFrame(rows, "record long, domain string, passage string")
    root = {r["record"]: r["root"] for r in related_groups(df).collect()}
    groups = {}
    for k, v in root.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [5], [6], [7], [8, 9]]


def test_greedy_is_largest_first_to_the_furthest_below():
    rnd = random.Random(4)
    sizes = sorted((rnd.choice([1, 1, 2, 3, 9, 40]) for _ in range(300)), reverse=True)
    shares = {"train": 84.0, "val": 8.0, "test": 8.0}
    hist = [(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)]
    got = {s: 0 for s in shares}
    for n, first, last, split in place_runs(hist, shares):
        got[split] += n * (last - first)
    assert sum(got.values()) == sum(sizes)
    assert all(abs(got[s] - sum(sizes) * shares[s] / 100) <= 2 for s in shares)


def one_by_one(hist, shares):
    total = sum(n * c for n, c in hist)
    short = {s: Fraction(total) * Fraction(w) / sum(map(Fraction, shares.values())) for s, w in shares.items()}
    got = Counter()
    for n, c in hist:
        for _ in range(c):
            best = max(shares, key=lambda s: short[s])
            short[best] -= n
            got[n, best] += 1
    return got


def test_runs_give_each_split_what_the_greedy_gives():
    rnd = random.Random(11)
    for _ in range(300):
        hist = sorted({rnd.randrange(1, 60): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 8))}.items(), reverse=True)
        shares = {s: rnd.choice([0, 1, 5, 8.5, 80]) for s in ("train", "val", "test", "rest")[: rnd.randrange(1, 5)]}
        if not sum(shares.values()):
            continue
        runs = place_runs(hist, shares)
        got = Counter()
        for n, first, last, split in runs:
            got[n, split] += last - first
        assert got == one_by_one(hist, shares)
        assert len(runs) <= len(hist) * len(shares) and [r[1] for r in runs[1:]] == [r[2] for r in runs[:-1]]


def test_a_million_equal_groups_take_three_runs():
    runs = place_runs([(1, 1_000_000)], {"train": 80, "val": 10, "test": 10})
    assert [(last - first, s) for _, first, last, s in runs] == [(800_000, "train"), (100_000, "val"), (100_000, "test")]


def test_every_group_is_placed_once(spark):
    df = spark.createDataFrame([(k, 1 + k % 5) for k in range(200)], "root long, n long")
    out = assign_splits(df, {"train": 3, "val": 1})
    rows = out.collect()
    assert sorted(r["root"] for r in rows) == list(range(200))
    assert abs(sum(r["n"] for r in rows if r["split"] == "val") - 150) <= 1
    assert assign_splits(df.limit(0), {"train": 1}).count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, {})
