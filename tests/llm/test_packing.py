import random
from collections import Counter

import pytest

from quillmill.llm.packing import Sizes, best_two_fit, pack, token_counts


def test_best_two_is_the_tightest_pair():
    rnd = random.Random(7)
    for _ in range(300):
        xs = [rnd.randrange(1, 30) for _ in range(rnd.randrange(0, 9))]
        room, above = rnd.randrange(1, 50), rnd.randrange(0, 20)
        sums = [xs[i] + xs[j] for i in range(len(xs)) for j in range(i) if above < xs[i] + xs[j] <= room]
        got = Sizes(iter(xs)).best_two(room, above)
        assert (sum(got) if got else None) == (max(sums) if sums else None)


def test_every_item_once_and_no_worse_than_first_fit():
    rnd = random.Random(8)
    for _ in range(50):
        xs = [min(100, int(rnd.expovariate(1 / 25)) + 1) for _ in range(400)]
        bins = best_two_fit(xs, 100)
        assert Counter(x for b in bins for x in b) == Counter(xs) and all(sum(b) <= 100 for b in bins)
        open_ = []
        for x in sorted(xs, reverse=True):
            k = next((k for k, r in enumerate(open_) if r >= x), None)
            if k is None:
                open_.append(100 - x)
            else:
                open_[k] -= x
        assert len(bins) <= len(open_) + 1


def test_pack_keeps_everything_and_splits_only_above_capacity(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice([1, 7, 50, 99, 100, 101, 250, 1000])) for k in range(500)] + [(7, 5), (7, 100), (7, 100), (8, 300), (8, 300), (None, 3), (900, 0), (901, None), (902, 10**6)]
    got = pack(spark.createDataFrame(rows, "doc_id long, tokens long"), 100, 60).collect()
    assert sum(r["tokens"] for r in got) == sum(n for k, n in rows if k is not None and n)
    load = Counter()
    for r in got:
        load[r["pool"], r["context"]] += r["tokens"]
        assert r["first_token"] == 100 * r["piece"]
    assert max(load.values()) <= 100
    pieces = Counter(r["doc_id"] for r in got)
    assert all(pieces[k] == sum(-(-n // 100) for j, n in rows if j == k and n) for k in pieces)
    assert len({(r["pool"], r["context"], r["place"]) for r in got}) == len(got)
    assert sum(load.values()) / (100 * len(load)) > 0.97
    assert pack(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, "doc_id long, tokens long"), 0)


def test_tokens_of_whole_texts(spark):
    got = {r["doc_id"]: r["tokens"] for r in token_counts(spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a b " * 50000)], "doc_id long, text string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 100000
