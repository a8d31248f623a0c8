import random
from collections import Counter

import pytest

from quillmill.llm.leakage import NEAR_ANCHORS, anchor_positions, leaked_phrases, near_passages
from quillmill.llm.prompts import words


def brute(docs, items, run=12):
    out = set()
    for d, text in docs:
        w = words(text)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, passage in items:
            p = words(passage)
            if any(tuple(p[i : i + run]) in grams for i in range(len(p) - run + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("block", [100_000, 200])
def test_every_leak_is_found(spark, block):
    rnd = random.Random(10)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 20
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(8, 40)))) for k in range(25)] + [(25, "a b " * 10)]
    docs = []
    for k in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if rnd.random() < 0.6:
            p = words(rnd.choice(items)[1])
            n = rnd.randrange(8, 16)
            at = rnd.randrange(max(1, len(p) - n))
            w[rnd.randrange(len(w) + 1) : 0] = p[at : at + n]
        docs.append((k, ",\n".join(w).upper() if rnd.random() < 0.3 else " ".join(w)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, passage string")
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in leaked_phrases(d, i, block).collect()} == want and len(want) > 10


def test_every_run_has_its_anchors():
    p = [str(i % 9) for i in range(50)]
    at = anchor_positions(p, {"3": 1, "4": 2})
    assert all(sum(s <= i < s + 12 for i in at) >= 2 for s in range(len(p) - 11))


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (4, "x " * 50000 + passage), (5, "one two three four five six seven eight nine ten eleven zero twelve thirteen")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, passage), (9, None), (None, passage), (10, "too short")], "item_id long, passage string")
    assert sorted((r["doc_id"], r["item_id"], r["longest_run"]) for r in leaked_phrases(docs, items).collect()) == [(1, 7, 13), (1, 8, 13), (4, 7, 13), (4, 8, 13)]
    assert leaked_phrases(docs.limit(0), items).count() == 0 == leaked_phrases(docs, items.limit(0)).count()
    assert {r["doc_id"] for r in near_passages(docs, items).collect()} == {1, 4, 5}


def brute_near(docs, items, share=0.5, slack=16):
    """Every document against every item, over all anchors."""
    df = Counter(w for _, t in docs for w in set(words(t)))
    out = set()
    for k, passage in items:
        p = words(passage)
        at = anchor_positions(p, df, anchors=NEAR_ANCHORS) if len(p) >= 12 else []
        for d, text in docs:
            offsets = [(j - i, i) for i in at for j, w in enumerate(words(text)) if w == p[i]]
            low = min((o for o, _ in offsets), default=0) // slack
            high = max((o for o, _ in offsets), default=-1) // slack
            met = max((len({i for o, i in offsets if c * slack <= o < (c + 2) * slack}) for c in range(low - 1, high + 1)), default=0)
            if met >= 3 and met >= share * len(at):
                out.add((d, k, met, len(at)))
    return out


@pytest.mark.parametrize("block", [100_000, 300])
def test_proximity_equals_brute_force_and_finds_edited_passages(spark, block):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(80)] + ["the", "a", "of"] * 15
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(8, 70)))) for k in range(30)]
    docs, edited = [], set()
    for k in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if k % 2:
            item, passage = rnd.choice(items)
            p = words(passage)
            for _ in range(len(p) // 9):  # words taken out and put in
                del p[rnd.randrange(len(p))]
                p.insert(rnd.randrange(len(p)), "zz")
            w[rnd.randrange(len(w) + 1) : 0] = p
            if len(words(passage)) >= 12:
                edited.add((k, item))
        docs.append((k, " ".join(w)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, passage string")
    got = {tuple(r) for r in near_passages(d, i, block_words=block).collect()}
    if block > 1000:
        assert got == brute_near(docs, items)
    assert len({x[:2] for x in got} & edited) >= 0.9 * len(edited) > 30
