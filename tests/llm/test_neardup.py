import os
import random
from fractions import Fraction

import numpy as np
import pytest

from quillmill.llm import neardup
from quillmill.llm.neardup import connecting_pairs, near_duplicate_groups, similar_pairs
from quillmill.llm.prompts import jaccard, shingles


def corpus(seed, n):
    """Texts made of a few common phrases and some words of their own, many of them edited copies."""
    rnd = random.Random(seed)
    phrases = [" ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(12)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randrange(0, 1 + len(w) // 6)):
                i = rnd.randrange(len(w) or 1)
                w[i : i + rnd.choice([0, 1, 1, 2])] = [f"x{rnd.randrange(500)}"] * rnd.choice([0, 1, 1, 2])
            if rnd.random() < 0.2:
                w += rnd.choice(texts).split()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rnd.choice(phrases) if rnd.random() < 0.5 else f"y{rnd.randrange(400)}" for _ in range(rnd.randrange(0, 30))))
    return texts


def components(pairs):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize(("seed", "t", "k", "dear"), [(1, Fraction(1, 2), 3, 300), (2, Fraction(4, 5), 5, 300), (3, Fraction(1, 2), 2, 4), (4, Fraction(1, 3), 3, 2), (5, Fraction(1, 5), 2, 300)])
def test_every_similar_pair_is_found(spark, monkeypatch, seed, t, k, dear):
    monkeypatch.setattr(neardup, "DEAR", dear)
    texts = corpus(seed, 160) + [" ".join(f"w{i}" for i in range(1200)), " ".join(f"w{i}" for i in range(600)), "one", ""]
    sets = list({frozenset(shingles(x, k)): (no, x) for no, x in enumerate(texts)}.values())
    want = {(a, b) for a, x in sets for b, y in sets if a < b and jaccard(shingles(x, k), shingles(y, k)) >= t}
    df = spark.createDataFrame(sets, "no long, text string").repartition(3)
    got = [tuple(r) for r in similar_pairs(df, t, k, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    some = [tuple(r) for r in connecting_pairs(df, t, k, 40).collect()]
    assert set(some) <= want and components(some) == components(want)


def test_groups_with_copies_nulls_and_repeats(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank every single morning"
    rows = [(9, base), (4, base.upper()), (7, base + " again"), (7, base + " again"), (5, None), (None, base), (6, ""), (8, "ab cd"), (3, "ab cd"), (1, "something else entirely is written here by hand"), (2, "zz " * 20000)]
    got = sorted(tuple(r) for r in near_duplicate_groups(spark.createDataFrame(rows, "no long, text string")).collect())
    assert got == [(4, 4), (7, 4), (9, 4)]
    assert near_duplicate_groups(spark.createDataFrame([], "no long, text string")).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(k, "one text that a third of all rows repeat word for word") for k in range(300)] + [(1000 + k, f"text {k} of its own with number {k * 7} and {k * 11}") for k in range(600)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "no long, text string"))
    assert got.where("group_no = 0").count() == 300


def test_many_different_near_copies_take_a_star_of_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:25] + [f"own{k}"] + base[25:])) for k in range(400)] + [(1000 + k, " ".join(f"v{k * 97 % 311}x{i}" for i in range(20))) for k in range(600)]
    df = spark.createDataFrame(rows, "no long, text string")
    pairs = connecting_pairs(df, block_sets=300)
    assert pairs.count() < 1000  # of 79,800 similar pairs
    assert near_duplicate_groups(df).where("group_no = 0").count() == 400


def test_chance_meetings_are_not_written_where_every_key_is_dear(spark, monkeypatch):
    """As in large tables, whose sketch is full: sets ask with no spare units."""
    rnd = random.Random(7)
    sentences = ["there was a {} {} on the floor", "only the {} noticed that the {} was still wet", "it did not help that the {} looked worse than the {}", "nobody has asked for the {} {} before"]
    fill = [f"f{i}" for i in range(60)]
    texts = [" ".join(rnd.choice(sentences).format(*rnd.sample(fill, 2)) for _ in range(8)) for _ in range(300)]
    texts += [x.replace(" the ", " this ", 1) for x in texts[:20]]
    sets = list({frozenset(shingles(x)): (no, x) for no, x in enumerate(texts)}.values())
    want = {(a, b) for a, x in sets for b, y in sets if a < b and jaccard(shingles(x), shingles(y)) >= Fraction(1, 2)}
    monkeypatch.setattr(neardup, "count_sketch", lambda sets, slots, keys_of, k: np.full(slots, 65535, np.uint16))
    counts, write = {}, neardup.materialize

    def counted(df, label):
        out = write(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(sets, "no long, text string"), block_sets=200).collect()}
    assert got == want and len(want) >= 20
    assert counts["candidates"] <= len(want) + 0.01 * len(sets) ** 2 / 2


def test_bitmaps_show_no_more_missing_tokens_than_there_are():
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    own = [rnd.choice(pool, rnd.integers(0, 200), replace=False) for _ in range(40)]
    row, h = np.repeat(np.arange(40), [len(x) for x in own]), np.concatenate(own)
    for bits in (64, 512):
        seen = neardup.bitmaps(row, h, 40, bits)
        assert seen.shape == (40, bits // 64)
        for i in range(40):
            for j in range(40):
                shown = int(np.bitwise_count(seen[i] & ~seen[j]).sum())
                assert shown <= len(set(own[i].tolist()) - set(own[j].tolist()))


def test_what_is_not_read_again_leaves_the_disk(spark):
    from quillmill.session import shared_dir

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {x.rsplit("-", 1)[0] + x[-32:] for x in os.listdir(shared_dir(spark).removeprefix("file://"))}
    before, setting = held(), spark.conf.get(name)
    assert near_duplicate_groups(spark.createDataFrame(list(enumerate(corpus(3, 80))), "no long, text string")).count() > 0
    new = {x[:-32] for x in held() - before}
    assert "texts" in new and not new & {"sets", "asks", "linked"}
    assert spark.conf.get(name) == setting
