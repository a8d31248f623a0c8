import random
from fractions import Fraction

import pytest

from quillmill.llm.overlap import cross_pairs, cross_split_pairs, merged
from quillmill.llm.prompts import jaccard, shingles
from tests.llm.test_neardup import corpus


def test_merged_intervals():
    assert merged([]) == 0 and merged([4]) == 3 and merged([0, 1, 2]) == 5 and merged([7, 0, 2]) == 8


@pytest.mark.parametrize(("seed", "t", "shard_words"), [(11, Fraction(1, 2), 10**6), (12, Fraction(1, 2), 200), (13, Fraction(3, 4), 10**6), (14, Fraction(1, 5), 500)])
def test_every_cross_pair_is_found(spark, seed, t, shard_words):
    texts = [x for x in corpus(seed, 220) if len(x.split()) > 2] + ["a b c", "a b c d", "a b c"]
    rnd = random.Random(seed)
    side = [rnd.random() < 0.3 for _ in texts]
    left = [(no, x) for no, x in enumerate(texts) if not side[no]]
    right = [(no, x) for no, x in enumerate(texts) if side[no]]
    want = {(a, b) for a, x in left for b, y in right if jaccard(shingles(x), shingles(y)) >= t}
    df = lambda rows: spark.createDataFrame([(no, x, len(shingles(x))) for no, x in rows], "no long, text string, size int").repartition(2)
    got = [(r["train"], r["eval"]) for r in cross_pairs(df(left), df(right), t, shard_words).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_splits_copies_nulls_and_repeats(spark):
    x = "the old bench was gone and nobody on the team had asked why it was taken away"
    rows = [(1, "train", x), (2, "train", x.upper()), (2, "train", x.upper()), (3, "val", x + " again"), (4, "test", x), (5, "test", None), (None, "val", x), (6, None, x), (7, "other", x), (8, "val", "a b"), (9, "train", "a b"), (10, "train", "w " * 30000)]
    df = spark.createDataFrame(rows, "no long, split string, text string")
    got = sorted((r["train_no"], r["eval_no"]) for r in cross_split_pairs(df).collect())
    assert got == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert cross_split_pairs(df.where("split = 'train'")).count() == 0 == cross_split_pairs(df.limit(0)).count()
