"""Further columns with the operators' own names change nothing."""

from fractions import Fraction

from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm.cutoffs import exact_cutoffs
from quillmill.llm.leakage import leaked_phrases
from quillmill.llm.neardup import near_duplicate_groups
from quillmill.llm.overlap import cross_split_pairs
from quillmill.llm.packing import pack, token_counts
from quillmill.llm.pairs import Languages, broken_pairs
from quillmill.llm.residue import residue
from quillmill.llm.splits import assign_splits, related_groups
from quillmill.llm.truncation import truncated_records

NAMES = (
    "a b c d k n no of at key keys set size rep root node group_no text source score pct want lo hi above inside held q kept cutoff record domain passage dk pk hd hp "
    "split place start first last pool context piece tokens units block found offset item_id doc_id passage word positions pair prompt answer question scene tail defect "
    "train eval covered similarity encoding length limit_length kinds _end _limits _source _hit _k _id _p _before value"
).split()


def more(df):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n not in df.columns])


def same(f, *dfs):
    got, want = f(*map(more, dfs)), f(*dfs)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 0


def test_all_operators(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank every single morning"
    frame = spark.createDataFrame
    same(exact_cutoffs, frame([("s", 0.1), ("s", 0.4)], "source string, score double"), frame([("s", 50)], "source string, pct int"))
    same(connected_components, frame([(1, 2)], "a long, b long"))
    same(related_groups, frame([(1, "x", "p"), (2, "y", "p")], "record long, domain string, passage string"))
    same(lambda df: assign_splits(df, {"train": 1.0}), frame([(1, 2)], "root long, n long"))
    same(truncated_records, frame([("s", "open (and"), ("s", "Done.")], "source string, text string"))
    same(lambda p, q: broken_pairs(p, q, Languages([])), frame([(1, 1, None), (2, 1, text)], "pair int, prompt long, answer string"), frame([(1, text, text)], "prompt long, question string, scene string"))
    same(near_duplicate_groups, frame([(1, text), (2, text + " again"), (3, "x")], "no long, text string"))
    same(lambda df: cross_split_pairs(df, Fraction(1, 2)), frame([(1, "train", text), (2, "val", text)], "no long, split string, text string"))
    same(pack, frame([(1, 5000), (2, 3)], "doc_id long, tokens long"))
    same(token_counts, frame([(1, text)], "doc_id long, text string"))
    same(leaked_phrases, frame([(1, text)], "doc_id long, text string"), frame([(2, text)], "item_id long, passage string"))
    same(residue, frame([(1, "404 Not Found")], "doc_id long, text string"))
