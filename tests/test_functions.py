import math

import pytest
from pyspark.sql import functions as F

from quillmill.functions import answers, parsers, scores, text


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


BOX = {
    "\\boxed{a{b}c}": ("a{b}c", "a{b}c"),
    "\\boxed{1} and \\boxed{2}": ("2", "1"),
    "\\boxed{open": (None, ""),
    "\\boxed{ }": (None, ""),
    "<think>\\boxed{in}</think> \\boxed{out}": ("out", "in"),
    "\\boxed {x}": (None, "x"),
    "\\boxed{open \\boxed{2}": ("2", "2"),
    "none": (None, ""),
    "": (None, ""),
}


def test_boxes(spark):
    assert apply(spark, list(BOX), answers.boxed_last) == [a for a, _ in BOX.values()]
    assert apply(spark, list(BOX), answers.boxed_first) == [b for _, b in BOX.values()]
    assert apply(spark, ["\\boxed{a} b {c} d"], answers.boxed_greedy) == ["a} b {c"]
    assert apply(spark, ["\\boxed{ 12) twelve }", "answer: 7", "Final Answer: 3)", "9"], answers.boxed_int) == [12, 7, 3, None]


THINK = {
    "<think>a</think> b": ("b", "b", "b", "a"),
    "[THINK]a[/think] b": ("b", "[THINK]a[/think] b", "b", "a"),
    "<|channel>thought a<channel|>b": ("b", "<|channel>thought a<channel|>b", "b", " a"),
    "x</think>y</THINK> z": ("z", "y</THINK> z", "x</think>y</THINK> z", "x"),
    "<think>never closed": ("<think>never closed", "<think>never closed", "<think>never closed", "never closed"),
    " plain ": ("plain", " plain ", "plain", ""),
    "": ("", "", "", ""),
}


def test_thinking_tags(spark):
    for i, f in enumerate((text.strip_think_last, text.strip_think_exact, text.strip_think_prefix, text.think_text)):
        assert apply(spark, list(THINK), f) == [v[i] for v in THINK.values()]


def test_unicode_white_space(spark):
    odd = [" a b ", "\x1f a\x1c", "\ta  b\n", "İ", None]
    assert apply(spark, odd, text.ustrip) == [x.strip() if x is not None else None for x in odd]
    assert apply(spark, odd, text.normalize_text) == [" ".join(x.strip().lower().split()) if x is not None else None for x in odd]
    assert apply(spark, ["- 3. \"Fish  Market\"", "* x", "'y'", None, "12) z"], text.clean_domain) == ["Fish Market", "x", "y", "", "z"]


def test_open_answers(spark):
    cases = ["<think>a</think> \\boxed{b}", "<think>open", "```json\nx\n```", "  ", "p</think>q</think>r"]
    assert apply(spark, cases, answers.open_answer) == ["b", None, "x", None, "q</think>r"]


@pytest.mark.parametrize(("values", "f", "want"), [
    (["1", "YES ", "off", None, "maybe"], text.coerce_bool, [True, True, False, False, False]),
    (["It is INCORRECT", "correct!", "true", "FALSE", "correctly", None], answers.verdict, [False, True, True, False, None, None]),
    (["Yes, sure", " no", "maybe", None], answers.label_normalize, ["yes", "no", None, None]),
    (["\\boxed{No} yes", "well, yes", "yesterday", None], answers.yes_no, ["no", "yes", None, None]),
    (["flouts the maxim of MANNER", "It does not flout any maxim", "x", None], answers.maxim_extract, ["Manner", "None", None, None]),
    (["a/b c", "..", "", None], text.safe_name, ["a_b_c", "model", "model", "model"]),
    (["2.5", "3.5", "99", "-4", "x", None, "NaN"], scores.clamp_confidence, [2, 4, 10, 1, None, None, None]),
    (["a b  c", " ", None], text.token_count_ws, [3, 0, 0]),
])
def test_small_functions(spark, values, f, want):
    assert apply(spark, values, f) == want


def test_sigmoid_is_clamped(spark):
    got = apply(spark, [0.0, 1e9, -1e9, 1.0], scores.sigmoid, "double")
    assert got[0] == 0.5 and got[1] < 1.0 + 1e-12 and got[2] > 0 and math.isclose(got[3], 1 / (1 + math.exp(-1)))


def test_format_reward(spark):
    cases = ["x", "<think>a</think>\\boxed{b}", "<think></think>\\boxed{b}", "<think>a</think>no box", "<think>a</think></think>\\boxed{b}", "</think>a<think>\\boxed{b}"]
    assert apply(spark, cases, answers.format_reward) == [0.0, 1.0, 0.5, 0.5, 0.5, 0.5]


def test_stable_numbers_equal_hashlib(spark):
    import hashlib

    want = [int(hashlib.sha256(f"7\x1f{x}".encode()).hexdigest()[:8], 16) for x in ("a", "b")]
    assert apply(spark, ["a", "b"], lambda c: text.stable_u32(7, c)) == want


def test_parsers():
    assert parsers.json_loose('noise {"a": 1} more {"b": "}"} end') == {"b": "}"}
    assert parsers.json_loose("```json\n{'a': 1}\n```") == {"a": 1}
    assert parsers.json_loose("nothing") is None and parsers.json_loose(None) is None
    assert parsers.tuples('1. ("c", "q", "a")\n2. ("d", "e", "f")') == [("c", "q", "a"), ("d", "e", "f")]
    assert parsers.tuples("[('c', 'q', 'a')]") == [("c", "q", "a")] and parsers.tuples("garbage (") == []
    assert parsers.domains('["Fish market", "fish  MARKET", "Tram"]') == ["Fish market", "Tram"]
    assert parsers.domains('{"domains": ["a", "b"]}') == ["a", "b"] and parsers.domains('{"a": 1, "b": 2}') == []
    assert parsers.domains('{"domain": "x"}\n{"domain": "y"}') == ["y", "x"]
    assert parsers.domains("- a\n2. \"b\"\n\na") == ["a", "b"] and parsers.domains(None) == []


def test_labelled_text(spark):
    got = apply(spark, ["Content: c\nQuestion: q?\nAnswer: a\nmore", "Question: q\nAnswer: a"], answers.labelled_qa)
    assert got[0].asDict() == {"content": "c", "question": "q?", "answer": "a\nmore"} and got[1] is None
