"""Prompts, parse ladders, composed runs and training rows against small cases."""

import pytest
from pyspark.sql import functions as F

from quillmill import provider, rounds
from quillmill.functions import answers, models, parsers, prompts, scores, text
from quillmill.operators import filters, reshape


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()]).select(c).first()[0]


def test_placeholders_are_filled_once(spark):
    c = prompts.fill("a {x} b {y} \\boxed{}", x=F.col("x"), y=F.lit(None))
    assert one(spark, c, x="{y}") == "a {y} b  \\boxed{}"
    assert one(spark, prompts.prefixed(F.lit("p"), F.col("x")), x=" head ") == "head\n\np" and one(spark, prompts.prefixed(F.lit("p"), F.col("x")), x=" ") == "p"


def test_messages_of_retries(spark):
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "s"), ("user", "u"), ("assistant", "old"))])
    again = one(spark, prompts.refine_prompt(m, F.lit(" "), F.lit(None).cast("string"), F.lit(""), F.lit("ref")), x=1)
    assert [x["role"] for x in again] == ["system", "user", "assistant", "user"] and again[2]["content"] == "(empty answer)"
    assert "constraints" in again[3]["content"] and "ref" in again[3]["content"]
    why = one(spark, prompts.rationalize_prompt(m, F.lit("a"), F.lit("bad"), F.lit("ref"), "Think. "), x=1)
    assert len(why) == 3 and "Verifier feedback:\nbad\n\n" in why[2]["content"] and "Think. Do not" in why[2]["content"]
    assert prompts.typed_system("a [THINK]b[/THINK] c ", "own") == [{"type": "text", "text": "a "}, {"type": "thinking", "thinking": "b", "closed": True}, {"type": "text", "text": " c\n\nown"}]
    with pytest.raises(ValueError):
        prompts.typed_system("no tags", None)
    parts = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("text"), F.lit(h).alias("thinking")) for t, x, h in (("text", " a ", ""), ("thinking", "", "b"), ("text", " ", ""))])
    assert one(spark, prompts.typed_content(parts), x=1) == "a\n\nb"


def test_nested_boxes_and_last_objects(spark):
    df = spark.createDataFrame([("no way: \\boxed{\\text{yes}}",), ("\\boxed{open \\boxed {No}",), (None,)], "t string")
    assert [r[0] for r in df.select(answers.yes_no(F.col("t"))).collect()] == ["yes", "no", None]
    assert parsers.object_spans('{"a": 1} see [3]')[-1] == '{"a": 1}' and parsers.object_spans('a "{" {"b": "}"} {c') == ['{"b": "}"}'] and parsers.object_spans("") == []
    assert [r[0] for r in df.select(parsers.last_json_span(F.col("t"))).collect()] == ["{\\text{yes}}", None, None]


def test_answers_by_ladder(spark):
    cases = ["\\boxed{2}", "Final Answer: 3)", "so\n4)\nthen", "it is option 1", "none 7 here"]
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    assert [r[0] for r in df.select(answers.final_int(F.col("t"))).collect()] == [2, 3, 4, 1, None]
    names = spark.createDataFrame([("quality",), ("<None>",), (" ",), ("odd one",), ("NONE",)], "t string")
    assert [r[0] for r in names.select(answers.normalize_maxim(F.col("t"))).collect()] == ["Quality", "None", "None", "odd one", "None"]
    assert one(spark, text.answer_or_raw(F.lit(" "), F.lit(" raw ")), x=1) == "raw"
    gold = answers.option_index(F.array(F.lit("a"), F.lit("b")), F.col("g"), text.normalize_text, strict=True)
    assert one(spark, gold, g="B ") == 2 and one(spark, gold, g="nan") is None
    with pytest.raises(Exception, match="no option"):
        one(spark, gold, g="c")


def test_question_records_by_ladder():
    item = {"content": "c", "question": "q?", "answer": "a"}
    assert parsers.qa_records("<think>x</think>```\nContent: c\nQuestion: q?\nAnswer: a\n```") == [item]
    line = '{"content": "c", "question": "q?", "answer": "a"}'
    assert parsers.qa_records(f"1. {line}\nnoise\n2. {line}") == [item, item]
    assert parsers.qa_records(f"text [{line}] more") == [item] and parsers.qa_records('("c", "q?", "a")') == [item]
    assert parsers.qa_records("Content: c\nAnswer: a") == [] and parsers.qa_records(None) == []


def test_domain_names_by_ladder():
    assert parsers.domains('["Fish Market", {"keyword": "fish market"}, {"seed": "Train"}]') == ["Fish Market", "Train"]
    assert parsers.domains('{"keywords": ["a", {"domain": "b"}]}') == ["a", "b"] and parsers.domains('{"seed": "x"}') == ["x"]
    assert parsers.domains('{"domain": "a"}\n{"domain": "b"}') == ["b", "a"] and parsers.domains("1. a b\n- 'c'\n{bad") == ["a b", "c"] and parsers.domains(None) == []


def test_judgements_keep_what_cannot_be_read(spark):
    cases = ['{"judgment": "Yes", "confidence": "8.4", "explanation": " e "}', '<think>{"judgment": "no"}</think>```json\n{"verdict": "yes", "confidence_score": 3}\n```', "so {'judgment': 'no', 'confidence': 12, 'ideal_answer': 'x'} done", "nothing", "[1]", '{"judgment": "maybe"}', None]
    read = spark.createDataFrame([(x,) for x in cases], "t string").select(answers.json_object(text.strip_think_last(F.coalesce("t", F.lit("")))).alias("v"))
    got = [tuple(r[0]) for r in read.select(answers.judgement_of(F.col("v"), 5)).collect()]
    unread = (None, None, False, "", "Judge output was not parseable JSON.")
    assert got[0] == ("yes", 8, True, "", "e") and got[1] == ("yes", 3, False, "", "Judge returned yes with confidence 3, below threshold 5.")
    assert got[2] == ("no", 10, False, "x", "") and got[3] == got[4] == got[6] == unread
    assert got[5] == (None, None, False, "", "Judge output lacked a valid yes/no judgment or confidence score.")


def test_reward_needs_an_answer_and_all_parts(spark):
    rows = [("<think>w</think> \\boxed{a}", "c", 0.9), ("<think>w</think> a", "c", 0.9), ("<think>w</think> \\boxed{a}", " ", 0.9), ("\\boxed{a}", "c", 0.9), ("\\boxed{a}", "c", None)]
    df = spark.createDataFrame(rows, "s string, c string, p double")
    s = F.col("s")
    r = scores.total_reward(answers.format_reward(s), answers.boxed_last(s), [F.col("c")], F.col("p"), F.lit(0.0), F.lit(0.5))
    assert [x[0]["score"] for x in df.select(r).collect()] == [2.0, 0.5, 1.0, 1.0, 0.0]


def test_examples_whose_prompt_takes_all_are_skipped(spark):
    df = spark.createDataFrame([(list(range(40)), 20), (list(range(40)), 15), ([1, 2], 2), ([1, 2], 0), ([], 0)], "ids array<int>, p int")
    assert [r[0] for r in df.select(reshape.label_mask(F.col("ids"), F.col("p"), 16)).collect()] == [None, [-100] * 15 + [15], None, [1, 2], None]
    rows = spark.createDataFrame([(0, [1], [1], "x"), (1, [1, 2, 3], [-100, 2, 3], "y"), (2, [5], [5], "z")], "pos long, input_ids array<int>, labels array<int>, tag string")
    got = {r["pos"]: (r["batch"], r["input_ids"], r["labels"], r["attention_mask"]) for r in reshape.collate(rows, "pos", 2, 9).collect()}
    assert got == {0: (0, [1, 9, 9], [1, -100, -100], [1, 0, 0]), 1: (0, [1, 2, 3], [-100, 2, 3], [1, 1, 1]), 2: (1, [5], [5], [1])}
    turns = lambda *roles: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(r).alias("content")) for r in roles])
    assert one(spark, reshape.trainable(turns("user", "assistant")), x=1) and not one(spark, reshape.trainable(turns("assistant")), x=1) and not one(spark, reshape.trainable(turns("user", "user")), x=1)
    assert one(spark, reshape.render_inst(turns("system", "user", "assistant", "assistant", "user")), x=1) == "<s>[INST] <<SYS>>\nsystem\n<</SYS>>\n\nuser [/INST] assistant </s><s>[INST] user [/INST]"
    assert one(spark, reshape.render_inst(turns("system")), x=1) == "<s>[INST] system [/INST]"


def test_ties_at_the_cut_of_a_score_for_which_less_is_better(spark):
    df = spark.createDataFrame([(k, "s", x) for k, x in enumerate([0.5, 0.5, 0.5, 0.1])], "pos long, section string, score double")
    assert sorted(r["pos"] for r in filters.drop_bottom_per_group(df, 25, "prob_drop", "section").collect()) == [0, 1, 3]
    assert [tuple(r) for r in filters.drop_thresholds(df, 25, "prob_drop", "section").collect()] == [("s", 0.5, 1)]
    assert filters.drop_thresholds(df, 10, "prob_drop", "section").count() == 0


def test_thinking_by_ids_or_by_text(spark):
    df = spark.createDataFrame([([1, 7, 2], "t</think> a"), ([1, 2], "t</think> a"), ([1, 2], " plain ")], "ids array<int>, t string")
    got = [tuple(r[0]) for r in df.select(models.content_of(F.col("ids"), 7, F.col("t"))).collect()]
    assert got == [([2], "t</think> a"), ([1, 2], "a"), ([1, 2], "plain")]


def test_rationalized_rows_are_renewed_and_not_judged_again(spark):
    df = spark.createDataFrame([(k, "old", k % 3 == 0) for k in range(9)], "k long, answer string, passed boolean")
    step = lambda rows, i: rows.withColumn("_fresh", F.when(F.col("k") % 2 == i % 2, F.concat(F.lit("new "), F.col("k").cast("string"))))
    got = {r["k"]: (r["answer"], r["rationalized"], r["rationalize_round"]) for r in rounds.rationalize(df, ~F.col("passed"), step, "answer", text.ustrip, 2).collect()}
    assert got == {k: ("old", False, None) if k % 3 == 0 else (f"new {k}", True, 1 if k % 2 else 2) for k in range(9)}
    none = rounds.rationalize(df, ~F.col("passed"), lambda rows, i: rows, "answer", text.ustrip, 1)
    assert none.where("rationalized").count() == 0 and none.count() == 9


def test_first_valid_item_within_its_attempts(spark):
    df = spark.range(6).withColumnRenamed("id", "k")
    good = F.concat(F.lit("Content: a scene long enough here "), F.col("k").cast("string"), F.lit("\nQuestion: why is that so\nAnswer: because"))
    step = lambda rows, i: rows.withColumn("_raw", F.when(F.col("k") % 3 < i, good).otherwise("noise"))
    valid = lambda x: filters.valid_candidate(x["content"], x["question"], x["answer"])
    got = rounds.first_valid(df, step, parsers.qa_candidates, valid, 3).collect()
    assert len(got) == 6 and all(r["item"]["question"] == "why is that so?" for r in got)
    assert rounds.first_valid(df, step, parsers.qa_candidates, valid, 2, strict=False).where("item is null").count() == 2
    with pytest.raises(ValueError):
        rounds.first_valid(df, step, parsers.qa_candidates, valid, 1)


def test_extraction_asks_the_judge_last(spark):
    df = spark.createDataFrame([(1, "\\boxed{2}", ""), (2, "none", "Answer: 3"), (3, "none", "none"), (4, "none", "none")], "k long, t string, a string")
    judge = lambda rows: rows.where("k = 3").select("k", F.lit(4).cast("long").alias("predicted"))
    got = {r["k"]: (r["predicted"], r["source"]) for r in rounds.extract_answers(df, "t", "a", answers.boxed_int, judge, "k").collect()}
    assert got == {1: (2, "full"), 2: (3, "answer"), 3: (4, "judge"), 4: (None, "failed")}


def test_open_answers_are_unwrapped_and_scored(spark):
    df = spark.createDataFrame([(1, '"candidate_sentence_1_intention": "It flouts the maxim of quality."', "Quality"), (2, "It does not flout any maxim", "Quality"), (3, None, "None")], "k int, t string, gold string")
    judge = lambda rows: rows.withColumn("_reply", F.when(F.col("k") == 1, '{"score": 9}').otherwise("no idea"))
    got = {r["k"]: (r["predicted_maxim"], r["maxim_correct"], r["judge_score"], r["judge_invalid"]) for r in rounds.scored_open(df, "t", "gold", judge).collect()}
    assert got == {1: ("Quality", True, 9, False), 2: ("None", False, None, True), 3: (None, False, None, True)}


class Broken(provider.FakeProvider):
    def score(self, prompts, answers):
        raise RuntimeError("down")


def test_judged_rows_without_answer_are_not_asked(spark):
    df = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "p", " "), (4, None, None)], "k int, p string, a string")
    got = {r["k"]: r for r in provider.judged(df, provider.FakeProvider, "p", "a", 0.1).collect()}
    assert got[1]["p_yes"] == got[2]["p_yes"] > 0 and got[1]["margin"] == got[1]["p_yes"] - got[1]["p_no"]
    assert all((got[k]["p_yes"], got[k]["format_ok"], got[k]["logged"], got[k]["confident_yes"]) == (0.0, False, False, False) for k in (3, 4))
    down = {r["k"]: (r["p_yes"], r["format_ok"], r["logged"]) for r in provider.judged(df, Broken, "p", "a", 0.1).collect()}
    assert down[1] == (0.0, True, True) and down[3] == (0.0, False, False)


class Slow(provider.FakeProvider):
    def generate(self, prompts):
        return ["" if p == "blank" else "<think>on and on" if p == "long" else "\\boxed{3}" for p in prompts]


def test_runs_over_a_benchmark(spark):
    df = spark.createDataFrame([("blank", 3), ("long", 3), ("plain", 2)], "p string, gold long")
    got = {r["p"]: (r["raw_output"], r["predicted_answer"], r["correct"], r["budget_forced"], r["force_reason"]) for r in provider.evaluate(df, Slow, "p", "gold", answers.boxed_int, " STOP</think> ").collect()}
    assert got == {"blank": ("\\boxed{3}", 3, True, True, "empty"), "long": ("<think>on and on STOP</think> \\boxed{3}", 3, True, True, "no_close"), "plain": ("\\boxed{3}", 3, False, False, None)}


class Counting(provider.FakeProvider):
    def generate(self, prompts):
        return [f"{p} of {len(prompts)}" for p in prompts]


def test_equal_keys_are_asked_once(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (1, None, "q"), (1, None, "q"), (2, "a", "r")], "id int, answer string, prompt string").coalesce(1)
    got = provider.generate_once(df.coalesce(1), Counting, ["id", "answer"], "prompt", "text").collect()
    assert sorted(r["text"].split(" ")[0] for r in got) == ["p", "p", "q", "q", "r"] and len({r["text"] for r in got}) == 3
