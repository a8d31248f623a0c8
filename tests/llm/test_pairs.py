import random

import pytest

from quillmill.llm.pairs import Languages, broken_pairs, end_statistics, fit_languages, is_copy, is_empty, is_refusal, lcs, unboxed

SAMPLE = [
    ("en", "the cat was on the table and nobody wanted to move it because it was asleep and they had no time for this"),
    ("de", "die katze war auf dem tisch und niemand wollte sie wecken weil sie schlief und alle keine zeit hatten dafür"),
]


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_equals_the_table():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(12))] for _ in "ab")
        assert lcs(a, b) == slow_lcs(a, b)


@pytest.mark.parametrize("text", [None, "", "  ", "-", "None", '""', "\\boxed{}", "​", "...", "n/a", "<answer></answer>", "[]", "{}", "null", "Answer:"])
def test_empty_answers(text):
    assert is_empty(unboxed(text)[0])


def test_refusals_decline_and_say_nothing_else():
    assert is_refusal("Sorry. I can't answer that. Thank you for understanding.")
    assert is_refusal("Dazu kann ich leider keine Auskunft geben.")
    assert not is_refusal("Anna cannot help with the picnic and says so politely.")
    assert not is_refusal("I am sorry is what Anna says, but it is meant as a complaint about the rope.")
    assert not is_refusal('Anna says "I can\'t answer that" because the rope was broken and she wants Ben to buy another one.')


def test_copies_repeat_the_question_only():
    q, scene = "Why does Anna mention the old rope to Ben?", "Anna met Ben near the shed. The rope was broken."
    assert is_copy(q, q, scene) and is_copy("You are asking: " + q, q, scene) and is_copy(q.lower() + " " + q, q, scene)
    assert is_copy("The rope was broken. " + q, q, scene)
    assert not is_copy("Anna mentions the old rope to Ben because she needs a new one.", q, scene)
    assert not is_copy(q + " Because she wants Ben to buy a new one before the next trip.", q, scene)
    assert not is_copy("", "", "")


def test_languages_need_two():
    assert not Languages([]).differ("the cat", "die katze war auf dem tisch")
    m = Languages.of_texts(SAMPLE)
    assert m.differ("the cat was asleep", "niemand wollte die katze wecken weil sie schlief")
    assert not m.differ("the cat was asleep", "nobody wanted to move the cat")


def test_pairs(spark):
    whole = [f"Anna {v} the {a} {n}." for v in ("wants", "likes", "takes") for a in ("old", "new", "red") for n in ("rope", "bench", "cup")] * 4
    rows = [(k, 1, t) for k, t in enumerate(whole)]
    rows += [(500, 1, "Anna wants the"), (501, 1, "Anna wants the old rope"), (502, 1, "Anna wants the old benchm"), (503, 1, None), (504, 2, "Anna takes the"), (505, None, "\\boxed{Anna likes"), (506, 1, "Ben"), (507, 1, "niemand wollte die katze wecken weil sie schlief und alle keine zeit hatten."), (500, 1, "Anna wants the"), (508, 1, "Anna likes the red cup. " * 3000)]
    pairs = spark.createDataFrame(rows, "pair int, prompt long, answer string")
    prompts = spark.createDataFrame([(1, "What does the cat do to Ben", "the cat was on the table and Ben was asleep")], "prompt long, question string, scene string")
    got = sorted((r["pair"], r["defect"]) for r in broken_pairs(pairs, prompts, Languages.of_texts(SAMPLE)).distinct().collect())
    assert got == [(500, "truncated"), (502, "truncated"), (503, "empty"), (504, "truncated"), (505, "truncated"), (507, "language")]
    assert broken_pairs(pairs.limit(0), prompts, SAMPLE).count() == 0
    assert broken_pairs(pairs.where("pair = 503"), prompts.limit(0), Languages([])).count() == 1


def test_word_fragments_stay_cut_however_many_answers_end_on_them(spark):
    whole = [f"{who} asks about the {what} and changes the subject at once." for who in ("Anna", "Ben", "Eva", "Tom") for what in ("rope", "bench", "cup", "door", "lamp")]
    cut = [f"{who} changes the sub" for who in ("Anna", "Ben", "Eva", "Tom", "Ida")]
    marked = ["Anna changes the sub...", "Ben changes the sub [truncated]"]
    phrases = [f"next week at the {what} hall" for what in ("ticket", "small", "old", "town", "ticket")]
    for times in (1, 10):  # the same share of cuts in ten times the rows
        texts = (whole + cut + marked + phrases) * times
        rows = [(k, 1, t) for k, t in enumerate(texts)] + [(0, 1, texts[0])]
        pairs = spark.createDataFrame(rows, "pair int, prompt long, answer string")
        prompts = spark.createDataFrame([(1, "Why does she ask that", "They met near the shed")], "prompt long, question string, scene string")
        got = {r["pair"] for r in broken_pairs(pairs, prompts, Languages([])).where("defect = 'truncated'").collect()}
        assert got == {k for k, t in enumerate(texts) if t in cut + marked}


def test_end_statistics_count_no_cut_as_use_and_redelivered_rows_once(spark):
    answers = spark.createDataFrame([("the sub",), ("the sub...",), ("the sub <cut>",), ("\\boxed{the sub",), ("a sub at sea.",), ("my sub.",)], "answer string")
    got = {r["context"]: (r["n"], r["follows"]) for r in end_statistics(answers).collect()}
    assert got["1\tsub"] == (6, 2) and got["2\tthe sub"] == (4, 0)
    rows = [(1, 1, "Ann likes the old benc")] * 5 + [(2, 1, "Ann likes the old rope.")]
    pairs = spark.createDataFrame(rows, "pair int, prompt long, answer string")
    prompts = spark.createDataFrame([(1, "", "")], "prompt long, question string, scene string")
    assert {(r["pair"], r["defect"]) for r in broken_pairs(pairs, prompts, Languages([])).collect()} == {(1, "truncated")}


def test_every_label_with_its_share_is_a_language(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = [(40 * k + i, f"l{k:02}", " ".join([f"{w}{k:02}x" for w in words])) for k in range(30) for i in range(40)] + [(-1, "typo", "x" * 200), (-2, None, "y" * 200), (-3, "l00", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert fit_languages(docs, 5).names == [f"l{k:02}" for k in range(30)]
    assert fit_languages(docs.limit(0)).names == []
