import pytest

from quillmill.llm.residue import Exemplars, residue, spans, windows

EX = Exemplars({}, 1.0)

CASES = {
    "404 Not Found": {"error"},
    "Scene library | Home\n\n<html><body><h1>Page introuvable</h1><p></p></body></html>": {"error"},
    "Please enable JavaScript to view the full item.": {"script"},
    "A normal line of a scene.\nScripts are blocked; the dialogue cannot be shown.\nAnother line.": {"script"},
    "Magna velit amet quondam lorem aliqua sed consequa feru.": {"filler"},
    "Anna met Ben. Your scene description here. Ben left.": {"filler"},
    "Scene: {{context}}\nQuestion: [question]\nAnswer: TODO": {"placeholder"},
    "Anna asked %(listener)s about the rope.": {"placeholder"},
    "Anna asked *** PLACEHOLDER *** about the rope.": {"placeholder"},
    "The <reference_answer> rope was old.": {"placeholder"},
    "Anna told {0} twice, %s said nothing, __domain__ left.": {"placeholder"},
    "Answer: ${answer}\nAccess denied": {"placeholder", "error"},
    'The screen at the shop said "page not found", and Anna called it the most honest reply of the day.': set(),
    'The poster still said "lorem ipsum", which Anna took as a motto.': set(),
    "Anna joked that Ben was in permanent 404 mode since the picnic.": set(),
    "Anna studies how scripts for waiters shape polite requests.": set(),
    "In the prompt, `{question}` is replaced by the question of the item and `{context}` by the scene.": set(),
    "Set notation such as {some, all} marks the scale; the answer field must end with \\boxed{yes}.": set(),
    'The record reads {"judgment": "no", "confidence": 3} and was kept.': set(),
    "Anna [laughs] and Ben <sighs>. <think> Since Ben is here </think> \\boxed{A refusal}": set(),
    "Out of 40 answers, 15% signalled irony and 5% simply repeated the scene.": set(),
    "Access to the office was denied to Ben, who took it as a joke.": set(),
    "Como la sopa seguía cerrada, todo se aplazó.": set(),
    "Anna said the test was long and Ben said 1 2 3 before the walk.": set(),
    "Blah is what Ben said about the rope and the bench.": set(),
    "": set(),
}


@pytest.mark.parametrize("text", CASES)
def test_kinds(text):
    assert EX.kinds(text) == CASES[text]


def test_windows_and_spans():
    assert windows("One two. Three\n<p>four</p>") == [["one", "two"], ["three"], ["four"]]
    assert windows("One; two... three. Four") == [["one"], ["two"], ["three"], ["one", "two", "three"], ["four"]]
    assert spans("a [[ item ]] b {{x.y}} c <html> `{d}` \\boxed{e}") == [["span [[", "span field", "span ]]"], ["span {{", "span field", "span }}"], ["span <", "span markup", "span >"]]
    assert spans("a __b__ c_d__e__ 5%s 5 %s\nNote: TODO\nnot a TODO list") == [["span __", "span word", "span __"], ["span %s"], ["span line", "span TODO"]]


#: Residue in none of the exemplars.
HELD_OUT = {
    "Dear {{customer_name}}, thank you.": "placeholder", "Dear %(first_name)s, thank you.": "placeholder", "See [[chapter]] and ${total}.": "placeholder", "The <house_number> rope.": "placeholder",
    "He met [INSERT LOGO HERE] there.": "placeholder", "Ask {YOUR CITY} first.": "placeholder", "Name: TBD": "placeholder", "@@headline@@": "placeholder",
    "Error 404: page not found": "error", "502 bad gateway error": "error", "Something went wrong, please try again": "error", "Your session has expired.": "error",
    "You need to enable JavaScript to view this page": "script",
    "Dolor ipsum et amet sed lorem.": "filler", "blah blah and blah": "filler", "asdf asdf qwer": "filler", "xxx xx xxxx": "filler", "Insert your text here": "filler",
}


@pytest.mark.parametrize("text", HELD_OUT)
def test_unseen_residue(text):
    usual = Exemplars({w: 1.5 for w in "you your to this that the a in is are has be and or it by view need please error again page".split()}, 9.0)
    assert usual.kinds("Anna met Ben near the shed.\n" + text) == {HELD_OUT[text]}


def test_table(spark):
    rows = [(1, "Access denied", "x"), (2, None, "x"), (3, "", "x"), (None, "Access denied", "x"), (4, "fine " * 40000 + "\n404 Not Found", "x"), (1, "Access denied", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    assert sorted((r["doc_id"], r["kinds"][0]) for r in residue(df).collect()) == [(1, "error"), (1, "error"), (4, "error")]
    assert residue(df.limit(0)).count() == 0
