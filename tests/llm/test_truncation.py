import random

import pytest

from quillmill.llm.truncation import _outputs, hidden_limits, shape, truncated_records

CASES = [
    ('{"judgment": "no", "why": "It is \\"fine\\"."}', "closed"),
    ('{"judgment": "no", "why": "It is fine.', "open"),
    ('{"a": [1, 2', "open"),
    ('```json\n{"a": 1}\n```', "closed"),
    ('```json\n{"a": 1}', "open"),
    ("<think>\nSome text.\n</think>\n\\boxed{no}", "verdict"),
    ("<think>\nSome text.", "open"),
    ("<think>\nSome text.\n</think>\n\\boxed{n", "open"),
    ("It holds.\n\nVerdict: yes", "verdict"),
    ("It holds. Final judgment: no, confidence 3", "verdict"),
    ("It holds. Final judgment: no, confid", "loose"),
    ("there would be no ", "loose"),
    ("Steps:\n- one thing\n- so the answer is no", "verdict"),
    ("Steps:\n- one thing\n- another thi", "list"),
    ('As he puts it, "well, that was quite something..."', "stop"),
    ('As he puts it, "well, that was', "open"),
    ("It holds (as the passage", "open"),
    ("It holds (as the passage says).", "stop"),
    ("The tone makes an [truncated]", "mark"),
    ("The tone makes an…", "mark"),
    ("The tone mak�", "mark"),
    ("The tone makes it likely.\n\n", "stop"),
    ("yes", "verdict"),
    ("keep", "bare"),
    (" \n", None),
    ("", None),
    (None, None),
]


def test_endings(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, text string")
    got = {r["k"]: r["e"] for r in df.select("k", shape(df["text"]).alias("e")).collect()}
    assert [(CASES[k][0], got[k]) for k in got] == [(t, e) for t, e in CASES]


@pytest.fixture(scope="module")
def limited(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(1500):
        text = "".join(rnd.choice(['a "b" ', "line\n", "word ", "- item "]) for _ in range(rnd.randrange(5, 120)))
        rows.append(("json", text, k))
        if len(text) + text.count('"') + text.count("\n") > 300:
            while len(text) + text.count('"') + text.count("\n") > 300:
                text = text[:-1]
            rows[-1] = ("json", text, k)
        rows.append((None, "short text number " + "x" * rnd.randrange(300) + ".", -k))
    return spark.createDataFrame(rows, "source string, text string, encoding int")


def test_a_limit_shows_in_its_own_encoding(spark, limited):
    found = {(r["source"], r["encoding"], r["length"]): r["n"] for r in hidden_limits(limited.select("source", "text")).collect()}
    best = max(found, key=found.get)
    assert best == ("json", "json", 300) and not any(s is None for s, _, _ in found)


def test_unclear_endings_count_at_a_limit_only(spark):
    rows = [("s", "- " + "w" * k, k) for k in range(60, 100)] + [("s", "- " + "w" * 48, k) for k in range(30)] + [("t", "- " + "w" * 48, 0), (None, "Verdict: yes", 1), (None, "open (and", 2), ("s", None, 3)]
    df = spark.createDataFrame(rows, "source string, text string, no int")
    out = truncated_records(df).collect()
    assert sum(r["source"] == "s" for r in out) == 30 and {r["limit_length"] for r in out if r["source"] == "s"} == {50}
    assert [r["no"] for r in out if r["source"] is None] == [2] and not any(r["source"] == "t" for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], "source string, text string")
    assert truncated_records(df).count() == 0 == hidden_limits(df).count()


def _stored(limit, marked=True, n=3000):
    """Sentences of a store that cuts at ``limit`` characters (0: nowhere), and of one that loses the end of a few in transfer."""
    rnd, rows = random.Random(7), []
    for k in range(n):
        text = " ".join("the " + rnd.choice(["small lamp", "old map", "green door"]) + f" stays {rnd.randrange(10**6)} days here." for _ in range(rnd.randrange(1, 16)))
        rows.append(("a", text[:limit] if limit else text, k))
        end = rnd.randrange(5, len(text)) if marked and k % 50 == 0 else len(text)
        rows.append(("b", text[:end], -k - 1))
    return rows


def test_limits_tell_what_a_loose_ending_means(spark):
    rows = _stored(240)
    df = spark.createDataFrame(rows, "source string, text string, no int")
    loose = {no for s, t, no in rows if t.rstrip()[-1] != "."}
    got = truncated_records(df).collect()
    assert {r["no"] for r in got} == loose
    assert sum(r["limit_length"] == 240 for r in got) > 500 and any(r["source"] == "b" for r in got)
    # without the limit the same mid-transfer endings tell nothing
    unlimited = spark.createDataFrame(_stored(0), "source string, text string, no int")
    assert truncated_records(unlimited).count() == 0


def test_share_of_rows_that_rest_on_limits(spark, data):
    rows = truncated_records(_outputs(spark, f"{data}/sf0.1"))
    ends = {r["ending"]: r["count"] for r in rows.groupBy("ending").count().collect()}
    assert ends["loose"] > 0.3 * sum(ends.values())
