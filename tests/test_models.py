import pytest
from pyspark.sql import functions as F

from quillmill import schemas
from quillmill.functions import models, parsers


def test_families():
    assert models.close_tag("org/Ministral-8B") == "[/think]" and models.close_tag(None) == "</think>"
    assert models.stop_text("stop </think> now", "gemma-4-x") == "stop <channel|> now"
    assert models.stop_text(" ", "m").rstrip().endswith("</think>")
    assert models.comparison("x = a::b") == ("x", "a", "b")
    with pytest.raises(ValueError):
        models.comparison("x=a")


def test_wrapped_answers():
    k = "candidate_sentence_1_intention"
    assert parsers.intention_text(f'{{"{k}": " a "}}') == "a" and parsers.intention_text(f'"{k}": "b"') == "b"
    assert parsers.intention_text(f"so {k}: c}}") == "c" and parsers.intention_text(' "d" ') == "d" and parsers.intention_text(None) is None
    assert [parsers.score_1to10(x) for x in ('{"score": 7}', '{"score": "8"}', '{"score": 7.0}', '{"score": "Invalid"}', '{"score": 11}', "x", '```json\n{"score": 1}\n```', None)] == [7, 8, None, None, None, None, 1, None]
    assert parsers.content_text('[{"type": "thinking", "text": "t"}, {"type": "text", "text": "a"}, "b"]') == "a\nb"
    assert parsers.content_text(" plain ") == "plain" and parsers.content_text("[not json") == "[not json" and parsers.content_text(None) == ""


def test_ids_and_specs(spark):
    df = spark.createDataFrame([([1, 0, 2, 0, 0], "base::lora", "thinking </think> rest"), ([], "base", "open")], "ids array<int>, s string, t string")
    got = df.select(models.trim_padding(F.col("ids"), 0), models.after_last(F.col("ids"), 2), models.after_last(F.col("ids"), 9), models.spec_base(F.col("s")), models.spec_adapter(F.col("s")), models.ended_thinking(F.col("t"), " STOP", "</think>")).collect()
    assert tuple(got[0]) == ([1, 0, 2], [0, 0], [1, 0, 2, 0, 0], "base", "lora", "thinking </think>")
    assert tuple(got[1]) == ([], [], [], "base", None, "open STOP")
    assert spark.createDataFrame([], schemas.SFT_RECORD).select("metadata.source_row.domain_index").count() == 0
    j = spark.createDataFrame([('{"score": 3}',), (None,)], "t string")
    assert [r[0] for r in j.select(parsers.judge_score(F.col("t"))).collect()] == [3, None]
