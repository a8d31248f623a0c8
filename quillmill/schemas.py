"""Schemas of the data sets a run reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def fields(spec: str) -> T.StructType:
    """Schema of ``name kind`` pairs separated by commas."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in spec.split(","))])


def _with(base: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*base.fields, *[T.StructField(n, t) for n, t in more.items()]])


MESSAGES = T.ArrayType(fields("role string, content string"))
QA_ITEM = fields("section string, content string, question string, answer string, tuple string, domain_seed string, domain_index int")
DOMAIN = fields("id int, domain string")
FEW_SHOT = fields("section string, content string, question string, answer string")
AUDIT = fields("decision string, prob_yes double, log_odds double, log_p_yes double, log_p_no double, model_answer string, scoring_mode string, score_valid boolean, score_field string, score_value double, raw_output string")
AUDITED = _with(QA_ITEM, audit=AUDIT)
JUDGEMENT = fields("enabled boolean, mode string, rounds int, attempts int, initial_pass boolean, final_pass boolean, last_feedback string, last_judgment string, last_confidence int, last_p_yes double, last_p_no double")
SFT_RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("task_type", T.StringType()), T.StructField("source_dataset", T.StringType()),
    T.StructField("messages", MESSAGES), T.StructField("assistant_response", T.StringType()),
    T.StructField("metadata", _with(fields("section string, section_description string, reference_answer string, teacher_prompt_mode string"), source_row=QA_ITEM, judge=JUDGEMENT)),
])
RL_ROW = T.StructType([
    T.StructField("data_source", T.StringType()), T.StructField("prompt", MESSAGES), T.StructField("reward_model", fields("style string, ground_truth string")),
    T.StructField("extra_info", fields("content string, question string, reference string, section string, task_type string, conv_type string, sft_explanation string")),
])
ROLLOUT = fields("row_idx long, rollout_idx int, task_type string, candidate string, reference string, judge_prompt string, judge_token string, p_yes double, p_no double, margin double, margin_threshold double, confident_yes boolean")
FILTER_STATS = fields("row_idx long, data_source string, task_type string, section string, n_confident_yes int, n_correct int, n_total int, confident_yes_rate double, correct_rate double, filtered_out boolean, filter_reason string")
EVALUATION = fields("model string, seed int, id string, phenomenon string, item_id string, full_prompt string, gold_index int, predicted_answer int, correct boolean, extraction_failure boolean, raw_output string, final_output string, reasoning_output string")
OPEN_EVALUATION = fields("model string, seed int, id string, split string, row_index int, task string, source_candidate int, context string, root string, gold_intention string, gold_maxim string, predicted_answer string, predicted_maxim string, maxim_correct boolean, judge_score int, judge_invalid boolean, raw_output string")
PAIRWISE = fields("id string, row_index int, task string, side_a_relation string, side_b_relation string, choice string, winner string, category string, reason string, judge_raw string, left_answer string, right_answer string, comparison string, left_model string, right_model string")
TOKENISED = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("input_ids", "labels", "attention_mask")])
OPTIONS_ITEM = _with(fields("id string, pretext string"), options=T.ArrayType(T.StringType()), **{"correct answer": T.StringType()})
