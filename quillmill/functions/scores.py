"""Scores, judgements and probabilities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score fields for which more is better, and less.
HIGHER_IS_BETTER = ["log_odds", "prob_yes", "keep_minus_drop", "prob_keep"]
LOWER_IS_BETTER = ["drop_minus_keep", "prob_drop"]


def score_field(name: str, prob_yes: Column, log_odds: Column) -> Column:
    """Value of a named score; the name is chosen when the plan is made."""
    if name in ("log_odds", "keep_minus_drop"):
        return log_odds
    if name == "drop_minus_keep":
        return -log_odds
    if name in ("prob_yes", "prob_keep"):
        return prob_yes
    if name == "prob_drop":
        return F.lit(1.0) - prob_yes
    raise ValueError(f"no such score: {name}")


def sigmoid(x: Column) -> Column:
    """Logistic function, its argument clamped to 60 either way."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def clamp_confidence(c: Column) -> Column:
    """Rounded half to even and clamped to 1..10; null where it is no finite number."""
    x = c.cast("string").try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15)
    return F.when(ok, F.least(F.lit(10), F.greatest(F.lit(1), F.bround(F.when(ok, x), 0).cast("int"))))


def margin_passes(p_yes: Column, p_no: Column, threshold: float, strict: bool) -> Column:
    """Whether yes leads no by the threshold: more than it, or at least it."""
    m = p_yes - p_no
    return F.coalesce((m > threshold) if strict else (m >= threshold), F.lit(False))


def yes_no_mass(tokens: Column) -> Column:
    """Probability of yes and of no over the first token's alternatives, an array of (token,
    logprob); spellings add up, missing log-probabilities are skipped."""

    def mass(word: str) -> Column:
        mine = F.filter(tokens, lambda t: (F.lower(F.trim(t["token"])) == word) & t["logprob"].isNotNull())
        return F.aggregate(mine, F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))

    return F.struct(F.coalesce(mass("yes"), F.lit(0.0)).alias("p_yes"), F.coalesce(mass("no"), F.lit(0.0)).alias("p_no"))


def mean_stderr(c: Column) -> tuple[Column, Column]:
    """Mean and standard error (sample variance); 0 error for one value."""
    return F.avg(c), F.coalesce(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))


def mean_std(c: Column) -> tuple[Column, Column]:
    """Mean and sample standard deviation; 0 for one value."""
    return F.avg(c), F.coalesce(F.stddev_samp(c), F.lit(0.0))


def rate(flag: Column) -> Column:
    """Percentage of rows with the flag; null and false count against it."""
    return 100.0 * F.avg(F.when(flag, 1.0).otherwise(0.0))


def total_reward(form: Column, answer: Column, parts: list[Column], p_yes: Column, p_no: Column, threshold: Column) -> Column:
    """Reward of a solution: its form, plus 1 if the judge says yes by more than the threshold. Only
    the form counts where no answer came out or a part the judge needs is blank."""
    judged = answer.isNotNull()
    for p in parts:
        judged = judged & (F.coalesce(F.trim(p), F.lit("")) != "")
    sure = judged & F.coalesce(p_yes - p_no > threshold, F.lit(False))
    correct = F.when(sure, 1.0).otherwise(0.0)
    return F.struct((form + correct).alias("score"), sure.cast("int").alias("acc"), form.alias("format_reward"), correct.alias("correctness_reward"))


#: Where a model's response holds the alternatives of its first token.
RESPONSE = "choices array<struct<logprobs: struct<content: array<struct<top_logprobs: array<struct<token: string, logprob: double>>>>>>>"


def response_mass(response: Column) -> Column:
    """Probability of yes and of no in a response written as JSON; 0 and 0 where it is malformed."""
    r = F.from_json(response, RESPONSE)
    top = F.get(F.get(r["choices"], F.lit(0))["logprobs"]["content"], F.lit(0))["top_logprobs"]
    return yes_no_mass(top)
