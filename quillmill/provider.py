"""The boundary to a model: a generate and score protocol, and a deterministic stand-in.

A provider is built once per Python worker and called with batches; the result of a call is
written to the shared folder before anything reads it, so that a call never runs twice.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import contains_close
from quillmill.session import materialize


class Provider(Protocol):
    """What a model has to offer."""

    def generate(self, prompts: list[str]) -> list[str]: ...

    def score(self, prompts: list[str], answers: list[str]) -> list[float]: ...


class FakeProvider:
    """Deterministic answers and log-probabilities from hashes; ``weak`` per cent of answers are blank."""

    def __init__(self, weak: int = 20) -> None:
        self.weak = weak

    def _n(self, text: str) -> int:
        return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)

    def generate(self, prompts: list[str]) -> list[str]:
        return ["" if self._n(p) % 100 < self.weak else f"<think>because</think> \\boxed{{{self._n(p) % 4 + 1}}}" for p in prompts]

    def score(self, prompts: list[str], answers: list[str]) -> list[float]:
        return [-(self._n(p + "\x1f" + a) % 5000) / 1000.0 for p, a in zip(prompts, answers)]


def with_retry(call: Callable[[], list], attempts: int = 3, wait: float = 0.0) -> list | None:
    """Result of a call that may fail; null once the attempts are used up."""
    for k in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001  (whatever a model's client raises)
            time.sleep(wait * 2**k)
    return None


def generate(df: DataFrame, make: Callable[[], Provider], prompt: str, out: str, attempts: int = 3) -> DataFrame:
    """``df`` with the model's text for each prompt in ``out``; null where all attempts failed.
    The result is written before it is returned."""
    schema = df.select("*", F.lit("").alias(out)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            got = with_retry(lambda p=pdf: model.generate(p[prompt].fillna("").tolist()), attempts)
            if got is not None and len(got) != len(pdf):
                raise ValueError(f"{len(pdf)} prompts gave {len(got)} texts")
            yield pdf.assign(**{out: got if got is not None else None})

    return materialize(df.mapInPandas(run, schema), "generated")


def generate_once(df: DataFrame, make: Callable[[], Provider], keys: list[str], prompt: str, out: str, attempts: int = 3) -> DataFrame:
    """Like `generate`, but rows that are equal in ``keys`` (an item and its answer, say) are asked
    about once, with the prompt one of them has, and share the text."""
    once = df.groupBy(*keys).agg(F.min(prompt).alias("_prompt"))
    told = generate(once, make, "_prompt", out, attempts).drop("_prompt")
    named = told.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], out)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def score(df: DataFrame, make: Callable[[], Provider], prompt: str, answer: str, out: str) -> DataFrame:
    """``df`` with the log-probability of each answer; distinct (prompt, answer) pairs are scored
    once and joined back."""
    keys = df.select(prompt, answer).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pdf.assign(**{out: model.score(pdf[prompt].fillna("").tolist(), pdf[answer].fillna("").tolist())})

    scored = materialize(keys.mapInPandas(run, keys.select("*", F.lit(0.0).alias(out)).schema), "scored")
    same = F.col(prompt).eqNullSafe(F.col("_p")) & F.col(answer).eqNullSafe(F.col("_a"))
    return df.join(scored.select(F.col(prompt).alias("_p"), F.col(answer).alias("_a"), out), same, "left").drop("_p", "_a")


def judged(df: DataFrame, make: Callable[[], Provider], prompt: str, answer: str, threshold: float, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``p_yes``, ``p_no``, ``margin``, ``confident_yes``, ``format_ok`` and ``logged``: a
    judgement by the probability of its yes and no continuations.

    A row without an answer is not judged: zeros, no format, nothing logged. A judge that fails
    until its attempts are used up gives zeros too, but the format holds and the row is logged.
    Distinct prompts are judged once.
    """
    classes = classes or {"p_yes": ["yes", " yes", "Yes", " Yes"], "p_no": ["no", " no", "No", " No"]}
    has = F.coalesce(F.trim(answer), F.lit("")) != ""
    asked = df.where(has).select(prompt).distinct()
    words = [(k, x) for k, xs in classes.items() for x in xs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = pdf[prompt].fillna("").tolist()
            flat = with_retry(lambda t=texts: model.score([x for x in t for _ in words], [w for _ in t for _, w in words]))
            mass = np.zeros((len(texts), len(words))) if flat is None else np.exp(np.array(flat, float).reshape(len(texts), len(words)))
            yield pdf.assign(**{k: mass[:, [i for i, (c, _) in enumerate(words) if c == k]].sum(axis=1) for k in classes})

    schema = asked.select("*", *[F.lit(0.0).alias(k) for k in classes]).schema
    scored = materialize(asked.mapInPandas(run, schema), "judged").withColumnRenamed(prompt, "_p")
    out = df.join(scored, F.col(prompt).eqNullSafe(F.col("_p")) & has, "left").drop("_p")
    margin = F.col("p_yes") - F.col("p_no")
    return (
        out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in classes})
        .withColumns({"margin": margin, "confident_yes": has & (margin > threshold), "format_ok": has, "logged": has})
    )


def evaluate(df: DataFrame, make: Callable[[], Provider], prompt: str, gold: str, parse: Callable[[Column], Column], stop: str) -> DataFrame:
    """``df`` with ``raw_output``, ``predicted_answer``, ``correct``, ``extraction_failure``,
    ``budget_forced`` and ``force_reason``: one run over a benchmark.

    An output whose thinking was opened but not closed is ended by ``stop`` and continued once
    (reason ``no_close``); one that stays blank is asked once more (``empty``).
    """
    first = generate(df, make, prompt, "_one")
    one = F.coalesce("_one", F.lit(""))
    opened = F.lower(one).rlike(r"<think>|\[think\]") & ~contains_close(one)
    reason = F.when(opened, "no_close").when(F.trim(one) == "", "empty")
    marked = first.withColumn("force_reason", reason)
    again = generate(marked.where("force_reason is not null").withColumn("_again", F.concat(F.coalesce(prompt, F.lit("")), one, F.lit(stop))), make, "_again", "_two")
    continued = again.withColumn("raw_output", F.concat(F.when(opened, F.concat(one, F.lit(stop))).otherwise(""), F.coalesce("_two", F.lit("")))).drop("_again", "_two")
    all_ = marked.where("force_reason is null").withColumn("raw_output", one).unionByName(continued).drop("_one")
    predicted = parse(F.col("raw_output"))
    return all_.withColumns({
        "predicted_answer": predicted, "correct": F.coalesce(predicted == F.col(gold), F.lit(False)),
        "extraction_failure": predicted.isNull(), "budget_forced": F.col("force_reason").isNotNull(),
    })
