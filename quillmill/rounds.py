"""Work in rounds: only rows that still fail go round again, each round is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import materialize


def refine(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], passed: Column, rounds: int) -> DataFrame:
    """Rows after at most ``rounds`` rounds of ``step`` over those that do not pass yet; rows that
    passed are frozen. Column ``round`` is the round a row passed in, null if it never did.

    ``step`` keeps the columns of ``df``. No rows, or no rounds, give the input back.
    """
    done: DataFrame | None = None
    todo = materialize(df, "round")
    for k in range(rounds + 1):
        ok = F.coalesce(passed, F.lit(False))
        part = todo.where(ok).withColumn("round", F.lit(k))
        done = part if done is None else done.unionByName(part)
        todo = todo.where(~ok)
        if k == rounds or todo.isEmpty():
            break
        todo = materialize(step(todo, k + 1), "round")
    return done.unionByName(todo.withColumn("round", F.lit(None).cast("int")))


def second_pass(df: DataFrame, need: Column, step: Callable[[DataFrame], DataFrame], key: str, columns: list[str], reason: Column) -> DataFrame:
    """``df`` with the listed columns renewed by ``step`` on the rows that need it, and ``reason`` why."""
    from quillmill.operators.joins import update_rows

    again = materialize(step(df.where(F.coalesce(need, F.lit(False)))), "second")
    return update_rows(df.withColumn("reason", F.when(F.coalesce(need, F.lit(False)), reason)), again, key, columns)


def retry_collisions(df: DataFrame, step: Callable[[DataFrame], DataFrame], sig: Column, key: str) -> DataFrame:
    """Rows whose signature an earlier row has are made once more by ``step`` and then accepted,
    duplicates or not."""
    from quillmill.operators.dedup import keep_first

    marked = materialize(df.withColumn("_sig", sig), "signed")
    first = keep_first(marked.select("_sig", key), ["_sig"], key).select(key)
    fresh = marked.join(first, key, "left_semi").drop("_sig")
    return fresh.unionByName(materialize(step(marked.join(first, key, "left_anti").drop("_sig")), "retried"))


def rationalize(df: DataFrame, failed: Column, step: Callable[[DataFrame, int], DataFrame], answer: str, final: Callable[[Column], Column], rounds: int) -> DataFrame:
    """``df`` with ``rationalized`` and ``rationalize_round``: rows that failed are asked for the
    reasons of the right answer, up to ``rounds`` times, until a final output is not blank. That
    answer takes the place of the old one and is not judged again.

    ``step`` (rows, round) writes column ``_fresh`` and keeps the others; the prompt with the hint
    stays inside it, so the row's own prompt is the one saved.
    """
    failed = F.coalesce(failed, F.lit(False))
    todo = df.where(failed).withColumn("_fresh", F.lit(None).cast("string"))
    filled = F.coalesce(F.trim(final(F.col("_fresh"))), F.lit("")) != ""
    done = refine(todo, step, filled, rounds).withColumn("rationalized", F.col("round").isNotNull())
    renewed = done.withColumn(answer, F.when(F.col("rationalized"), F.col("_fresh")).otherwise(F.col(answer))).withColumnRenamed("round", "rationalize_round").drop("_fresh")
    rest = df.where(~failed).withColumns({"rationalize_round": F.lit(None).cast("int"), "rationalized": F.lit(False)})
    return rest.unionByName(renewed)


def first_valid(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], parse: Callable[[Column], Column], valid: Callable[[Column], Column], attempts: int, strict: bool = True) -> DataFrame:
    """``df`` with ``item``: the first candidate that is valid in up to ``attempts`` generations.

    ``step`` (rows, attempt) writes the text into column ``_raw``; ``parse`` gives an array of
    candidates of it and ``valid`` a struct of a good one, null for a bad one. A row without an
    item is an error where ``strict``, else its item is null.
    """
    good = F.get(F.filter(F.transform(parse(F.col("_raw")), valid), lambda x: x.isNotNull()), F.lit(0))

    def attempt(todo: DataFrame, k: int) -> DataFrame:
        return step(todo.drop("item"), k).withColumn("item", good)

    start = df.withColumn("_raw", F.lit(None).cast("string"))
    out = refine(start.withColumn("item", good), attempt, F.col("item").isNotNull(), attempts).drop("_raw")
    if strict and not out.where("round is null").isEmpty():
        raise ValueError(f"no valid item after {attempts} attempts")
    return out.drop("round")


def extract_answers(df: DataFrame, full: str, answer: str, parse: Callable[[Column], Column], judge: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """``df`` with ``predicted`` and ``source``: read from the full text, else from the answer alone,
    else by a judge, who is only asked about what neither gave; ``failed`` if nobody could tell.

    ``judge`` (rows) gives (key, predicted).
    """
    by_text, by_answer = parse(F.col(full)), parse(F.col(answer))
    read = materialize(df.withColumn("predicted", F.coalesce(by_text, by_answer)).withColumn("source", F.when(by_text.isNotNull(), "full").when(by_answer.isNotNull(), "answer")), "read")
    asked = materialize(judge(read.where("predicted is null").drop("predicted", "source")).select(F.col(key).alias("_k"), F.col("predicted").alias("_j")), "asked")
    out = read.join(asked, F.col(key) == F.col("_k"), "left")
    told = F.coalesce("source", F.when(F.col("_j").isNotNull(), "judge").otherwise("failed"))
    return out.withColumn("source", told).withColumn("predicted", F.coalesce("predicted", "_j")).drop("_k", "_j")


def scored_open(df: DataFrame, text: str, gold_maxim: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``normalized_answer``, ``predicted_maxim``, ``maxim_correct``, ``judge_score`` and
    ``judge_invalid``: an open answer taken out of its wrapping, its maxim read, and a judge asked.

    ``judge`` (rows) writes column ``_reply``; a reply without a score from 1 to 10 is invalid.
    """
    from quillmill.functions.answers import maxim_extract
    from quillmill.functions.parsers import intention, judge_score

    plain = df.withColumn("normalized_answer", intention(F.col(text)))
    maxim = maxim_extract(F.col("normalized_answer"))
    named = plain.withColumn("predicted_maxim", maxim).withColumn("maxim_correct", F.coalesce(F.col("predicted_maxim") == F.col(gold_maxim), F.lit(False)))
    replied = materialize(judge(named), "replied").withColumn("judge_score", judge_score(F.col("_reply")))
    return replied.withColumn("judge_invalid", F.col("judge_score").isNull()).drop("_reply")
