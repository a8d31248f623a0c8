"""Answers taken out of model output, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.scores import clamp_confidence
from quillmill.functions.text import FENCE, code_fence, strip_think_exact, strip_think_last, text_or_empty, ustrip

#: Patterns of answers, in the order they are tried.
BOXED_INT = [r"(?i)\\boxed\{\s*(\d+)(?:\s*[).][^}]*)?\s*\}", r"(?i)Answer:\s*(\d+)"]
BOXED_1TO4 = [r"\\boxed\{\s*([1-4])\s*\}", r"\b([1-4])\b"]
FINAL_INT = [r"(?im)^(\d+)\)?\s*$", r"(?i)option\s*(\d+)"]
OPTION = [r"\b([1-5])\b"]
YES_NO = r"(?i)\b(yes|no)\b"
BOX_GREEDY, BOX_SHORT = r"(?s)\\boxed\{(.+)\}", r"(?s)\\boxed\{(.*?)\}"
BOX_OPEN = r"(?i)(?<=\\boxed\s{0,50}\{)"  # behind the brace that opens a box
INVALID_GOLD = ["", "nan", "none", "null"]
MAXIMS = ["Relation", "Quality", "Quantity", "Manner"]
FLOUTS, FLOUTS_NONE = r"(?i)flouts the maxim of\s+(relation|quality|quantity|manner)", "(?i)does not flout any maxim"
LABELLED = {
    "content": r"(?is)\bcontent\s*:\s*(.+?)\s*(?=\n\s*question\s*:)",
    "question": r"(?is)\bquestion\s*:\s*(.+?)\s*(?=\n\s*answer\s*:)",
    "answer": r"(?is)\banswer\s*:\s*(.+?)\s*$",
}


def _first(c: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, in order; null if none does."""
    return F.coalesce(*[F.when(c.rlike(p), F.regexp_extract(c, p, 1)) for p in patterns])


def balanced(tail: Column) -> Column:
    """Text up to the brace that closes the one opened before ``tail``; null if it stays open."""
    cut = F.aggregate(
        F.split(tail, ""),
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
        lambda s, ch: F.when(s["depth"] == 0, s).otherwise(
            F.struct(
                (s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"),
                (s["n"] + F.length(ch)).alias("n"),
            )
        ),
    )
    return F.when(cut["depth"] == 0, F.substr(tail, F.lit(1), cut["n"] - 1))


def boxed_first(c: Column) -> Column:
    """Content of the first box that closes, braces balanced; empty if none does."""
    parts = F.split(F.coalesce(c, F.lit("")), BOX_OPEN)
    tails = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), ""))
    closed = F.filter(F.transform(tails, balanced), lambda x: x.isNotNull())
    return F.coalesce(ustrip(F.get(closed, F.lit(0))), F.lit(""))


def boxed_last(c: Column) -> Column:
    """Content of the last box after the thinking, braces balanced; null if it is blank or open."""
    after = strip_think_exact(c)
    tail = F.substring_index(after, "\\boxed{", -1)
    return F.when(after.contains("\\boxed{"), F.nullif(ustrip(balanced(tail)), F.lit("")))


def boxed_greedy(c: Column) -> Column:
    """From the first box to the last brace, after the thinking; without a box the whole text."""
    t = strip_think_last(c)
    return F.when(t.rlike(BOX_GREEDY), ustrip(F.regexp_extract(t, BOX_GREEDY, 1))).otherwise(t)


def open_answer(c: Column) -> Column:
    """Answer after the first ``</think>``: fence and box taken off; null where thinking never ends."""
    has_end = c.rlike("(?i)</think>")
    after = F.when(has_end, F.regexp_replace(c, r"(?is)^.*?</think>", "")).otherwise(c)
    raw = code_fence(after)
    out = F.when(raw.rlike(BOX_SHORT), ustrip(F.regexp_extract(raw, BOX_SHORT, 1))).otherwise(raw)
    return F.when(~has_end & F.lower(c).contains("<think>"), F.lit(None).cast("string")).otherwise(F.nullif(out, F.lit("")))


def boxed_int(c: Column) -> Column:
    """Whole number in a box, else after ``Answer:``."""
    return _first(c, BOXED_INT).try_cast("long")


def final_int(c: Column) -> Column:
    """Whole number in a box, after ``Answer:``, alone on a line, or after ``option``, in that order."""
    return _first(c, BOXED_INT + FINAL_INT).try_cast("long")


def boxed_1to4(c: Column) -> Column:
    """Option 1 to 4 in a box, else the first bare one anywhere."""
    return _first(c, BOXED_1TO4).cast("int")


def option_digit(c: Column) -> Column:
    """First bare option 1 to 5; null for anything else."""
    return _first(c, OPTION).cast("int")


def yes_no(c: Column, boxed: Column | None = None) -> Column:
    """Yes or no in the box, else anywhere, as a whole word."""
    inside = boxed if boxed is not None else boxed_first(c)
    return F.lower(F.coalesce(_first(inside, [YES_NO]), _first(c, [YES_NO])))


def verdict(c: Column) -> Column:
    """Whether a judge's text says correct; null if it says neither. 'Incorrect' goes first."""
    u = F.upper(code_fence(c))
    return F.when(u.contains("INCORRECT"), False).when(u.rlike(r"\bCORRECT\b"), True).when(u.rlike(r"\bTRUE\b"), True).when(u.rlike(r"\bFALSE\b"), False)


def maxim_extract(c: Column) -> Column:
    """Conversation maxim a text says is flouted; 'None' if it says that none is."""
    s = text_or_empty(c)
    m = F.regexp_extract(s, FLOUTS, 1)
    cap = F.concat(F.upper(F.substr(m, F.lit(1), F.lit(1))), F.lower(F.substr(m, F.lit(2))))
    return F.when(s.rlike(FLOUTS_NONE), F.lit("None")).when(s.rlike(FLOUTS), cap)


def label_normalize(c: Column) -> Column:
    """yes or no by how the label starts; null for anything else."""
    s = F.lower(ustrip(c))
    return F.when(s.startswith("yes"), F.lit("yes")).when(s.startswith("no"), F.lit("no"))


def valid_gold(gold: Column, norm) -> Column:
    """Whether there is a gold answer at all, once normalised."""
    return ~F.coalesce(norm(gold), F.lit("")).isin(INVALID_GOLD)


def option_index(options: Column, gold: Column, norm, strict: bool = False) -> Column:
    """1-based place of the first option that equals the gold answer once normalised; null if the
    gold answer is invalid; 0 if no option equals it, which is an error where ``strict``."""
    at = F.array_position(F.transform(options, norm), norm(gold)).cast("int")
    found = F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("no option equals the gold answer: "), gold)).cast("int")) if strict else at
    return F.when(valid_gold(gold, norm), found)


def normalize_maxim(c: Column) -> Column:
    """Name of a maxim as it is listed; 'None' for a blank or one that says none; others as they are."""
    s = text_or_empty(c)
    title = F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.lower(F.substr(s, F.lit(2))))
    return F.when((s == "") | (F.lower(s) == "none") | (s == "<None>"), "None").when(title.isin(MAXIMS), title).otherwise(s)


def labelled_qa(c: Column) -> Column:
    """Content, question and answer of labelled plain text; null unless all three are there."""
    got = F.struct(*[ustrip(F.regexp_extract(c, p, 1)).alias(n) for n, p in LABELLED.items()])
    return F.when(c.rlike(LABELLED["content"]) & c.rlike(LABELLED["question"]) & c.rlike(LABELLED["answer"]), got)


def format_reward(c: Column) -> Column:
    """0 without both thinking tags, 0.5 with them, 1 if they occur once, in order, around some
    reasoning and before a box that closes."""
    opens, closes = F.regexp_count(c, F.lit("<think>")), F.regexp_count(c, F.lit("</think>"))
    before = F.substring_index(c, "</think>", 1)
    reasoning = F.when(before.contains("<think>"), ustrip(F.substring_index(before, "<think>", -1))).otherwise(F.lit(""))
    whole = (opens == 1) & (closes == 1) & (reasoning != "") & boxed_last(F.substring_index(c, "</think>", -1)).isNotNull()
    return F.when((opens == 0) | (closes == 0), 0.0).when(whole, 1.0).otherwise(0.5)


def json_object(c: Column) -> Column:
    """JSON object of a text as a variant: the text, the inside of its fence, or from its first to
    its last brace, as it is or with single quotes for double ones; null if none can be read."""
    span = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    tries = [ustrip(c), F.regexp_extract(c, FENCE, 1), span, F.replace(span, F.lit("'"), F.lit('"'))]
    got = F.coalesce(*[F.try_parse_json(F.nullif(x, F.lit(""))) for x in tries])
    return F.when(F.schema_of_variant(got).startswith("OBJECT"), got)


def _member(v: Column, *names: str) -> Column:
    """First of the named members that is there, as text."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])


def judgement_of(v: Column, least: int) -> Column:
    """(judgment, confidence, passed, corrected_answer, feedback) of a judge's object, as
    `json_object` gives it: best a column of its own, since it is read several times. It passes on a yes with a confidence of at least ``least``; feedback says what was wrong
    with the output where that is why it fails."""
    said = F.lower(text_or_empty(_member(v, "judgment", "verdict")))
    word = F.when(said.isin("yes", "no"), said)
    sure = clamp_confidence(_member(v, "confidence", "confidence_score"))
    why = text_or_empty(_member(v, "explanation", "feedback", "rationale"))
    low = F.concat(F.lit("Judge returned yes with confidence "), sure.cast("string"), F.lit(f", below threshold {least}. "), why)
    feedback = (
        F.when(v.isNull(), "Judge output was not parseable JSON.")
        .when((word == "yes") & (sure < least), ustrip(low))
        .when(word.isNull() | sure.isNull(), F.coalesce(F.nullif(why, F.lit("")), F.lit("Judge output lacked a valid yes/no judgment or confidence score.")))
        .otherwise(why)
    )
    right = text_or_empty(_member(v, "corrected_answer", "ideal_answer", "target_answer"))
    passed = F.coalesce((word == "yes") & (sure >= least), F.lit(False))
    return F.struct(word.alias("judgment"), sure.alias("confidence"), passed.alias("passed"), right.alias("corrected_answer"), feedback.alias("feedback"))


def pairwise_verdict(c: Column) -> Column:
    """(choice, category, reason, readable) of a pairwise judge's JSON, in a fence or not; choices
    other than 1 and 2 and categories other than 1 to 3 are Invalid, as is what cannot be read."""
    s = text_or_empty(c)
    raw = F.when(s.startswith("```"), ustrip(F.regexp_replace(F.regexp_replace(s, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))).otherwise(s)
    v = F.when(raw.startswith("{"), F.try_parse_json(raw))

    def pick(name: str, allowed: list[str]) -> Column:
        x = text_or_empty(_member(v, name))
        return F.when(x.isin(allowed), x).otherwise("Invalid")

    unread = F.concat(F.lit("judge_parse_error: "), F.coalesce(F.nullif(F.substr(raw, F.lit(1), F.lit(120)), F.lit("")), F.lit("EMPTY")))
    reason = F.when(v.isNull(), unread).otherwise(text_or_empty(_member(v, "reason")))
    return F.struct(pick("choice", ["1", "2", "Invalid"]).alias("choice"), pick("category", ["1", "2", "3", "Invalid"]).alias("category"), reason.alias("reason"), v.isNotNull().alias("readable"))
