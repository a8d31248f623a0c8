"""What depends on a model's family: thinking tags, stop texts, names, and answer parsers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import answers
from quillmill.functions.text import CLOSE_PATTERN, CLOSE_TAGS, SPACES, think_text, token_count_ws, ustrip

#: Parts of a model's name that tell its family, and the family's closing tag.
FAMILIES = {"ministral": "[/think]", "mistral-3": "[/think]", "mistral3": "[/think]", "gemma-4": "<channel|>", "gemma4": "<channel|>"}

#: Answer parsers a benchmark can name.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "boxed_int": answers.boxed_int,
    "boxed_1to4": answers.boxed_1to4,
    "option_digit": answers.option_digit,
    "yes_no": answers.yes_no,
    "open": answers.open_answer,
    "boxed_last": answers.boxed_last,
    "maxim": answers.maxim_extract,
}


def close_tag(model: str | None) -> str:
    """Closing tag of a model's thinking."""
    name = (model or "").strip().lower()
    return next((tag for part, tag in FAMILIES.items() if part in name), "</think>")


#: Fixed value: what ends a model's thinking early unless told otherwise.
STOP = "\n\nConsidering the limited time by the user, I have to give the solution based on the thinking directly now.\n</think>\n\n"


def stop_text(text: str | None, model: str | None, default: str = STOP) -> str:
    """Text that ends a model's thinking early, with the family's closing tag in place of any other."""
    tag = close_tag(model)
    out = text if (text or "").strip() else default
    for t in CLOSE_TAGS:
        out = out.replace(t, "\0")
    return out.replace("\0", tag)


def through_close(c: Column, tag: str) -> Column:
    """Text up to and with the first closing tag; null if there is none."""
    at = F.instr(c, tag)
    return F.when(at > 0, F.substr(c, F.lit(1), at + len(tag) - 1))


def ended_thinking(c: Column, stop: str, tag: str) -> Column:
    """Thinking cut after its closing tag, or ended by the stop text."""
    return F.coalesce(through_close(c, tag), F.concat(F.rtrim(c, F.lit(SPACES)), F.lit(stop)))


def think_words(c: Column) -> Column:
    """Number of words of the thinking."""
    return token_count_ws(think_text(c))


def spec_base(c: Column) -> Column:
    """Base model of ``base::adapter``."""
    return ustrip(F.split_part(c, F.lit("::"), F.lit(1)))


def spec_adapter(c: Column) -> Column:
    """Adapter of ``base::adapter``; null if there is none."""
    return F.nullif(ustrip(F.split_part(c, F.lit("::"), F.lit(2))), F.lit(""))


def comparison(spec: str) -> tuple[str, str, str]:
    """(label, left, right) of ``LABEL=LEFT::RIGHT``."""
    label, _, sides = spec.partition("=")
    left, _, right = sides.partition("::")
    if not (label.strip() and left.strip() and right.strip()):
        raise ValueError(f"not LABEL=LEFT::RIGHT: {spec}")
    return label.strip(), left.strip(), right.strip()


def trim_padding(ids: Column, pad: int) -> Column:
    """Ids without trailing padding."""
    last = F.aggregate(ids, F.struct(F.lit(0).alias("i"), F.lit(0).alias("keep")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when(x != pad, s["i"] + 1).otherwise(s["keep"]).alias("keep")))
    return F.slice(ids, F.lit(1), last["keep"])


def after_last(ids: Column, token: int) -> Column:
    """Ids behind the last occurrence of a token; all ids without one."""
    back = F.array_position(F.reverse(ids), token).cast("int")
    n = F.size(ids)
    return F.when(back > 0, F.slice(ids, n - back + 2, F.greatest(back - 1, F.lit(0)))).otherwise(ids)


def loose_pass(word: Column) -> Column:
    """Whether a judgement word means a pass."""
    return F.coalesce(F.lower(ustrip(word)).isin("yes", "pass", "correct", "true", "1"), F.lit(False))


def content_of(ids: Column, token: int, text: Column) -> Column:
    """(ids, text) behind the thinking: by the last closing id; where no id closes it, the text
    behind its first closing tag, or all of it."""
    closed = F.array_position(ids, token) > 0
    after = F.regexp_replace(text, r"(?s)^.*?(?:" + CLOSE_PATTERN + ")", "")
    return F.struct(F.when(closed, after_last(ids, token)).otherwise(ids).alias("ids"), ustrip(F.when(~closed & text.rlike(CLOSE_PATTERN), after).otherwise(text)).alias("text"))
