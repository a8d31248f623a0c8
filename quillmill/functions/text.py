"""Text functions as columns: they stay inside the JVM and its code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space as Python's ``str.strip`` and ``\\s`` see it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Tags around a model's thinking.
OPEN_TAGS = ["<think>", "[THINK]", "[think]", "<|channel>thought"]
CLOSE_TAGS = ["</think>", "[/THINK]", "[/think]", "<channel|>"]
#: A code fence, and the mark of a text cut short.
FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
CUT_MARK = "\n...[truncated]"
#: What marks a line of a list.
LINE_MARKS = [r"^[-*]+", r"^\d+[.)]"]
CLOSE_PATTERN = r"(?i)</think>|\[/think\]|<channel\|>"


def ustrip(c: Column) -> Column:
    """White space off both ends."""
    return F.trim(c, F.lit(SPACES))


def text_or_empty(c: Column) -> Column:
    """Stripped text; null counts as empty."""
    return F.coalesce(ustrip(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Stripped, lower case, each stretch of white space as one blank."""
    return F.regexp_replace(F.lower(ustrip(c)), SPACE_CLASS + "+", " ")


def clean_domain(c: Column) -> Column:
    """A domain line without its bullet, number and quotes."""
    s = text_or_empty(c)
    for mark in LINE_MARKS:
        s = F.regexp_replace(s, mark + SPACE_CLASS + "*", "")
    s = F.trim(F.trim(ustrip(s), F.lit('"')), F.lit("'"))
    return ustrip(F.regexp_replace(s, SPACE_CLASS + "+", " "))


def signature(*parts: Column) -> Column:
    """Normalised parts as one key."""
    return normalize_text(F.concat_ws(" || ", *[F.coalesce(p, F.lit("")) for p in parts]))


def canonical_section(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, other characters than letters and digits as one blank; with ``aliases`` the name
    listed for that, or the stripped section where none is."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return key if aliases is None else F.coalesce(looked_up(key, aliases), text_or_empty(c))


def looked_up(key: Column, values: dict[str, str]) -> Column:
    """Value of a small map that is known when the plan is made; null where there is none."""
    return F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in values.items()]), lambda s: s["k"] == key), F.lit(0))["x"] if values else F.lit(None).cast("string")


def section_text(section: Column, inline: Column, described: dict[str, str], default: str = "") -> Column:
    """Description of a section: its own where it is not blank, else the one listed, else the default."""
    return F.coalesce(F.nullif(ustrip(inline), F.lit("")), looked_up(section, described), F.lit(default))


def strip_suffix(c: Column, suffix: str = "Answer:") -> Column:
    """The text without a closing label."""
    return F.rtrim(F.regexp_replace(c, suffix + SPACE_CLASS + "*$", ""), F.lit(SPACES))


def strip_think_last(c: Column) -> Column:
    """What follows the last closing tag of any kind; the whole text without one; stripped."""
    tail = F.element_at(F.split(c, CLOSE_PATTERN), -1)
    return ustrip(tail)


def strip_think_exact(c: Column) -> Column:
    """What follows the last ``</think>``, stripped; without one the text as it is."""
    return F.when(c.contains("</think>"), ustrip(F.substring_index(c, "</think>", -1))).otherwise(c)


def strip_think_prefix(c: Column) -> Column:
    """A thinking block at the start cut at the first closing tag found in tag order; stripped."""
    s = F.ltrim(c, F.lit(SPACES))
    low = F.lower(s)
    opened = reduce(lambda x, y: x | y, [low.startswith(t.lower()) for t in OPEN_TAGS])
    cut = F.lit(None).cast("string")
    for tag in reversed(CLOSE_TAGS):
        at = F.instr(low, tag.lower())
        cut = F.when(at > 0, F.substr(s, at + len(tag))).otherwise(cut)
    return F.when(opened & cut.isNotNull(), ustrip(cut)).otherwise(ustrip(c))


def contains_close(c: Column) -> Column:
    """Whether any closing tag occurs."""
    return c.rlike(CLOSE_PATTERN)


def think_text(c: Column) -> Column:
    """The thinking between the first opening and the first closing tag; what precedes a closing
    tag alone, what follows an opening tag alone, nothing without tags."""
    low = F.lower(c)

    def first(tags: list[str]) -> Column:
        places = [F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in tags]
        return F.least(*places)

    begin, end = first(OPEN_TAGS), first(CLOSE_TAGS)
    size = F.lit(0)
    for t in reversed(OPEN_TAGS):
        size = F.when(F.nullif(F.instr(low, t.lower()), F.lit(0)) == begin, len(t)).otherwise(size)
    start = begin + size
    return (
        F.when(begin.isNotNull() & end.isNotNull() & (start <= end), F.substr(c, start, end - start))
        .when(end.isNotNull(), F.substr(c, F.lit(1), end - 1))
        .when(begin.isNotNull(), F.substr(c, start))
        .otherwise(F.lit(""))
    )


def explanation_text(c: Column, least: int = 10) -> Column:
    """Text between the last ``</think>`` and the box after it; empty unless longer than ``least``."""
    after = ustrip(F.substring_index(c, "</think>", -1))
    e = ustrip(F.substring_index(after, "\\boxed{", 1))
    return F.when(c.contains("</think>") & (F.length(e) > least), e).otherwise(F.lit(""))


def code_fence(c: Column) -> Column:
    """Inside of the first code fence, else the text; stripped."""
    s = ustrip(c)
    return F.when(s.rlike(FENCE), ustrip(F.regexp_extract(s, FENCE, 1))).otherwise(s)


def truncate_marker(c: Column, most: int, mark: str = CUT_MARK) -> Column:
    """Stripped text, cut to ``most`` - 32 characters plus a mark where it is longer."""
    s = text_or_empty(c)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substr(s, F.lit(1), F.lit(most - 32)), F.lit(SPACES)), F.lit(mark))).otherwise(s)


def render_template(template: str, values: dict[str, Column]) -> Column:
    """Named placeholders filled one after the other, in the order given: text put in for an
    earlier name can hold a later one and is then filled too."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def token_count_ws(c: Column) -> Column:
    """Number of words between white space."""
    s = text_or_empty(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, SPACE_CLASS + "+")))


def safe_name(c: Column, fallback: str = "model") -> Column:
    """A file name: other characters than letters, digits, dot, underscore and hyphen as one underscore."""
    s = F.trim(F.regexp_replace(text_or_empty(c), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def fmt_mean_err(mean: Column, err: Column) -> Column:
    """Mean and error with two decimals."""
    return F.format_string("%.2f±%.2f", mean, err)


def tuple_text(*parts: Column) -> Column:
    """Parts quoted as JSON strings, in brackets."""

    def quote(c: Column) -> Column:
        j = F.to_json(F.array(F.coalesce(c, F.lit(""))))
        return F.substr(j, F.lit(2), F.length(j) - 2)

    return F.concat(F.lit("("), F.concat_ws(", ", *[quote(p) for p in parts]), F.lit(")"))


def fallback_chain(*cs: Column) -> Column:
    """First present value; an empty text is present, null is not."""
    return F.coalesce(*cs)


def first_filled(*cs: Column) -> Column:
    """First value that is not blank, stripped."""
    return F.coalesce(*[F.nullif(ustrip(c), F.lit("")) for c in cs])


def coerce_bool(c: Column, default: bool = False) -> Column:
    """Boolean of the usual words; anything else is the default."""
    s = F.lower(ustrip(c.cast("string")))
    return F.when(s.isin("1", "true", "yes", "y", "on"), True).when(s.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def int_eq(a: Column, b: Column) -> Column:
    """Equality as whole numbers; false where either is none."""
    return F.coalesce(ustrip(a.cast("string")).try_cast("long") == ustrip(b.cast("string")).try_cast("long"), F.lit(False))


def stable_u32(seed: int | str, *parts: Column) -> Column:
    """Seeded 32-bit number of a row: first eight hexadecimal digits of the SHA-256 of the parts
    joined by the unit separator. The same in every engine and partitioning."""
    joined = F.concat_ws("\x1f", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.sha2(joined, 256), F.lit(1), F.lit(8)), 16, 10).cast("long")


def subsequence_at(ids: Column, pattern: list[int]) -> Column:
    """First place (from 0) of a run of ids, -1 if it does not occur."""
    n = len(pattern)
    if n == 0:
        return F.lit(-1)
    starts = F.when(F.size(ids) >= n, F.sequence(F.lit(1), F.size(ids) - n + 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(ids, i, n) == F.array(*[F.lit(x) for x in pattern]))
    return F.coalesce(F.get(hits, F.lit(0)) - 1, F.lit(-1))


def truncate_tokens_ws(c: Column, most: int, side: str = "right") -> Column:
    """First ``most`` words of a text, or its last with ``side`` left; a text that is short enough as it is."""
    if side not in ("left", "right"):
        raise ValueError("side is left or right: the one that is cut")
    parts = F.split(text_or_empty(c), SPACE_CLASS + "+")
    kept = F.slice(parts, 1, most) if side == "right" else F.slice(parts, F.greatest(F.size(parts) - most + 1, F.lit(1)), most)
    return F.when(F.size(parts) > most, F.array_join(kept, " ")).otherwise(c)


#: Entries of a list that stand for none.
NEUTRAL = ["none", "no", "null", "n/a", "na", "[]", "-"]


def clean_list(c: Column) -> Column:
    """Stripped entries of a list of texts, blank ones and those that stand for none left out; null gives none."""
    kept = F.filter(F.transform(c, ustrip), lambda x: (x != "") & ~F.lower(x).isin(NEUTRAL))
    return F.coalesce(kept, F.array().cast("array<string>"))


def clamped_int(c: Column, low: int, high: int, default: int = 0) -> Column:
    """A whole number of a text within bounds; the default where it is none."""
    return F.least(F.greatest(F.coalesce(ustrip(c.cast("string")).try_cast("long"), F.lit(default)), F.lit(low)), F.lit(high))


def answer_or_raw(predicted: Column, raw: Column) -> Column:
    """The predicted answer where it is not blank, else the raw output; stripped."""
    return F.coalesce(F.nullif(ustrip(predicted), F.lit("")), text_or_empty(raw))
