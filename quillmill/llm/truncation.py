"""Text cut off by field limits or mid-transfer (problem 3).

The length of every text is taken under several encodings (characters, UTF-8 bytes, UTF-16
units, entity-escaped, JSON-escaped, with CR LF line ends). Counted per source and encoding, a
hidden storage limit stands out as one length far more frequent than the lengths around it; a
length that is one only because texts at another limit share it is dropped.

Then the endings are inspected. An open structure or a cut mark is a cut wherever it is, a closed
one, a verdict and a full stop never are. What the other endings mean (a word without a stop, a
list line, a bare word) is told by the limits: the share of an ending among texts at limits is set
against its share among texts away from them. An ending that cutting makes common is a cut
anywhere, mid-transfer cuts included; one that is in excess at one limit only is a cut there.
Without limits in the table these endings tell nothing and count as complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import sql
from quillmill.llm.registry import register
from quillmill.session import materialize, table

#: A length is a limit if it is this many standard deviations (and this many rows) above its surroundings.
SIGMAS, SPARE_ROWS, AROUND = 6.0, 6, 20
#: An ending is one that cutting makes if its share at limits is this many times its share elsewhere.
LIFT = 4.0
#: Endings whose meaning the limits tell.
LEARNED = ["loose", "list", "bare"]
#: Characters of the last line that a verdict and its label can take.
VERDICT_END = 80
#: Fixed value: what is blank at the end of a text.
BLANKS = " \t\r\n\u00a0\u200b"
#: Encodings in the order in which one is named where several agree on a length.
ENCODINGS = ["chars", "utf8", "utf16", "crlf", "json", "entities"]

#: Marks that a transfer leaves where it cut a text.
CUT_MARKS = ["…", "...", "[...]", "[…]", "[truncated]", "[cut]", "<cut>", "<truncated>", "(truncated)", "�"]


def _count(c: Column, what: str) -> Column:
    """How often the string ``what`` occurs in ``c``."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what)))) / F.lit(len(what))).cast("int")


def lengths(c: Column) -> dict[str, Column]:
    """Length of a text under each encoding a store may have measured it in."""
    n, quotes, breaks = F.length(c), _count(c, '"'), _count(c, "\n")
    return {
        "chars": n,
        "utf8": F.octet_length(c),
        "utf16": (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"),
        "entities": n + 4 * _count(c, "&") + 3 * (_count(c, "<") + _count(c, ">")) + 5 * (quotes + _count(c, "'")),
        "json": n + quotes + breaks + _count(c, "\\") + _count(c, "\t") + _count(c, "\r"),
        "crlf": n + breaks,
    }


def _measures(texts: DataFrame) -> DataFrame:
    """``texts`` without its text, with its lengths in the order of `ENCODINGS` and its ending."""
    x = F.col("text")
    of = lengths(x)
    further = [c for c in texts.columns if c != "text"]
    sized = texts.where(x.isNotNull() & (x != "")).select(*further, F.array(*[of[e].cast("int") for e in ENCODINGS]).alias("_lengths"), F.trim(x, F.lit(BLANKS)).alias("_t"))
    lined = sized.withColumns({"_last": F.substring_index("_t", "\n", -1), "_plain": _unescaped(F.col("_t"))})
    return lined.select(*further, "_lengths", _shape(F.col("_t"), F.col("_last"), F.col("_plain")).alias("_shape"))


def _limits(measured: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(e) for e in ENCODINGS])
    spread = measured.select("source", F.posexplode("_lengths").alias("_e", "length"))
    counts = spread.groupBy("source", "_e", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("encoding", F.get(names, F.col("_e")))
    near = Window.partitionBy("source", "encoding").orderBy("length").rangeBetween(-AROUND, AROUND)
    expected = (F.sum("n").over(near) - F.col("n")) / F.lit(2.0 * AROUND)
    return counts.withColumn("expected", expected).where(_beyond(F.col("n"), F.col("expected"))).select("source", "encoding", "length", "n", "expected")


def _beyond(n: Column, expected: Column) -> Column:
    """Whether a count is far above what is expected."""
    return n > expected + SIGMAS * F.sqrt(expected) + SPARE_ROWS


def hidden_limits(texts: DataFrame) -> DataFrame:
    """(source, encoding, length, n, expected): lengths so frequent that a limit must be behind them.

    ``texts`` has (source, text). Null and empty texts have no length; an empty table no limits.
    Of encodings that agree on a length (plain text is as long in all) all are reported.
    """
    x, of = F.col("text"), lengths(F.col("text"))
    return _limits(texts.where(x.isNotNull() & (x != "")).select("source", F.array(*[of[e].cast("int") for e in ENCODINGS]).alias("_lengths")))


def _unescaped(t: Column) -> Column:
    """A text without the escapes of a JSON string."""
    return F.replace(F.replace(t, F.lit("\\\\")), F.lit('\\"'))


def _open_structure(t: Column, last: Column, plain: Column) -> Column:
    """Whether a fence, thinking block, box, quotation, parenthesis or JSON value is left open at the end."""
    outside = F.regexp_replace(plain, r'"[^"]*"', "")
    opens = (_count(outside, "{") > _count(outside, "}")) | (_count(outside, "[") > _count(outside, "]"))
    json = t.startswith("{") | t.startswith("[") | t.startswith("```")
    box = F.substring_index(t, "\\boxed{", -1)
    return (
        (_count(t, "```") % 2 == 1)
        | (t.startswith("<think>") & ~t.contains("</think>"))
        | (_count(plain, '"') % 2 == 1)
        | F.when(json, opens).otherwise(F.lit(False))
        | F.when(t.contains("\\boxed{"), ~box.contains("}")).otherwise(F.lit(False))
        | (last.contains("(") & ~F.substring_index(last, "(", -1).contains(")"))
    )


def shape(text: Column) -> Column:
    """How a text ends: ``mark`` (a cut mark), ``open`` (in a structure), ``verdict``, ``closed`` (a
    structure), ``stop`` (a sentence), ``list`` (a list line without a stop), ``bare`` (a single
    word) or ``loose`` (anything else); null for a blank text."""
    t = F.trim(text, F.lit(BLANKS))
    return _shape(t, F.substring_index(t, "\n", -1), _unescaped(t))


def _shape(t: Column, last: Column, plain: Column) -> Column:
    marked = F.lit(False)
    for m in CUT_MARKS:
        marked = marked | t.endswith(m)
    end = F.substr(last, F.greatest(F.length(last) - VERDICT_END, F.lit(1)))  # enough for a verdict and its label
    label = F.when(F.length(last) <= VERDICT_END, end.rlike(r"(?i)^\W*(?:yes|no)\W*$")).otherwise(F.lit(False))
    verdict = label | end.rlike(r"(?i)(?:[:*\"{]\s*|\b(?:answer|verdict|judge?ment|decision)\b[^.]{0,20}\s)(?:yes|no)\W*$") | end.rlike(r"(?i)\bconfidence:?\s+\d+\W*$")
    closed = t.startswith("```") | t.startswith("{") | t.startswith("[") | t.endswith("}") | t.endswith("`")
    stop = F.substr(t, F.length(t), F.lit(1)).isin(list(".!?。！？»”\"')]"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string"))
        .when(marked, F.lit("mark"))
        .when(_open_structure(t, last, plain), F.lit("open"))
        .when(verdict, F.lit("verdict"))
        .when(closed, F.lit("closed"))
        .when(stop, F.lit("stop"))
        .when(last.rlike(r"^\s*(?:[-*•]|\d+[.)])\s"), F.lit("list"))
        .when(last.rlike(r"^\W*\w+\W*$") & (F.length(last) == F.length(t)), F.lit("bare"))
        .otherwise(F.lit("loose"))
    )


def _at_limits(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``_at``, the limit a row sits at: of several the one most rows share."""
    order = F.array(*[F.lit(e) for e in ENCODINGS])
    rank = (-F.array_position(order, F.col("encoding"))).cast("int")
    held = limits.groupBy(F.col("source").alias("_source")).agg(F.collect_list(F.struct("n", rank.alias("r"), "encoding", "length", "expected")).alias("_limits"))  # a few per source
    mine = F.filter(F.coalesce("_limits", F.array()), lambda q: F.get(F.col("_lengths"), -q["r"] - 1) == q["length"])
    return measured.join(held, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_at", F.array_max(mine)).drop("_source", "_limits", "_lengths")


def cutting_endings(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shape) of the endings that are cuts anywhere, and (source, encoding, length, shape) of those
    that are cuts at one limit.

    ``counts`` has (source, encoding, length, expected, shape, n): how many rows end so at a limit,
    or away from limits where encoding is null.
    """
    away = counts.where("encoding is null").groupBy("shape").agg(F.sum("n").alias("away"))
    all_away = counts.where("encoding is null").agg(F.sum("n")).first()[0] or 1
    at = counts.where("encoding is not null")
    own = at.groupBy("source", "encoding", "length", "expected").agg(F.sum("n").alias("own")).where(_beyond(F.col("own"), F.col("expected")))  # not the echo of another limit
    real = at.join(own.select(F.col("source").alias("_s"), F.col("encoding").alias("_c"), F.col("length").alias("_l")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("encoding") == F.col("_c")) & (F.col("length") == F.col("_l"))).drop("_s", "_c", "_l")
    real = real.where(F.col("shape").isin(LEARNED)).join(away, "shape", "left")
    share = F.coalesce(F.col("away") / all_away, F.lit(0.0))
    here = real.where(_beyond(F.col("n"), F.col("expected") * share)).select("source", "encoding", "length", "shape")
    pooled = real.groupBy("shape").agg(F.sum("n").alias("n"), F.first(share).alias("share"))
    usual = (own.agg(F.sum("own")).first()[0] or 0) * F.col("share")
    return pooled.where(_beyond(F.col("n"), usual) & (F.col("n") >= LIFT * usual)).select("shape"), here


def truncated_records(records: DataFrame) -> DataFrame:
    """The rows of ``records`` (source, text, further columns) whose text is cut off, without the
    text, with ``encoding`` and ``limit_length`` of the limit they sit at (null if they were cut
    elsewhere) and ``ending``.

    Null, empty and blank texts are no cases. Repeated rows stay repeated. A null source is a
    source of its own. Further columns are kept, whatever their names, but for those called
    encoding, limit_length or ending, which are dropped.
    """
    records = records.drop("encoding", "limit_length", "ending")
    further = [c for c in records.columns if c not in ("source", "text")]
    own = iter(range(len(further)))
    records = records.toDF(*[c if c in ("source", "text") else f"_x{next(own)}" for c in records.columns])
    measured = materialize(_measures(records), "measured")
    placed = _at_limits(measured, materialize(_limits(measured), "limits")).where("_shape is not null")
    counts = materialize(
        placed.groupBy("source", "_at.encoding", "_at.length", "_at.expected", F.col("_shape").alias("shape")).agg(F.count(F.lit(1)).alias("n")), "endings"
    )
    anywhere, here = cutting_endings(counts)
    learned = [r["shape"] for r in anywhere.collect()]  # at most the learned endings
    here = here.select(F.col("source").alias("_source"), F.col("encoding").alias("_e"), F.col("length").alias("_l"), F.col("shape").alias("_s"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at.encoding") == F.col("_e")) & (F.col("_at.length") == F.col("_l")) & (F.col("_shape") == F.col("_s"))
    return (
        placed.where(F.col("_shape").isin("mark", "open", *LEARNED))
        .join(here, same, "left")
        .where(F.col("_shape").isin("mark", "open", *learned) | F.col("_s").isNotNull())
        .select("source", *[F.col(f"_x{i}").alias(c) for i, c in enumerate(further)], F.col("_at.encoding").alias("encoding"), F.col("_at.length").alias("limit_length"), F.col("_shape").alias("ending"))
    )


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str) -> DataFrame:
        return table(spark, d, name).where("raw_output <> ''").select(
            F.lit(name).alias("row_table"), F.col(key).alias("row_no"), F.col("backend").alias("source"), F.col("raw_output").alias("text")
        )

    return of("audit_result", "audit_no").union(of("judge_result", "judge_no"))


@register("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose raw output is cut off."""
    return truncated_records(_outputs(spark, d)).select("row_table", "row_no").distinct()


@register("p3_rates")
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Cut rate of each backend over its non-empty outputs."""
    out = _outputs(spark, d)
    total = out.groupBy("row_table", "row_no", "source").agg(F.lit(1)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    cut = truncated_records(out).groupBy("row_table", "row_no", "source").agg(F.lit(1)).groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("cut"))
    j = total.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    return j.select(F.col("source").alias("backend"), "n", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("n")).alias("cut_rate"))


@register("p3_limits", sql.P3_LIMITS)
def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits by backend and encoding."""
    return materialize(hidden_limits(_outputs(spark, d)), "limits")
