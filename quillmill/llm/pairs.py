"""Broken prompt and response pairs (problem 4).

A response is aligned with its prompt by the containment of word shingles and the longest common
subsequence with the question (copies), and with refusal templates by shingle containment
(refusals). Its language is compared with the prompt's by a letter-trigram model fitted on a
bounded, labelled sample of `documents`. Whether an unpunctuated end is a complete phrase or a
cut is told by corpus statistics over all responses, each counted once: how often its last words
end a sentence, and whether longer words continue a last word that nobody else uses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.prompts import question_of, scene_of, words
from quillmill.llm.registry import register
from quillmill.operators.ranking import top_by
from quillmill.session import materialize, table

#: Documents per language the language model is fitted on, whole texts; a label is a language if at
#: least this share of the labelled documents bears it (so there are at most 1 / share of them).
FIT_DOCS, LANGUAGE_SHARE = 300, 0.005
#: Least support and largest share of sentence ends at which the last words count as unfinished.
LEAST_SUPPORT, END_SHARE = 20, {"1": 0.015, "2": 0.015, "4": 0.004}
#: A word is unused if its uses are at most this share of its loose ends (nothing follows, no stop).
USED_SHARE = 0.05

#: Refusals, each the part that declines.
REFUSALS = [
    "I have to pass on this one",
    "I don't have opinions and can't judge what somebody meant",
    "I won't be able to assist here",
    "this is something I am unable to discuss",
    "it would not be appropriate for me to respond to this",
    "answering this goes against my guidelines",
    "I can't answer that",
    "I am not able to comment on other people's intentions",
    "I must decline to answer this question",
    "I cannot help with this request",
    "I cannot help with that",
    "I am unable to answer this question",
    "I am not able to answer this question",
    "I'm unable to assist with that",
    "I can't help with this",
    "I would rather not answer this",
    "As an AI language model I cannot",
    "Dazu kann ich leider keine Auskunft geben",
    "bei dieser Anfrage darf ich nicht helfen",
    "Als Sprachmodell kann ich dazu nichts sagen",
    "Diese Frage kann ich leider nicht beantworten",
    "Désolé, je ne peux pas aider sur ce point",
    "il m'est impossible de répondre à cette demande",
    "je ne peux pas répondre à cette question",
    "Como modelo de lenguaje, no puedo opinar sobre esta pregunta",
    "no puedo ayudar con esta solicitud",
    "no puedo responder a esta pregunta",
    "Lo siento, pero no puedo ayudar con eso",
]
#: What may stand around a refusal.
COURTESIES = [
    "Sorry",
    "Apologies",
    "Unfortunately",
    "I'm sorry, but",
    "I am sorry",
    "As an AI language model",
    "As an assistant",
    "Thank you for understanding",
    "Please ask something else",
    "Is there anything else I can do for you",
    "as it may involve private matters",
    "Es tut mir leid, aber",
    "Je regrette, mais",
    "Lo siento, pero",
]
#: Words that stand for a missing answer, and labels before an answer.
NOTHING = ["none", "null", "nil", "nan", "na", "n a", "undefined", "empty", "no answer"]
LABELS = ["answer", "response", "reply", "output", "antwort", "réponse", "reponse", "respuesta"]

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_BOX = re.compile(r"^\\boxed\s*\{(.*)\}$", re.S)
_OPEN_BOX = re.compile(r"^\\boxed\s*\{")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
_WHOLE = re.compile(r"[.!?。！？»”\"')\]}]$")
_MARK = re.compile(r"(?:…|\.\.\.|\[\.\.\.\]|\[truncated\]|<cut>|�)$")


def unboxed(answer: str | None) -> tuple[str, bool]:
    """The answer without its box, and whether the box was left open."""
    s = (answer or "").strip()
    if m := _BOX.match(s):
        return m.group(1).strip(), False
    return (_OPEN_BOX.sub("", s).strip(), True) if _OPEN_BOX.match(s) else (s, False)


def is_empty(s: str) -> bool:
    """No word is left without tags, labels and words that stand for nothing."""
    w = words(_TAG.sub(" ", s))
    while w and w[0] in LABELS:
        w = w[1:]
    return not w or " ".join(w) in NOTHING


def _grams(w: list[str], k: int) -> list[tuple[str, ...]]:
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def _covered(w: list[str], grams: set, k: int) -> np.ndarray:
    """Which words lie in a ``k``-gram that occurs in ``grams``."""
    out = np.zeros(len(w), bool)
    for i, g in enumerate(_grams(w, k)):
        if g in grams:
            out[i : i + k] = True
    return out


_REFUSAL_SETS = [set(_grams(words(t), 2)) for t in REFUSALS]
_KNOWN = {g for t in REFUSALS + COURTESIES for g in _grams(words(t), 2)} | {(w,) for t in COURTESIES if len(words(t)) == 1 for w in words(t)}


def is_refusal(s: str) -> bool:
    """A refusal template is contained, and little is said besides refusals and courtesies."""
    w = words(s)
    mine = set(_grams(w, 2))
    if not mine or max(len(t & mine) / len(t) for t in _REFUSAL_SETS) < 0.8:
        return False
    cover = _covered(w, _KNOWN, 2) | np.array([(x,) in _KNOWN for x in w])
    return cover.mean() >= 0.7


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit of ``a`` per machine word bit."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def is_copy(s: str, question: str, scene: str) -> bool:
    """The question is in the response, in order and nearly whole, and the rest of the response
    is text of the prompt or a few words around it."""
    q, w = words(question), words(s)
    if not q or not w or lcs(q, w) < 0.9 * len(q):
        return False
    k = min(3, len(q))
    if len(set(_grams(q, k)) & set(_grams(w, k))) < 0.8 * len(set(_grams(q, k))):
        return False
    rest = ~_covered(w, set(_grams(q, k)) | set(_grams(words(scene), 3)), k)
    return rest.sum() <= max(3, 0.1 * len(w))


def _plain_words(text: str) -> list[str]:
    """Words that start in lower case: names tell no language."""
    return [x for x in re.findall(r"[^\W\d_]+", text) if not x[0].isupper()]


def _trigrams(text: str) -> Iterator[str]:
    for w in _plain_words(text):
        p = f" {w} "
        for i in range(len(p) - 2):
            yield p[i : i + 3]


class Languages:
    """Letter-trigram model: which of the labelled languages a text is in."""

    def __init__(self, counts: list[tuple[str, str, int]]) -> None:
        """``counts``: (language, trigram, occurrences)."""
        by: dict[str, Counter] = {}
        for lang, g, n in counts:
            by.setdefault(lang, Counter())[g] += n
        self.names = sorted(by)
        grams = sorted({g for c in by.values() for g in c})
        self.at = {g: i for i, g in enumerate(grams)}
        m = np.array([[by[n][g] for g in grams] for n in self.names], float).reshape(len(self.names), len(grams)) + 0.5
        self.log = np.log(m / m.sum(1, keepdims=True)) if len(self.names) else m

    @classmethod
    def of_texts(cls, sample: list[tuple[str, str]]) -> Languages:
        """Fitted on (language, text)."""
        return cls([(lang, g, 1) for lang, text in sample for g in _trigrams(text)])

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        """Log-likelihood by language, and the trigrams it rests on."""
        ix = [self.at[g] for g in _trigrams(text) if g in self.at]
        return self.log[:, ix].sum(1), len(ix)

    def differ(self, prompt: str, answer: str, margin: float = 6.0) -> bool:
        """Whether the answer is clearly in another language than the prompt."""
        if len(self.names) < 2:
            return False
        p, n = self.scores(prompt)
        a, m = self.scores(answer)
        if not n or m < 5:
            return False
        home = int(np.argmax(p))
        return int(np.argmax(a)) != home and a.max() - a[home] > margin


def contexts(tokens: list[str], i: int) -> list[str]:
    """What is counted about a word at a possible end: the word, its pair, and what stands before
    its last two words."""
    out = ["1\t" + tokens[i]]
    if i:
        out.append(f"2\t{tokens[i - 1]} {tokens[i]}")
    if i >= 3 and tokens[i - 3][0].isalnum() and tokens[i - 2][0].isalnum():
        out.append(f"4\t{tokens[i - 3]} {tokens[i - 2]}")
    return out


def _tokens(s: str) -> list[str]:
    return [x.lower() for x in _TOKEN.findall(s)]


def _end_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    ends: Counter = Counter()
    follows: Counter = Counter()

    def out() -> pd.DataFrame:
        pdf = pd.DataFrame([(k, n, ends[k], follows[k]) for k, n in total.items()], columns=["context", "n", "ends", "follows"])
        for c in (total, ends, follows):
            c.clear()
        return pdf

    for pdf in batches:
        for a in pdf["answer"]:
            s, is_open = unboxed(a)
            t, kept = _tokens(s), _MARK.sub("", s).rstrip()
            head = _tokens(kept)
            final = max((i for i, x in enumerate(head) if x[0].isalnum()), default=-1)
            closed = not is_open and bool(_WHOLE.search(kept))
            for i, x in enumerate(t):
                if not x[0].isalnum():
                    continue
                last = i + 1 == len(t)
                for k in contexts(t, i):
                    total[k] += 1
                    ends[k] += last or t[i + 1] in ".!?"
                    follows[k] += i < final or (i == final and closed)
        if len(total) > 500_000:
            yield out()
    yield out()


def end_statistics(answers: DataFrame) -> DataFrame:
    """(context, n, ends, follows) over every position of every answer: how often the context
    occurs, ends a sentence or the answer, and is in use, that is followed by a word or at the end
    of a closed answer (a cut mark follows nothing)."""
    return (
        answers.select("answer").where("answer is not null").mapInPandas(_end_counts, "context string, n long, ends long, follows long")
        .groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("follows").alias("follows"))
    )


def word_fragments(tails: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, after) of the asked endings that are the beginning of a longer word.

    ``tails`` has (word, after): a last word and its pair as contexts of order 1 and 2; ``stats``
    are `end_statistics`. An ending is continued if words that begin with it stand after the same
    word at least as often as it ends there loosely. A word nobody uses is a fragment where it is
    continued, or if half of its endings are; a pair nobody uses is one if it is continued
    `LEAST_SUPPORT` times as often. All are ratios of counts, so more rows change nothing.
    """
    tails = tails.where("word is not null and after is not null").select("word", "after").distinct()
    pairs = stats.where(F.col("context").startswith("2\t"))
    text = F.substring_index("context", " ", -1)
    longer = (
        pairs.where("follows > 0").where(F.length(text) > 1)
        .select("follows", F.substring_index("context", " ", 1).alias("first"), text.alias("text"))
        .select("follows", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.concat("first", F.lit(" "), F.col("text").substr(F.lit(1), i)))).alias("after"))
        .join(tails.select("after").distinct(), "after", "left_semi").groupBy("after").agg(F.sum("follows").alias("longer"))
    )
    ending = pairs.select(F.col("context").alias("after"), (F.col("n") - F.col("follows")).alias("loose"), F.col("follows").alias("used"))
    word = stats.where(F.col("context").startswith("1\t")).select(F.col("context").alias("word"), (F.col("follows") <= USED_SHARE * (F.col("n") - F.col("follows"))).alias("unused"))
    asked = tails.join(ending, "after").join(longer, "after", "left").join(word, "word").withColumn("continued", F.coalesce(F.col("longer") >= F.col("loose"), F.lit(False)))
    most = asked.groupBy("word").agg((F.avg(F.col("continued").cast("int")) >= 0.5).alias("mostly"))
    alone = (F.col("used") <= USED_SHARE * F.col("loose")) & (F.coalesce("longer", F.lit(0)) >= LEAST_SUPPORT * F.col("loose"))
    return asked.join(most, "word").where((F.col("unused") & (F.col("continued") | F.col("mostly"))) | alone).select("word", "after")


def broken_pairs(pairs: DataFrame, prompts: DataFrame, model: Languages) -> DataFrame:
    """(pair, defect) of each defective pair, at most one defect a pair.

    ``pairs`` has (pair: any type, prompt: bigint, answer: string), ``prompts`` (prompt, question,
    scene); ``model`` tells languages apart (fewer than two: none). In this order a pair is
    empty (also a null answer), refusal, copy, truncated, language. A pair without its prompt is
    judged by its answer alone. Repeated pairs repeat their defect and count once in the statistics;
    no pairs give no rows.
    """
    languages = pairs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = languages.value
        for pdf in batches:
            rows = []
            for answer, question, scene in zip(pdf["answer"], pdf["question"], pdf["scene"]):
                question, scene = question or "", scene or ""
                s, is_open = unboxed(answer)
                tail: list[str] = []
                if is_empty(s):
                    defect = "empty"
                elif is_refusal(s):
                    defect = "refusal"
                elif is_copy(s, question, scene):
                    defect = "copy"
                elif is_open or _MARK.search(s) or s.count('"') % 2 or re.search(r"[,;:(\-–]$", s):
                    defect = "truncated"
                else:
                    defect = "language" if model.differ(question + " " + scene, s) else ""
                    if not _WHOLE.search(s):
                        t = _tokens(s)
                        if t[-1][0].isalnum():
                            tail = contexts(t, len(t) - 1)
                            if t[-1] not in set(words(question + " " + scene)):
                                tail[0] = "0" + tail[0][1:]
                rows.append((defect, tail))
            yield pd.DataFrame({"pair": pdf["pair"], "defect": [r[0] for r in rows], "tail": [r[1] for r in rows]})

    kind = dict(pairs.dtypes)["pair"]
    joined = pairs.select("pair", "prompt", "answer").join(prompts.select("prompt", "question", "scene"), "prompt", "left")
    judged = materialize(joined.mapInPandas(judge, f"pair {kind}, defect string, tail array<string>"), "judged")
    # a first context marked 0 is the last word where the prompt lacks it: unknown unless others use it on
    asked = judged.where("size(tail) > 0").select("pair", "defect", F.explode("tail").alias("asked")).withColumn("context", F.regexp_replace("asked", "^0\t", "1\t"))
    stats = materialize(end_statistics(pairs.select("pair", "prompt", "answer").dropDuplicates(["pair", "prompt", "answer"])), "endings")
    share = F.col("ends") / F.col("n")
    order = F.substring("context", 1, 1)
    low = F.lit(False)
    for k, most in END_SHARE.items():
        low = low | ((order == k) & (share < most))
    unfinished = F.coalesce((F.col("n") >= LEAST_SUPPORT) & low, F.lit(False)) | (
        F.col("asked").startswith("0\t") & (F.coalesce(F.col("follows") + F.col("ends") / 3, F.lit(0.0)) < 1)
    )
    after = F.get("tail", F.lit(1))
    tails = judged.where(F.get("tail", F.lit(0)).startswith("0\t")).select(
        "pair", F.regexp_replace(F.get("tail", F.lit(0)), "^0\t", "1\t").alias("word"), F.when(after.startswith("2\t"), after).alias("after")
    )
    fragments = tails.join(word_fragments(tails, stats), ["word", "after"], "left_semi").select("pair", F.lit("").alias("defect"), F.lit(True).alias("cut"))
    ends = asked.join(stats, "context", "left").select("pair", "defect", unfinished.alias("cut")).union(fragments).groupBy("pair").agg(F.max("defect").alias("d"), F.max("cut").alias("cut"))
    late = ends.select("pair", F.when(F.col("cut"), F.lit("truncated")).otherwise(F.col("d")).alias("defect"))
    return judged.where("size(tail) = 0").select("pair", "defect").union(late).where("defect <> ''")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, keep: str, answer: str) -> DataFrame:
        return table(spark, d, name).where(keep).select(
            F.struct(F.lit(name).alias("row_table"), F.col(key).alias("row_no")).alias("pair"), F.col("task_no").alias("prompt"), F.col(answer).alias("answer")
        )

    return of("audit_result", "audit_no", "scoring_mode = 'generation'", "model_answer").union(of("judge_result", "judge_no", "not passed", "corrected_answer"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("sft_messages")
    return table(spark, d, "sft_task").select(F.col("task_no").alias("prompt"), question_of(m).alias("question"), scene_of(m).alias("scene")).dropDuplicates(["prompt"])


def fit_languages(docs: DataFrame, per_language: int = FIT_DOCS, share: float = LANGUAGE_SHARE) -> Languages:
    """Language model of the labels that at least ``share`` of the labelled documents bear, fitted
    on ``per_language`` documents of each, whole texts. Trigrams are counted on the executors."""
    labelled = docs.where("lang is not null and length(text) > 100")
    size = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    enough = size.where(F.col("n") >= share * (size.agg(F.sum("n")).first()[0] or 0)).select("lang")
    drawn = top_by(labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")), ["lang"], [F.col("h")], per_language).join(enough, "lang", "left_semi").select("lang", "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                total.update((lang, g) for g in _trigrams(text))
        yield pd.DataFrame([(lang, g, n) for (lang, g), n in total.items()], columns=["lang", "gram", "n"])

    texts = labelled.select("doc_id", "lang", "text").join(drawn, ["lang", "doc_id"], "left_semi").select("lang", "text")
    rows = texts.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # trigrams of the fitted sample
    return Languages([(r["lang"], r["gram"], r["n"]) for r in rows])


@register("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective question and answer pairs with their defect."""
    found = broken_pairs(_pairs(spark, d), _prompts(spark, d), fit_languages(table(spark, d, "documents")))
    return found.select("pair.row_table", "pair.row_no", "defect").distinct()
