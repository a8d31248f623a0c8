"""Template residue, filler, error pages and script notices in place of content (problem 9).

Labelled exemplars of residue are kept in an inverted index from token to exemplar. A text is cut
into passage windows: lines and sentences, their parts, and every bracketed span or bare note. The
tokens of a sentence are its words; those of a span are its brackets and what kind of content they
hold (a field of a template, a word, a shouted note, ...), so that an exemplar stands for its form
with any name in it. The rarest tokens of a window retrieve exemplars; TF-IDF containment decides:
a window is residue if a phrase covers nearly all of its weight and is itself mostly there, or if
nearly all of its weight lies in a passage of filler. Token weights are document frequencies over
all documents. Spans directly in quotes are talked about and make no window.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.prompts import words
from quillmill.llm.registry import register
from quillmill.session import table

#: Least share of a window's weight that an exemplar covers, and of the exemplar's that the window holds.
WINDOW_SHARE, EXEMPLAR_SHARE = 0.75, 0.6
#: Least share of a window's weight that lies in a passage of filler, and words of such a window.
PASSAGE_SHARE, PASSAGE_WORDS = 0.8, 3
#: Largest share of documents in which the rarest word of a window of filler occurs.
PASSAGE_RARE = 0.05

#: Labelled exemplars, by kind.
EXEMPLARS = {
    "error": [
        "404 Not Found",
        "Page not found",
        "403 Forbidden",
        "500 - Internal error",
        "500 Internal Server Error",
        "502 Bad Gateway",
        "Error 503: service unavailable",
        "Gateway time-out (504)",
        "Request failed: code 429",
        "429 Too Many Requests",
        "401 Unauthorized",
        "Access denied",
        "Session expired",
        "This page is no longer available",
        "Seite nicht gefunden",
        "Zugriff verweigert",
        "Page introuvable",
        "Accès refusé",
        "Acceso denegado",
        "Página no encontrada",
        "The document you asked for could not be located on this server.",
        "Please go back and try again later.",
        "Something went wrong. Please try again later.",
        "Contact the administrator if the trouble persists.",
        "You do not have permission to view this item.",
        "The upstream service did not answer in time.",
        "Your login has run out.",
        "Sign in to continue reading.",
        "Bitte versuchen Sie es in einigen Minuten noch einmal.",
        "Veuillez patienter puis recharger la page.",
        "No tiene permiso para ver este recurso.",
    ],
    "script": [
        "Please enable JavaScript to view the full item.",
        "JavaScript is disabled.",
        "Turn it on and reload.",
        "JavaScript is required to view this page.",
        "Please enable JavaScript to view this page.",
        "Checking your browser before opening the page",
        "scripts and cookies must be allowed.",
        "Scripts are blocked; the dialogue cannot be shown.",
        "You need a browser with script support to read this scene.",
        "This viewer needs scripts to be switched on in your browser.",
        "Bitte aktivieren Sie JavaScript, um diesen Dialog zu lesen.",
        "Ce contenu exige que les scripts soient activés.",
        "Active JavaScript para ver esta escena.",
    ],
    "filler": [
        "Sample text goes here.",
        "Your scene description here.",
        "Your text here.",
        "Text follows.",
        "Replace this paragraph before publishing.",
        "Insert text here.",
        "This is placeholder text.",
    ],
    "placeholder": [
        "{{question}}", "{{word}}", "{{NAME}}", "${question}", "${word}", "${NAME}", "%(question)s", "%(word)s", "%(NAME)s", "%(question)d", "%(word)d", "%(NAME)d",
        "__question__", "__word__", "__NAME__", "@@question@@", "@@word@@", "@@NAME@@", "@@1@@", "<<question>>", "<<word>>", "<<NAME>>", "[[question]]", "[[word]]", "[[NAME]]",
        "{question}", "{word}", "{NAME}", "{0}", "[question]", "[NAME]", "<question>", "<NAME>", "***NAME***", "%s", "%d", "TODO", "TBD", "FIXME", "XXX",
    ],
}
#: Passages of filler; a window is filler if it is made of the words of one.
PASSAGES = [
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum pariat sintra mirabu quondam turpis consequa feru obita vestra nonest",
    "bla blah blub und and et y yada",
    "asdf qwer jklq jkl zxcv uiop hjkl qwerty asdfgh",
    "x xx xxx xxxx xxxxx xxxxxx xxxxxxx xxxxxxxx",
    "test testing 123 1234",
    "foo bar baz qux quux",
]
#: Names that fields of a template go by, and markup that is none.
FIELDS = (
    "context question answer domain listener speaker speaker_name section section_title n_turns reference reference_answer item "
    "item.text name first_name last_name placeholder tbd todo text title scene content category label input output prompt value"
).split()
MARKUP = (
    "a abbr answer_box article aside b blockquote body br button center code div dl dt em footer form h1 h2 h3 h4 h5 h6 head header hr html i img "
    "li link main meta nav ol p pre s script section_tag small span strong style sub sup table tbody td th thead tr u ul think"
).split()

_IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*")
_LOUD = re.compile(r"[A-Z][A-Z_]+(?: [A-Z][A-Z_]+)*|TODO:.*|(?:INSERT|YOUR|ADD|Insert|Your|Add) .+")
#: Brackets of template fields, longer ones first.
BRACKETS = [("{{", "}}"), ("${", "}"), ("%(", ")s"), ("%(", ")d"), ("<<", ">>"), ("[[", "]]"), ("***", "***"), ("@@", "@@"), ("__", "__"), ("{", "}"), ("[", "]"), ("<", ">")]
_SPAN = re.compile("|".join(rf"{re.escape(o)}[ \t]*([^\[\]{{}}<>\n]{{1,60}}?)[ \t]*{re.escape(c)}" for o, c in BRACKETS) + r"|%[sd]\b")
_FIRST = ["{", "[", "<", "%", "@", "*", "__"]
_OPENS = re.compile(r"[{\[<$%@*]|__")
_BARE = re.compile(r"(?m)^[ \t]*(?:[A-Za-z]+:[ \t]*)?(TODO|TBD|FIXME|XXX)\W*$")
_QUOTES = {"`": "`", '"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’"}
_NOTE = re.compile(r"TODO|TBD|FIXME|XXX")
#: Words, markup, and what ends a sentence or a part of one.
_TOKEN = re.compile(r"[^\W_]+|<[^<>\n]{1,40}>|\n|\.{3}|…|[.!?;](?=\s)")
_ENDS, _PART_ENDS = frozenset("\n.!?"), frozenset(["...", "…", ";"])


def _content(inner: str, bracket: str) -> str:
    """Kind of what a bracketed span holds."""
    if _LOUD.fullmatch(inner):
        return "loud"
    if inner.isdigit():
        return "digits"
    if not _IDENTIFIER.fullmatch(inner):
        return "text"
    if inner in MARKUP and bracket in ("<", "["):
        return "markup"
    return "field" if inner in FIELDS or ("_" in inner.strip("_") or "." in inner.strip(".")) and inner == inner.lower() else "word"


def spans(text: str) -> list[list[str]]:
    """Tokens of every bracketed span, format directive and bare note of a text, quoted ones left out."""
    out, last = [], 0
    for at in _OPENS.finditer(text) if any(c in text for c in _FIRST) else ():
        start = at.start()
        m = _SPAN.match(text, start) if start >= last else None
        before = text[start - 1] if start else " "
        if m is None or at.group() == "__" and (before.isalnum() or before == "_"):
            continue
        last = end = m.end()
        if start and end < len(text) and _QUOTES.get(before) == text[end]:
            continue
        if not m.lastindex:
            if not (before.isalnum() or before in "%_"):
                out.append([f"span {m.group()}"])
            continue
        o, c = BRACKETS[m.lastindex - 1]
        if not (o == "{" and (before.isalnum() or before in "_\\}") or o == "__" and text[end : end + 1].isalnum()):
            out.append([f"span {o}", f"span {_content(m.group(m.lastindex), o)}", f"span {c}"])
    return out + ([["span line", f"span {m.group(1)}"] for m in _BARE.finditer(text)] if _NOTE.search(text) else [])


def windows(text: str) -> list[list[str]]:
    """Words of every line or sentence of a text, markup aside, and of the parts of each."""
    tokens = _TOKEN.findall(text.lower())
    out: list[list[str]] = []
    sentence: list[str] = []
    lo, parts = 0, False
    for i in [*(i for i, x in enumerate(tokens) if x in _ENDS or x in _PART_ENDS or x[0] == "<"), len(tokens)]:
        part = tokens[lo:i]
        lo = i + 1
        if i < len(tokens) and tokens[i] in _PART_ENDS:
            parts = True
        if parts and part:
            out.append(part)
        sentence = sentence + part if sentence else part
        if i == len(tokens) or tokens[i] not in _PART_ENDS:
            if sentence and not (parts and len(sentence) == len(part)):
                out.append(sentence)
            sentence, parts = [], False
    return out


class Exemplars:
    """Inverted index over the exemplars with document-frequency weights."""

    def __init__(self, weight: dict[str, float], unknown: float) -> None:
        self.weight, self.unknown = weight, unknown
        self.rare = min(math.log(1 / PASSAGE_RARE) + 1, unknown)  # a window of filler has a word in so few documents
        self.entries: list[tuple[str, Counter, float]] = []  # kind, tokens, weight (0: a passage)
        self.index: dict[str, list[int]] = {}
        #: Words of which a text with residue in its sentences holds at least one.
        self.marks: set[str] = set()
        for kind, tokens, passage in labelled():
            c = Counter(tokens)
            for x in c:
                self.index.setdefault(x, []).append(len(self.entries))
            total = sum(self._w(x) * n for x, n in c.items())
            self.entries.append((kind, c, 0.0 if passage else total))
            self.marks |= {x for x in c if self._w(x) >= self.rare} if passage else self._needed(c, total)

    def _w(self, token: str) -> float:
        return self.weight.get(token, self.unknown)

    def _needed(self, tokens: Counter, total: float) -> set[str]:
        """Heaviest tokens without which too little of an exemplar is left to be found."""
        out, left = set(), total
        for x in sorted(tokens, key=self._w, reverse=True):
            if left < EXEMPLAR_SHARE * total:
                break
            out.add(x)
            left -= self._w(x) * tokens[x]
        return out

    def kind_of(self, window: list[str]) -> str | None:
        """Kind of the residue a window consists of; null if it is content."""
        index = self.index
        if 2 * sum(x in index for x in window) < len(window):
            return None
        c = Counter(window)
        known = [x for x in c if x in index]
        mass = sum(self._w(x) * n for x, n in c.items())
        asked = sorted(known, key=self._w, reverse=True)[:3]
        for e in sorted({e for x in asked for e in index[x]}):
            kind, other, total = self.entries[e]
            if total:
                shared = sum(self._w(x) * min(n, other[x]) for x, n in c.items() if x in other)
                if shared >= WINDOW_SHARE * mass and shared >= EXEMPLAR_SHARE * total:
                    return kind
            elif len(window) >= PASSAGE_WORDS and self._w(asked[0]) >= self.rare and sum(self._w(x) * n for x, n in c.items() if x in other) >= PASSAGE_SHARE * mass:
                return kind
        return None

    def kinds(self, text: str) -> set[str]:
        """Every kind of residue in a text."""
        asked = spans(text) if self.marks.isdisjoint(words(text)) else windows(text) + spans(text)
        return {k for w in asked if (k := self.kind_of(w))}


def labelled() -> Iterator[tuple[str, list[str], bool]]:
    """(kind, tokens, whether it is a passage) of every exemplar."""
    for kind, texts in EXEMPLARS.items():
        for t in texts:
            yield kind, spans(t)[0] if kind == "placeholder" else words(t), False
    for t in PASSAGES:
        yield "filler", words(t), True


_VOCABULARY = frozenset(w for _, tokens, _ in labelled() for w in tokens)


def _vocabulary_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, df = 0, Counter()
    for pdf in batches:
        for t in pdf["text"]:
            n += 1
            if not t:
                continue
            df.update(_VOCABULARY.intersection(words(t)) | _VOCABULARY.intersection(x for w in spans(t) for x in w))
    yield pd.DataFrame([("", n), *df.items()], columns=["token", "n"])


def fit_exemplars(docs: DataFrame) -> Exemplars:
    """Exemplar index weighted by the document frequencies of its own tokens over all texts (as
    many counts reach the driver as the exemplars have words)."""
    rows = docs.select("text").mapInPandas(_vocabulary_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = {r["token"]: r["n"] for r in rows}
    n = df.pop("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in _VOCABULARY}
    return Exemplars(idf, sum(idf.values()) / len(idf))


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds) of every document that holds residue; kinds is sorted.

    ``docs`` has (doc_id, text, any others); null and empty texts hold none. An id that occurs
    twice is judged twice. An empty table gives no rows.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(fit_exemplars(docs))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex = fitted.value
        for pdf in batches:
            rows = [(i, sorted(k)) for i, t in zip(pdf["doc_id"], pdf["text"]) if t and (k := ex.kinds(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "kinds"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(judge, f"doc_id {kind}, kinds array<string>")


@register("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue."""
    return residue(table(spark, d, "documents")).select("doc_id").distinct()


@register("p9_kinds")
def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source hold each kind of residue."""
    docs = table(spark, d, "documents")
    kinds = residue(docs).select("doc_id", F.explode("kinds").alias("kind")).distinct()
    return kinds.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("documents"))
