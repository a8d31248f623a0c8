"""Scene and question inside the user turn of a prompt, and words and shingles of a text."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")

#: Labels that open the scene and the question, and what ends the question, in any prompt layout.
SCENE = r"(?s)(?:^|\n)(?:#+ *Context|Context:|Scene:)\s*(.*?)\s*\n(?:#+ *Question|Question:|Q:)"
QUESTION = r"(?s)\n(?:#+ *Question|Question:|Q:)\s*(.*?)\s*(?:\n\n|\n#+ *Instructions|$)"


def user_turn(messages: Column) -> Column:
    """Content of the last user turn; null if there is none."""
    return F.get(F.reverse(F.filter(messages, lambda m: m["role"] == "user")), F.lit(0))["content"]


def scene_of(messages: Column) -> Column:
    """Scene of the user turn without labels; the whole turn if it has no label, null without a turn."""
    u = user_turn(messages)
    return F.when(u.rlike(SCENE), F.regexp_extract(u, SCENE, 1)).otherwise(u)


def question_of(messages: Column) -> Column:
    """Question of the user turn without labels and instructions; empty if it has no label."""
    return F.regexp_extract(user_turn(messages), QUESTION, 1)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def shingles(text: str | None, k: int = 3) -> set[tuple[str, ...]]:
    """Distinct runs of ``k`` consecutive words."""
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a: set, b: set) -> float:
    """Shared part of two sets; 0 if both are empty."""
    return len(a & b) / len(a | b) if a or b else 0.0


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 300_000) -> None:
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        out = []
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int = 3) -> np.ndarray:
    """Hash of every run of ``k`` word hashes, by its first place."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        step = np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)
        acc = mix(acc + step + h[j : len(h) - k + 1 + j])
    return acc


def shingle_table(texts: list[str | None], hashes: WordHashes, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``k``-word shingles of every text, ordered by row and hash."""
    flat: list[int] = []
    n_words = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = words(t)
        n_words[i] = len(ws)
        flat += hashes(ws)
    row = np.repeat(np.arange(len(texts)), n_words)
    acc = run_hashes(np.array(flat, np.uint64), k)
    if not len(acc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = row[: len(acc)] == row[k - 1 :]
    row, acc = row[: len(acc)][whole], acc[whole]
    order = np.lexsort((acc, row))
    row, acc = row[order], acc[order]
    first = np.ones(len(acc), bool)
    first[1:] = (row[1:] != row[:-1]) | (acc[1:] != acc[:-1])
    return row[first], acc[first]
