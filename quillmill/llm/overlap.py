"""Same or near-same records across splits (problem 2).

The evaluation texts are normalised and sharded; the word runs of each shard make an Aho-Corasick
automaton that every training text is scanned with. A text needs only so many of its runs as
patterns that a partner with the wanted similarity must hold some of them, and the rarest are
taken. The runs found in a training text are merged, per evaluation record, into coverage; a pair
whose coverage reaches what the similarity demands is compared exactly, over all its runs.

Copies are one text on either side until the end. The driver holds one shard of evaluation texts
at a time, of bounded size; training texts stay on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.neardup import distinct_sets
from quillmill.llm.prompts import WordHashes, jaccard, question_of, run_hashes, scene_of, shingles, words
from quillmill.llm import sql
from quillmill.llm.registry import register
from quillmill.llm.sketch import count_sketch, slot, slots_for
from quillmill.llm.splits import dataset_name
from quillmill.operators.ranking import global_rank
from quillmill.session import materialize, table

#: Evaluation words in one shard (its automaton takes about 70 bytes a word), and patterns a
#: record has beyond the least number.
SHARD_WORDS, SPARE_PATTERNS = 2_500_000, 3


def _patterns(batches: Iterator[pd.DataFrame], sketch: np.ndarray, t: Fraction) -> Iterator[pd.DataFrame]:
    """Of every evaluation text its size, the patterns it asks with (the rarest runs by the
    sketch) and their places, and how many of them any partner holds at least."""
    hashes = WordHashes()
    for pdf in batches:
        rows = []
        for no, text in zip(pdf["no"], pdf["text"]):
            ws = words(text)
            h, at = np.unique(run_hashes(np.array(hashes(ws), np.uint64)), return_index=True)
            a = len(h)
            lost = a - int(np.ceil(a * float(t) - 1e-9))
            number = min(a, lost + 1 + SPARE_PATTERNS)
            chosen = at[np.argsort(sketch[slot(h, len(sketch))], kind="stable")[:number]]
            rows.append((no, a, number, number - lost, "\n".join(" " + " ".join(ws[i : i + 3]) + " " for i in chosen), chosen.astype(np.int32).tobytes(), len(ws)))
        yield pd.DataFrame(rows, columns=["no", "size", "asked", "least", "patterns", "places", "words"])


def merged(places: list[int], k: int = 3) -> int:
    """Words covered by runs of ``k`` words that start at ``places``."""
    total, end = 0, -1
    for p in sorted(places):
        total += min(k, p + k - max(p, end)) if end > p else k
        end = p + k
    return total


def coverage(text: str, runs: set[tuple[str, ...]], k: int = 3) -> int:
    """Words of a text that lie in one of the runs of ``k`` words."""
    w = words(text)
    return merged([i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in runs], k)


class Shard:
    """Automaton over the patterns of some evaluation texts, and what each of them demands."""

    def __init__(self, rows: pd.DataFrame, t: Fraction) -> None:
        self.numbers, self.size, self.asked, self.least = (rows[c].to_numpy(np.int64) for c in ("no", "size", "asked", "least"))
        of: dict[str, int] = {}
        pattern, record, place = [], [], []
        for e, (ps, at) in enumerate(zip(rows["patterns"], rows["places"])):
            ps = ps.split("\n") if ps else []
            pattern += [of.setdefault(p, len(of)) for p in ps]
            record += [e] * len(ps)
            place.append(np.frombuffer(at, np.int32))
        ids = np.array(pattern, np.int64)
        order = np.argsort(ids, kind="stable")
        self.start = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(of)))))
        self.record = np.array(record, np.int32)[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int32))[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, n in of.items():
            self.automaton.add_word(p, n)
        if of:
            self.automaton.make_automaton()
        self.t = t

    def partners(self, text: str, size: int) -> list[tuple[int, int]]:
        """(evaluation number, covered words) of the records a normalised text may be similar to: h of
        the asked runs, each at a place of its own, cover at least h + 2 words."""
        if not len(self.record):
            return []
        found = np.fromiter({n for _, n in self.automaton.iter(text)}, np.int64)
        if not len(found):
            return []
        first, count = self.start[found], self.start[found + 1] - self.start[found]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        met = self.record[at]
        some, hits = np.unique(met, return_counts=True)
        enough = hits >= self.least[some]
        some, hits = some[enough], hits[enough]
        a, num, den = self.size[some], self.t.numerator, self.t.denominator
        shared = -(-num * (a + size) // (num + den))
        ok = (a * num <= size * den) & (size * num <= a * den)
        out = []
        for e, demanded in zip(some[ok], (self.asked[some] - (a - shared))[ok]):
            covered = merged(self.place[at[met == e]].tolist())
            if covered >= demanded + 2:
                out.append((int(self.numbers[e]), covered))
        return out


_BUILT: dict[str, Shard] = {}


def _scan(batches: Iterator[pd.DataFrame], name: str, rows: pd.DataFrame, t: Fraction) -> Iterator[pd.DataFrame]:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Shard(rows, t)
    built = _BUILT[name]
    for pdf in batches:
        rows = [(no, e, c) for no, text, n in zip(pdf["no"], pdf["text"], pdf["size"]) for e, c in built.partners(f" {text} ", n)]
        yield pd.DataFrame(rows, columns=["train", "eval", "covered"])


def cross_pairs(train: DataFrame, evaluation: DataFrame, t: Fraction = Fraction(1, 2), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train, eval, similarity, covered) of all pairs of a training and an evaluation text whose
    distinct runs of three words have Jaccard similarity ``t`` or more.

    Both tables have (no: bigint, text: string, size: int) as `distinct_sets` gives them (words
    with single blanks, number of shingles), no number twice, and are read several times.
    ``covered`` is how many words of the evaluation text lie in runs that the training text has
    too. Texts of fewer than three words are similar to none; empty tables give no rows.
    """
    spark = train.sparkSession
    sc = spark.sparkContext
    slots = slots_for(evaluation.count(), 64, most=1 << 22)
    sketch = sc.broadcast(count_sketch(evaluation, slots, lambda row, h, size: [h], 3))
    asked = evaluation.select("no", "text").mapInPandas(lambda b: _patterns(b, sketch.value, t), "no long, size int, asked int, least int, patterns string, places binary, words int")
    ranked = materialize(global_rank(asked, [F.col("no")], "k"), "evaluation")
    parts = ranked.groupBy(F.floor(F.col("k") / 1000).alias("b")).agg(F.sum("words").alias("w")).orderBy("b").collect()  # a row per thousand texts
    shards: list[list[int]] = []
    room = 0
    for r in parts:
        if not shards or room + r["w"] > shard_words:
            shards.append([r["b"], r["b"]])
            room = 0
        shards[-1][1] = r["b"]
        room += r["w"]
    found = None
    for s, (lo, hi) in enumerate(shards):
        sent = sc.broadcast(ranked.where(F.floor(F.col("k") / 1000).between(lo, hi)).drop("k", "words").toPandas())  # one shard
        name = f"{sc.applicationId}-{id(sent)}-{s}"
        scan = train.select("no", "text", "size").mapInPandas(lambda b, sent=sent, name=name: _scan(b, name, sent.value, t), "train long, eval long, covered int")
        some = materialize(scan, "found")
        sent.destroy()
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "train long, eval long, similarity double, covered int")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lru_cache(1000)(shingles)  # rows come ordered by eval
        for pdf in batches:
            pdf = pdf.assign(similarity=[jaccard(cut(x), cut(y)) for x, y in zip(pdf["ta"], pdf["tb"])])
            pdf = pdf[pdf["similarity"] >= float(t)]
            yield pdf.assign(covered=[coverage(y, cut(x)) for x, y in zip(pdf["ta"], pdf["tb"])])[["train", "eval", "similarity", "covered"]]

    both = found.select("train", "eval").join(train.select(F.col("no").alias("train"), F.col("text").alias("ta")), "train").join(evaluation.select(F.col("no").alias("eval"), F.col("text").alias("tb")), "eval")
    return both.mapInPandas(compare, "train long, eval long, similarity double, covered int")


def cross_split_classes(records: DataFrame, t: Fraction = Fraction(1, 2), shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similar texts of both sides, and who bears them: (train, eval, similarity, covered) between
    classes of equal texts, and (no, rep) of the training and of the evaluation records."""
    train_member, train = distinct_sets(records.where("split = 'train'"))
    eval_member, evaluation = distinct_sets(records.where("split in ('val', 'test')"))
    return materialize(cross_pairs(train, evaluation, t, shard_words), "pairs"), train_member, eval_member


def cross_split_pairs(records: DataFrame, t: Fraction = Fraction(1, 2), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(train_no, eval_no, similarity): every training record with every evaluation record it is a
    copy or near copy of.

    ``records`` has (no: bigint, split: string, text: string); splits val and test are evaluation,
    train is training, other and null splits are neither. A repeated number counts once a split.
    Null numbers and texts, and texts of fewer than three words, are similar to none.
    """
    pairs, train_member, eval_member = cross_split_classes(records, t, shard_words)
    return (
        pairs.join(train_member.select(F.col("rep").alias("train"), F.col("no").alias("train_no")), "train")
        .join(eval_member.select(F.col("rep").alias("eval"), F.col("no").alias("eval_no")), "eval")
        .select("train_no", "eval_no", "similarity")
    )


def overlapping_records(records: DataFrame, t: Fraction = Fraction(1, 2), shard_words: int = SHARD_WORDS) -> DataFrame:
    """(no, pairs, covered) of every evaluation record with a partner: how many training records
    are similar to it, and the most words of it that one of them covers. Copies are counted by
    class, never written out as pairs. ``records`` as in `cross_split_pairs`."""
    pairs, train_member, eval_member = cross_split_classes(records, t, shard_words)
    copies = train_member.groupBy(F.col("rep").alias("train")).agg(F.count(F.lit(1)).alias("copies"))
    per = pairs.join(copies, "train").groupBy("eval").agg(F.sum("copies").alias("pairs"), F.max("covered").alias("covered"))
    return eval_member.select("no", F.col("rep").alias("eval")).join(per, "eval").select("no", "pairs", "covered")


def _records(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("sft_messages")
    return table(spark, d, "sft_task").select(F.col("task_no").alias("no"), "split", F.concat_ws(" ", scene_of(m), question_of(m)).alias("text"))


@register("p2_found", sql.P2)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train task and a val or test task with the same or nearly the same scene and question."""
    p = cross_split_pairs(_records(spark, d))
    return p.select(F.least("train_no", "eval_no").alias("task_no_a"), F.greatest("train_no", "eval_no").alias("task_no_b"))


@register("p2_overlap", sql.P2_OVERLAP)
def p2_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source dataset: records, records with a partner, pairs."""
    tasks = table(spark, d, "sft_task").where("split in ('val', 'test')").groupBy("task_no").agg(F.min("split").alias("split"), F.min(dataset_name(F.col("source_dataset"))).alias("source_dataset"))
    per = overlapping_records(_records(spark, d)).select(F.col("no").alias("task_no"), "pairs")
    return tasks.join(per, "task_no", "left").groupBy("split", "source_dataset").agg(
        F.count(F.lit(1)).alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


@register("p2_coverage", sql.P2_COVERAGE)
def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every val or test task with a partner: how many, and the most words one of them covers."""
    return overlapping_records(_records(spark, d)).select(F.col("no").alias("task_no"), "pairs", "covered")
