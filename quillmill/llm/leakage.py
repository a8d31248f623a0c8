"""Evaluation passages inside training documents (problem 8).

A positional inverted index is built over the documents: for every word that serves as an anchor
the documents and positions it occurs at. Anchors are the rarest words of each run of twelve (by
document frequency over all documents), so every run an item could share with a document holds at
least two. Offset-adjusted position lists (position in the document less position in the passage)
are intersected from there; where two anchors of a run agree on an offset, the words between are
compared, which gives exact phrases. Proximity matches need a share of an item's anchors near one
another: the lists of so many of its rarest anchors are intersected that a match cannot do without
all of them, and what is left is measured over all anchors.

Test items are the query set: they are taken in blocks of bounded words and sent to the executors.
Nothing of the corpus reaches the driver but the document frequencies of one block's words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.prompts import words
from quillmill.llm import sql
from quillmill.llm.registry import register
from quillmill.operators.ranking import global_rank
from quillmill.session import materialize, table

RUN = 12
#: Anchors in every run, and words of passages sent to the executors at once (a longer passage goes alone).
ANCHORS, BLOCK_WORDS = 2, 500_000
#: Anchors in every run for proximity matches, where each may be missing, and anchors probed beyond the least number.
NEAR_ANCHORS, SPARE_ANCHORS = 4, 3
#: Finds of a document that are compared at once, and documents with finds that are broadcast; more are joined by shuffle.
FINDS, BROADCAST_DOCS = 1000, 500_000


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """(item_id, words) of all items with a passage of at least a run, blocks of about ``block_words`` at a time."""
    size = F.size(F.split("passage", r"[^\p{L}\p{N}]+"))
    kept = items.select("item_id", "passage", size.alias("n")).where("item_id is not null and passage is not null")
    ranked = materialize(global_rank(kept, [F.col("item_id"), F.col("passage")], "k"), "items")
    step = max(1, min(1000, block_words // 100))
    parts = ranked.groupBy(F.floor((F.col("k") - 1) / step).alias("p")).agg(F.sum("n").alias("n")).orderBy("p").collect()  # a row per ``step`` items
    room, first = 0, 0
    for i, r in enumerate(parts):
        room += r["n"]
        if i + 1 == len(parts) or room + parts[i + 1]["n"] > block_words:
            rows = ranked.where(F.col("k").between(first * step + 1, (i + 1) * step)).collect()  # at most a block
            yield [(x["item_id"], w) for x in rows if len(w := words(x["passage"])) >= RUN]
            room, first = 0, i + 1


def document_frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> dict[str, int]:
    """In how many documents each word of a bounded vocabulary occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                df.update(sent.value.intersection(words(t)))
        yield pd.DataFrame(list(df.items()), columns=["word", "n"])

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def anchor_positions(passage: list[str], df: dict[str, int], run: int = RUN, anchors: int = ANCHORS) -> list[int]:
    """Positions of the rarest words, at least ``anchors`` in every run of the passage."""
    rare = sorted(range(len(passage)), key=lambda i: (df.get(passage[i], 0), passage[i], i))
    rank = {i: r for r, i in enumerate(rare)}
    chosen: set[int] = set()
    for s in range(len(passage) - run + 1):
        chosen.update(sorted(range(s, s + run), key=rank.__getitem__)[:anchors])
    return sorted(chosen)


def positional_index(docs: DataFrame, vocabulary: frozenset[str]) -> DataFrame:
    """(word, doc_id, positions): postings of a bounded vocabulary over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                ws = words(t)
                at: dict[str, list[int]] = {}
                for p in [p for p, w in enumerate(ws) if w in sent.value]:
                    at.setdefault(ws[p], []).append(p)
                rows += [(w, i, p) for w, p in at.items()]
            yield pd.DataFrame(rows, columns=["word", "doc_id", "positions"])

    return materialize(docs.select("doc_id", "text").mapInPandas(index, "word string, doc_id long, positions array<int>"), "postings")


def _intersected(postings: DataFrame, anchors: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, item_id, at, positions): where an anchor (at: its place in the passage) meets a
    document. The anchors are those of one block, bounded by its words."""
    lists = postings.sparkSession.createDataFrame(anchors, "word string, item_id long, at int")
    return postings.join(F.broadcast(lists), "word").select("doc_id", "item_id", "at", "positions")


def _with_texts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text, found): the documents with finds, at most `FINDS` of them in a row."""
    found = materialize(found, "finds")
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("finds"))
    part = F.pmod(F.xxhash64(*[c for c in found.columns if c != "doc_id"]), 1 + F.floor(F.col("finds") / FINDS))
    listed = found.join(n, "doc_id").groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct(*[c for c in found.columns if c != "doc_id"])).alias("found"))
    ids = found.select("doc_id").distinct()
    few = ids.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")  # texts without finds are not shuffled
    return texts.join(listed, "doc_id").select("doc_id", "text", "found")


def _phrases(batches: Iterator[pd.DataFrame], passages: dict[int, list[list[str]]]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, found in zip(pdf["doc_id"], pdf["text"], pdf["found"]):
            ws = words(text)
            best: dict[int, int] = {}
            for f in found:
                for passage in passages[f["item_id"]]:
                    a, b = max(0, f["offset"]), min(len(ws), f["offset"] + len(passage))
                    same = np.array([ws[p] == passage[p - f["offset"]] for p in range(a, b)], bool)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
                    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
                    best[f["item_id"]] = max(run, best.get(f["item_id"], 0))
            rows += [(doc, i, n) for i, n in best.items() if n >= RUN]
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_run"])


def leaked_phrases(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, longest_run): documents with twelve or more consecutive words that are
    consecutive in the item's passage.

    ``docs`` has (doc_id, text), ``items`` (item_id, passage). Words are runs of letters and
    digits in lower case. Null texts, passages and ids match nothing, nor do passages of fewer
    than twelve words; a repeated id counts with its longest run; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, longest_run int")
    for some in item_blocks(items, block_words):
        if not some:
            continue
        df = document_frequencies(docs, frozenset(w for _, p in some for w in p))
        anchors = [(p[i], item, i) for item, p in some for i in anchor_positions(p, df)]
        postings = positional_index(docs, frozenset(a[0] for a in anchors))
        placed = _intersected(postings, anchors).select("doc_id", "item_id", "at", F.explode("positions").alias("place"))
        meets = placed.groupBy("doc_id", "item_id", (F.col("place") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
        found = meets.where(F.col("n") >= ANCHORS).select("doc_id", "item_id", "offset")
        passages: dict[int, list[list[str]]] = {}
        for item, p in some:
            passages.setdefault(item, []).append(p)
        sent = docs.sparkSession.sparkContext.broadcast(passages)
        exact = _with_texts(found, docs).mapInPandas(lambda b, s=sent: _phrases(b, s.value), "doc_id long, item_id long, longest_run int")
        out = out.union(exact)
    return out.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"))


def met_anchors(place: dict[str, list[int]], anchors: list[tuple[int, str]], slack: int) -> int:
    """Most anchors (place in the passage, word) that one document, its places by word, holds at
    offsets within two neighbouring cells of ``slack`` words."""
    at: dict[int, set[int]] = {}
    for i, w in anchors:
        for p in place.get(w, ()):
            c = (p - i) // slack
            at.setdefault(c, set()).add(i)
            at.setdefault(c + 1, set()).add(i)
    return max(map(len, at.values()), default=0)


def near_passages(docs: DataFrame, items: DataFrame, share: float = 0.5, slack: int = 16, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, met, anchors): proximity matches, where at least ``share`` of an item's
    anchors (and three) occur in a document at offsets within ``slack`` to twice that of each
    other, so that words inserted or left out do not hide a passage. Nulls, repeats and empty
    tables as in `leaked_phrases`; of several passages of an item the best met counts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, met int, anchors int")
    for some in item_blocks(items, block_words):
        if not some:
            continue
        df = document_frequencies(docs, frozenset(w for _, p in some for w in p))
        passages: list[tuple[int, list[tuple[int, str]], int]] = []
        probes: list[tuple[str, int, int]] = []
        least: list[tuple[int, int]] = []
        for no, (item, p) in enumerate(some):
            mine = [(i, p[i]) for i in anchor_positions(p, df, anchors=NEAR_ANCHORS)]
            need = max(3, math.ceil(share * len(mine) - 1e-9))
            passages.append((item, mine, need))
            rarest = sorted(mine, key=lambda a: (df.get(a[1], 0), a[1], a[0]))[: len(mine) - need + 1 + SPARE_ANCHORS]
            probes += [(w, no, i) for i, w in rarest]
            least.append((no, need - (len(mine) - len(rarest))))
        postings = positional_index(docs, frozenset(a[0] for a in probes))
        hit = _intersected(postings, probes).groupBy("doc_id", F.col("item_id").alias("no")).agg(F.count_distinct("at").alias("n"))
        enough = spark.createDataFrame(least, "no long, least int")  # a row per passage of the block
        found = hit.join(F.broadcast(enough), "no").where("n >= least").select("doc_id", "no")
        sent = spark.sparkContext.broadcast(passages)

        def measure(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for doc, text, listed in zip(pdf["doc_id"], pdf["text"], pdf["found"]):
                    place: dict[str, list[int]] = {}
                    for i, w in enumerate(words(text)):
                        place.setdefault(w, []).append(i)
                    for f in listed:
                        item, mine, need = sent.value[f["no"]]
                        if (met := met_anchors(place, mine, slack)) >= need:
                            rows.append((doc, item, met, len(mine)))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "met", "anchors"])

        out = out.union(_with_texts(found, docs).mapInPandas(measure, "doc_id long, item_id long, met int, anchors int"))
    best = F.max(F.struct(F.col("met") / F.col("anchors"), F.col("met"), F.col("anchors"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.met", "b.anchors")


@register("p8_found", sql.P8)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of an item's passage."""
    return leaked_phrases(table(spark, d, "documents"), table(spark, d, "bench_item")).select("doc_id", "item_id")


@register("p8_proximity")
def p8_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold much of an item's passage, edits included."""
    return near_passages(table(spark, d, "documents"), table(spark, d, "bench_item"))


@register("p8_items")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: in how many documents, and the longest run."""
    return leaked_phrases(table(spark, d, "documents"), table(spark, d, "bench_item")).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.max("longest_run").alias("longest_run")
    )
