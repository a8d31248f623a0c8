"""Filling training contexts of fixed token capacity with documents (problem 7).

Best-two-fit. Documents are cut into pools by a hash of their id, so that a pool fits one task
whatever the size of the collection; only the last context of a pool can stay open. Inside a pool
contexts are filled greedily, largest fitting document first; then the smallest document of a
context gives way to the two unpacked documents that fill its expanded gap more tightly.
A document above the capacity is split into full pieces and a rest; no other is split.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.registry import register
from quillmill.operators.ranking import global_rank
from quillmill.session import materialize, table

#: Folder of the public tokenizers' files, tokens of a training context, items of a pool.
TOKENIZERS = os.environ.get("QUILLMILL_TOKENIZERS", "/opt/tokenizers")
CAPACITY = 2048
POOL_ITEMS = 20_000

#: Fixed value: the pattern that cuts text for the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Sizes:
    """How many items of each size are unpacked, with the sizes in order."""

    def __init__(self, sizes: Iterator[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)

    def add(self, s: int, n: int) -> None:
        c = self.count.get(s, 0) + n
        if c:
            if s not in self.count:
                self.order.insert(bisect_right(self.order, s), s)
            self.count[s] = c
        else:
            del self.count[s]
            self.order.pop(bisect_right(self.order, s) - 1)

    def largest(self, room: int) -> int | None:
        """Largest unpacked size that fits; null if none does."""
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """The two unpacked sizes with the largest sum within ``room`` and above ``above``."""
        best, found = above, None
        i, j = 0, bisect_right(self.order, room) - 1
        while i <= j:
            a, b = self.order[i], self.order[j]
            if a + b > room:
                j -= 1
                continue
            if a + b > best and (a != b or self.count[a] > 1):
                best, found = a + b, (a, b)
                if best == room:
                    break
            i += 1
        return found


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Contexts as lists of sizes, each at most ``capacity`` in sum; every size is used once."""
    left = Sizes(iter(sizes))
    out = []
    while left.order:
        inside: list[int] = []
        room = capacity
        while (s := left.largest(room)) is not None:
            left.add(s, -1)
            inside.append(s)
            room -= s
        # the smallest gives way to two that leave less room
        while room and inside and left.order:
            s = inside[-1]
            two = left.best_two(room + s, s)
            if two is None:
                break
            inside.pop()
            left.add(s, 1)
            for x in two:
                left.add(x, -1)
            inside += sorted(two, reverse=True)
            inside.sort(reverse=True)
            room += s - sum(two)
        out.append(inside)
    return out


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens) of every document by a public byte-level vocabulary; whole texts, null and
    empty texts have no tokens. The vocabulary is read from ``folder`` on the executors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, tokens long")


def pack(items: DataFrame, capacity: int = CAPACITY, pool_items: int = POOL_ITEMS) -> DataFrame:
    """(pool, context, place, doc_id, piece, first_token, tokens): where every document lies.

    ``items`` has (doc_id: bigint, tokens: bigint). A document of more than ``capacity`` tokens is
    split into pieces of ``capacity`` and a rest; ``piece`` counts from 0. ``context`` counts
    within its pool, ``place`` within its context. Documents with a null id or without tokens lie
    nowhere; a repeated id is placed as often as it occurs; an empty table gives no rows.
    """
    if capacity < 1 or pool_items < 1:
        raise ValueError("capacity and pool_items must be at least 1")
    items = items.select("doc_id", "tokens").where("doc_id is not null and tokens > 0")
    cuts = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity))
    pieces = materialize(
        items.select("doc_id", "tokens", F.explode(cuts).alias("piece")).select(
            "doc_id", "piece", (F.col("piece") * capacity).alias("first_token"),
            F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("tokens"),
        ),
        "pieces",
    )
    whole = pieces.where(F.col("tokens") == capacity)
    rest = pieces.where(F.col("tokens") < capacity)
    pools = max(1, -(-rest.count() // pool_items))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        of: dict[int, list[int]] = {}
        for i, s in enumerate(pdf["tokens"].tolist()):
            of.setdefault(s, []).append(i)
        at, context, place = [], [], []
        for c, sizes in enumerate(best_two_fit(pdf["tokens"].tolist(), capacity)):
            for p, s in enumerate(sizes):
                at.append(of[s].pop())
                context.append(c)
                place.append(p)
        out = pdf.iloc[at].reset_index(drop=True)
        return out.assign(context=context, place=place)[NAMES] if len(out) else pd.DataFrame(columns=NAMES)

    pooled = rest.withColumn("pool", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(pools)).cast("long"))
    packed = pooled.groupBy("pool").applyInPandas(fill, COLUMNS)
    # a full piece is a context by itself, in a pool of its own kind, numbered one by one
    alone = global_rank(whole.select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("first_token").cast("long").alias("first_token"), "tokens"), [F.col("doc_id"), F.col("piece")], "k")
    return packed.union(alone.select(F.lit(-1).cast("long").alias("pool"), (F.col("k") - 1).alias("context"), F.lit(0).cast("long").alias("place"), "doc_id", "piece", "first_token", "tokens"))


COLUMNS = "pool long, context long, place long, doc_id long, piece long, first_token long, tokens long"
NAMES = ["pool", "context", "place", "doc_id", "piece", "first_token", "tokens"]


@register("p7_placement")
def p7_placement(spark: SparkSession, d: str) -> DataFrame:
    """Placement of all documents into contexts of 2048 tokens."""
    return pack(token_counts(table(spark, d, "documents")))


@register("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many contexts there are, and how full they are."""
    per = p7_placement(spark, d).groupBy("pool", "context").agg(F.sum("tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("contexts"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"))
