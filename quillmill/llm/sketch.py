"""Counting sketch over the keys of many sets, built on the executors in fixed-size slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from quillmill.llm.prompts import WordHashes, shingle_table

#: Texts handled at once in a task, counters of a slice they are merged in, and partitions that merge.
BATCH, SLICE, MERGERS = 2000, 4096, 64


def slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (key & np.uint64(slots - 1)).astype(np.int64)


def set_batches(pdf: pd.DataFrame, hashes: WordHashes, k: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each shingle, hash of each shingle, size of each set), a batch at a time."""
    for at in range(0, len(pdf), BATCH):
        part = pdf.iloc[at : at + BATCH]
        row, h = shingle_table(part["text"].tolist(), hashes, k)
        yield part, row, h, np.bincount(row, minlength=len(part))


def slots_for(n: int, per_set: int, least: int = 1 << 16, most: int = 1 << 24) -> int:
    """A power of two that gives each of ``n`` sets ``per_set`` counters, within bounds."""
    return 1 << int(np.clip(np.ceil(np.log2(max(1, per_set * n))), np.log2(least), np.log2(most)))


def count_sketch(sets: DataFrame, slots: int, keys_of: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], k: int) -> np.ndarray:
    """How many keys fall into each slot: at least the number of sets that hold a key of it.

    ``keys_of`` (row, hash, size) gives the keys of a batch, each once per set. ``slots`` counters
    of two bytes (saturating) reach the driver, whatever the number of sets.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = WordHashes(), np.zeros(slots, np.uint32)
        for pdf in batches:
            for _, row, h, size in set_batches(pdf, hashes, k):
                for x in keys_of(row, h, size):
                    at, n = np.unique(slot(x, slots), return_counts=True)
                    total[at] += n.astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        used = [i for i in range(slots // SLICE) if total[i * SLICE : (i + 1) * SLICE].any()]
        yield pd.DataFrame({"slice": used, "counts": [pack(total[i * SLICE : (i + 1) * SLICE].tobytes()) for i in used]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, total = zstandard.ZstdDecompressor().decompress, {}
        for pdf in batches:  # added up as they come: a merger holds its slices once, however many tasks there were
            for i, b in zip(pdf["slice"], pdf["counts"]):
                x = np.frombuffer(unpack(b), np.uint32)
                total[i] = total[i] + x if i in total else x.astype(np.uint64)
        yield pd.DataFrame({"slice": list(total), "counts": [np.minimum(x, 65535).astype(np.uint16).tobytes() for x in total.values()]})

    counted = sets.select("text").mapInPandas(count, "slice int, counts binary")
    out = np.zeros(slots, np.uint16)
    for r in counted.repartition(MERGERS, "slice").mapInPandas(add, "slice int, counts binary").collect():  # two bytes a slot
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint16)
    return out
