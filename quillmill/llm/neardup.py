"""Groups of records that share most of their content (problem 5).

Universe-partition pigeonhole. The word shingles of a text are its tokens; a hash cuts the token
universe into segments, their number set by the band of sizes a set falls into. Of two sets with
similarity t or more, the smaller one (a tokens, against b) misses at most
a - ceil(t / (1 + t) * (a + b)) tokens of the other. A segment that holds g of its tokens counts
g - 1 units through its pairs (a pair is the segment's subset; all pairs but one token's are its
one-deletion neighbourhood): while fewer than g - 1 of the segment's tokens are missing, a pair is
left whole. A segment with one token counts one unit. A set that asks with more units than tokens
may be missing must find at least (units - missing) of its pairs in every partner, so

* every set asks with the cheapest segments that reach the units it needs, priced by a counting
  sketch over the pairs of all sets: a pair in no other set costs nothing and is never asked for;
* the asked pairs (and single tokens, where needed) are indexed in blocks of bounded size in the
  shared folder, and every set is looked up in every block with all pairs of its segments;
* two sets that meet in fewer pairs than the pigeonhole demands are dropped at once, in memory, so
  chance meetings are never shuffled;
* so are two sets whose bitmaps (a bit for each token's hash) show that too many tokens of one are
  missing in the other. In large tables most keys are dear, sets ask with hardly more units than may
  be missing, and the demand alone lets chance meetings pass.

What is left is compared exactly, word by word. Exact copies are one set from the start.

Groups need no pair of every two members. Sets that ask with the same keys are first linked to one
representative, verified exactly; the look-up then passes over all sets of the looked-up set's own
group as one run, so a group of many near copies costs a star of pairs and not all of them, and
every link between different groups is still found.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm.prompts import WordHashes, jaccard, mix, scene_of, shingles, words
from quillmill.llm import sql
from quillmill.llm.registry import register
from quillmill.llm.sketch import count_sketch, set_batches, slot, slots_for
from quillmill.session import discard, materialize, scratch_path, short_shuffles, table, written

#: Counters of the sketch per set.
SLOTS_PER_SET = 64
#: Segments of the lowest band; each further band covers four times the sizes with four times the segments.
SEGMENTS = 64
#: Units asked for beyond the least number, so that chance meetings stay below the demand.
SPARE_UNITS = 6
#: A key that may be in more sets than this is dear: only sets that lack units without it ask for it.
DEAR = 300
#: Sets whose asks form a block (about 500 bytes each in a worker), its slots, sets looked up at
#: once, and meetings sorted at once.
BLOCK_SETS, BLOCK_SLOTS, SCAN_SETS, MEETINGS = 60_000, 1 << 22, 30_000, 1_000_000
#: Words of bitmaps compared at once (a few times 8 bytes each).
BITMAP_WORDS = 1 << 20
#: Bits of a set's bitmap for each of its words, on average, and the least and most of them.
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 4, 512, 8192
#: Asked keys of a set that may find it a representative; what they miss the look-up finds.
STAR_KEYS = 12


def segment_bits(size: np.ndarray) -> np.ndarray:
    """Number of hash bits that name a segment in the band of each size."""
    band = np.maximum(0, np.floor(np.log(np.maximum(size, 1) / SEGMENTS) / np.log(4)))
    return (np.log2(SEGMENTS) + 2 * band).astype(np.uint64)


class Keys:
    """Pairs within segments, and single tokens, of a batch of sets (rows of ordered hashes)."""

    def __init__(self, row: np.ndarray, h: np.ndarray, bits: np.ndarray) -> None:
        """``bits``: segment bits of every row."""
        seg = h >> (np.uint64(64) - bits[row])
        left, right = [], []
        for gap in range(1, len(h)):
            same = np.flatnonzero((row[gap:] == row[:-gap]) & (seg[gap:] == seg[:-gap]))
            if not len(same):
                break
            left.append(same)
            right.append(same + gap)
        self.row, self.h = row, h
        self.left = np.concatenate(left) if left else np.zeros(0, np.int64)
        self.right = np.concatenate(right) if right else np.zeros(0, np.int64)
        start = np.ones(len(h), bool)
        start[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])
        self.segment = np.cumsum(start) - 1  # number of the segment each token lies in
        self.pairs = mix(mix(h[self.left]) + h[self.right])
        self.singles = mix(h ^ np.uint64(0x5851F42D4C957F2D))


def _index_bits(size: np.ndarray, t: Fraction) -> np.ndarray:
    """Segment bits a set is indexed under: those of the smallest partner it may have, whose
    segments hold its own."""
    return segment_bits(np.ceil(size * float(t) - 1e-9))


def _asks(keys: Keys, size: np.ndarray, cost: np.ndarray, slots: int, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) each set asks with and the units of every row."""
    row, n_seg = keys.row, (keys.segment[-1] + 1 if len(keys.segment) else 0)
    need = size - np.ceil(size * float(2 * t / (1 + t)) - 1e-9).astype(np.int64) + 1
    tokens = np.bincount(keys.segment, minlength=n_seg)
    seg_row = np.zeros(n_seg, np.int64)
    seg_row[keys.segment] = row
    pair_seg, pair_cost = keys.segment[keys.left], cost[slot(keys.pairs, slots)].astype(np.float64)
    paid = np.where(pair_cost > 1, pair_cost, 0.0)
    full = np.bincount(pair_seg, paid, minlength=n_seg)
    worst = np.zeros(n_seg)
    np.maximum.at(worst, pair_seg, pair_cost)
    order = np.lexsort((pair_cost, pair_seg))
    first = np.full(n_seg, -1)
    first[pair_seg[order][::-1]] = order[::-1]  # cheapest pair of each segment
    least = np.where(first >= 0, pair_cost[first], np.inf)
    alone = tokens == 1
    single_cost = cost[slot(keys.singles, slots)].astype(np.float64)
    own = np.zeros(n_seg)
    own[keys.segment] = single_cost  # of use where the segment has one token
    # a segment with a dear pair asks with its cheapest pair alone, if that one is not dear
    reduced = ~alone & (worst > DEAR) & (least <= DEAR)
    units = np.where(alone | reduced, 1, tokens - 1)
    short = np.bincount(seg_row, units, minlength=len(size)) < need
    reduced &= ~short[seg_row]
    units = np.where(alone | reduced, 1, tokens - 1)
    price = np.where(alone, np.where(own > 1, own, 0.0), np.where(reduced, np.where(least > 1, least, 0.0), full))
    dear = np.where(alone, own > DEAR, ~reduced & (worst > DEAR))
    rate = price / units + np.where(dear, 1e9, 0.0)
    order = np.lexsort((rate, seg_row))
    run = np.cumsum(units[order])
    base = np.zeros(len(size), np.int64)
    starts = np.flatnonzero(np.concatenate(([True], seg_row[order][1:] != seg_row[order][:-1]))) if n_seg else np.zeros(0, np.int64)
    base[seg_row[order][starts]] = run[starts] - units[order][starts]
    before = run - units[order] - base[seg_row[order]]
    want = need[seg_row[order]]
    taken = np.zeros(n_seg, bool)
    taken[order] = np.where(dear[order], before < want, before < want + SPARE_UNITS)
    total = np.bincount(seg_row, np.where(taken, units, 0), minlength=len(size)).astype(np.int64)
    poor = total < need  # at low similarities segments may not have the units: such a set asks with every single token
    total = np.where(poor, size, total)
    use = taken[pair_seg] & (~reduced[pair_seg] | (first[pair_seg] == np.arange(len(pair_seg)))) & ~poor[row[keys.left]]
    lone = (taken[keys.segment] & alone[keys.segment]) | poor[row]
    return np.concatenate((row[keys.left][use], row[lone])), np.concatenate((keys.pairs[use], keys.singles[lone])), total


def bitmaps(row: np.ndarray, h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A row of ``bits`` bits for each of ``n`` sets, with the bit of each of its tokens set."""
    on = np.zeros(n * bits, bool)
    on[row * bits + (h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on.reshape(n, bits), axis=1).view(np.uint64)


class Block:
    """Asked keys of some sets, by slot; in a slot the sets of one group stand side by side, as a run."""

    def __init__(self, rows: pa.Table, linked: pa.Table) -> None:
        """``linked`` has (no, root) of the sets that have been linked to others."""
        self.no = rows["no"].to_numpy()
        self.size = rows["size"].to_numpy().astype(np.int64)
        self.units = rows["units"].to_numpy().astype(np.int64)
        self.bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(self.no), -1) if len(self.no) else np.zeros((0, 1), np.uint64)
        root = self.no.copy()
        who = linked["no"].to_numpy()
        order = np.argsort(who)
        place = np.searchsorted(who[order], self.no)
        known = np.flatnonzero(place < len(who))
        known = known[who[order][place[known]] == self.no[known]]
        root[known] = linked["root"].to_numpy()[order][place[known]]
        slots = [np.frombuffer(x, np.int32) for x in rows["slots"].to_pylist()]
        of = np.repeat(np.arange(len(slots)), [len(x) for x in slots])
        at = np.concatenate(slots) if slots else np.zeros(0, np.int32)
        order = np.lexsort((root[of], at))
        self.asks, at, group = of[order].astype(np.int64), at[order], root[of][order]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (group[1:] != group[:-1])))) if len(at) else np.zeros(0, np.int64)
        self.run = np.concatenate((new, [len(at)]))  # where each run of asks begins
        self.root = group[new]
        self.start = np.zeros(BLOCK_SLOTS + 1, np.int32)  # first run of each slot
        np.cumsum(np.bincount(at[new], minlength=BLOCK_SLOTS), out=self.start[1:])

    def meetings(self, row: np.ndarray, at: np.ndarray, no: np.ndarray, size: np.ndarray, root: np.ndarray, bits: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the smaller set, of the larger) that are in different groups, meet often
        enough and may be similar by their bitmaps; ``row`` and ``at`` are the rows and slots of the
        keys the larger sets hold, ordered by row, ``root`` the group of each set."""
        first = self.start[at].astype(np.int64)
        count = self.start[at + 1] - first
        hit = count > 0
        row, first, count = row[hit], first[hit], count[hit]
        which = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row = np.repeat(row, count)
        other = self.root[which] != root[row]
        row, which = row[other], which[other]
        first, count = self.run[which], self.run[which + 1] - self.run[which]
        total = np.cumsum(count)
        cut = 0
        while cut < len(row):  # whole rows, of bounded meetings together
            base = total[cut] - count[cut]
            end = max(int(np.searchsorted(total, base + MEETINGS, "right")), int(np.searchsorted(row, row[cut], "right")))
            end = int(np.searchsorted(row, row[end], "left")) if end < len(row) and row[end] == row[end - 1] and row[end] != row[cut] else end
            f, c = first[cut:end], count[cut:end]
            which = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())
            code = np.sort(np.repeat(row[cut:end], c) << 32 | self.asks[which])
            new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            met = np.diff(np.concatenate((new, [len(code)])))
            b, a = code[new] >> 32, code[new] & 0xFFFFFFFF
            na, nb, num, den = self.size[a], size[b], t.numerator, t.denominator
            missing = na + (-num * (na + nb)) // (num + den)
            ok = (met >= self.units[a] - missing) & ((na < nb) | (na == nb) & (self.no[a] < no[b])) & (nb * num <= na * den)
            a, b, missing, more = a[ok], b[ok], missing[ok], (nb - na)[ok]
            step = max(1, BITMAP_WORDS // bits.shape[1])
            near = [np.zeros(0, bool)]
            for i in range(0, len(a), step):
                s = slice(i, i + step)
                x, y = self.bits[a[s]], bits[b[s]]
                # a bit that only one of them has is a token that the other lacks
                near.append((np.bitwise_count(x & ~y).sum(axis=1) <= missing[s]) & (np.bitwise_count(y & ~x).sum(axis=1) <= missing[s] + more[s]))
            ok = np.concatenate(near)
            yield self.no[a[ok]], no[b[ok]]
            cut = end


_LOADED: dict[str, Block] = {}
_ASKS = pa.schema([("no", pa.int64()), ("size", pa.int32()), ("units", pa.int32()), ("slots", pa.binary()), ("bits", pa.binary())])
_LINKED = pa.schema([("no", pa.int64()), ("root", pa.int64())])


def _read(path: str, schema: pa.Schema) -> pa.Table:
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None).select(schema.names).cast(schema) for f in files] or [schema.empty_table()])


def _block(asks: str, linked: str | None, b: int) -> Block:
    """A block of asks from the shared folder; the last few stay in the worker."""
    name = f"{asks} {linked} {b}"
    if name not in _LOADED:
        while len(_LOADED) >= 2:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[name] = Block(_read(f"{asks}/block={b}", _ASKS), _read(f"{linked}/block={b}", _LINKED) if linked else _LINKED.empty_table())
    return _LOADED[name]


def _block_of(no: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(no.astype(np.uint64)) % np.uint64(blocks)).astype(np.int32)


def _links(sets: DataFrame, t: Fraction, k: int, block_sets: int, stars: bool) -> DataFrame:
    """(a, b), a < b, of texts with similarity ``t`` or more: all of them, or with ``stars`` enough
    of them to connect the same texts."""
    n, chars = sets.agg(F.count(F.lit(1)), F.avg(F.length("text"))).first()
    bits = 1 << int(np.clip(np.ceil(np.log2(BITS_PER_WORD * (chars or 0) / 6 + 1)), np.log2(LEAST_BITS), np.log2(MOST_BITS)))  # a word has about six characters
    spark = sets.sparkSession
    slots = slots_for(n, SLOTS_PER_SET)

    def keys_of(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        keys = Keys(row, h, _index_bits(size, t))
        return [keys.pairs, keys.singles]

    sent = spark.sparkContext.broadcast(count_sketch(sets, slots, keys_of, k))
    blocks = max(1, -(-n // block_sets))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, cost = WordHashes(), sent.value
        for pdf in batches:
            for part, row, h, size in set_batches(pdf, hashes, k):
                of, key, units = _asks(Keys(row, h, segment_bits(size)), size, cost, slots, t)
                asked = cost[slot(key, slots)] > 1
                of, key = of[asked], key[asked]
                order = np.argsort(of, kind="stable")
                cuts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(part)))))
                key = key[order]
                no = part["no"].to_numpy()
                first = [np.sort(key[x:y])[:STAR_KEYS].astype(np.int64) for x, y in zip(cuts[:-1], cuts[1:])]
                at = slot(key, BLOCK_SLOTS).astype(np.int32)
                seen = bitmaps(row, h, len(part), bits)
                out = {"no": no, "size": size, "units": units, "slots": [at[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], "bits": [x.tobytes() for x in seen], "first": first, "block": _block_of(no, blocks)}
                yield pd.DataFrame(out)[np.diff(cuts) > 0]

    asks = scratch_path(spark, "asks")
    schema = "no long, size int, units int, slots binary, bits binary, first array<long>, block int"
    sets.select("no", "text").mapInPandas(ask, schema).write.partitionBy("block").parquet(asks)
    texts = sets.select("no", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lru_cache(1000)(lambda x: shingles(x, k))  # rows come ordered by b
        for pdf in batches:
            ok = [jaccard(cut(x), cut(y)) >= t for x, y in zip(pdf["ta"], pdf["tb"])]
            yield pd.DataFrame({"a": pdf[["a", "b"]].min(axis=1)[ok], "b": pdf[["a", "b"]].max(axis=1)[ok]})

    def verified(candidates: DataFrame) -> DataFrame:
        both = candidates.join(texts.select(F.col("no").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("no").alias("b"), F.col("text").alias("tb")), "b")
        return both.mapInPandas(compare, "a long, b long")

    tasks = max(spark.sparkContext.defaultParallelism, -(-n // SCAN_SETS))
    star, linked, looked_up = None, None, texts.withColumn("root", F.col("no")).repartition(tasks)
    if stars:
        star = materialize(verified(materialize(_representatives(spark.read.schema(schema).parquet(asks)), "reps")), "star")
        root = connected_components(star).withColumnRenamed("node", "no")
        linked = scratch_path(spark, "linked")

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(block=_block_of(pdf["no"].to_numpy(), blocks))

        root.mapInPandas(placed, "no long, root long, block int").write.partitionBy("block").parquet(linked)
        roots = spark.read.schema("no long, root long, block int").parquet(linked).select("no", "root")
        looked_up = texts.repartition(tasks, "no").join(roots.repartition(tasks, "no"), "no", "left").select("no", "text", F.coalesce("root", "no").alias("root"))
        looked_up = looked_up.coalesce(tasks)  # the join may take more partitions; each task loads every block

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        waiting: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            pdf = pd.concat(waiting)
            waiting.clear()
            parts = []
            for part, row, h, size in set_batches(pdf, hashes, k):
                keys = Keys(row, h, _index_bits(size, t))
                of, key = np.concatenate((row[keys.left], row)), np.concatenate((keys.pairs, keys.singles))
                at = slot(key, BLOCK_SLOTS)
                held = sent.value[slot(key, slots)] > 1
                of, at = of[held], at[held]
                order = np.argsort(of, kind="stable")
                parts.append((of[order], at[order].astype(np.int32), part["no"].to_numpy(), size, part["root"].to_numpy(), bitmaps(row, h, len(part), bits)))
            for b in range(blocks):
                block = _block(asks, linked, b)
                for of, at, no, size, root, seen in parts:
                    for x, y in block.meetings(of, at, no, size, root, seen, t):
                        yield pd.DataFrame({"a": x, "b": y})

        for pdf in batches:
            waiting.append(pdf)
            if sum(map(len, waiting)) >= SCAN_SETS or sum(int(x["text"].str.len().sum()) for x in waiting) > SCAN_SETS * 1000:
                yield from flush()
        if waiting:
            yield from flush()

    candidates = materialize(looked_up.mapInPandas(scan, "a long, b long"), "candidates")
    for path in (asks, linked):
        if path:
            discard(path)
    return verified(candidates) if star is None else star.union(verified(candidates))


def _representatives(asks: DataFrame) -> DataFrame:
    """(a, b): every set with the one representative it shares most of its first asked keys with,
    where it shares two of them; a key's representative is the smallest number that asks with it."""
    keyed = asks.select("no", F.explode("first").alias("key"))
    rep = keyed.groupBy("key").agg(F.min("no").alias("rep"), F.max("no").alias("last")).where("rep < last").select("key", "rep")
    met = keyed.join(rep, "key").where("rep < no").groupBy("no", "rep").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    return met.groupBy("no").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("a")).select("a", F.col("no").alias("b"))


def similar_pairs(sets: DataFrame, t: Fraction = Fraction(1, 2), k: int = 3, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b): the numbers of all texts whose distinct ``k``-word shingles have Jaccard
    similarity ``t`` or more, a < b.

    ``sets`` has (no: bigint, text: string) and is read several times (a written table). Texts of
    fewer than ``k`` words are similar to none. Numbers must not repeat; texts may, but copies
    are better taken out first.
    """
    return _links(sets, t, k, block_sets, stars=False)


def connecting_pairs(sets: DataFrame, t: Fraction = Fraction(1, 2), k: int = 3, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b): similar texts as in `similar_pairs`, but only so many that they connect the same
    texts: of a group of near copies a star to their representative, and what links groups."""
    return _links(sets, t, k, block_sets, stars=True).distinct()


def distinct_sets(texts: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Members (no, rep) and one text per distinct shingle set (no, text, size), where ``rep`` is
    the smallest number with that set, ``text`` its words with single blanks between them and
    ``size`` its number of shingles. ``texts`` has (no, text); null numbers, and texts of fewer
    than ``k`` words, are in neither; a repeated number counts once."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            for part, row, h, size in set_batches(pdf, hashes, k):
                at = np.concatenate(([0], np.cumsum(size)))
                digest = [xxhash.xxh3_128_digest(h[at[i] : at[i + 1]].tobytes()) for i in range(len(part))]
                plain = [" ".join(words(x)) for x in part["text"]]
                out = pd.DataFrame({"no": part["no"], "set": digest, "text": plain, "size": size})
                yield out[size > 0]

    path = scratch_path(texts.sparkSession, "sets")
    rows = written(texts.where("no is not null and text is not null").select("no", "text").mapInPandas(keyed, "no long, set binary, text string, size int"), path)
    rep = rows.groupBy("set").agg(F.min("no").alias("rep"))
    member = materialize(rows.select("no", "set").join(rep, "set").groupBy("no").agg(F.min("rep").alias("rep")), "members")
    chosen = rows.join(member.where("no = rep").select("no"), "no").select("no", "text", "size").dropDuplicates(["no"])
    chosen = materialize(chosen, "texts")
    discard(path)
    return member, chosen


def near_duplicate_groups(texts: DataFrame, t: Fraction = Fraction(1, 2), k: int = 3) -> DataFrame:
    """(no, group_no) of every text in a group of two or more that are linked, directly or through
    others, by similarity ``t`` or more; ``group_no`` is the smallest number of the group.

    ``texts`` has (no: bigint, text: string). Null numbers and texts, and texts of fewer than
    ``k`` words, are in no group; a repeated number counts once; an empty table gives no rows.
    """
    with short_shuffles(texts.sparkSession):
        member, sets = distinct_sets(texts, k)
        comp = connected_components(connecting_pairs(sets, t, k))
        grouped = materialize(member.join(comp, member["rep"] == comp["node"], "left").select("no", F.coalesce("root", "rep").alias("group_no")), "grouped")
    several = grouped.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_no")
    return grouped.join(several, "group_no").select("no", "group_no")


def task_scenes(spark: SparkSession, d: str) -> DataFrame:
    """(no, text): the scene of every task, of its source row where the teacher's messages are missing."""
    scene = F.coalesce(scene_of(F.col("teacher_messages")), F.col("metadata.source_row.content"))
    return table(spark, d, "sft_task").select(F.col("task_no").alias("no"), scene.alias("text"))


@register("p5_found", sql.P5)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose scenes differ only by small edits, by group."""
    return near_duplicate_groups(task_scenes(spark, d)).select(F.col("no").alias("task_no"), "group_no")


@register("p5_sizes", sql.P5_SIZES)
def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of each size there are."""
    g = near_duplicate_groups(task_scenes(spark, d)).groupBy("group_no").agg(F.count(F.lit(1)).alias("tasks"))
    return g.groupBy("tasks").agg(F.count(F.lit(1)).alias("groups"))
