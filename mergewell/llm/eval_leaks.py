"""Evaluation passages inside training text (problem 8).

Windows of as many words as a passage has are compared by edit distance. The CGK random walk embeds a window into twice its length,
so that windows at small edit distance get embeddings at small Hamming distance: step j writes the word under the
cursor and moves the cursor on if a random bit of (j, word) says so. Bit sampling takes a few positions of the embedding as
a bucket key; repetitions with walks and samples of their own raise the recall to its target. Windows that
share a bucket are compared exactly, so precision is 1. Equal windows have equal embeddings under every walk, so a passage
without any edit is always found.

The random bits come from a hash of step and word, so no table grows with the vocabulary. The items' buckets are a table
that windows of documents meet in a join by bucket. Two bit filters of bounded size save work and change no result: one lets only windows
walk that have a run of words in common with an item, without which they are too many edits away; the other lets only windows
into the join whose bucket an item has. The corpus is read once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mergewell.runtime import cut

#: log2 of the most bits of a filter: 32 MB are broadcast at most. A fuller filter lets more windows through to the join and changes no result.
FILTER_BITS = 28
#: Bits by which a key must tell one window from all item windows, and bits that one sampled position is worth.
SELECTIVE, WORTH = 10, 5
#: Simulated pairs of windows from which the number of repetitions follows.
TRIALS = 4000
#: Words hashed at a time, and hashes that a task remembers.
CHUNK, MEMO = 1 << 19, 1 << 20
_WORDS = re.compile(r"[^\W_]+").findall
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The maximal runs of letters and digits, in lower case."""
    return _WORDS(text.lower()) if text else []


class _Hashes(dict):
    """The 64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return h


def _mix(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    key = (key ^ symbol) * _ODD
    return key ^ (key >> np.uint64(29))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Insertions, deletions and substitutions between the windows in the rows of a and of b, for all pairs at once."""
    n, m = a.shape[1], b.shape[1]
    row = np.repeat(np.arange(m + 1, dtype=np.int16)[None], len(a), 0)
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        differ = (b != a[:, i - 1 : i]).astype(np.int16)
        for j in range(1, m + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + differ[:, j - 1])
        row = new
    return row[:, m]


@dataclass
class Sketch:
    """The walks and samples of all repetitions."""

    width: int
    salts: np.ndarray  # repetitions x steps
    at: np.ndarray  # repetitions x samples, ascending

    @classmethod
    def of(cls, width: int, sampled: int, repetitions: int, seed: int) -> Sketch:
        rng = np.random.default_rng(seed)
        steps = 2 * width
        salts = rng.integers(1, 2**63, (repetitions, steps)).astype(np.uint64)
        # One position from each of as many equal stretches: neighbours would often hold the same word.
        edges = np.linspace(0, steps, min(sampled, steps) + 1).round().astype(np.int64)
        return cls(width, salts, np.stack([rng.integers(edges[:-1], edges[1:]) for _ in range(repetitions)]))

    def keys(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The bucket keys, windows x repetitions, of the windows of symbols that start at begin."""
        out = np.empty((len(begin), len(self.at)), np.uint64)
        end, last = begin + self.width, max(len(symbols) - 1, 0)
        for r, at in enumerate(self.at):
            cursor, key, n = begin.copy(), np.full(len(begin), self.salts[r, 0]), 0
            for j in range(int(at[-1]) + 1):
                inside = cursor < end
                now = np.where(inside, symbols[np.minimum(cursor, last)], np.uint64(0))
                if j == at[n]:
                    key = _mix(key, now)
                    n += 1
                move = (((now ^ self.salts[r, j]) * _ODD) >> np.uint64(63)).astype(bool)
                cursor += move & inside
            out[:, r] = key
        return out


def repetitions_for(width: int, edits: int, sampled: int, recall: float, seed: int = 7, most: int = 64) -> int:
    """Repetitions after which two windows ``edits`` apart have met with probability ``recall``, by simulation.

    Windows differ by substitutions or, where the edits suffice, by a word left out and another put in elsewhere.
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, (TRIALS, width)).astype(np.uint64)
    b = a.copy()
    for t in range(TRIALS):
        left = edits
        while left:
            k = int(rng.integers(0, width))
            if left >= 2 and rng.random() < 0.5:
                b[t] = np.insert(np.delete(b[t], k), int(rng.integers(0, width)), rng.integers(1, 2**63))
                left -= 2
            else:
                b[t, k] = rng.integers(1, 2**63)
                left -= 1
    sketch = Sketch.of(width, sampled, most, seed)
    begin = np.arange(TRIALS) * width
    met = np.logical_or.accumulate(sketch.keys(a.ravel(), begin) == sketch.keys(b.ravel(), begin), 1).mean(0)
    enough = np.flatnonzero(met >= recall)
    if not len(enough):
        raise ValueError(f"{most} repetitions don't reach a recall of {recall} for {edits} edits in {width} words")
    return int(enough[0]) + 1


def _windows(texts: list[str | None], width: int, hashes: _Hashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, starts of windows, text of each start) of runs of texts of about CHUNK words; no window crosses a text's end."""
    part: list[np.ndarray] = []
    owner, size = [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        if len(words) >= width:
            part.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
            owner.append(k)
            size += len(words)
        if part and (size >= CHUNK or k == len(texts) - 1):
            yield _laid_out(part, owner, width)
            part, owner, size = [], [], 0
    if part:
        yield _laid_out(part, owner, width)


def _laid_out(part: list[np.ndarray], owner: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in part])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(part)), sizes)
    begin = np.arange(int(ends[-1]))
    begin = begin[begin + width <= ends[text]]
    return np.concatenate(part), begin, np.array(owner)[text[begin]]


def _digest(symbols: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window's words."""
    key = np.full(len(begin), np.uint64(width))
    for k in range(width):
        key = _mix(key, symbols[begin + k])
    return key


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel().view(np.int64)))


def run_length(width: int, edits: int) -> int:
    """Words in a row that two windows have in common at least if they are ``edits`` apart: these leave width - edits words in edits + 1 runs."""
    return max(1, -(-(width - edits) // (edits + 1)))


def item_windows(items: DataFrame, width: int, run_words: int) -> DataFrame:
    """(item_id, w, words, runs): the windows of each item, w a hash of its words, runs those of its runs of ``run_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for symbols, begin, owner in _windows(b.column(1).to_pylist(), width, hashes):
                w = _digest(symbols, begin, width)
                starts = begin[:, None] + np.arange(width - run_words + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner)), pa.array(w.view(np.int64)), _lists(symbols[begin[:, None] + np.arange(width)]), _lists(_digest(symbols, starts.ravel(), run_words).reshape(starts.shape))],
                    names=["item_id", "w", "words", "runs"],
                )

    return items.mapInArrow(run, "item_id long, w long, words array<long>, runs array<long>")


def _with_keys(windows: DataFrame, sketch: Sketch) -> DataFrame:
    """windows (w, words) with ``keys``, one per repetition."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            symbols = b.values.to_numpy().view(np.uint64) if len(b) else np.zeros(0, np.uint64)
            symbols = symbols[b.offsets[0].as_py() : b.offsets[-1].as_py()] if len(b) else symbols
            yield _lists(sketch.keys(symbols, np.arange(len(b)) * sketch.width))

    return windows.withColumn("keys", F.arrow_udf(run, "array<long>")("words"))


class BitFilter:
    """A set of hashes, in which members are always and others seldom found; each sets two bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    @staticmethod
    def places(h: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return (h * _ODD) >> shift, (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(h.shape, bool)
        for at in self.places(h, self.shift):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    @classmethod
    def of(cls, column: DataFrame, members: int) -> BitFilter:
        """Of the one long column, with about so many members; the bits are set by the tasks, united by Spark."""
        log2 = min(FILTER_BITS, max(16, math.ceil(math.log2(max(members, 1) * 32))))
        shift = np.uint64(64 - log2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (log2 - 3), np.uint8)
            for b in batches:
                for at in cls.places(b.column(0).to_numpy().view(np.uint64), shift):
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            eights = bits.view(np.int64)
            at = np.flatnonzero(eights)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(eights[at])], names=["at", "eight"])

        rows = column.mapInArrow(run, "at int, eight long").groupBy("at").agg(F.bit_or("eight").alias("eight")).toArrow()
        eights = np.zeros(1 << (log2 - 6), np.int64)
        eights[rows.column("at").to_numpy()] = rows.column("eight").to_numpy()
        return cls(eights.view(np.uint8))


def _candidates(documents: DataFrame, sketch: Sketch, run_words: int, runs: BitFilter, buckets: BitFilter) -> DataFrame:
    """(doc_id, w, words, keys) of the windows of documents that may share a bucket with an item's; the words and keys of a
    window stand in one of its rows of each task at least, and are null in others."""
    width = sketch.width
    shared = documents.sparkSession.sparkContext.broadcast((sketch, runs, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, runs, buckets = shared.value
        hashes, seen = _Hashes(), set()
        for b in batches:
            for symbols, begin, owner in _windows(b.column(1).to_pylist(), width, hashes):
                # Windows without a run of words in common with an item's are too far from it; walks are for the others.
                in_items = np.concatenate([[0], np.cumsum(runs.has(_digest(symbols, np.arange(len(symbols) - run_words + 1), run_words)))])
                kept = in_items[begin + width - run_words + 1] > in_items[begin]
                begin, owner = begin[kept], owner[kept]
                keys = sketch.keys(symbols, begin)
                kept = buckets.has(keys).any(1)
                begin, owner, keys = begin[kept], owner[kept], keys[kept]
                if not len(begin):
                    continue
                w = _digest(symbols, begin, width)
                # A document's repeated windows say nothing new.
                _, first = np.unique(np.stack([owner.astype(np.uint64), w]), axis=1, return_index=True)
                begin, owner, keys, w = begin[first], owner[first], keys[first], w[first]
                if len(seen) > MEMO:
                    seen.clear()
                fresh = np.array([not (x in seen or seen.add(x)) for x in w.tolist()])
                null = pa.array(~fresh)
                at = pa.array(np.cumsum(fresh) - 1, mask=~fresh)
                words = _lists(symbols[begin[fresh][:, None] + np.arange(width)]) if fresh.any() else None
                some = _lists(keys[fresh]) if fresh.any() else None
                empty = pa.nulls(len(null), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(owner)), pa.array(w.view(np.int64)), words.take(at) if words is not None else empty, some.take(at) if some is not None else empty],
                    names=["doc_id", "w", "words", "keys"],
                )

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).filter("doc_id is not null and text is not null")
    return source.mapInArrow(run, "doc_id long, w long, words array<long>, keys array<long>")


def _distance(a: str, b: str) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            sides = [s.flatten().to_numpy().reshape(len(s), -1) if len(s) else np.zeros((0, 1), np.int64) for s in (x, y)]
            yield pa.array(distances(*sides).astype(np.int32))

    return F.arrow_udf(run, "int")(a, b)


def find_leaks(documents: DataFrame, items: DataFrame, words: int = 12, edits: int = 1, recall: float = 0.99, sampled: int | None = None, seed: int = 20) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold a run of ``words`` words of an item, give or take ``edits`` word edits, with the
    fewest edits found.

    Words are the maximal runs of letters and digits in lower case. Items with fewer words, null and empty texts
    leak nowhere; repeated rows of documents or items give their pair once; ids must not be null (such rows are left out);
    an empty table gives an empty result. Leaks without an edit are all found, others with probability ``recall`` each at
    least, and none is wrong.

    ``sampled`` positions make a key; by default as many as the number of item windows asks for. The corpus is read
    once; of it only windows that may share a bucket are written to the checkpoint folder and meet the items' buckets in a join. No
    text comes to the driver: only two bit filters do, each of at most 2 ** FILTER_BITS bits.
    """
    kept = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("item_id is not null and text is not null")
    run_words = run_length(words, edits)
    owned = cut(item_windows(kept, words, run_words).dropDuplicates(["item_id", "w"]))
    if sampled is None:
        sampled = math.ceil((math.log2(max(owned.count(), 2)) + SELECTIVE) / WORTH)
    sketch = Sketch.of(words, sampled, repetitions_for(words, edits, sampled, recall), seed)
    windows = cut(_with_keys(owned.groupBy("w").agg(F.any_value("words").alias("words"), F.any_value("runs").alias("runs")), sketch))
    n = windows.count()
    # As many runs as windows, about, for these overlap.
    runs, buckets = BitFilter.of(windows.select(F.explode("runs")), n), BitFilter.of(windows.select(F.explode("keys")), n * len(sketch.at))
    near = cut(_candidates(documents, sketch, run_words, runs, buckets))
    met = near.filter("words is not null").groupBy("w").agg(F.any_value("words").alias("words"), F.any_value("keys").alias("keys"))
    of_items = windows.select(F.col("w").alias("v"), F.explode("keys").alias("key"))
    pairs = met.select("w", F.explode("keys").alias("key")).join(of_items, "key").select("w", "v").distinct()
    both = pairs.join(met.select("w", F.col("words").alias("x")), "w").join(windows.select(F.col("w").alias("v"), F.col("words").alias("y")), "v")
    close = both.withColumn("edits", _distance("x", "y")).filter(F.col("edits") <= edits).select("w", "v", "edits")
    items_of = close.join(owned.select(F.col("w").alias("v"), "item_id"), "v").groupBy("w", "item_id").agg(F.min("edits").alias("edits"))
    return near.select("doc_id", "w").join(items_of, "w").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
