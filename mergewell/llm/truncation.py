"""Texts that stop before their page does (problem 9).

A backward character n-gram model tells, for the context in front of any place of a text (read backwards from
there), how often the text stops at such a place, by a line's or the text's end, and how often it goes on. A value's final context
is scored with it: texts that end where others nearly always go on were cut. The context is read backwards in two
ways that are scored apart and added: its last 1, 3 and 5 characters; and the shape of its line (its first
word, how many words it has, how it ends, whether a sentence came before), which tells headings, links and list items
from sentences. Longer contexts are smoothed by shorter ones. Digits count as one. A text that ends as a sentence does is
scored by its characters alone: how long its last line is says nothing about it then.

A mark put in place of the rest (an ellipsis or "read more" on the line of the content) is taken off first, in
training too, so that lines which always carry one are known as such.

The model is a table of fixed size: contexts are hashed to buckets, so neither the driver nor a worker ever holds
more than ``BUCKETS`` counters, however large the corpus is. All texts are counted, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mergewell.runtime import cut

#: log2 of the buckets of each kind of context; the first of each chain is the shallowest.
CHAINS = (("last1", 14), ("last3", 18), ("last5", 20)), (("shape", 14), ("start", 18), ("start_end", 20))
SIZES = [1 << bits for chain in CHAINS for _, bits in chain]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
BUCKETS = int(OFFSETS[-1])
#: Weight of the shallower context in a smoothed rate.
PRIOR = 4.0
#: Score under which an unmarked text counts as cut as long as no texts tell, and that for a marked one.
DEFAULT_THRESHOLD, MARKED_THRESHOLD = -7.75, -2.5
#: Where the valley of a language's scores is sought, and the width of a bin.
VALLEY, BIN = (-9.0, -6.5), 0.25
#: Texts of all languages that a language's own weigh against, and of the default that all languages' do; the share of texts
#: in four bins by which the default's valley rises per bin.
SHRINK, SLOPE = 20_000, 0.001

# Marks that stand for a rest.
_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|\[\s*(?:…|\.{3,})\s*\]|\(\s*(?:more|continued|…|\.{3,})\s*\)|(?:read|see|show) more\s*(?:»|>+|→|…)?|\[(?:more|truncated|cut)\]))+\s*$", re.I)
_OUTER = " \t\r\n\v\f  　​﻿\x00\x1c\x1d\x1e\x1f\x85"
_SENTENCE = ".!?。！？"
#: A full stop of East Asian text whose bytes were read as another charset.
_MISREAD_STOPS = ("ã€‚", "ã\x80\x82", "¡£")
#: A byte order mark whose bytes were read as another charset: nothing visible.
_MISREAD_MARK = "ï»¿"
_CLOSERS = "\"'”’»“)]」』"


def split_mark(text: str) -> tuple[str, bool]:
    """The text up to its last visible character, without a mark that stands behind content; whether there was one."""
    t = text.removeprefix(_MISREAD_MARK).rstrip(_OUTER)
    begin = t.rfind("\n") + 1
    m = _MARK.search(t, begin)
    if m is not None and t[begin : m.start()].strip(_OUTER + "-*•\"'“”«»„"):
        return t[: m.start()].rstrip(_OUTER), True
    return t, False


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ b) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


class Places:
    """All places of some texts at which a line could stop: their buckets, and whether it does."""

    def __init__(self, texts: list[str]) -> None:
        # Each text is followed by a line break, its end; so the last place of a text is a stop.
        joined = "\n".join(texts) + "\n"
        # Capitals stay: a heading or a menu is known by them.
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        digit = (code >= 48) & (code <= 57)
        code = np.where(digit, np.uint32(48), code)
        n = len(code)
        newline = code == 10
        blank = (code == 32) | (code == 9) | (code == 0xA0) | (code == 13)
        index = np.arange(n)
        line = np.cumsum(newline) - newline  # number of the line of each character
        begin = np.concatenate([[0], np.flatnonzero(newline)[:-1] + 1])  # where each line begins
        in_line = index - begin[line]
        word_start = ~blank & ~newline & ((in_line == 0) | np.concatenate([[True], blank[:-1]]))
        words = np.cumsum(word_start)
        words = words - (words[begin] - word_start[begin])[line]
        sizes = np.array([len(t) + 1 for t in texts])
        self.last = np.cumsum(sizes) - 2  # last character of each text
        doc_begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ender = np.isin(code, np.array([ord(c) for c in _SENTENCE], np.uint32))
        enders = np.cumsum(ender)
        doc_of_line = np.searchsorted(doc_begin, begin, side="right") - 1
        before = np.where(begin > doc_begin[doc_of_line], enders[np.maximum(begin - 1, 0)] - enders[doc_begin[doc_of_line]] + ender[doc_begin[doc_of_line]], 0) > 0
        first = code[begin].astype(np.uint64)
        letter = ((first >= 97) & (first <= 122)) | ((first >= 65) & (first <= 90)) | ((first >= 0xC0) & (first < 0x2000)) | (first > 0x2E7F)
        kind = np.where(letter, np.uint64(97), first)
        head = _mix(kind, np.uint64(5))  # the first word of each line, up to 12 characters
        going = np.ones(len(begin), bool)
        for k in range(12):
            at = np.minimum(begin + k, n - 1)
            going = going & ~newline[at] & ~blank[at]
            head = np.where(going, _mix(head, code[at].astype(np.uint64)), head)
        c = code.astype(np.uint64)

        def back(k: int) -> np.ndarray:
            """The character k places before each, 1 where the line doesn't reach so far."""
            shifted = np.concatenate([np.ones(k, np.uint64), c[:-k]]) if k else c
            return np.where(in_line >= k, shifted, np.uint64(1))

        b = [back(k) for k in range(5)]
        last1 = _mix(b[0], np.uint64(11))
        last3 = _mix(_mix(last1, b[1]), b[2])
        last5 = _mix(_mix(last3, b[3]), b[4])
        capped = np.minimum(words, 12).astype(np.uint64)
        shape = _mix(_mix((kind * np.uint64(2) + before)[line], capped), np.uint64(23))
        start = _mix(_mix(head * np.uint64(2) + before, np.uint64(37))[line], capped)
        start_end = _mix(_mix(_mix(start, b[0]), b[1]), np.uint64(41))
        self.buckets = []
        for (h, size, offset) in zip((last1, last3, last5, shape, start, start_end), SIZES, OFFSETS[:-1]):
            self.buckets.append((h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64) + int(offset))
        self.kept = ~newline & ~blank
        # The line's shape is looked at where a word ends; scripts without blanks have such places everywhere.
        word = ((code >= 97) & (code <= 122)) | ((code >= 65) & (code <= 90)) | (code == 48) | ((code >= 0xC0) & (code < 0x2000))
        self.ended = self.kept & ~(word & np.concatenate([word[1:], [False]]))
        self.stops = np.concatenate([newline[1:], [True]])
        # A blank before the line's end belongs to the end.
        self.stops |= np.concatenate([blank[1:], [False]]) & np.concatenate([newline[2:], [True, True]])


def count_places(texts: list[str], stops: np.ndarray, goes: np.ndarray) -> None:
    """Adds the places of the texts to the counters of the buckets."""
    if not texts:
        return
    p = Places(texts)
    for k, b in enumerate(p.buckets):
        kept = p.kept if k < len(CHAINS[0]) else p.ended
        stop, go = kept & p.stops, kept & ~p.stops
        low, size = int(OFFSETS[k]), SIZES[k]
        stops[low : low + size] += np.bincount(b[stop] - low, minlength=size)
        goes[low : low + size] += np.bincount(b[go] - low, minlength=size)


def final_counts(texts: list[str], stops: np.ndarray, goes: np.ndarray) -> np.ndarray:
    """How often a text stops and goes on where these end: texts x contexts (of all chains) x 2."""
    p = Places(texts)
    at = np.stack([b[p.last] for b in p.buckets], 1)
    return np.stack([stops[at], goes[at]], 2).astype(np.int64)


def log_odds(counts: list[tuple[Column, Column]], copies: Column, closed: Column) -> Column:
    """Log-odds that a text stops where one does, from (stops, goes) of its contexts; its own end and those of its copies are left out.

    closed: it ends as a sentence does, so the line's shape isn't looked at.
    """
    total, k = F.lit(0.0), 0
    for chain in CHAINS:
        rate = F.lit(0.05)
        for _ in chain:
            s, g = counts[k]
            s = F.greatest(s - copies, F.lit(0))
            rate = (s + PRIOR * rate) / (s + g + PRIOR)
            k += 1
        rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        odds = F.log(rate / (1 - rate))
        total = total + (odds if chain is CHAINS[0] else F.when(closed, F.lit(0.0)).otherwise(odds))
    return total


def finishes(text: str) -> bool:
    """Whether a text's last line ends as a sentence does."""
    t = text.rstrip(_CLOSERS + _OUTER)
    return t[-1:] in _SENTENCE or t.endswith(_MISREAD_STOPS) if t else True


def train(documents: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The counters (stops, goes) of all texts.

    One scan; each task counts its texts in arrays of BUCKETS counters and sends those that aren't zero; the sums are
    made by Spark. Only they, at most BUCKETS rows, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops, goes = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for texts in _chunks([split_mark(t)[0] for t in b.column(0).to_pylist()]):
                count_places(texts, stops, goes)
        at = np.flatnonzero(stops + goes)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(stops[some]), pa.array(goes[some])], names=["bucket", "stops", "goes"])

    # As many tasks as run at a time: each sends up to BUCKETS counters, so more of them would send more for the same sums.
    texts = documents.select(F.col(text_col).alias("t")).filter("t is not null").coalesce(max(1, documents.sparkSession.sparkContext.defaultParallelism))
    counted = texts.mapInArrow(run, "bucket int, stops long, goes long")
    sums = counted.groupBy("bucket").agg(F.sum("stops").alias("stops"), F.sum("goes").alias("goes")).toArrow()
    stops, goes = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = sums.column("bucket").to_numpy()
    stops[at], goes[at] = sums.column("stops").to_numpy(), sums.column("goes").to_numpy()
    return stops, goes


def _chunks(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """The texts that aren't empty, in runs of about ``most`` characters, so that the arrays over them stay small."""
    part, size = [], 0
    for t in texts:
        if t:
            part.append(t)
            size += len(t)
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


def language(c: Column) -> Column:
    """The main language of a tag in lower case; ``und`` for none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit("")), F.lit("und"))


def score_texts(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, source, lang, score, marked) of every document with visible text.

    score: log-odds that other texts stop where this one does. Copies of a text, whatever mark and blanks end them, don't speak for each
    other: they are known by a hash, counted, and their ends are taken from the counts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tuple(np.minimum(x, 2**31 - 1).astype(np.int32) for x in model))
    contexts = sum(len(chain) for chain in CHAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops, goes = shared.value
        for b in batches:
            ends = [split_mark(t) if t else ("", False) for t in b.column(3).to_pylist()]
            kept = [k for k, (t, _) in enumerate(ends) if t]
            parts = [final_counts(texts, stops, goes).reshape(len(texts), -1) for texts in _chunks([t for t, _ in ends])]
            counts = np.concatenate(parts) if parts else np.zeros((0, 2 * contexts), np.int64)
            at = pa.array(kept, pa.int64())
            digest = np.array([xxhash.xxh64_intdigest(ends[k][0].encode("utf-8", "surrogatepass")) for k in kept], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array([ends[k][1] for k in kept], pa.bool_()), pa.array([not ends[k][1] and finishes(ends[k][0]) for k in kept], pa.bool_()), pa.array(digest),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * 2 * contexts, pa.int32()), pa.array(counts.ravel()))],
                names=["doc_id", "source", "lang", "marked", "closed", "digest", "counts"],
            )

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), language(F.col("lang")).alias("lang"), F.col("text").alias("text"))
    # Read twice, for the copies and for the scores: a few numbers per text, written to the checkpoint folder.
    ends = cut(src.mapInArrow(run, "doc_id long, source string, lang string, marked boolean, closed boolean, digest long, counts array<long>"))
    copies = ends.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    counts = [(F.col("counts")[2 * k], F.col("counts")[2 * k + 1]) for k in range(contexts)]
    score = log_odds(counts, F.coalesce("copies", F.lit(1)), F.col("closed"))
    return ends.join(copies, "digest", "left").select("doc_id", "source", "lang", score.alias("score"), "marked")


def valleys(count: dict[str, dict[int, int]]) -> dict[str, float]:
    """The middle of the emptiest stretch of each language's histogram (texts per bin), at every size.

    Shares are shrunk towards those of all languages, these towards a valley at the default, by weights that grow smoothly with
    the texts.
    """
    edges = range(round(VALLEY[0] / BIN), round(VALLEY[1] / BIN) + 1)

    def near(by_bin: dict[int, int]) -> np.ndarray:
        return np.array([sum(by_bin.get(e + k, 0) for k in (-2, -1, 0, 1)) for e in edges], float)

    every: dict[int, int] = {}
    for by_bin in count.values():
        for b, n in by_bin.items():
            every[b] = every.get(b, 0) + n
    shape = SLOPE * np.array([abs(e - DEFAULT_THRESHOLD / BIN) for e in edges])
    shape = (near(every) + SHRINK * shape) / (sum(every.values()) + SHRINK)
    out = {}
    for lang, by_bin in count.items():
        own = (near(by_bin) + SHRINK * shape) / (sum(by_bin.values()) + SHRINK)
        flat = np.flatnonzero(np.isclose(own, own.min(), rtol=1e-9, atol=1e-12))
        out[lang] = edges[int(flat[len(flat) // 2])] * BIN
    return out


def thresholds(scored: DataFrame) -> dict[str, float]:
    """The score between cut and complete texts per language. The histogram has at most a few bins per language."""
    bins = scored.filter("not marked").groupBy("lang", F.floor(F.col("score") / BIN).cast("int").alias("bin")).count()
    count: dict[str, dict[int, int]] = {}
    for lang, b, n in bins.collect():
        count.setdefault(lang, {})[b] = n
    return valleys(count)


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, score, marked) of the documents whose text was cut off.

    A text was cut if it ends where others go on (its score lies under its language's threshold), or with a mark in place
    of the rest behind content that others don't end with. Null, empty and
    blank texts weren't cut; a copy of a cut text was; repeated rows and null ids are kept. Columns other than
    doc_id, source, lang and text aren't read.
    """
    scored = cut(score_texts(documents, train(documents)))  # read twice, by the thresholds and by the result
    by_lang = thresholds(scored)
    limit = F.lit(DEFAULT_THRESHOLD)
    for lang, t in sorted(by_lang.items()):
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    stops_early = F.when(F.col("marked"), F.col("score") < MARKED_THRESHOLD).otherwise(F.col("score") < limit)
    return scored.filter(stops_early)


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, texts, truncated, share): how often each source truncates, over its texts with visible characters."""
    scored = documents.select("doc_id", "source", (F.regexp_replace("text", r"(?U)[\s\u200b\ufeff]+", "") != "").alias("seen"))
    all_texts = scored.groupBy("source").agg(F.count_if("seen").alias("texts"))
    short = truncated(documents).groupBy("source").agg(F.count(F.lit(1)).alias("truncated"))
    joined = all_texts.alias("a").join(short.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    n = F.coalesce("c.truncated", F.lit(0))
    return joined.select(F.col("a.source").alias("source"), "texts", n.alias("truncated"), (n / F.nullif("texts", F.lit(0))).alias("share"))
