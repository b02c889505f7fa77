"""Fuzzy lookup in a short fixed list, as Arrow UDFs with a memo per worker.

The score weighs several similarities of two texts (0 to 100): plain, of sorted and of shared words, and of the best
part of the longer text. It follows the published definition of the weighted ratio; equality with any library's
numbers to the last digit isn't claimed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

NEAR = "struct<name: string, score: double>"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * _common(a, b) / n if n else 100.0


def part_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one, windows at the ends being shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, m = len(a), len(b)
    windows = {b[max(0, i) : min(m, i + n)] for i in range(1 - n, m)}
    return max(ratio(a, w) for w in windows if w)


def word_ratio(a: str, b: str, of=ratio) -> float:
    """The better of the ratios of sorted words and of shared with all words."""
    x, y = a.split(), b.split()
    best = of(" ".join(sorted(x)), " ".join(sorted(y)))
    both, left, right = sorted({*x} & {*y}), sorted({*x} - {*y}), sorted({*y} - {*x})
    if both and (not left or not right):
        return 100.0
    shared = " ".join(both)
    one, two = " ".join([*both, *left]), " ".join([*both, *right])
    if of is not ratio:
        return 100.0 if both else max(best, of(one, two))
    best = max(best, of(one, two))
    return max(best, of(shared, one), of(shared, two)) if shared else best


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    if lengths < 1.5:
        return max(ratio(a, b), 0.95 * word_ratio(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(ratio(a, b), scale * part_ratio(a, b), 0.95 * scale * word_ratio(a, b, part_ratio))


class _Choice:
    """A choice with what bounds its score from above."""

    __slots__ = ("text", "n", "bag", "words")

    def __init__(self, text: str) -> None:
        self.text, self.n, self.bag, self.words = text, len(text), Counter(text), frozenset(text.split())

    def at_most(self, n: int, bag: Counter, words: frozenset) -> float:
        """No score with this text is higher: letters in common can't be more than in both bags."""
        if self.words & words:
            return 100.0
        common = sum(min(k, bag[c]) for c, k in self.bag.items() if c in bag)
        low, high = min(n, self.n), max(n, self.n)
        whole = 200.0 * common / (low + high)
        if high < 1.5 * low:
            return whole
        return max(whole, (0.9 if high <= 8 * low else 0.6) * min(100.0, 200.0 * common / (low + min(common, low))))


@lru_cache(maxsize=8)
def nearest_in(choices: tuple[str, ...], cutoff: float):
    """text -> (choice, score) of the first of the best choices at or above the cutoff, or None; choices themselves give None.

    Choices are scored by falling upper bound until no bound exceeds the best score.
    """
    known = frozenset(choices)
    every = [_Choice(c) for c in choices]

    @lru_cache(maxsize=200_000)
    def nearest(text: str | None) -> tuple[str, float] | None:
        if not text or text in known:
            return None
        n, bag, words = len(text), Counter(text), frozenset(text.split())
        bounds = sorted(((c.at_most(n, bag, words), -k) for k, c in enumerate(every)), reverse=True)
        best, at = -1.0, 0
        for bound, k in bounds:
            if bound < cutoff or bound < best:
                break
            score = weighted_ratio(text, every[-k].text)
            if score > best or (score == best and -k < at):
                best, at = score, -k
        return (choices[at], best) if best >= cutoff else None

    return nearest


def near_each(values: Column, choices: tuple[str, ...], cutoff: float) -> Column:
    """array<struct<name, score>> for an array of texts, one entry each, null where nothing is near."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nearest = nearest_in(choices, cutoff)
        for b in batches:
            rows = [None if r is None else [None if (g := nearest(x)) is None else {"name": g[0], "score": g[1]} for x in r] for r in b.to_pylist()]
            yield pa.array(rows, pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64())])))

    return F.arrow_udf(run, f"array<{NEAR}>")(values)
