"""Names that agree among those of one place of meeting, found in one task.

Pairs of the places of up to so many names need no index in shuffles: the names of a place come sorted after each other, and the
pigeonhole join of name_variants is made in memory, place by place. Larger places are left to that join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame

from mergewell.llm import names

#: Up to so many names all pairs are compared.
ALL_PAIRS = 24
#: Names of the largest place that one task takes.
LOCAL_NAMES = 40_000
#: Rows of the largest contact whose rows one task ties.
LOCAL_ROWS = 20_000
#: Stands for the likeness where a place has more names than were asked for.
OVER = -1


def _lesser(form: str, k: int) -> set[str]:
    """form and what is left of it after up to k deletions; forms within k edits, swaps among them, have one of these in common."""
    found, last = {form}, {form}
    for _ in range(k):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found |= last
    return found


def _forms(part: str) -> set[str]:
    bare = part.replace("-", "")
    return {bare} | {h for h in part.split("-") if len(h) > 3} | names._SHORT.get(bare, set())


def near_parts_of(parts: set[str]) -> dict[str, set[str]]:
    """For each part those that are alike in full (names.part_likeness), itself among them."""
    near = {p: {p} for p in parts}
    long = [p for p in parts if len(p) > 1]
    at, bare = defaultdict(list), defaultdict(list)
    for p in long:
        bare[p.replace("-", "")].append(p)
        for v in {v for f in _forms(p) for v in _lesser(f, names.allowed(len(f)))}:
            at[v].append(p)
    for group in at.values():
        for p, q in combinations(group, 2):
            if q not in near[p] and names.part_likeness(p, q) == names.FULL:
                near[p].add(q)
                near[q].add(p)
    for f, group in bare.items():
        for n in range(3, len(f)):
            for q in bare.get(f[:n], ()):
                for p in group:
                    near[p].add(q)
                    near[q].add(p)
    return near


def _whole_pairs(split: list[tuple[str, ...]]) -> set[tuple[int, int]]:
    """Names that may be one by their letters without blanks, or by those of the first and the last part: equal ones, and, where one
    has another number of parts or a single one, those within two edits.

    Of five segments two edits leave one whole, up to two places away; and the letters that occur differ by four at most.
    """
    at, same, found = defaultdict(list), defaultdict(set), set()
    wholes = []
    for i, w in enumerate(split):
        whole = "".join(w).replace("-", "")
        for f in {whole, (w[0] + w[-1]).replace("-", "") if len(w) > 2 else whole}:
            letters = 0
            for c in f:
                letters |= 1 << ord(c) % 61
            same[f].add(i)
            if len(f) > 3:
                wholes.append((i, f, letters))
                for s in range(5):
                    at[len(f), s, f[s * len(f) // 5 : (s + 1) * len(f) // 5]].append((i, len(w), letters))
    for group in same.values():
        found.update(combinations(sorted(group), 2))
    for i, f, letters in wholes:
        parts = len(split[i])
        if parts != 2:
            for n in range(max(4, len(f) - 2), len(f) + 3):
                for s in range(5):
                    low, w = s * n // 5, (s + 1) * n // 5 - s * n // 5
                    for t in {f[p : p + w] for p in range(max(0, low - 2), low + 3)}:
                        for j, others, theirs in at.get((n, s, t), ()):
                            if i != j and (others != parts or parts == 1) and (letters ^ theirs).bit_count() < 5:
                                found.add((i, j) if i < j else (j, i))
    return found


def alike_in(group: list[str], least: int = 2) -> Iterator[tuple[str, str, int]]:
    """(name_a, name_b, likeness), name_a < name_b, of the pairs of different names whose likeness is least or more.

    least: 2 or more, but for groups of up to ALL_PAIRS.
    """
    group = sorted(group)
    split = [tuple(x.split(" ")) for x in group]
    if len(group) <= ALL_PAIRS:
        met = combinations(range(len(group)), 2)
    else:
        near = near_parts_of({p for w in split for p in w})
        turned, met = defaultdict(set), _whole_pairs(split)
        for i, w in enumerate(split):
            for p, q in combinations(w, 2):
                for key in ((p, q), (q, p), (p[0], q), (q, p[0]), (p, q[0]), (q[0], p)):
                    turned[key].add(i)
        for i, w in enumerate(split):
            for p, q in combinations(w, 2):
                for x in near[p]:
                    for y in near[q]:
                        met.update((min(i, j), max(i, j)) for j in turned.get((x, y), ()) if i != j)
    for i, j in met:
        like = names.likeness(split[i], split[j])
        if like >= least:
            yield group[i], group[j], like


def local_pairs(named: DataFrame, least: int, most: int) -> DataFrame:
    """(contact, name_a, name_b, like) of the names that meet in a contact, name_a < name_b, with a likeness of least or more.

    named: contact, name, made distinct. A contact of more than most names only has a row with the likeness OVER and without names.
    A task holds one contact at a time, and no more than most names of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str | None, str | None, int]] = []

        def take(contact: int | None, group: list[str], n: int) -> None:
            if n > most:
                rows.append((contact, None, None, OVER))
            elif n > 1:
                rows.extend((contact, *x) for x in alike_in(group, least))

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["contact", "name_a", "name_b", "like"])
            rows.clear()
            return made

        now, group, n = None, [], 0
        for b in batches:
            for contact, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if contact != now:
                    take(now, group, n)
                    now, group, n = contact, [], 0
                    if len(rows) > 10_000:
                        yield out()
                n += 1
                if n <= most:
                    group.append(name)
        take(now, group, n)
        yield out()

    ordered = named.select("contact", "name").repartition("contact").sortWithinPartitions("contact")
    return ordered.mapInArrow(run, "contact long, name_a string, name_b string, like int")


def tied_rows(entries: DataFrame, most: int, shared_above: int) -> DataFrame:
    """(contact, a, b): rows that one contact makes one person: each row and the smallest of its name, and the smallest of two names that agree.

    entries: contact, name, id, need (how alike names must be there). A contact of more than shared_above groups of alike names ties whole
    names of several parts only (name_variants.shared_contacts). A contact of more than most names, or of more than LOCAL_ROWS rows, only has a row without a and b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int | None, int | None]] = []

        def take(contact: int | None, group: dict[str, list[int]], n: int, need: int) -> None:
            if n > LOCAL_ROWS or len(group) > most:
                rows.append((contact, None, None))
            elif n > 1:
                pairs = list(alike_in(list(group), 1)) if len(group) > 1 else []
                led = {y for _, y, like in pairs if like > 1}
                shared = sum(" " in x and x not in led for x in group) > shared_above
                least = {x: min(ids) for x, ids in group.items()}
                for x, ids in group.items():
                    if not shared or " " in x:
                        rows.extend((contact, i, least[x]) for i in ids if i != least[x])
                rows.extend((contact, least[x], least[y]) for x, y, like in pairs if (like > 2 and (" " in x or " " in y) if shared else like >= need) and least[x] != least[y])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["contact", "a", "b"])
            rows.clear()
            return made

        now, group, n, needed = None, {}, 0, 0
        for b in batches:
            for contact, name, i, need in zip(*(c.to_pylist() for c in b.columns)):
                if contact != now:
                    take(now, group, n, needed)
                    now, group, n, needed = contact, {}, 0, need
                    if len(rows) > 10_000:
                        yield out()
                n += 1
                if n <= LOCAL_ROWS and len(group) <= most:
                    group.setdefault(name, []).append(i)
        take(now, group, n, needed)
        yield out()

    ordered = entries.select("contact", "name", "id", "need").repartition("contact").sortWithinPartitions("contact")
    return ordered.mapInArrow(run, "contact long, a long, b long")
