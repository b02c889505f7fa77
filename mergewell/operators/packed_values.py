"""Split cells that pack several values into one row per value (problem 1).

A parsing expression grammar, tried alternative by alternative:

    cell    <- blank* (bracket / numbered / lines / items) blank* !.
    bracket <- '[' items ']'                 # only if it spans the whole cell
    numbered<- ('1' mark) item ('2' mark) item ...   # marks in counting order
    items   <- item (separator item)*
    item    <- listmark? (quoted / bare)
    quoted  <- open (escape / !close .)* close &(blank* (separator / 'and' / end))
    bare    <- (group / !separator .)+
    group   <- '(' (group / !')' .)* ')'     # only if it closes
    separator <- [,;|\\n\\r\\t•·，、；] / blank '/' blank

An alternative that fails gives back what it consumed: a quote that never closes in front of a separator is
read again as part of a bare value, and the value gets the flag ``open_quote``; a parenthesis that never
closes is an ordinary character (flag ``open_group``).

What backtracking has found out about a cell is kept (`_Memo`), so every place is read a bounded number of times and the
time grows with the length of the cell, however malformed it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Quote pairs, separators and list marks of the grammar.
QUOTES = {'"': '"', "“": "”", "'": "'", "‘": "’", "«": "»", "„": "“"}
SEPARATORS = ",;|\n\r\t•·，、；"
BRACKETS = {"[": "]", "{": "}"}

_BLANK = "  　​﻿"
_SEP = frozenset(SEPARATORS)
_OUTER = _BLANK + "\n\r\t\v\f"
_NUMBER = re.compile(r"(\d{1,4})([.)])(?=\s)")
_LISTMARK = re.compile(r"(?:[-*–—▪◦‣](?=\s)|[•·])\s*")
_AND = re.compile(r"(?<!\s)\s+and\s+", re.I)
_LEAD_AND = re.compile(r"and\s+", re.I)
_PARENTHESIS = re.compile(r"[()]")
_STOP = re.compile(r"[,;|\n\r\t•·，、；(/]")


def _separator(s: str, i: int) -> int:
    """End of the separator at i, or -1."""
    c = s[i]
    if c in _SEP:
        return i + 1
    if c == "/" and i and s[i - 1].isspace() and i + 1 < len(s) and s[i + 1].isspace():
        return i + 1
    return -1


class _Memo:
    """What is known of a cell: where its parentheses close, and from where a quoted value never closes."""

    def __init__(self, s: str) -> None:
        self.s = s
        self._groups: dict[int, int] | None = None
        self._dead: dict[str, set[int]] = {}

    def group(self, i: int) -> int:
        """End of the parenthesised group at i, or -1 if it never closes."""
        if self._groups is None:
            self._groups, opened = {}, []
            for m in _PARENTHESIS.finditer(self.s):
                if m[0] == "(":
                    opened.append(m.start())
                elif opened:
                    self._groups[opened.pop()] = m.end()
        return self._groups.get(i, -1)

    def dead(self, quote: str) -> set[int]:
        """Places inside a value opened by ``quote`` from which no end of it is reached."""
        return self._dead.setdefault(quote, set())


def _quoted(s: str, i: int, memo: _Memo) -> tuple[str, int] | None:
    """quoted: (value, end), or None to backtrack."""
    close = QUOTES.get(s[i])
    if close is None:
        return None
    dead, passed = memo.dead(s[i]), []
    out, j, n = [], i + 1, len(s)
    while j < n:
        if j in dead:
            break
        if j > i + 1:
            passed.append(j)
        c = s[j]
        if c == "\\" and j + 1 < n and s[j + 1] in (close, s[i], "\\"):
            out.append(s[j + 1])
            j += 2
        elif c == close:
            if j + 1 < n and s[j + 1] == close and close == s[i]:
                # A doubled quote stands for one, unless it closes an empty value.
                if j == i + 1 and _ends(s, j + 1):
                    return "", j + 1
                out.append(close)
                j += 2
            elif _ends(s, j + 1):
                return "".join(out), j + 1
            elif close in "'’":  # an apostrophe within the value
                out.append(c)
                j += 1
            else:
                break
        else:
            out.append(c)
            j += 1
    dead.update(passed)
    return None


def _ends(s: str, j: int) -> bool:
    """Whether a value may end at j: blanks, then a separator, the connecting 'and' or the end."""
    k, n = j, len(s)
    while k < n and s[k] in _BLANK:
        k += 1
    return k == n or _separator(s, k) >= 0 or (k > j and _LEAD_AND.match(s, k) is not None)


def _bare(s: str, i: int, memo: _Memo) -> tuple[int, bool]:
    """End of the bare value at i, and whether a parenthesis was left open."""
    n, opened = len(s), False
    while i < n:
        m = _STOP.search(s, i)
        if m is None:
            return n, opened
        i = m.start()
        if s[i] == "(":
            end = -1 if opened else memo.group(i)
            if end < 0:
                opened = True
                i += 1
            else:
                i = end
        elif _separator(s, i) >= 0:
            return i, opened
        else:
            i += 1
    return n, opened


def _items(s: str) -> Iterator[tuple[str, str | None, bool]]:
    """(value, flag, whether it was quoted) of each piece; empty pieces are included."""
    i, n, fresh, memo = 0, len(s), True, _Memo(s)
    while i < n:
        while i < n and s[i] in _BLANK:
            i += 1
        if i >= n:
            return
        if fresh and (m := _LISTMARK.match(s, i)):
            i, fresh = m.end(), False
            continue
        if (end := _separator(s, i)) >= 0:
            fresh = s[i] in "\n\r"
            i = end
            continue
        fresh = False
        if not (i == 0) and (m := _LEAD_AND.match(s, i)) and _follows(s, i):
            i = m.end()
            continue
        got = _quoted(s, i, memo)
        if got is not None:
            yield got[0], None, True
            i = got[1]
            continue
        end, opened = _bare(s, i, memo)
        flag = "open_quote" if s[i] in QUOTES else "open_group" if opened else None
        yield s[i:end], flag, False
        i = end


def _follows(s: str, i: int) -> bool:
    """Whether the 'and' at i stands after a finished value or a separator, so that it connects."""
    j = i - 1
    while j >= 0 and s[j] in _BLANK:
        j -= 1
    return j >= 0


def _numbered(s: str) -> list[str] | None:
    """The parts of a list numbered 1, 2, 3 ... with one kind of mark; None if the cell isn't one."""
    m = _NUMBER.match(s)
    if m is None or m[1] != "1":
        return None
    mark, parts, at, want = m[2], [], m.end(), 2
    for m in _NUMBER.finditer(s, at):
        if m[2] == mark and int(m[1]) == want and s[m.start() - 1].isspace():
            parts.append(s[at : m.start()])
            at, want = m.end(), want + 1
    return [*parts, s[at:]]


def _connected(found: list[tuple[str, str | None, bool]]) -> list[tuple[str, str | None, bool]]:
    """Splits the last bare value at the 'and' that connects it to the list."""
    if found and not found[-1][2]:
        value, flag, _ = found[-1]
        m, depth, at = None, 0, 0
        for found_and in _AND.finditer(value):
            depth += value.count("(", at, found_and.start()) - value.count(")", at, found_and.start())
            at = found_and.start()
            if depth <= 0:
                m = found_and
        if m is not None:
            left, right = value[: m.start()], value[m.end() :]
            inner = _quoted(right, 0, _Memo(right)) if right and right[0] in QUOTES else None
            tail = (inner[0], flag, True) if inner and inner[1] == len(right.rstrip(_OUTER)) else (right, flag, False)
            return [*found[:-1], (left, None, False), tail]
    return found


def parse_cell(cell: str | None) -> list[tuple[str, str | None]]:
    """(value, error flag) of each value in a packed cell, in order.

    Null, empty and blank cells give no value. A value has no outer white space; empty pieces are dropped.
    """
    s = (cell or "").strip(_OUTER)
    if not s:
        return []
    if s[0] in BRACKETS and s[-1] == BRACKETS[s[0]] and len(s) > 1:
        s = s[1:-1].strip(_OUTER)
    parts = _numbered(s)
    if parts is not None:
        found = []
        for p in parts:
            p = p.strip(_OUTER)
            got = _quoted(p, 0, _Memo(p)) if p and p[0] in QUOTES else None
            found.append((got[0], None, True) if got and got[1] == len(p) else (p.rstrip(",;").rstrip(), None, False))
    else:
        found = _connected(list(_items(s)))
    out = []
    for value, flag, _ in found:
        value = value.strip(_OUTER)
        if value:
            out.append((value, flag))
    return out


def split_packed(df: DataFrame, id_col: str, cell_col: str) -> DataFrame:
    """One row (id, pos, value, error) per value packed in ``cell_col``.

    Narrow: no shuffle; cells go to Python as Arrow batches with only the two columns read. Null, empty and
    blank cells give no row; repeated values stay, ``pos`` (int64) counts from 0 after empty pieces are
    dropped. Rows with a null id keep it. ``error`` is null, ``open_quote`` or ``open_group``. Other columns of
    df aren't looked at, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, pos, values, flags = b.column(0), [], [], [], []
            for k, cell in enumerate(b.column(1).to_pylist()):
                if cell:
                    for p, (value, flag) in enumerate(parse_cell(cell)):
                        at.append(k)
                        pos.append(p)
                        values.append(value)
                        flags.append(flag)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(values, pa.string()), pa.array(flags, pa.string())],
                names=["id", "pos", "value", "error"],
            )

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(cell_col).cast("string").alias("cell")).filter("cell is not null")
    return src.mapInArrow(run, "id long, pos long, value string, error string")
