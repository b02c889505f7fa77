"""Encoding of a text column with a public byte-level BPE vocabulary (problem 7).

The encoder never replays merges. Per piece (a run that the vocabulary's pre-tokenizer cuts out):

1. The piece's UTF-8 bytes, read as Latin-1, go through an Aho-Corasick automaton of the whole vocabulary, which
   yields the longest token starting at each byte.
2. Tokens are laid from the left, longest first. Two neighbours are accepted only if BPE, given just their bytes,
   would leave exactly this boundary; by the locality of BPE a sequence whose neighbours are all compatible is the
   encoding. Compatibility depends on the pair alone and is memoised.
3. If no token at a position fits its left neighbour, the position is marked dead and the last token gives way to
   its next shorter prefix. A position dies at most once, so the time is linear in the piece.

Pieces recur, so each worker also keeps the ids of the pieces it has seen (a bounded memo).
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The pre-tokenizer of the byte-level vocabularies (a fixed value, published with them).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs that a worker remembers at most, and the longest piece (in characters) that it remembers.
MEMO, MEMO_LENGTH = 1_000_000, 64


class BacktrackingEncoder:
    """Exact BPE ids of text, for a vocabulary whose ids are its merge ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self.pieces = regex.compile(PIECES).findall
        self.size = {i: len(t) for t, i in ranks.items()}
        self.text = {i: t.decode("latin-1") for t, i in ranks.items()}
        self.ids = {s: i for i, s in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        for i in sorted(self.text):
            self._learn(i)

    def _learn(self, i: int) -> None:
        """The two tokens whose merge makes token i: the split whose halves BPE leaves apart until then."""
        s = self.text[i]
        for cut in range(1, len(s)):
            a, b = self.ids.get(s[:cut]), self.ids.get(s[cut:])
            if a is not None and b is not None and a < i and b < i and self._apart(a, b, i):
                self.halves[i] = (a, b)
                self.joined[(a, b)] = i
                return
        self.halves[i] = (i, i)

    def _apart(self, a: int, b: int, below: int) -> bool:
        """Whether BPE with only the merges of ids under ``below`` leaves the boundary between tokens a and b.

        Walks back down the merges that made a and b, latest first: at no moment may the tokens that then touch the
        boundary have an earlier merge with each other.
        """
        limit = below
        while True:
            m = self.joined.get((a, b))
            if m is not None and m < limit:
                return False
            # Undo the later of the two merges; on equal ids the left one was made first.
            if a > b and self.halves[a][1] != a:
                limit, a = a, self.halves[a][1]
            elif self.halves[b][0] != b:
                limit, b = b + 1, self.halves[b][0]
            elif self.halves[a][1] != a:
                limit, a = a, self.halves[a][1]
            else:
                return True

    def _compatible(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            got = self.fits[(a, b)] = self._apart(a, b, 1 << 60)
        return got

    def _prefix(self, i: int) -> int:
        """The longest token that is a proper prefix of token i, or -1."""
        got = self.shorter.get(i)
        if got is None:
            s = self.text[i]
            got = self.shorter[i] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), -1)
        return got

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode("utf-8", "replace").decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None and self._alone(whole):
            return (whole,)
        n, size = len(s), self.size
        longest = [-1] * n
        for end, i in self.automaton.iter(s):  # ends ascend, so the last match from a start is its longest
            longest[end + 1 - size[i]] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            left = out[-1] if out else None
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (left is None or self._compatible(left, token)):
                    break
                token = self._prefix(token)
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = self._prefix(token)
        return tuple(out)

    def _alone(self, i: int) -> bool:
        """Whether token i is the encoding of its own bytes (every merged token of these vocabularies is)."""
        return self.size[i] == 1 or self.halves[i][0] != i

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for piece in self.pieces(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


_ENCODERS: dict[str, BacktrackingEncoder] = {}


def encoder_of(data: bytes) -> BacktrackingEncoder:
    """The worker's encoder for a vocabulary file; built once per Python process."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BacktrackingEncoder(read_ranks(data))
    return _ENCODERS[key]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), name)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row, whole texts, by a public byte-level vocabulary, without special tokens.

    A null text and an empty text give an empty list, never null; blank texts are ordinary. Strings that look like
    special tokens are ordinary text. Repeated rows and null ids are kept; other columns of df aren't read.
    Narrow: one scan, no shuffle. The vocabulary file (under 2 MB, fixed) is read on the driver and broadcast.
    """
    with open(vocabulary or vocabulary_path(), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared.value).encode
        for b in batches:
            ids, ends = np.empty(1 << 16, np.int32), np.zeros(b.num_rows + 1, np.int32)
            n = 0
            for k, text in enumerate(b.column(1)):
                got = encode(text.as_py()) if text.is_valid else ()
                if n + len(got) > len(ids):
                    ids = np.concatenate([ids, np.empty(max(len(ids), len(got)), np.int32)])
                ids[n : n + len(got)] = got
                n += len(got)
                ends[k + 1] = n
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[:n]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    src = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
