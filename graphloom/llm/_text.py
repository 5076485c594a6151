"""Vectorised text kernels shared by the corpus operators.

Every kernel works on whole texts.  A list of strings is laid out as one
code-point array; word boundaries come from a lookup table and word hashes from
prefix sums, so the cost a character is a handful of NumPy passes and no Python
loop runs a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Characters laid out at once; a longer text is laid out alone, whole.
CHUNK_CHARS = 1 << 18


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True at the code points that belong to a word (letters and digits)."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def fold(text: str) -> str:
    """Lower case that keeps every character's position."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the entropy of a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_CHARS + 1)
        for i, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            if size > CHUNK_CHARS * 4:  # an unusually long text: don't keep its tables
                return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_P, _P_INV))
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of several texts. Word w covers characters start[w]:end[w] of text doc[w], counted in that text."""

    hashes: np.ndarray  # uint64, one a word
    doc: np.ndarray  # int32, index of the word's text
    start: np.ndarray  # int64
    end: np.ndarray  # int64
    first: np.ndarray  # int64, index of each text's first word; one more at the end

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every run of n words within one text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * _Q + self.hashes[k : k + m]
        return mix(h)[at], at


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about CHUNK_CHARS characters; null is the empty text."""
    run, size, at = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > CHUNK_CHARS:
            yield at, run
            run, size, at = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of texts with a newline after each, and where each text starts."""
    folded = [fold(t) for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in folded), np.int64, len(folded))
    cp = np.frombuffer(("\n".join(folded) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate(([0], np.cumsum(lengths)))


def split_words(texts: list[str]) -> Words:
    """Words (runs of letters and digits, lower case) of texts, which are laid out together."""
    cp, at = code_points(texts)
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = word_table()[cp]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _power_tables(len(cp) + 1)
    total = np.empty(len(cp) + 1, np.uint64)
    total[0] = 0
    np.cumsum((cp + np.uint32(1)) * power[: len(cp)], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    doc = (np.searchsorted(at, start, side="right") - 1).astype(np.int32)
    first = np.searchsorted(start, at)
    return Words(hashes, doc, start - at[doc], end - at[doc], first)


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that split_words gives each of these single words."""
    return split_words(words).hashes if words else np.empty(0, np.uint64)


def reduce_by_doc(op: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """op.reduceat over each text's run of values; `empty` where a text has none."""
    n = len(first) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = op.reduceat(values, first[:-1][some], axis=0)
    return out
