"""Cut many texts into hashed words at once with numpy.

Texts are handled a chunk at a time (about ``CHUNK_CHARS`` code points, or one longer
text), so memory does not follow the size of an Arrow batch. Words are maximal runs of
word characters; ``alnum`` takes letters, digits and everything beyond ASCII, ``spaced``
takes everything but ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

CHUNK_CHARS = 250_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _alnum() -> np.ndarray:
    table = np.zeros(129, bool)
    for c in range(128):
        table[c] = chr(c).isalnum()
    table[128] = True
    return table


def _spaced() -> np.ndarray:
    table = np.ones(129, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


ALNUM, SPACED = _alnum(), _spaced()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_CHARS + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a chunk of texts: code points, spans in them, owning text, hash."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    n_texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n_texts)

    def firsts(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts with the index of the first; null is the empty text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > CHUNK_CHARS:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the code points of each span; equal spans have equal hashes wherever they stand."""
    power, inverse = _grown(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def cut(texts: Sequence[str], table: np.ndarray = ALNUM, lower: bool = True) -> Words:
    if lower:
        texts = [t.lower() for t in texts]
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = table[np.minimum(codes, 128)]
    step = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return Words(codes, starts, ends, owner, span_hashes(codes, starts, ends), len(texts))


def grams(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words of one text, and the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _GRAM
        out += hashes[j : n + j]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(out[at]), at
