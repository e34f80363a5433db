"""Vectorised text primitives shared by the operators that run in Arrow batches.

A block of texts becomes one array of code points. Tokens are maximal runs of word characters
(letters, digits, underscore) or one symbol each, and every token's hash comes from differences of one
prefix sum, so the cost is a few array passes a character and no Python step a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Characters in a block. One longer text forms a block of its own; texts are never cut.
BLOCK_CHARS = 1_000_000
_TOP = 0x3000
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
SPACE, LOWER, UPPER, DIGIT, SYMBOL = range(5)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below ``_TOP`` (above it: a caseless letter): class, shift to lower case, shape counts."""
    kind = np.full(_TOP + 1, LOWER, np.uint8)
    shift = np.zeros(_TOP + 1, np.int32)
    for c in range(_TOP):
        s = chr(c)
        if s.isspace() or c < 32:
            kind[c] = SPACE
        elif s.isdigit():
            kind[c] = DIGIT
        elif s.isupper():
            kind[c] = UPPER
            low = s.lower()
            shift[c] = ord(low) - c if len(low) == 1 else 0
        elif not (s.isalnum() or s == "_"):
            kind[c] = SYMBOL
    counts = np.zeros(_TOP + 1, np.uint64)
    counts[kind == LOWER] += np.uint64(1)
    counts[kind == UPPER] += np.uint64(1 << 16)
    counts[kind == DIGIT] += np.uint64(1 << 32)
    counts[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("f") + 1)]] += np.uint64(1 << 48)
    return kind, shift, counts


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_CHARS + BLOCK_CHARS // 4)
        for k, base in enumerate((_MULT, _INV)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Tokens:
    """Tokens of a block: text number, code point span in the block, and hashes."""

    cp: np.ndarray
    base: np.ndarray  # where each text starts in cp
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sums: np.ndarray
    shapes: np.ndarray | None
    inv: np.ndarray

    def word(self) -> np.ndarray:
        return mix((self.sums[self.end] - self.sums[self.start]) * self.inv[self.start])

    def prefix(self, n: int) -> np.ndarray:
        end = np.minimum(self.start + n, self.end)
        return mix((self.sums[end] - self.sums[self.start]) * self.inv[self.start] + np.uint64(n))


def tokenize(texts: list[str], shapes: bool = False) -> Tokens:
    """Tokens of lower-cased texts; texts are set apart by one line feed, which is white space."""
    kind, shift, counts = _tables()
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = code_points("\n".join(texts))
    base = np.zeros(len(texts), np.int64)
    np.cumsum(lens[:-1] + 1, out=base[1:])
    low = np.minimum(cp, _TOP)
    k = kind[low]
    word = (k != SPACE) & (k != SYMBOL)
    symbol = k == SYMBOL
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    start = np.flatnonzero(edge | symbol)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    end = np.flatnonzero(edge | symbol) + 1
    power, inv = powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp + shift[low] + 1).astype(np.uint64) * power[: len(cp)], out=sums[1:])
    shape = None
    if shapes:
        shape = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(counts[low], out=shape[1:])
    doc = np.searchsorted(base, start, "right") - 1
    return Tokens(cp, base, start, end, doc, sums, shape, inv)


def shape_code(t: Tokens) -> np.ndarray:
    """Small integers for length, case, digits and whether all is hexadecimal; symbols have their own."""
    d = t.shapes[t.end] - t.shapes[t.start]
    n = (t.end - t.start).astype(np.uint64)
    low, up, dig, hexa = (((d >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48))
    level = lambda x: (x > 0).astype(np.uint64) + (x == n)  # noqa: E731  none, some, all
    length = np.searchsorted(np.array([1, 2, 4, 6, 8, 12, 16, 20, 24, 32, 48, 64]), n, "right").astype(np.uint64)
    code = length + np.uint64(16) * (level(low) + np.uint64(3) * (level(up) + np.uint64(3) * (level(dig) + np.uint64(3) * level(hexa))))
    return np.where((low + up + dig) == 0, np.uint64(4096) + t.cp[t.start].astype(np.uint64), code)


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters; each range has one text at least."""
    i, n = 0, 0
    for j, t in enumerate(texts):
        if n and n + len(t) > most:
            yield i, j
            i, n = j, 0
        n += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


@dataclass
class Words:
    """Words of a block: maximal runs of characters other than space and U+0009 to U+000D, unchanged.

    A word's hash is the sum of a mixed number for each of its characters and places, mixed once more; so no word is the other's hash by the
    algebra of one multiplier. ``second`` is a further one, from other numbers for the same characters and places."""

    hash: np.ndarray  # of each word
    doc: np.ndarray
    start: np.ndarray  # in the block's code points
    end: np.ndarray
    base: np.ndarray
    second: np.ndarray | None = None


_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def words(texts: list[str], second: bool = False) -> Words:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = code_points("\n".join(texts))
    base = np.zeros(len(texts), np.int64)
    np.cumsum(lens[:-1] + 1, out=base[1:])
    word = (cp != 32) & ((cp < 9) | (cp > 13))
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    start = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    end = np.flatnonzero(edge) + 1
    doc = np.searchsorted(base, start, "right") - 1
    if not len(start):
        none = np.zeros(0, np.uint64)
        return Words(none, doc, start, end, base, none)
    size = end - start
    at = np.cumsum(size) - size
    own = cp[word].astype(np.uint64)
    own |= (np.arange(len(own)) - np.repeat(at, size)).astype(np.uint64) << np.uint64(21)
    own = mix(own)
    total = np.add.reduceat(own, at) + size.astype(np.uint64)
    return Words(mix(total), doc, start, end, base, mix(np.add.reduceat(mix(own ^ _SECOND), at) + size.astype(np.uint64)) if second else None)


def shingles(w: Words, n_docs: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of n words; a text of fewer words has one, made of all of them."""
    size = np.bincount(w.doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(size)))
    k = len(w.hash) - n + 1
    if k > 0:
        h = np.zeros(k, np.uint64)
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w.hash[j : j + k]
        ok = w.doc[:k] == w.doc[n - 1 :]
        h, doc = mix(h[ok]), w.doc[:k][ok]
    else:
        h, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = []
        for d in short:
            x = np.zeros(1, np.uint64)
            for v in w.hash[first[d] : first[d + 1]]:
                x = x * np.uint64(0xD6E8FEB86659FD93) + v
            own.append(mix(x + np.uint64(size[d])))
        h, doc = np.concatenate([h, *own]), np.concatenate([doc, short])
    return h, doc
