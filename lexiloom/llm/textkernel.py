"""Vectorised text primitives for the training-data operators.

Everything here is numpy over whole Arrow batches: no loop per token. Text is
turned into code points once, folded through a lookup table (0 for separators,
lower-case code point for letters, digits and combining marks), and every token
gets a 64-bit hash from one wrapped cumulative sum.

Nulls count as empty text. Texts of any length are processed whole: a long text
is cut only between tokens, inside this module, and its tokens are numbered on.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points hashed at a time; texts are gathered into chunks of about this size.
SEGMENT = 1 << 18
#: Rows of an Arrow column that are Python strings at a time.
ROWS = 256


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> lower-case code point, or 0 where it separates words."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if cp < 128:
            word = c.isalnum()
        else:
            word = unicodedata.category(c)[0] in "LNM"
        if word:
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """The powers of base from 0 to n - 1 at least, wrapped."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 4096), base, U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; changes x in place and returns it."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Tokens(NamedTuple):
    """Tokens of several texts; those of text i are offsets[i]:offsets[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray  # code point in its own text
    ends: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash_tokens(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(folded)
    inside = np.zeros(n + 2, bool)
    np.not_equal(folded, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(n + 1, U64)
    term = folded.astype(U64)
    term *= power(_BASE, n)[:n]
    np.cumsum(term, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * power(_INVERSE, n)[starts]
    return starts, ends, mix(hashes)


def tokenize(texts: list[str]) -> Tokens:
    """Words of each text: runs of letters, digits and combining marks, lower-cased."""
    return tokenize_points(texts)[0]


def tokenize_points(texts: list[str]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """tokenize; the code points of the texts, one between two; these folded; each text's first."""
    cps = codepoints("\n".join(texts))
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    folded = fold_table()[cps]
    if len(folded) <= SEGMENT + 4096:
        starts, ends, hashes = _hash_tokens(folded)
    else:
        parts, at = [], 0
        while at < len(folded):
            to = min(at + SEGMENT, len(folded))
            step = 4096
            while to < len(folded) and folded[to] != 0:
                gap = np.flatnonzero(folded[to : to + step] == 0)
                to = to + gap[0] if len(gap) else min(to + step, len(folded))
                step *= 2
            s, e, h = _hash_tokens(folded[at:to])
            parts.append((s + at, e + at, h))
            at = to
        starts, ends, hashes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    offsets = np.searchsorted(starts, bounds)
    base = np.repeat(bounds[:-1], np.diff(offsets))
    return Tokens(hashes, starts - base, ends - base, offsets), cps, folded, bounds


def stems(hashes: np.ndarray, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """(words, 1 + sizes) buckets: of the word, and of its first letters for each size; a shorter word repeats its own."""
    out = np.empty((len(hashes), 1 + len(sizes)), np.int64)
    out[:, 0] = hashes % U64(buckets)
    rolled = np.zeros(len(hashes), U64)
    n, x = ends - starts, 1
    for j in range(max(sizes)):
        rolled = rolled * U64(0xD6E8FEB86659FD93) + folded[np.minimum(starts + j, len(folded) - 1)] if len(hashes) else rolled
        if j + 1 in sizes:
            out[:, x] = np.where(n >= j + 1, mix(rolled + U64(j)) % U64(buckets), out[:, 0])
            x += 1
    return out


def _strings(texts: list | pa.Array) -> Iterator[str]:
    if isinstance(texts, list):
        yield from (t or "" for t in texts)
    else:
        for lo in range(0, len(texts), ROWS):
            yield from (t or "" for t in texts.slice(lo, ROWS).to_pylist())


def chunks(texts: list | pa.Array, size: int = SEGMENT) -> Iterator[tuple[int, int, list[str]]]:
    """Cut texts (None is empty) into (from, to, texts) of about size code points; an Arrow column is converted piece by piece."""
    at, held = 0, 0
    part: list[str] = []
    for i, text in enumerate(_strings(texts)):
        if part and held + len(text) > size:
            yield at, i, part
            at, held, part = i, 0, []
        part.append(text)
        held += len(text) + 1
    if part:
        yield at, at + len(part), part


def chosen(texts: list[str] | pa.ChunkedArray, at: np.ndarray) -> list[str]:
    """Some of the texts; those of an Arrow column become Python strings only here."""
    return [texts[i] for i in at] if isinstance(texts, list) else texts.take(pa.array(at)).to_pylist()


def release() -> None:
    """Give memory that is free but kept by the allocators back to the system; idle workers hold it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def grams(tokens: Tokens, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and their offsets by text.

    With short, a text of 1 to k - 1 words gives one hash of all its words; else none.
    """
    counts = tokens.counts()
    n = np.maximum(counts - k + 1, 0)
    if short:
        n = np.where((counts > 0) & (counts < k), 1, n)
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    h = tokens.hashes
    if len(h) >= k:
        rolled = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            rolled *= U64(0xD6E8FEB86659FD93)
            rolled += h[j : len(h) - k + 1 + j]
        at = np.arange(offsets[-1]) + np.repeat(tokens.offsets[:-1] - offsets[:-1], n)
        out = mix(rolled[np.minimum(at, len(rolled) - 1)])
    else:
        out = np.zeros(offsets[-1], U64)
    if short:
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            x = 0
            for v in h[tokens.offsets[i] : tokens.offsets[i + 1]].tolist():
                x = (x * 0xD6E8FEB86659FD93 + v + 1) & (2**64 - 1)
            out[offsets[i]] = x
    return out, offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each group, and the new offsets."""
    group = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    v, g = v[keep], g[keep]
    return v, np.searchsorted(g, np.arange(len(offsets)))
