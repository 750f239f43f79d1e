"""Vectorised text kernels shared by the operators that run on Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, unchanged. All hashes are wrapping
64-bit polynomials over a random byte table followed by a bijective mixer, computed for a whole
block of documents at once, so no Python code runs for each word. Such polynomials of long sequences
vanish for some patterns whatever the base is, so a word of more than LONG bytes is hashed by BLAKE2b.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes of text that are hashed at a time; bounds the memory of a kernel (a longer text is a block of its own).
BLOCK = 1 << 20
#: Bytes of a word, up to which the polynomial is as good as random.
LONG = 32


def tidied(kernel: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A kernel that hands the memory it has freed back to the system when its task ends; workers outlive tasks."""

    @functools.wraps(kernel)
    def run(*args, **more):
        try:
            yield from kernel(*args, **more)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Poly:
    """Polynomial hash of any slice of a sequence from one prefix sum."""

    def __init__(self, seed: int):
        self.base = int(stream(seed, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = stream(seed + 1, 256)
        self.powers = self.inverses = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BLOCK + 1024)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                a = np.full(n, base, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverses[start])


WORD_A, WORD_B = Poly(11), Poly(23)
SPAN_A, SPAN_B = Poly(37), Poly(53)


@dataclass
class Words:
    """The words of a block: byte spans in ``data``, the block's document of each, first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n_docs + 1

    def hashes(self, poly: Poly = WORD_A) -> np.ndarray:
        out = poly.slices(poly.prefix(poly.table[self.data]), self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > LONG):
            out[k] = int.from_bytes(hashlib.blake2b(self.data[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest(), "little")
        return out


def blocks(texts: pa.Array, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of rows with about ``size`` bytes (0: BLOCK); null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, 8 * texts.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (size or BLOCK), "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n_docs = len(offsets) - 1
    inside = ~IS_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    if len(data):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        ends = offsets[1:][offsets[1:] > 0] - 1
        after[ends] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(n_docs), np.diff(first)), first)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of n words; a document of 1 to n - 1 words is one shingle of all of them."""
    count = np.diff(w.first)
    pre = SPAN_A.prefix(w.hashes())
    at = np.arange(len(w.start))
    full = at + n <= w.first[1:][w.doc] if len(at) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    start = np.concatenate([at[full], w.first[short]])
    end = np.concatenate([at[full] + n, w.first[short + 1]])
    return np.concatenate([w.doc[full], short]), SPAN_A.slices(pre, start, end)


def bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) with counts, in ascending order."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))
