"""Words, shingles and their hashes, computed on Arrow text columns with numpy.

A word is a maximal run of digits, letters a-z (A-Z lower-cased) and
characters beyond ASCII.  All work runs on the UTF-8 bytes: every byte of a
character beyond ASCII is 0x80 or more.  Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BLOCK = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
# everything but white space: blank, tab, line feed, vertical tab, form feed, return
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``; text i has words ``first[i]`` to ``first[i+1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    origin: np.ndarray  # first byte of each text

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one blank."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each range, from running sums; in blocks, so that memory stays small."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + TEXT_BLOCK, "right")))
        low, high = start[a], end[b - 1]
        power = np.full(high - low + 1, _BASE)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        # the base is odd, so it has an inverse modulo 2**64
        inverse = np.full(high - low + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return out


def split_words(texts: pa.Array, kind: np.ndarray = ALNUM) -> Words:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    _, offsets, raw = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = LOWER[np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[bounds] = False
    after[bounds] = False
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), _hashes(data, start, end), bounds)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and each text's first position among them.

    A text with fewer words, but not none, has one shorter shingle.
    """
    count = np.diff(words.first)
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(number)])
    at = np.repeat(words.first[:-1] - first[:-1], number) + np.arange(first[-1])
    length = np.repeat(np.minimum(count, width), number)
    padded = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    total = length.astype(np.uint64)
    for j in range(width):
        total = np.where(j < length, total * _STEP + padded[at + j], total)
    return mix(total), first


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each (a longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    reach = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        done = reach[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(reach, done + limit, "right")))
        yield batch.slice(a, b - a)
        a = b
