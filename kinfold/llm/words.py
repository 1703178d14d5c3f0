"""Hashes of words and word n-grams of whole texts, vectorised over UTF-8 bytes.

A word is a maximal run of bytes other than ASCII white space, A-Z lower-cased.
Its 64-bit hash sums random values of its bytes times powers of an odd base, so
that one running sum per block of bytes gives the hashes of all words in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once: what one task holds beside its Arrow batch.
BLOCK = 1 << 18

_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, BLOCK + 4096), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _block_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its hash); a word ends at white space or where a text of ``firsts`` begins."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = firsts[firsts > 0] - 1
    ends[before] = inside[before]
    at, end = np.flatnonzero(starts), np.flatnonzero(ends)
    values = _BYTE[data] * _powers(_BASE, len(data))
    run = np.cumsum(values, dtype=np.uint64)
    sums = run[end] - run[at] + values[at]
    return at, mix64(sums * _powers(_INVERSE, len(data))[at] + (end - at).astype(np.uint64))


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and the number of words before each text.

    The second array has one entry more than there are rows; a null has no words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    firsts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    places, hashes, lo = [], [], 0
    while lo < len(data):
        hi = _cut(data, firsts, lo)
        own = firsts[np.searchsorted(firsts, lo) : np.searchsorted(firsts, hi)] - lo
        at, found = _block_words(data[lo:hi], own)
        places.append(at + lo)
        hashes.append(found)
        lo = hi
    if not places:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def _cut(data: np.ndarray, firsts: np.ndarray, lo: int) -> int:
    """Where the block from ``lo`` ends: not inside a word, so later than BLOCK if a word is that long."""
    hi = lo + BLOCK
    while hi < len(data):
        after = np.flatnonzero(_SPACE[data[hi : hi + BLOCK]])[:1]
        text = firsts[np.searchsorted(firsts, hi) :][:1]
        found = [hi + int(x) for x in after] + [int(x) for x in text]
        if found and min(found) <= hi + BLOCK:
            return min(found)
        hi += BLOCK
    return len(data)


def grams(words: np.ndarray, starts: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie in one text, and the text of each.

    ``whole``: a text of fewer than n words, but some, gives its whole sequence as one.
    """
    counts = np.diff(starts)
    docs = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    if len(words) >= n:
        last = len(words) - n + 1
        sums = words[:last] * _GRAM[0]
        for k in range(1, n):
            sums += words[k : last + k] * _GRAM[k]
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = sums[owner[:last] == owner[n - 1 :]]
    else:
        sums = np.zeros(0, np.uint64)
    hashes = mix64(sums + np.uint64(n))
    if whole and (short := np.flatnonzero((counts > 0) & (counts < n))).size:
        own = np.array(
            [(words[starts[d] : starts[d + 1]] * _GRAM[: counts[d]]).sum(dtype=np.uint64) for d in short], np.uint64
        )
        hashes = np.concatenate([hashes, mix64(own + counts[short].astype(np.uint64))])
        docs = np.concatenate([docs, short])
    return hashes, docs


def distinct_by_doc(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, text after text, and the number before each text."""
    order = np.argsort(docs, kind="stable")  # nearly in order, so cheap
    hashes, docs = hashes[order], docs[order]
    bounds = np.searchsorted(docs, np.arange(n + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(n + 1))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that working arrays stay bounded."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            done = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
