"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than ASCII white space, after A-Z are
lower-cased.  A word's hash is a polynomial in its bytes modulo 2^64, taken
from prefix sums over the whole batch; a shingle's hash mixes the hashes of
its words in order.  Texts go through in chunks of about ``CHUNK_BYTES``, and a
longer text in slices cut at white space, so the working arrays stay small.
"""

from __future__ import annotations

import functools

import numpy as np

from depotline.llm.keytable import MULTIPLIER

BASE = 0x5851F42D4C957F2D  # fixed value: an odd multiplier modulo 2^64
CHUNK_BYTES = 1 << 18
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    def row(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    return row(BASE), row(pow(BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a byte array."""
    starts, hashes, first = [], [], 0
    while first < len(data):
        last = min(len(data), first + 2 * CHUNK_BYTES)
        if last < len(data):
            white = np.flatnonzero(_WHITE[data[first:last]])
            while not len(white) and last < len(data):  # a word longer than the slice stays whole
                last = min(len(data), 2 * last - first)
                white = np.flatnonzero(_WHITE[data[first:last]])
            last = first + int(white[-1]) + 1 if len(white) else len(data)
        start, h = _word_hashes(data[first:last])
        starts.append(start + first)
        hashes.append(h)
        first = last
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_WHITE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    small = len(data) <= 2 * CHUNK_BYTES
    up, down = powers(2 * CHUNK_BYTES) if small else powers.__wrapped__(len(data))  # large ones aren't kept
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    return start, mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * MULTIPLIER)


def shingle_sets(texts: list[str | None], size: int):
    """Yield (first text, [sorted distinct shingle hashes of each text]) chunk by chunk."""
    first = 0
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # bytes.lower: A-Z only
    while first < len(raw):
        last, total = first, 0
        while last < len(raw) and (last == first or total + len(raw[last]) < CHUNK_BYTES):
            total += len(raw[last]) + 1
            last += 1
        yield first, _sets(raw[first:last], size)
        first = last


def _sets(raw: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw), np.uint8)
    begin = np.cumsum([0] + [len(r) + 1 for r in raw])
    start, word = word_hashes(data)
    at = np.searchsorted(start, begin)  # the first word of each text; the last entry: one past all words
    n_words = np.diff(at)
    out = []
    rolled = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for j in range(size):
        rolled = mixed(rolled * MULTIPLIER + word[j:j + len(rolled)])
    for a, n in zip(at[:-1], n_words):
        if n >= size:
            h = rolled[a:a + n - size + 1]
        elif n:
            one = np.full(1, n, np.uint64)  # the whole sequence as one shingle
            for w in word[a:a + n]:
                one = mixed(one * MULTIPLIER + w)
            h = one
        else:
            h = np.zeros(0, np.uint64)
        out.append(np.unique(h))
    return out
