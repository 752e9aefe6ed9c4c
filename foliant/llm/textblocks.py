"""Numpy passes over many texts at once: UTF-8 bytes of a block of texts end to end, with offsets.

Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z. A word's hash is a polynomial over its bytes
modulo 2**64, mixed; a shingle's hash is a polynomial over five word hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
SHINGLE = 5

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers: dict[int, np.ndarray] = {}


def byte_runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of about ``most`` bytes, one row at least."""
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)).cumsum()
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(size, most + (size[first - 1] if first else 0), "right")))
        yield first, end
        first = end


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``BLOCK_BYTES``; null texts count as empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    white = _WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = ~white
    starts[1:] &= white[:-1] | edge[1:-1]
    ends = ~white
    ends[:-1] &= white[1:] | edge[1:-1]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    terms = (_LOWER[data] + np.uint64(1)) * _power(_P, n)
    terms[white] = 0
    total = np.cumsum(terms, dtype=np.uint64)
    sums = total[to] - np.where(at > 0, total[at - 1], np.uint64(0))
    return mix(sums * _power(_P_INV, n)[at]), np.searchsorted(at, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles, text by text, with offsets; a text of one to four words has one."""
    words, first = word_hashes(data, offsets)
    count = np.diff(first)
    if len(words) == 0:
        return words, np.zeros(len(offsets), np.int64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    whole = padded[: len(words)] * _Q[0]
    for k in range(1, SHINGLE):
        whole += padded[k : len(words) + k] * _Q[k]
    own = np.repeat(np.arange(len(count)), count)
    keep = np.arange(len(words)) - first[own] <= np.maximum(count[own] - SHINGLE, 0)
    for t in np.flatnonzero((count > 0) & (count < SHINGLE)):
        a = first[t]
        keep[a + 1 : a + count[t]] = False
        total = (words[a : a + count[t]] * np.array(_Q[: count[t]])).sum(dtype=np.uint64)
        whole[a] = mix(np.array([total]))[0] ^ np.uint64(count[t])
    per_text = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    return mix(whole[keep]), np.concatenate([[0], np.cumsum(per_text)])


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the values of each text in place; returns them and a mark on the first of equal ones."""
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][offsets[:-1] < len(values)]] = True
    return values, new
