"""Words and shingles of a whole Arrow batch as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        got = np.full(size, _U(base & (2**64 - 1)))
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 2 * CHUNK:
            _POWERS[base] = got
    return got[:n]


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and about so many bytes of one column of texts; a longer text is a part alone."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))])
    a, n = 0, len(batch)
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1))
        yield batch.slice(a, b - a)
        a = b


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string array, and where each row begins (null: empty)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    if texts.null_count:  # the span of a null may hold bytes
        null = np.asarray(texts.is_null())
        keep = np.repeat(~null, np.diff(offsets))
        raw = raw[keep]
        offsets = np.concatenate([[0], np.cumsum(np.where(null, 0, np.diff(offsets)))])
    return raw, offsets


#: Texts are worked on so many bytes at a time (a longer one alone), which bounds the temporary arrays.
CHUNK = 1 << 20


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all rows, A-Z lower-cased, and where each row's words begin (len + 1)."""
    raw, offsets = buffers(texts)
    found, starts, a, rows, base = [], [np.zeros(1, np.int64)], 0, len(offsets) - 1, 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        h, at = _hashed(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        found.append(h)
        starts.append(at[1:] + base)
        a, base = b, base + len(h)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(starts)


def _hashed(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = ink[edges]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[edges - 1] = ink[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    code = _CODE[_LOWER[raw] if lower else raw]
    code *= powers(_BASE, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code, dtype=np.uint64)])
    h = (total[end] - total[start]) * powers(_INVERSE, n)[start]
    h = mix(h ^ mix((end - start).astype(np.uint64)))
    return h, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; all its words as one where it has fewer."""
    n = len(words)
    run = mix(words + _U(1))
    partial = {1: run}
    for j in range(1, k):
        if n > j:
            run = mix(run[: n - j] * _U(0xD6E8FEB86659FD93) + words[j:])
        else:
            run = np.zeros(0, np.uint64)
        partial[j + 1] = run
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            got = np.sort(run[a : b - k + 1])
            out.append(got[np.concatenate([[True], got[1:] != got[:-1]])] if len(got) > 1 else got)
        elif b > a:
            out.append(mix(partial[b - a][a : a + 1] + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
