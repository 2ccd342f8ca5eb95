"""Words and shingles of many texts at once, as 64-bit hashes, in numpy (runs inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
SLICE = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse modulo 2**64, for n positions."""
    if not _powers or len(_powers[0]) < n:
        base = int(_STEP)
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and each text's number of words."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    whole = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        to = min(at + SLICE, len(whole))
        while to < len(whole) and not _IS_SPACE[whole[to - 1]]:  # a slice ends with white space
            step = np.flatnonzero(_IS_SPACE[whole[to : to + SLICE]])
            to = to + int(step[0]) + 1 if len(step) else min(to + SLICE, len(whole))
        b = whole[at:to]
        if lower:
            b = b + (((b >= 65) & (b <= 90)).view(np.uint8) << 5)
        space = _IS_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        up, down = _power(max(SLICE, len(b)) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start]))
        starts.append(start + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    where = np.searchsorted(ends, np.concatenate(starts), side="right")
    return np.concatenate(hashes), np.bincount(where, minlength=len(texts))


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of so many lower-cased (A-Z) words, as sorted hashes; shorter texts have one."""
    hashes, counts = word_hashes(texts, lower=True)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * _ODD[k]
    rolled = mix(rolled)
    at = 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(rolled[at : at + c - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            yield mix((hashes[at : at + c] * _ODD[:c]).sum(keepdims=True) + _ODD[32 + c])
        else:
            yield np.zeros(0, np.uint64)
        at += c


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into runs of rows with about `most` bytes of text (one row at least), with the texts as bytes; null: empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]).cumsum()
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, to - at), column.slice(at, to - at).to_pylist()
            at = to
