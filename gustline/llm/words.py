"""Words and word shingles of text columns as 64-bit fingerprints, computed on whole Arrow batches with numpy.

A word is a run of bytes outside ``20 09 0A 0B 0C 0D``; ``A-Z`` count as ``a-z``. UTF-8 never uses these bytes
inside a character, so working on bytes is the same as working on characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Bytes hashed at once: keeps the work arrays of a step within a few MB, whatever the length of a text.
STEP = 1 << 19
# Text handed to an operator's code at once.
SLICE_BYTES = 2 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def mix32(x: np.ndarray) -> np.ndarray:
    """The same on 32-bit numbers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def numbered(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` only."""
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# The first n of eight bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)
_LENGTH, _LANE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
# Longer words are hashed one by one.
_LONG = 1 << 10


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; NULL is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def in_slices(batches, column: int, size: int = SLICE_BYTES):
    """The rows of Arrow batches, at most ``size`` bytes of the text column at a time, one row at least.

    A worker keeps the memory of its largest step, so steps must not grow with the rows of a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(low, high - low)
            low = high


def _steps(data: np.ndarray) -> list[tuple[int, int]]:
    """Cut at blanks so that no word is cut; a step is longer than STEP only if it has no blank."""
    cuts, at = [0], 0
    while len(data) - at > STEP:
        step, look = at, 1 << 12
        while step == at and look <= 2 * STEP:
            low = max(at + 1, at + STEP - look)
            blanks = np.flatnonzero(~_IS_WORD.take(data[low : at + STEP]))
            if len(blanks):
                step = low + int(blanks[-1])
            look *= 8
        if step == at:
            step = at + STEP
            while step < len(data) and _IS_WORD[data[step]]:
                step += 1
        cuts.append(step)
        at = step
    return list(zip(cuts, [*cuts[1:], len(data)], strict=True))


def _hashed(part: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of words, eight bytes of all words at a time."""
    padded = np.zeros(len(part) + 8, np.uint8)
    _LOWER.take(part, out=padded[:-8], mode="clip")
    lanes = np.ndarray((len(part) + 1,), "<u8", padded, strides=(1,))
    found = mix64((lanes[starts] & _FIRST[np.minimum(lengths, 8)]) + lengths.astype(_U) * _LENGTH)
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more) and at < _LONG:
        lane = lanes[starts[more] + at] & _FIRST[np.minimum(lengths[more] - at, 8)]
        found[more] = mix64(found[more] + lane * _LANE)
        at += 8
        more = more[lengths[more] > at]
    for i in more:
        word = padded[starts[i] : starts[i] + lengths[i]].tobytes()
        found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return found


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word, and the n + 1 offsets of each row's words."""
    found, places = [], []
    for low, high in _steps(data):
        part = data[low:high]
        if not len(part):
            continue
        inside = _IS_WORD.take(part)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        # a row begins a word even if the row before ends with one
        edges = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low
        first[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        last[edges] = inside[edges]
        starts = np.flatnonzero(first)
        if len(starts):
            found.append(_hashed(part, starts, np.flatnonzero(last) + 1 - starts))
            places.append(starts + low)
    if not found:
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), bounds)


class Shingles:
    """Sorted distinct fingerprints of ``size`` neighbouring words; fewer words are one shingle, none are none."""

    def __init__(self, size: int):
        self.size, self.weights = size, numbered(size, 3)

    def _hashes(self, words: np.ndarray, take: int) -> np.ndarray:
        total = words[: len(words) - take + 1] * self.weights[0]
        for i in range(1, take):
            total += words[i : len(words) - take + 1 + i] * self.weights[i]
        return mix64(total + _U(take))

    def sets(self, column: pa.Array):
        """The shingles of each row of a string column, in order."""
        words, at = word_hashes(*text_bytes(column))
        # shingles over the end of a row are computed with the others and left out
        whole = self._hashes(words, self.size) if len(words) >= self.size else words[:0]
        for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if high - low >= self.size:
                yield np.unique(whole[low : high - self.size + 1])
            else:
                yield self._hashes(words[low:high], high - low) if high > low else words[:0]
