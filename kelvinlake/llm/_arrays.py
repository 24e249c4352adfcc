"""Vectorised text primitives shared by the Python operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 6_000_000
CHUNK = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of words as they are hashed, and 0 for all others; with digits alike, and not.
_PLAIN = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
_ZERO_DIGITS = bytes(48 if 48 <= b <= 57 else _PLAIN[b] for b in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def handing_back(run: Callable) -> Callable:
    """``run`` over a task's batches; what it freed goes back to the system at the
    task's end, as Python workers live on through other stages' tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return task


def as_large(texts: pa.Array) -> pa.LargeStringArray:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def text_buffer(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (rows + 1) of an array without nulls."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _byte_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes, eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix64((eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _GOLD)
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        rest = np.minimum(size[more] - at, 8)
        out[more] = mix64(out[more] * _GOLD + (eight[start[more] + at] & _FIRST_BYTES[rest]))
        at += 8
        more = more[size[more] > at]
    return out


def word_hashes(texts: pa.Array, digits_alike: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offset of each row, rows + 1).

    Words are maximal runs of ASCII letters or digits and of characters beyond ASCII,
    in lower case; but a Han or kana character is a word of its own, as are the signs of
    their block (U+3000 to U+9FFF), since those scripts don't part words. A null text
    has no words.
    """
    low = pc.utf8_lower(as_large(texts))
    data, off = text_buffer(low)
    data = np.frombuffer(data.tobytes().translate(_ZERO_DIGITS if digits_alike else _PLAIN), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a row's end is a word's end
    found, starts = [], []
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not first[end] and data[end] and data[end - 1]:
            step = data[end : end + CHUNK]
            stop = np.flatnonzero((step == 0) | first[end : end + len(step)])
            end += int(stop[0]) if len(stop) else len(step)
        part = data[at:end]
        is_word = part != 0
        new = first[at:end]
        alone = np.flatnonzero((part >= 0xE3) & (part <= 0xE9))  # first of the three bytes of U+3000 to U+9FFF
        if len(alone):
            new = new.copy()
            new[alone] = True
            new[(alone + 3)[alone + 3 < len(new)]] = True
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1] | new[1:]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:] | new[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(s):
            found.append(_byte_hashes(part, s, e - s))
            starts.append(s + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), off).astype(np.int64)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each element, from row offsets."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row. Integers wrap."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def sequence_keys(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row's word sequence, order and length included."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(offsets[:-1].astype(np.uint64), np.diff(offsets))
    key = sums(mix64(words + (place + np.uint64(1)) * _GOLD), offsets)
    return mix64(key + np.diff(offsets).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, offsets). A row with fewer words, but
    with any, has one shingle of all its words."""
    n = np.diff(offsets)
    whole = np.where(n >= size, n - size + 1, 0)
    parts = mix64(words + _GOLD)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += parts[k : len(parts) - size + 1 + k] * np.uint64(2 * k + 1 | (k + 1) << 33)
        ends = np.repeat(offsets[1:], n)[: len(rolled)]
        rolled = mix64(rolled[np.arange(len(rolled)) + size <= ends])
    else:
        rolled = np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        keys = sequence_keys(words, offsets)[short].view(np.uint64)
        at = np.concatenate([[0], np.cumsum(whole)])
        rolled = np.insert(rolled, at[short], keys)
        whole[short] = 1
    return rolled, np.concatenate([[0], np.cumsum(whole)]).astype(np.int64)
