"""Packing token sequences into windows by non-negative least squares.

Documents give whole windows as far as they reach. The remainders' lengths, in
units of ``UNIT`` tokens, make a histogram; all combinations of at most ``DEPTH``
lengths that fill a window are its columns, and non-negative least squares gives
how often to use each. Counts are rounded within what the histogram still has.
Remainders that no combination takes are packed greedily: they are cut to fill
the gaps of the combinations' windows, then windows of their own, and the last
piece of a shard is cut into powers of two, which need no padding.

A shard is what one task has read until it holds ``SHARD_TOKENS`` tokens, so
memory is bounded and no row moves between tasks.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.llm._arrays import handing_back, slices
from kelvinlake.llm.wordbpe import TEXT_BYTES, encoder

WINDOW, UNIT, DEPTH, SHARD_TOKENS = 2048, 64, 4, 4_000_000
END = 1


@functools.lru_cache(maxsize=8)
def combinations_filling(units: int, depth: int) -> np.ndarray:
    """(units, combinations) counts of each length 1..units whose sum is ``units``."""
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], room: int, most: int) -> None:
        if room == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for length in range(min(room, most), 0, -1):
                grow((*chosen, length), room - length, length)

    grow((), units, units)
    out = np.zeros((units, len(found)))
    for j, chosen in enumerate(found):
        for length in chosen:
            out[length - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * max(1.0, np.abs(a).max(initial=0))
    for _ in range(3 * n):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= slack:
            break
        free[j] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            below = free & (trial <= 0)
            if not below.any():
                break
            step = np.min(x[below] / np.maximum(x[below] - trial[below], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
        x = trial
    return x


def pack(lengths: np.ndarray, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[np.ndarray]:
    """[document, start, length, sequence, offset] of the pieces of documents with
    ``lengths`` tokens. Sequences are numbered from 0; each token is in one piece."""
    doc, start, size, seq, off = ([] for _ in range(5))
    full = lengths // window
    owner = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    at = len(owner)

    rest = lengths - full * window
    classes = -(-rest // unit)
    units = window // unit
    columns = combinations_filling(units, depth)
    histogram = np.bincount(classes, minlength=units + 1)[1:].astype(float)
    left = histogram.astype(np.int64)
    by_class = [deque(np.flatnonzero(classes == c).tolist()) for c in range(1, units + 1)]
    windows: list[list[tuple[int, int, int]]] = []
    x = nnls(columns, histogram) if left.any() else np.zeros(columns.shape[1])
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        need = columns[:, j].astype(np.int64)
        used = np.flatnonzero(need)
        times = int(min(round(x[j]), (left[used] // need[used]).min()))
        left[used] -= times * need[used]
        for _ in range(times):
            members = [by_class[c].popleft() for c in used for _ in range(need[c])]
            windows.append([(d, int(full[d] * window), int(rest[d])) for d in members])

    # greedily: the longest residual first, cut where a window is full
    loose = deque(
        (d, int(full[d] * window), int(rest[d])) for c in range(units - 1, -1, -1) for d in by_class[c]
    )
    done: list[list[tuple[int, int, int]]] = []
    windows = deque(windows)
    while windows or loose:
        pieces = windows.popleft() if windows else []
        room = window - sum(p[2] for p in pieces)
        while room:
            if not loose:
                if not windows:
                    break
                loose.extend(windows.pop())
            d, s, n = loose.popleft()
            take = min(n, room)
            pieces.append((d, s, take))
            room -= take
            if take < n:
                loose.appendleft((d, s + take, n - take))
        done.append(pieces)
    if done and (last := sum(p[2] for p in done[-1])) < window:
        pieces = deque(done.pop())
        while last:
            room = 1 << (last.bit_length() - 1)
            last -= room
            own = []
            while room:
                d, s, n = pieces.popleft()
                take = min(n, room)
                own.append((d, s, take))
                room -= take
                if take < n:
                    pieces.appendleft((d, s + take, n - take))
            done.append(own)
    for k, pieces in enumerate(done):
        o = 0
        for d, s, n in pieces:
            doc.append(d), start.append(s), size.append(n), seq.append(at + k), off.append(o)
            o += n
    none = np.zeros(at, np.int64)
    return [
        np.concatenate([np.asarray(x, np.int64), np.asarray(y, np.int64)])
        for x, y in ((owner, doc), (nth * window, start), (none + window, size), (np.arange(at), seq), (none, off))
    ]


_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
)


def _pack(path: str, window: int, unit: int, depth: int, shard: int):
    def run(batches):
        first = TaskContext.get().partitionId() << 40
        ids, ends, names, held = [], [], [], 0

        def flush():
            nonlocal ids, ends, names, held, first
            flat = np.concatenate(ids).astype("<u4")
            lengths = np.concatenate(ends)
            begin = np.cumsum(lengths) - lengths
            doc, start, size, seq, off = pack(lengths, window, unit, depth)
            raw = memoryview(flat).cast("B")
            at = ((begin[doc] + start) * 4).tolist()
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at, (size * 4).tolist(), strict=True)]
            fill = np.bincount(seq, size).astype(np.int64)
            pad = np.where(fill & (fill - 1) == 0, 0, window - fill)
            named = pa.chunked_array(names).combine_chunks().take(pa.array(doc))
            cols = [start, size, np.array(crc, np.int64), lengths[doc], seq + first, off, np.where(off == 0, pad[seq], 0)]
            out = pa.RecordBatch.from_arrays(
                [named, *map(pa.array, cols)], [x.split()[0] for x in _SCHEMA.split(", ")]
            )
            first += int(seq.max()) + 1
            ids, ends, names, held = [], [], [], 0
            return out

        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                found, off = encoder(path).encode(part.column("text"))
                ids.append(np.insert(found, off[1:], END))
                ends.append(np.diff(off) + 1)
                names.append(part.column("doc_id"))
                held += len(ids[-1])
                if held >= shard:
                    yield flush()
        if held:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    window: int = WINDOW,
    unit: int = UNIT,
    depth: int = DEPTH,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padding.

    ``tokenizer`` is the path of a tokenizer file on every executor. A document is
    its text's ids and one end id; a null or empty text is that id alone. Each
    input row is a document of its own, so repeated rows are packed each, also with
    a null doc_id. ``padding`` is a sequence's, on its first piece, 0 elsewhere; a
    sequence whose length is a power of two needs none. Sequence ids are unique,
    not gapless. Other columns are not read. Empty in, empty out.
    """
    if window % unit:
        raise ValueError("unit must divide window")
    return docs.select("doc_id", F.col("text")).mapInArrow(
        handing_back(_pack(tokenizer, window, unit, depth, shard_tokens)), _SCHEMA
    )
