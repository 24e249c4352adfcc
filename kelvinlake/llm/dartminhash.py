"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is a weighted set of five-word shingles; a shingle that occurs c times
weighs 1 + ln c, so that one endlessly repeated phrase doesn't make texts alike.
Each weighted element owns a region [0, weight) x rank; darts fall into it as a
Poisson process that a hash of the element fixes, so equal regions of two
documents get equal darts. A document keeps, for each of ``k`` coordinates, the
earliest dart that falls on it, and looks only at ranks below the one at which
about k ln k + 2 k darts have fallen. Coordinates of two documents agree with
the probability of their weighted Jaccard similarity.

Signatures are joined band by band, and each candidate pair is verified on the
two documents' whole weighted sets: a link means similarity >= 0.8. Texts
with the same word sequence are one class from the start and are signed once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.llm._arrays import handing_back, mix64, row_of, sequence_keys, shingles, slices, sums, word_hashes
from kelvinlake.llm._fetch import only_rows
from kelvinlake.llm._links import link, meet
from kelvinlake.scratch import Scratch

SHINGLE = 5
BANDS, ROWS = 20, 6
_MASK = np.uint64((1 << 24) - 1)
_LOG = 1 + np.log(np.maximum(np.arange(4096), 1))


def signatures(element: np.ndarray, weight: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) coordinates; each is 24 bits of the earliest dart's name. Rows
    without elements get 0. ``weight`` may be any positive number."""
    n = len(offsets) - 1
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    row = row_of(offsets)
    total = np.bincount(row, weight, n)
    reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    cells = np.ceil(weight).astype(np.int64)
    cell = np.arange(cells.sum(), dtype=np.int64) - np.repeat(np.cumsum(cells) - cells, cells)
    owner = np.repeat(np.arange(len(element)), cells)
    names = mix64(element[owner] + cell.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    room, of = (weight[owner] - cell).astype(np.float64), row[owner]
    todo = np.ones(len(names), bool)
    while True:
        _throw(best, names[todo], room[todo], of[todo], reach, k)
        missing = (best.reshape(n, k) == np.iinfo(np.uint64).max).any(1) & (total > 0)
        if not missing.any():
            return np.where(best == np.iinfo(np.uint64).max, np.uint64(0), best & _MASK).reshape(n, k)
        reach = np.where(missing, reach * 2, reach)
        todo = missing[of]


def _throw(best: np.ndarray, names: np.ndarray, room: np.ndarray, of: np.ndarray, reach: np.ndarray, k: int) -> None:
    """Darts of each unit cell in order of rank, as far as its row's reach."""
    rank, j = np.zeros(len(names)), 0
    while len(names):
        j += 1
        h = mix64(names + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        live = rank < reach[of]
        names, room, of, rank, h = names[live], room[live], of[live], rank[live], h[live]
        dart = mix64(h ^ np.uint64(0xA0761D6478BD642F))
        high = (dart >> np.uint64(40)).astype(np.float64) * 2.0**-24
        inside = high < room
        code = of * k + ((dart >> np.uint64(24)) % np.uint64(k)).astype(np.int64)
        value = (np.minimum(rank, 1000.0) * 2.0**30).astype(np.uint64) << np.uint64(24) | mix64(dart) & _MASK
        if inside.all():
            np.minimum.at(best, code, value)
        else:
            np.minimum.at(best, code[inside], value[inside])


def weighted_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, offsets of rows, key of each row's words, words of each row)."""
    words, at = word_hashes(texts)
    found, off = shingles(words, at, size)
    row = row_of(off)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.concatenate([first, [len(found)]]))
    return (
        found[first],
        _LOG[np.minimum(weight, len(_LOG) - 1)] if weight.max(initial=0) < len(_LOG) else 1 + np.log(weight),
        np.searchsorted(row[first], np.arange(len(off))).astype(np.int64),
        sequence_keys(words, at),
        np.diff(at),
    )


def band_keys(element: np.ndarray, weight: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows of texts, bands): keys under which texts meet."""
    sig = signatures(element, weight, offsets, bands * rows).reshape(-1, bands, rows)
    band = np.zeros(sig.shape[:2], np.uint64)
    for r in range(rows):
        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return mix64(band + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                element, weight, off, key, words = weighted_sets(part.column("text"), size)
                band = band_keys(element, weight, off, bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(len(band) + 1, dtype=np.int32) * bands, pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(key), pa.array(words), lists],
                    ["doc_id", "row", "key", "words", "bands"],
                )

    return run


class SetJudge:
    """Links bodies whose weighted Jaccard similarity reaches ``least``. A body: the
    band keys, then (shingle, bits of its weight) pairs, all of 64 bits."""

    def __init__(self, least: float, bands: int):
        self.least, self.bands = least, bands

    def _sets(self, bodies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, weights, number of each body)."""
        flat = [np.frombuffer(x, np.uint64)[self.bands :] for x in bodies]
        both = np.concatenate(flat).reshape(-1, 2)
        return both[:, 0], np.ascontiguousarray(both[:, 1]).view(np.float64), np.repeat(np.arange(len(flat)), [len(x) // 2 for x in flat])

    def _reached(self, shared: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (shared >= self.least * (total - shared) - 1e-9) & (total > 0)

    def pairs(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        out = []
        size = np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy().astype(np.int64))
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 16_000_000, side="right")))
            a, wa, ra = self._sets([v.as_buffer() for v in x[at:to]])
            b, wb, rb = self._sets([v.as_buffer() for v in y[at:to]])
            row, both, weight = np.concatenate([ra, rb]), np.concatenate([a, b]), np.concatenate([wa, wb])
            order = np.lexsort((both, row))
            both, row, weight = both[order], row[order], weight[order]
            same = np.flatnonzero((both[1:] == both[:-1]) & (row[1:] == row[:-1]))
            shared = np.bincount(row[same], np.minimum(weight[same], weight[same + 1]), to - at)
            out.append(self._reached(shared, np.bincount(row, weight, to - at)))
            at = to
        return np.concatenate(out) if out else np.zeros(0, bool)

    def prepare(self, bodies: list[bytes]):
        element, weight, owner = self._sets(bodies)
        names, place = np.unique(element, return_inverse=True)
        off = np.searchsorted(owner, np.arange(len(bodies) + 1))
        keys = np.stack([np.frombuffer(x, np.int64, self.bands) for x in bodies])
        return place, weight, off, np.zeros(len(names)), np.bincount(owner, weight, len(bodies)), keys

    def may(self, block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = block[4]  # the lesser set's weight bounds what is shared
        x, y = total[i][:, None], total[j][None]
        return np.minimum(x, y) >= self.least * np.maximum(x, y) - 1e-9

    def row(self, block, i: int, j: np.ndarray, key: int) -> np.ndarray:
        place, weight, off, held, total, keys = block
        before = int(np.flatnonzero(keys[i] == key)[0])
        out = ~(keys[j, :before] == keys[i, :before]).any(1)
        j = j[out]
        if len(j):
            own = slice(off[i], off[i + 1])
            held[place[own]] = weight[own]
            n = off[j + 1] - off[j]
            at = np.concatenate([[0], np.cumsum(n)])
            index = np.arange(at[-1]) + np.repeat(off[j] - at[:-1], n)
            shared = sums(np.minimum(held[place[index]], weight[index]), at)
            held[place[own]] = 0
            out[out] = self._reached(shared, total[j] + total[i])
        return out


def _bodies(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                element, weight, off, _, _ = weighted_sets(part.column("text"), size)
                keys = band_keys(element, weight, off, bands, rows)
                sets = np.stack([element, weight.astype(np.float64).view(np.uint64)], 1)
                body = [k.tobytes() + sets[a:b].tobytes() for k, a, b in zip(keys, off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(body, pa.binary())], ["id", "body"])

    return run


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch | None = None,
    *,
    threshold: float = 0.8,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: doc_id, row, class_id, class_size, words, kept.

    ``row`` names the input row (a hash of doc_id and text); ``class_id`` is the
    least doc_id of the connected group, ``class_size`` counts its rows. ``kept``
    marks one row of the group: least doc_id, then least ``row``, then any one of rows
    that repeat both. A null text counts as empty; texts without any word are one exact
    class, as their word sequences are equal. A null doc_id sorts first.
    Other columns of ``docs`` are neither read nor returned. Empty in, empty out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "dartminhash")
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    signed = texts.mapInArrow(handing_back(_sign(size, bands, rows)), "doc_id long, row long, key long, words long, bands array<long>")
    signed = scratch.store(signed.withColumn("at", F.monotonically_increasing_id()), "signed")
    classes = signed.groupBy("key").agg(
        F.min(F.struct("doc_id", "row", "at")).alias("least"),
        F.count(F.lit(1)).alias("n"),
        F.any_value("bands").alias("bands"),  # equal word sequences have equal ones
        F.max("words").alias("words"),
    )
    classes = scratch.store(classes, "classes")
    banded = classes.where("words > 0").select(
        F.explode("bands").alias("key"), F.col("key").alias("id"), F.col("n").alias("weight"), F.lit(0).cast("long").alias("sig")
    )

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, classes.key == ids.id, "left_semi").select("key", "least.doc_id", "least.row")
        wanted = scratch.store(wanted, "wanted")
        found = only_rows(texts, wanted, ["doc_id", "row"], wanted.count()).select("key", "text")
        # rows that repeat both doc_id and text stand for one key: one of them is enough
        return found.mapInArrow(handing_back(_bodies(size, bands, rows)), "id long, body binary").dropDuplicates(["id"])

    roots, _ = link(meet(banded), bodies, SetJudge(threshold, bands), scratch)
    grouped = scratch.store(
        classes.join(roots, classes.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("root"), "least", "n"), "grouped"
    )
    groups = grouped.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("class_size"))
    # written first: a join of two plain tables is one whose large keys adaptive execution can split
    decided = grouped.select("key", "root").join(scratch.store(groups, "groups"), "root").select("key", "first", "class_size")
    decided = scratch.store(decided, "decided")
    out = signed.join(decided, "key").select(
        "doc_id",
        "row",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        "words",
        (F.col("at") == F.col("first.at")).alias("kept"),
    )
    scratch.drop(classes, grouped, groups)
    return out
