"""Fuzzy line deduplication across a corpus.

Lines are normalised to their words in lower case with all digits alike; a line
without a word, but not blank, to its characters. Lines with one word sequence are one
class. Classes are linked if the edit similarity of their words, 1 - distance / longer
length, is at least 0.8. Candidates lose no such pair: an edit of a word changes at most
``GRAM`` word n-grams, so lines of n >= m words within k edits share at least
n + 1 - GRAM * (k + 1) of them, and if all lines rank their n-grams alike, they share one
of their first few, and a line has a posting for each of these. Longer lines have some more
and must share as many (``shared_grams``) in places that fit. Rare ones rank first, by
hashed counts over all documents; the ranking decides how many candidates there are, not which
links. Postings travel as sorted columns, one row for each of a task's target parts. In a bucket, lengths and the
parities of word hashes (an edit changes two bits at most) rule pairs out before they
are verified. Of each connected group the first occurrence (least doc_id, row, line)
stays.
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.llm._arrays import as_large, handing_back, mix64, row_of, sequence_keys, shingles, slices, word_hashes
from kelvinlake.llm._fetch import BROADCAST_ROWS, likely_rows, only_rows
from kelvinlake.llm._links import FIRST, WHOLE, buckets, link
from kelvinlake.scratch import Scratch

SIMILARITY = 0.8
GRAM = 2
#: Counters that rank n-grams, and those that a row of a task's counts holds.
COUNTERS, CHUNK = 1 << 20, 1 << 16
#: Postings that a task of the bucket stage holds, on average at most.
PART_POSTINGS = 1 << 20
#: Postings that a task of the text stage holds before it hands them on.
HELD_POSTINGS = 1 << 21
_TOKEN = 40
#: A signature: the number of words, if it is less than this, above parities of their hashes;
#: and the n-gram's place in the line, in parts of 256.
SIGNATURE = np.dtype([("line", np.uint64), ("place", np.uint8)], align=True)
_LONGEST = 4095
_BITS = 52
_PARITY = np.uint64((1 << _BITS) - 1)
#: Words up to which parities rule lines out: half of them differ in unlike lines, longer ones may differ in more.
_PARITIES = 80
#: Pairs of lines whose edits are counted at once; fewer, and those of more times 64 words, go one by one.
PAIRS_AT_ONCE, FEW_PAIRS, MOST_PARTS = 2048, 16, 8
#: Lines on one side of a block.
SIDE = 1024
#: Cells over which the words of a block's lines are counted, at most.
_CELLS = 2048
#: Words for each further n-gram that lines must share, and the most of these that count.
_WORDS_A_SHARED, _MOST_SHARED = 24, 6


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lines, offsets of rows) of an array of texts."""
    lists = pc.split_pattern(as_large(texts), "\n")
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(at[0], at[-1] - at[0]), at - at[0]


def _without_words(line: pa.Array) -> np.ndarray:
    """Keys of lines that have no words: of their characters; 0 if there are none."""
    each = pc.dictionary_encode(pc.utf8_trim_whitespace(line))
    keys = [xxhash.xxh64_intdigest(x) | 1 if x else 0 for x in each.dictionary.to_pylist()]
    return np.array([*keys, 0], np.uint64).view(np.int64)[each.indices.to_numpy()]


def _lines(batches):
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            line, at = _split(part.column("text"))
            doc = row_of(at)
            words, off = word_hashes(line, digits_alike=True)
            token, _ = _tokens(words, off)
            total += np.bincount((token % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            key, n = sequence_keys(words, off), np.diff(off)
            none = np.flatnonzero(n == 0)
            key[none] = _without_words(line.take(pa.array(none)))
            some = np.flatnonzero((n > 0) | (key != 0))
            doc = doc[some]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(doc)),
                    part.column("row").take(pa.array(doc)),
                    pa.array((some - at[:-1][doc]).astype(np.int32)),
                    pa.array(key[some]),
                    pa.array(n[some].astype(np.int32)),
                    pa.nulls(len(some), pa.binary()),
                ],
                _NAMES,
            )
    if total.any():
        at = np.arange(0, COUNTERS, CHUNK)
        nothing = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.int32())]
        counts = pa.array([total[x : x + CHUNK].tobytes() for x in at], pa.binary())
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(at), pa.nulls(len(at), pa.int32()), counts], _NAMES)


#: Lines; and, with ``counts``, a task's counts of n-grams from counter ``key`` on.
_LINES = "doc_id long, row long, line int, key long, words int, counts binary"
_NAMES = [x.split()[0] for x in _LINES.split(", ")]


def edits(longer: np.ndarray, least: float) -> np.ndarray:
    """Most edits at which lines, the longer of ``longer`` words, are similar."""
    return ((1 - least) * longer + 1e-9).astype(np.int64)


def shared_grams(n: np.ndarray) -> np.ndarray:
    """How many of their first n-grams lines, the shorter of n words, share at least if they are
    similar and not equal. Much less than all that they share, n - GRAM * edits or so."""
    return 1 + np.minimum(n // _WORDS_A_SHARED, _MOST_SHARED - 1)


def first_grams(n: np.ndarray, least: float) -> np.ndarray:
    """How many first n-grams of a line of n words have ``shared_grams`` in common with every
    line that is similar to it and not equal; 0 if there can be none."""
    out = np.zeros(len(n), np.int64)
    # a similar line of j words more shares (n + j) + 1 - GRAM * (k + 1) n-grams; beyond this j the bound only falls
    for j in range(int(GRAM / (1 - GRAM * (1 - least))) + 1):
        k = edits(n + j, least)
        out = np.maximum(out, np.where((k >= 1) & (k >= j), shared_grams(n) + GRAM * k - j, 0))
    return np.minimum(out, np.maximum(n + 1 - GRAM, 0))


def _tokens(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, at = shingles(words, offsets, GRAM)
    return mix64(grams) >> np.uint64(64 - _TOKEN), at


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column("key").to_pylist(), batch.column("counts"), strict=True):
            total[at] = total.get(at, 0) + np.frombuffer(raw.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["key", "counts"])


def gram_levels(counts: DataFrame) -> np.ndarray:
    """Level (0 to 63, the logarithm of the count) of each counter of n-grams, from the
    counts (key, counts) of all tasks."""
    out = np.zeros(COUNTERS, np.uint8)
    parts = counts.repartition(COUNTERS // CHUNK, "key").mapInArrow(handing_back(_summed), "key long, counts binary").toArrow()
    for at, raw in zip(parts["key"].to_pylist(), parts["counts"].to_pylist(), strict=True):
        out[at : at + CHUNK] = np.minimum(63, 3 * np.log2(1 + np.frombuffer(raw, np.int64)))
    return out


def _planes(x: np.ndarray) -> bytes:
    """The bytes of a column, all first ones first: equal high bytes compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _column(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * at).reshape(8, n).T).view(np.uint64).ravel()


def _order(token: np.ndarray) -> np.ndarray:
    """Places of tokens in their order; equal ones as they came."""
    bits = np.uint64(64 - _TOKEN)
    if len(token) >> 64 - _TOKEN:
        return np.argsort(token, kind="stable")
    return (np.sort(token << bits | np.arange(len(token), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)


def _handed_on(held: list, parts: int) -> pa.RecordBatch:
    """One row for each part: its postings sorted by token, as differences, ids and signatures."""
    token, ids, sig, place = (np.concatenate([x[c] for x in held]) for c in range(4))
    order = _order(token)
    token, ids, sig, place = token[order], ids[order], sig[order], place[order]
    part = token * np.uint64(parts) >> np.uint64(_TOKEN)  # ranges of tokens
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    blobs = [
        _planes(np.diff(token[lo:hi], prepend=np.uint64(0))) + _planes(ids[lo:hi]) + _planes(sig[lo:hi]) + place[lo:hi].tobytes()
        for lo, hi in zip(edge[:-1], edge[1:], strict=True)
    ]
    return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "postings"])


def _postings(levels: np.ndarray, least: float, parts: int):
    """What classes meet by: a class under each of its first n-grams. A class comes once
    a slice of texts; slices and tasks may repeat each other's."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words, off = word_hashes(_split(part.column("text"))[0], digits_alike=True)
                n = np.diff(off)
                key = sequence_keys(words, off)
                take = first_grams(n, least)
                chosen = np.zeros(len(n), bool)
                chosen[np.unique(key, return_index=True)[1]] = True
                chosen &= take > 0
                words = words[np.repeat(chosen, n)]
                n, key, take = n[chosen], key[chosen], take[chosen]
                off = np.concatenate([[0], np.cumsum(n)])
                step = 1 << 16  # the number of a line takes 16 bits beside level and token
                for lo in range(0, len(n), step):
                    hi = min(lo + step, len(n))
                    own, at = words[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                    bit = np.uint64(1) << (own % np.uint64(_BITS))
                    parity = np.where(n[lo:hi] <= _PARITIES, np.bitwise_xor.reduceat(bit, at[:-1]), np.uint64(0))
                    sig = parity | (np.minimum(n[lo:hi], _LONGEST).astype(np.uint64) << np.uint64(_BITS))
                    token, place = _tokens(own, at)
                    level = levels[(token % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
                    row = row_of(place)
                    ranked = (row.astype(np.uint64) << np.uint64(_TOKEN + 6)) | (level << np.uint64(_TOKEN)) | token
                    order = np.argsort(ranked)
                    ranked = ranked[order]
                    ok = np.arange(len(row)) - place[row] < take[lo:hi][row]
                    ok[1:] &= ranked[1:] != ranked[:-1]
                    row = row[ok]
                    # an n-gram that a line repeats has no single place in it: 255 says so
                    again = np.append(ranked[1:] == ranked[:-1], False)[ok]
                    at = np.where(again, 255, (order[ok] - place[row]) * 254 // np.maximum(place[row + 1] - place[row], 1)).astype(np.uint8)
                    held.append((ranked[ok] & np.uint64((1 << _TOKEN) - 1), key[lo:hi][row].view(np.uint64), sig[row], at))
                    size += len(row)
                    if size >= HELD_POSTINGS:
                        yield _handed_on(held, parts)
                        held, size = [], 0
        if size:
            yield _handed_on(held, parts)

    return run


def _met(least: float):
    """Rows of ``FIRST`` from the postings of whole parts."""

    def bucketed(blobs: list[bytes]):
        token, ids, sig = [], [], []
        for raw in blobs:
            n = len(raw) // 25
            token.append(np.cumsum(_column(raw, 0, n)))
            ids.append(_column(raw, 1, n))
            sig.append(np.zeros(n, SIGNATURE))
            sig[-1]["line"], sig[-1]["place"] = _column(raw, 2, n), np.frombuffer(raw, np.uint8, n, 24 * n)
        token, ids, sig = np.concatenate(token), np.concatenate(ids), np.concatenate(sig)
        order = _order(token)
        sorted_ = token[order]
        alone = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        order = order[~(alone & np.concatenate([alone[1:], [True]]))]
        if len(order):
            order = order[np.argsort(ids[order])]
            order = order[_order(token[order])]
            yield from buckets(token[order].view(np.int64), ids[order].view(np.int64), sig[order], partial(may_be_similar, least))

    def run(batches):
        part, blobs = None, []
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("postings"), strict=True):
                if p != part and blobs:
                    yield from bucketed(blobs)
                    blobs = []
                part = p
                blobs.append(raw.as_py())
        if blobs:
            yield from bucketed(blobs)

    return run


def may_be_similar(least: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of ``WHOLE`` of an n-gram that two lines have in common, 0 if their lengths, parities
    or its places rule the similarity out. Words before it and behind it must be moved by as many edits.
    One that a line repeats may stand for all that they must share."""
    a, b = x["line"], y["line"]
    n, m = (a >> np.uint64(_BITS)).astype(np.int32), (b >> np.uint64(_BITS)).astype(np.int32)
    longer = np.maximum(n, m)
    k = _edits_of(least)[longer]
    ok = (np.abs(n - m) <= k) & ((np.bitwise_count((a ^ b) & _PARITY) <= 2 * k) | (longer > _PARITIES)) | (longer == _LONGEST)
    out = np.zeros(len(ok), np.int64)
    some = np.flatnonzero(ok)  # few: the rest is for them alone
    n, m, k, longer = n[some], m[some], k[some], longer[some]
    p, q = x["place"][some].astype(np.int32), y["place"][some].astype(np.int32)
    before = p * (n - 1) - q * (m - 1)  # in parts of 254, each place rounded down by less than a part of its line
    moved = np.abs(before) + np.abs((n - m) * 254 - before)
    again = (p == 255) | (q == 255)
    fits = (moved <= 254 * k + 2 * (n + m)) | again | (longer == _LONGEST)
    out[some] = np.where(fits, np.where(again, WHOLE, WHOLE // shared_grams(np.minimum(n, m))), 0)
    return out


@cache
def _edits_of(least: float) -> np.ndarray:
    return edits(np.arange(_LONGEST + 1), least).astype(np.int32)


def edit_similar(x: list, y: list, least: float) -> bool:
    """Whether 1 - edit distance / longer length >= ``least``, for two word lists.

    Common ends are taken off; then a column of differences of the distance table is
    one integer of as many bits as words (Myers), and each word of y is a few operations."""
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    lo, n = 0, min(len(x), len(y))
    while lo < n and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if max(len(x), len(y)) <= most:
        return True
    if not x or not y:
        return False
    at: dict = {}
    for i, word in enumerate(x):
        at[word] = at.get(word, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    more, less, distance = full, 0, len(x)
    for left, word in zip(range(len(y) - 1, -1, -1), y, strict=True):
        same = at.get(word, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(across | more)), more & across
        distance += bool(up & top) - bool(down & top)
        if distance - left > most:
            return False
        up, down, same = up << 1 | 1, down << 1, same | less
        more, less = full & (down | ~(same | up)), full & up & same
    return distance <= most


def share_words(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted rows of words have enough in common: an edit takes one away."""
    longer = max(len(x), len(y))
    need = longer - int(edits(np.array(longer), least))
    if min(len(x), len(y)) < need:
        return False
    # the i-th occurrence of a word in x has a partner if y has it i times too
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    at = np.searchsorted(y, x) + nth
    ok = at < len(y)
    return int((y[at[ok]] == x[ok]).sum()) >= need


def _flat(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets) of bodies."""
    bodies = bodies.cast(pa.large_binary())
    _, offsets, data = bodies.buffers()
    off = np.frombuffer(offsets, np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    words = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return words.view(np.uint32), (off - off[0]) // 4


def _distances(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distance of the first n[i] words of each row of x and the first m[i] of y, m falling from row
    to row and all of n in the same 64 words: ``edit_similar``'s columns of differences in integers of 64
    bits, each with what the one below carries, those of all rows at once."""
    one = np.uint64(1)
    parts = -(-int(n[0]) // 64)
    last = ((n - 1) % 64).astype(np.uint64)
    more, less = np.full((parts, len(n)), ~np.uint64(0)), np.zeros((parts, len(n)), np.uint64)
    distance, equal = n.astype(np.int64), np.zeros((len(n), 64 * parts), bool)
    for k in range(int(m[0])):
        rows = int(np.searchsorted(-m, -k))  # those with a word k
        np.equal(x[:rows], y[:rows, k, None], out=equal[:rows, : x.shape[1]])
        same_all = np.packbits(equal[:rows], axis=1, bitorder="little").view("<u8")
        carry_up, carry_down = one, None
        for part in range(parts):
            same, high, low = same_all[:, part], more[part, :rows], less[part, :rows]
            beside = same | low
            if carry_down is not None:
                same = same | carry_down
            across = (((same & high) + high) ^ high) | same
            up, down = low | ~(across | high), high & across
            if part == parts - 1:
                distance[:rows] += ((up >> last[:rows]) & one).view(np.int64) - ((down >> last[:rows]) & one).view(np.int64)
            carried = up >> np.uint64(63), down >> np.uint64(63)
            up, down = up << one | carry_up, down << one
            if carry_down is not None:
                down |= carry_down
            more[part, :rows], less[part, :rows] = down | ~(beside | up), up & beside
            carry_up, carry_down = carried
    return distance


def _rows(words: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row for each run of words, filled up with zeros."""
    out = np.zeros((len(n), int(n.max(initial=1))), np.uint32)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row, at] = words[np.repeat(start, n) + at]
    return out


def similar_pairs(words: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """``edit_similar`` of lines i and j, whose words lie between their offsets: many pairs of like lengths
    at a time, very long ones one by one."""
    size = np.diff(off)
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    n, m = size[i], size[j]
    k = edits(m, least)
    out = m - n <= k
    out[n == 0] &= m[n == 0] == 0
    some = np.flatnonzero(out & (n > 0))
    parts = (n[some] + 63) // 64
    order = np.lexsort((-m[some], parts))
    some, parts = some[order], parts[order]
    edge = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(some) else []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        for at in (some[x : min(x + PAIRS_AT_ONCE, hi)] for x in range(lo, hi, PAIRS_AT_ONCE)):
            if parts[lo] <= MOST_PARTS and len(at) >= FEW_PAIRS:
                x, y = _rows(words, off[i[at]], n[at]), _rows(words, off[j[at]], m[at])
                out[at] = _distances(x, n[at], y, m[at]) <= k[at]
                continue
            for one in at:
                x, y = words[off[i[one]] : off[i[one] + 1]], words[off[j[one]] : off[j[one] + 1]]
                out[one] = share_words(np.sort(x), np.sort(y), least) and edit_similar(x.tolist(), y.tolist(), least)
    return out


class LineJudge:
    """Links bodies (32 bits of each word's hash) whose edit similarity reaches ``least``."""

    def __init__(self, least: float):
        self.least = least

    def pairs(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        words, off = _flat(pa.concat_arrays([x, y]))
        i = np.arange(len(x))
        return similar_pairs(words, off, i, i + len(x), self.least)

    def prepare(self, bodies: list[bytes]):
        words, off = _flat(pa.array(bodies, pa.binary()))
        owner = row_of(off)
        order = np.lexsort((words, owner))  # owners are in order as they are
        word = words[order].astype(np.uint64)
        first = np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])[: len(word)]
        start = np.flatnonzero(first)
        nth = np.arange(len(word)) - np.repeat(start, np.diff(np.append(start, len(word))))
        # a word's second occurrence in a line is a word of its own
        names, cell, n = np.unique(word | nth.astype(np.uint64) << np.uint64(32), return_inverse=True, return_counts=True)
        cells = np.cumsum(n > 1) - 1  # words of one line are of no use
        shared = n[cell] > 1
        cell, owner = cells[cell[shared]] % _CELLS, owner[shared]
        width = min(_CELLS, int(cells[-1]) + 1 if len(cells) else 0)
        counts = np.bincount(cell + width * owner, minlength=width * len(bodies)).reshape(len(bodies), -1).astype(np.float32)
        return words, off, np.diff(off), counts

    def may(self, block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, counts = block[2:]
        longer = np.maximum(n[i][:, None], n[j][None])
        need = longer - edits(longer, self.least)
        # an edit takes a word away; what lines have in common is in one cell: no more than this
        return (counts[i] @ counts[j].T >= need) & (np.minimum(n[i][:, None], n[j][None]) >= need)

    def several(self, block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return similar_pairs(*block[:2], i, j, self.least)


def _bodies(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            words, off = word_hashes(part.column("text"), digits_alike=True)
            words = (words >> np.uint64(32)).astype(np.uint32)
            body = [words[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(body, pa.binary())], ["id", "body"])


def line_classes(docs: DataFrame, scratch: Scratch, *, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, classes, decisions).

    Occurrences of lines that aren't blank: doc_id, row, line, key, words. Classes: key,
    first (the first occurrence), n. Decisions: key, first of the whole group, n of the
    group; for the classes that stand for more than one occurrence only.
    """
    if similarity < 0.7:
        raise ValueError("lines that are less similar than 0.7 needn't share an n-gram")
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    both = scratch.store(texts.mapInArrow(handing_back(_lines), _LINES), "lines")
    lines = both.where("counts is null").drop("counts")
    lines._kelvinlake_path = both._kelvinlake_path  # noqa: SLF001 - lets drop() find the table
    levels = gram_levels(both.where("counts is not null").select("key", "counts"))
    place = F.struct("doc_id", "row", "line")
    classes = scratch.store(lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    # a line of n words has about 2 GRAM n / 10 postings; parts grow in number with them, not in size
    postings = lines.agg(F.sum(F.lit(1) + F.col("words") * (GRAM * (1 - similarity) * 1.25))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(postings / PART_POSTINGS) + 1)
    met = (
        texts.mapInArrow(handing_back(_postings(levels, similarity, 2 * parts)), "part int, postings binary")
        .repartition(parts, "part")
        .sortWithinPartitions("part")
        .mapInArrow(handing_back(_met(similarity)), FIRST)
    )

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = (
            classes.join(ids, classes.key == ids.id, "left_semi")
            .groupBy("first.doc_id", "first.row")
            .agg(F.collect_list(F.struct("key", F.col("first.line").alias("line"))).alias("at"))
        )
        wanted = scratch.store(wanted, "wanted")  # an array is bounded by its document's lines
        entries = wanted.agg(F.sum(F.size("at"))).first()[0] or 0
        likely = texts if entries <= BROADCAST_ROWS else likely_rows(texts, wanted)
        found = only_rows(likely, wanted, ["doc_id", "row"], entries).withColumn("all", F.split("text", "\n"))
        at = F.transform("at", lambda x: F.struct(x["key"].alias("key"), F.get("all", x["line"]).alias("text")))
        return (
            found.select(F.explode(at).alias("x")).select("x.key", "x.text").mapInArrow(handing_back(_bodies), "id long, body binary").dropDuplicates(["id"])
        )

    roots, links = link(met, bodies, LineJudge(similarity), scratch, side=SIDE)
    known = classes.select("key", "first", "n").join(roots, F.col("key") == F.col("node"), "left")
    grouped = known.where("node is not null or n > 1").select("key", F.coalesce("root", "key").alias("root"), "first", "n")
    grouped = scratch.store(grouped, "grouped")
    # written first: a join of two plain tables is one whose large keys adaptive execution can split
    groups = scratch.store(grouped.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "groups")
    decisions = scratch.store(grouped.select("key", "root").join(groups, "root").select("key", "first", "n"), "decisions")
    scratch.drop(grouped, groups)
    return lines, classes, decisions


def dedup_lines(
    docs: DataFrame,
    scratch: Scratch | None = None,
    *,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with a new ``text`` and the added columns ``lines`` (before),
    ``dropped`` (sorted line numbers from 0 that went) and ``row``.

    Blank lines always stay. Lines are found alike by their words; those without a word
    (rules, dots) by their characters. Rows that repeat both doc_id and text are one document: they get the same text.
    A null text stays null, with no lines; a null doc_id sorts first. Columns of
    ``docs`` besides text pass through; ones named lines, dropped or row are
    replaced. Empty in, empty out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    lines, classes, decisions = line_classes(docs, scratch, similarity=similarity)
    # the hot side of this join (a line that half of the corpus repeats) is the left one,
    # which adaptive execution may split
    repeated = lines.select("doc_id", "row", "line", "key").join(decisions, "key")
    here = F.struct("doc_id", "row", "line")
    drops = (
        repeated.where(here != F.col("first"))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    )
    drops = scratch.store(drops, "drops")
    scratch.drop(lines, classes, decisions)
    base = docs.drop("lines", "dropped").withColumn("row", F.xxhash64("doc_id", "text"))
    d = drops.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "dropped")
    kept = F.array_join(
        F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n"
    )
    return (
        base.join(d, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
        .drop("_d", "_r")
        .withColumn("lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))))
        .withColumn("text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept))
        .withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    )
