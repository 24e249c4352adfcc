"""From bucketed rows to verified links and their components, without all pairs of a
bucket and without a row per pair of a dense one.

A bucket is a set of rows with one key. One with few near pairs gives them all; a
dense one gives its members' pairs with its first member, and its members. Where similar
rows must share several keys, a bucket gives its pairs a part of ``WHOLE`` only, and pairs
that don't come to it over all buckets are not tried; one that meets in a dense bucket is
covered by that. Pairs are judged on the two rows' bodies, and components of the links are found. A dense
bucket in which more than one component is left is then dealt out in blocks: its
members outside its largest component, in slices, against all members, in slices.
A task judges the pairs of a block that lie in different components and gives a link
only if it joins two: at most as many links as there are components in the block.
So every pair that could join two components is judged, by the same rule whatever
the size of its bucket, and no pair of a dense bucket becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.llm._arrays import handing_back
from kelvinlake.operators.components import components
from kelvinlake.scratch import Scratch

FIRST = "key long, a long, b long, weight long"
PAIRS = "a long, b long"
#: Weight from which a pair is tried; 2 to 6 buckets can share it evenly.
WHOLE = 60
#: Members up to which buckets of one size are compared together.
SMALL = 64
#: Near pairs of whole weight per member up to which a bucket gives them all at once.
SPARSE = 4
#: Pairs compared at once.
CELLS = 1 << 16
#: Members on one side of a block.
SLICE = 256

#: Whether pairs x[i], y[i] are near, or their weights: 0 for those that aren't.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Judge(Protocol):
    """Decides links by the bodies (bytes) of rows. In blocks, by ``row``, or by
    ``several(block, i, j)``: whether bodies i[k] and j[k] are linked, for each k."""

    def pairs(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        """Whether x[i] and y[i] are linked, for each i."""

    def prepare(self, bodies: list[bytes]) -> object:
        """What ``row`` needs of the bodies of a block."""

    def may(self, block: object, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(i, j): false where a cheap bound rules the link out."""

    def row(self, block: object, i: int, j: np.ndarray, key: int) -> np.ndarray:
        """Whether body i is linked to each of the bodies j. Where ``j`` meets i under a
        key that comes before ``key`` in both, it may say no: that bucket decides."""


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """Columns of whole runs of equal values in the first of the columns, several at a time, in input
    order; binary ones as lists. One run is held at a time, with what else came in its batch."""

    def joined(held: list) -> list:
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*held, strict=True)]

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [
            batch.column(n).to_pylist() if pa.types.is_binary(batch.column(n).type) else batch.column(n).fill_null(0).to_numpy(zero_copy_only=False)
            for n in names
        ]
        last = int(np.searchsorted(-(cols[0] != cols[0][-1]).astype(np.int8), 0))
        if last or (held and held[-1][0][-1] != cols[0][0]):
            held.append([c[:last] for c in cols])
            yield joined(held)
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield joined(held)


def _each_run(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """``_runs``, one run at a time."""
    for cols in _runs(batches, names):
        edge = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1], [True]]))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            yield [c[lo:hi] for c in cols]


def batch_of(schema: str, cols: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names)


def _weights(near: Near, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    found = near(x, y)
    return found * np.int64(WHOLE) if found.dtype == bool else found


def _few_pairs(sig: np.ndarray, near: Near | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The near pairs of a bucket and their weights, or None if they weigh more than ``SPARSE`` per member."""
    m, count, found, at = len(sig), 0, [], 0
    if near is None:  # all pairs are near
        return None if (m - 1) / 2 > SPARSE else (*np.triu_indices(m, 1), np.full(m * (m - 1) // 2, WHOLE))
    while at < m - 1:  # some members against all later ones
        own = np.arange(at, min(m - 1, at + max(1, CELLS // (m - at))))
        later = m - 1 - own
        i = np.repeat(own, later)
        j = np.arange(len(i)) - np.repeat(np.cumsum(later) - later - own - 1, later)
        weight = _weights(near, sig[i], sig[j])
        some = np.flatnonzero(weight)
        found.append((i[some], j[some], weight[some]))
        count += int(found[-1][2].sum())
        if count > SPARSE * WHOLE * m:
            return None
        at += len(own)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _few_pairs_each(start: np.ndarray, m: int, sig: np.ndarray, near: Near | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_few_pairs`` of all buckets of m members; and the starts of those for which it is None."""
    i, j = np.triu_indices(m, 1)
    found, dense = [], []
    step = max(1, CELLS // len(i))
    for lo in range(0, len(start), step):
        at = start[lo : lo + step, None]
        weight = np.full((len(at), len(i)), WHOLE) if near is None else _weights(near, sig[(at + i).ravel()], sig[(at + j).ravel()]).reshape(len(at), -1)
        few = weight.sum(1) <= SPARSE * WHOLE * m
        dense.append(at[~few, 0])
        at, weight = at[few, 0], weight[few]
        row, pair = np.nonzero(weight)
        found.append((at[row] + i[pair], at[row] + j[pair], weight[row, pair]))
    return (*(np.concatenate(c) for c in zip(*found, strict=True)), np.concatenate(dense))


def buckets(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, near: Near | None) -> Iterator[pa.RecordBatch]:
    """Rows of ``FIRST`` of whole buckets, which are runs of equal keys in which equal ids
    are neighbours: pairs (a, b) with what they weigh, and members a of dense buckets, with b null."""
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
    key, ids, sig = key[once], ids[once], sig[once]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    start, size = edge[:-1], np.diff(edge)
    a, b, w, rows = [], [], [], []
    large = size > (SMALL if near is not None else 2 * SPARSE + 1)
    several = []
    for m in np.unique(size[~large & (size > 1)]):  # all buckets of one size together
        i, j, weight, dense = _few_pairs_each(start[size == m], int(m), sig, near)
        a.append(ids[i])
        b.append(ids[j])
        w.append(weight)
        several += [(lo, m) for lo in dense]
    for lo, m in zip(start[large], size[large], strict=True):
        pairs = _few_pairs(sig[lo : lo + m], near)
        if pairs is None:
            several.append((lo, m))
            continue
        a.append(ids[lo + pairs[0]])
        b.append(ids[lo + pairs[1]])
        w.append(pairs[2])
    for lo, m in several:
        r = np.arange(lo, lo + m)
        rows.append(r)
        ok = r[1:] if near is None else r[1:][near(np.repeat(sig[r[:1]], m - 1), sig[r[1:]]) > 0]
        a.append(np.full(len(ok), ids[r[0]]))
        b.append(ids[ok])
        w.append(np.full(len(ok), WHOLE))
    if a and sum(map(len, a)):
        x, y, weight = np.concatenate(a), np.concatenate(b), np.concatenate(w)
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        yield batch_of(FIRST, [pa.nulls(len(new), pa.int64()), x[new], y[new], np.add.reduceat(weight[order].astype(np.int64), new)])
    if rows:
        r = np.concatenate(rows)
        yield batch_of(FIRST, [key[r], ids[r], *[pa.nulls(len(r), pa.int64())] * 2])


def meet(rows: DataFrame, near: Near | None = None) -> DataFrame:
    """``FIRST`` of rows key, id, weight, sig. The heaviest member leads a dense bucket."""

    def run(batches):
        for key, ids, sig in _runs(batches, ["key", "id", "sig"]):
            yield from buckets(key, ids, sig, near)

    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("weight").desc(), "id").select("key", "id", "sig")
    return ordered.mapInArrow(handing_back(run), FIRST)


def _judged(judge: Judge):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(judge.pairs(batch.column("x"), batch.column("y")), pa.bool_()))

    return run


_BLOCKS = ["block", "key", "id", "root", "side", "body"]


def _by_rows(judge: Judge, state: object, i: np.ndarray, j: np.ndarray, may: np.ndarray, root: np.ndarray, key: np.ndarray, found: Callable) -> None:
    for x, others in ((i[r], j[may[r]]) for r in np.flatnonzero(may.any(1))):
        others = others[root[others] != root[x]]
        few = 1
        while len(others):  # a few members of each other component first: one link to it is enough
            others = others[np.argsort(root[others], kind="stable")]
            now = np.arange(len(others)) - np.searchsorted(root[others], root[others]) < few
            for to in others[now][judge.row(state, x, others[now], int(key[x]))]:
                found(x, to)
            others = others[~now]
            others = others[root[others] != root[x]]
            few *= 4


def _by_rounds(judge: Judge, state: object, i: np.ndarray, j: np.ndarray, may: np.ndarray, root: np.ndarray, found: Callable) -> None:
    x, y = np.nonzero(may)
    x, y = i[x], j[y]
    few = 1
    while len(x):  # a few pairs of each member first: their links leave fewer to judge
        now = np.arange(len(x)) - np.searchsorted(x, x) < few
        for one, to in zip(*(z[now][judge.several(state, x[now], y[now])] for z in (x, y)), strict=True):
            found(one, to)
        x, y = x[~now], y[~now]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        few *= 4


def _joining(judge: Judge):
    """Links that join two components of a block, if none of the task's earlier ones do."""

    def run(batches):
        into: dict[int, int] = {}  # components that links of this task have joined to others

        def now_in(x: int) -> int:
            while x in into:
                into[x] = x = into.get(into[x], into[x])
            return x

        for _, key, ids, root, side, body in _each_run(batches, _BLOCKS):
            names, root = np.unique(root, return_inverse=True)
            names, now = np.unique(np.array([now_in(x) for x in names.tolist()]), return_inverse=True)
            root = now[root]
            if len(names) == 1:
                continue
            a, b = [], []

            def found(i: int, j: int) -> None:
                if root[i] != root[j]:  # noqa: B023
                    a.append(ids[i])  # noqa: B023
                    b.append(ids[j])  # noqa: B023
                    into[int(names[root[j]])] = int(names[root[i]])  # noqa: B023
                    root[root == root[j]] = root[i]  # noqa: B023

            rest, every = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
            # two members outside the largest component meet on either side: the lesser id's row judges
            outside = side[every] == 2
            state = judge.prepare(body)
            step = max(1, CELLS // max(1, len(every)))
            for lo in range(0, len(rest), step):
                part = rest[lo : lo + step]
                may = (root[every] != root[part][:, None]) & (~outside | (ids[every] > ids[part][:, None]))
                if may.any():
                    may &= judge.may(state, part, every)
                if hasattr(judge, "several"):
                    _by_rounds(judge, state, part, every, may, root, found)
                else:
                    _by_rows(judge, state, part, every, may, root, key, found)
            if a:
                yield batch_of(PAIRS, [np.minimum(a, b), np.maximum(a, b)])

    return run


def _blocks(dense: DataFrame, roots: DataFrame, scratch: Scratch, side: int) -> DataFrame:
    """block, key, id, root, side of the dense buckets with more than one component. Side 0:
    judges its pairs, as it is outside the largest component; 1 and 2: all members, those
    in it and those outside."""
    members = scratch.store(
        dense.join(roots, dense.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root")), "members"
    )
    parts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main")
    )
    mixed = mixed.where("parts > 1").select(
        "key",
        "main",
        F.ceil(F.col("all") / side).cast("long").alias("slices"),
        F.ceil((F.col("all") - F.col("most")) / side).cast("long").alias("rest"),
    )
    rows = members.join(scratch.store(mixed, "mixed"), "key")
    i, j = F.pmod(F.xxhash64("id"), F.col("rest")), F.pmod(F.xxhash64("id"), F.col("slices"))
    within = F.when(F.col("root") == F.col("main"), 1).otherwise(2)
    against = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), within.alias("side")))
    outside = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(0).alias("side")))
    places = F.when(F.col("root") == F.col("main"), against).otherwise(F.concat(against, outside))
    return rows.select("key", "id", "root", F.explode(places).alias("x")).select(
        F.xxhash64("key", "x.i", "x.j").alias("block"), "key", "id", "root", F.col("x.side").cast("long").alias("side")
    )


def link(first: DataFrame, bodies: Callable[[DataFrame], DataFrame], judge: Judge, scratch: Scratch, *, side: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(components as (node, root), verified links as (a, b)).

    ``first``: rows of ``FIRST``. ``bodies`` gives (id, body) for a table of distinct ids. ``side``: members
    on one side of a block, ``SLICE`` if not given; with more, fewer rows are dealt out for the same pairs.
    The links are all of sparse buckets, and of dense ones enough for the components.
    """
    first = scratch.store(first, "first")
    tried = scratch.store(
        first.where("b is not null").groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= WHOLE).select("a", "b"), "tried"
    )
    dense = first.where("b is null").select("key", F.col("a").alias("id"))
    ids = tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).unionByName(dense.select("id"))
    body = scratch.store(bodies(ids.distinct()), "bodies")
    links = scratch.store(
        tried.join(body.select(F.col("id").alias("a"), F.col("body").alias("x")), "a")
        .join(body.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
        .mapInArrow(handing_back(_judged(judge)), PAIRS),
        "links",
    )
    roots = components(links, scratch)
    if dense.limit(1).count():
        blocks = _blocks(dense, roots, scratch, side or SLICE).join(body, "id")
        found = scratch.store(
            blocks.repartition("block").sortWithinPartitions("block", "side", "id").select(*_BLOCKS).mapInArrow(handing_back(_joining(judge)), PAIRS),
            "links",
        )
        if found.limit(1).count():
            links = links.unionByName(found)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), scratch)
    scratch.drop(first, tried, body)
    return roots, links
