"""Each operator against a plain version, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelvinlake.llm import _arrays, _fetch, bm25, dartminhash, htmltext, linededup, mixing, packing, queries, severity, tokencount, urltrie, winnow
from kelvinlake.llm._links import link, meet
from kelvinlake.llm.wordbpe import ChunkEncoder
from kelvinlake.operators.components import components
from kelvinlake.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ODD = [
    (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"),
    (6, "É\u0301 日本語 テスト İstanbul ﬁ ß"), (7, LONG), (8, LONG), (9, "x" * 200_000), (10, "<|endoftext|> a <|ENDOFTEXT|>"), (11, "\n\n\n"),
    (12, "one two three four five six"),
]


def words(text):
    return re.findall(r"(?:[a-z0-9]|[\u0080-\u2fff\ua000-\U0010ffff])+|[\u3000-\u9fff]", (text or "").lower())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, with columns that operators use inside."""
    rows = [(i, t, "en", None if k % 3 else "s", None, k, "x", "y") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS + ", row int, key string, tokens string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_groups(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


# --- primitives


def test_word_hashes_agree_with_a_scan():
    texts = [t for _, t in ODD]
    got, off = _arrays.word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in words(t)]
    assert list(np.diff(off)) == [len(words(t)) for t in texts]
    by_word = {}
    for w, h in zip(flat, got.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400 + i) for i in range(60)] + [(600 + i, 601 + i) for i in range(40)]
    root = brute_groups(700, edges)
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, i), i)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: low[root[i]] for i in {x for a, b in edges if a != b for x in (a, b)}}


def number_judge():
    class NumberJudge:
        """Links numbers of one rest modulo 3 that are at most 6 apart."""

        def pairs(self, x, y):
            x, y = (np.array([int.from_bytes(v.as_py(), "little") for v in z]) for z in (x, y))
            return (x % 3 == y % 3) & (abs(x - y) <= 6)

        def prepare(self, bodies):
            return np.array([int.from_bytes(x, "little") for x in bodies])

        def may(self, block, i, j):
            return np.ones((len(i), len(j)), bool)

        def row(self, block, i, j, key):
            return (block[i] % 3 == block[j] % 3) & (abs(block[i] - block[j]) <= 6)

    return NumberJudge()


def test_blocks_of_wider_sides_deal_fewer_rows(spark):
    """The same pairs, dealt out in fewer rows: members of a dense bucket times the other side's slices."""
    from kelvinlake.llm import _links

    dense = spark.createDataFrame([(1, i) for i in range(2000)], "key long, id long")
    roots = spark.createDataFrame([(i, i % 500 if i >= 1500 else 0) for i in range(2000)], "node long, root long")
    for side, most in ((256, 12000), (1024, 3000)):
        rows = _links._blocks(dense, roots, Scratch(spark, "t"), side).collect()
        meets = collections.defaultdict(lambda: (set(), set()))
        for r in rows:
            meets[r.block][r.side > 0].add(r.id)
        pairs = {(i, j) for outside, every in meets.values() for i in outside for j in every}
        outside = [i for i in range(1501, 2000)]
        assert len(rows) < most and pairs == {(i, j) for i in outside for j in range(2000)}


def test_blocks_are_judged_one_by_one():
    """Members of different blocks in a batch aren't compared, and what a task has joined isn't judged again."""
    from kelvinlake.llm import _links

    def tried(judge_, blocks):
        rows = [(block, 1, x, x, 2, x.to_bytes(4, "little")) for block, ids in enumerate(blocks) for x in ids]
        rows += [(block, 1, x, x, 0, x.to_bytes(4, "little")) for block, ids in enumerate(blocks) for x in ids]
        cols = list(zip(*sorted(rows, key=lambda r: (r[0], r[4], r[2])), strict=True))
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], _links._BLOCKS)
        n, real = [], judge_.row
        judge_.row = lambda block, i, j, key: n.append(len(j)) or real(block, i, j, key)
        links = [x for b in _links._joining(judge_)([batch]) for x in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        return sum(n), links

    apart = number_judge()
    apart.row = lambda block, i, j, key: np.zeros(len(j), bool)
    assert tried(apart, [range(10 * b, 10 * b + 10) for b in range(20)]) == (20 * 45, [])
    once, links = tried(number_judge(), [range(12)])
    many, again = tried(number_judge(), [range(12)] * 20)
    # pairs of different components, here three, are judged in every block; others once
    assert links == again and many - once <= 19 * 12 * 11 // 2 and len(links) == 9


def test_buckets_of_one_size_are_compared_together():
    from kelvinlake.llm import _links

    rng = np.random.default_rng(4)
    size = rng.integers(9, 15, 300)
    key = np.repeat(np.arange(300), size)
    ids, sig = np.arange(len(key)), rng.integers(0, 40, len(key))
    calls = []

    def near(x, y):
        calls.append(1)
        return np.abs(x - y) <= 1

    got = collections.Counter()
    for batch in _links.buckets(key, ids, sig, near):
        for a, b, w in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["weight"].to_pylist(), strict=True):
            got[a, b] = w
    want = {(i, j): _links.WHOLE for i in range(len(key)) for j in range(i + 1, len(key)) if key[i] == key[j] and abs(sig[i] - sig[j]) <= 1}
    assert got == want and len(calls) < 30


def test_similar_pairs():
    """Many pairs at a time: as one by one, whatever the lengths."""
    rng = random.Random(11)
    lines = []
    for n in [0, 1, 2, 5, 20, 63, 64, 65, 100, 127, 128, 129, 190, 520, 600] * 40:
        few = rng.choice([2, 20, 500])
        x = rng.choices(range(few), k=n)
        y = x[:]
        for _ in range(rng.randrange(n // 4 + 2)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choices(range(few), k=rng.randrange(2))
        lines += [x, y]
    want = [linededup.edit_similar(x, y, 0.8) for x, y in zip(lines[::2], lines[1::2], strict=True)]
    body = pa.array([np.array(x, np.uint32).tobytes() for x in lines], pa.binary())
    judge_ = linededup.LineJudge(0.8)
    i = np.arange(0, len(lines), 2)
    assert 0.2 < np.mean(want) < 1 and judge_.pairs(body.take(i), body.take(i + 1)).tolist() == want
    block = judge_.prepare(body.to_pylist())
    assert judge_.several(block, i, i + 1).tolist() == want
    may = judge_.may(block, i, i + 1)
    assert may.diagonal()[want].all() and may.mean() < 0.2


@pytest.mark.parametrize("n", [60, 700])  # one block, and slices against slices
def test_link_loses_none_of_a_dense_bucket(spark, monkeypatch, n):
    from kelvinlake.llm import _links

    monkeypatch.setattr(_links, "SLICE", 128)
    # one bucket; links form three groups, none of them with the leader's rows alone
    rows = spark.createDataFrame([(1, i, n - i, 0) for i in range(n)], "key long, id long, weight long, sig long")
    table = spark.createDataFrame([(i, i.to_bytes(4, "little")) for i in range(n)], "id long, body binary")
    bodies = lambda ids: table.join(ids, "id")
    roots, links = link(meet(rows), bodies, number_judge(), Scratch(spark, "t"))
    assert {r.node: r.root for r in roots.collect()} == {i: i % 3 for i in range(n)}
    assert links.count() < 3 * n  # no row per pair


# --- 1 lines


def test_edit_similar():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x, p in enumerate(a, 1):
            now = [x]
            for y, q in enumerate(b, 1):
                now.append(min(row[y] + 1, now[-1] + 1, row[y - 1] + (p != q)))
            row = now
        return row[-1]

    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(12))]
        b = a[:]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice("abc")] * rng.randrange(2)
        assert linededup.edit_similar(a, b, 0.8) == (distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9)


def line_words(line):
    return re.findall(r"[a-z0\u0080-\u2fff\ua000-\U0010ffff]+|[\u3000-\u9fff]", re.sub("[0-9]", "0", line.lower()))


def test_share_words():
    rng = random.Random(6)
    for _ in range(2000):
        x, y = (sorted(rng.choices(range(6), k=rng.randrange(1, 15))) for _ in "xy")
        longer = max(len(x), len(y))
        both = sum((collections.Counter(x) & collections.Counter(y)).values())
        assert linededup.share_words(np.array(x), np.array(y), 0.8) == (both >= longer - int(0.2 * longer + 1e-9))


def test_lines_brute_force(docs):
    """Groups by edit similarity alone, of all lines that aren't blank."""
    rows = sorted(docs.select("doc_id", "text").collect())
    at, normal = [], []
    for r in rows:
        for i, line in enumerate(r.text.split("\n")):
            if line.strip():
                at.append((r.doc_id, i))
                normal.append(line_words(line) or [line.strip()])
    counts = np.zeros((len(normal), 128), np.int16)
    for i, w in enumerate(normal):
        for x in w:
            counts[i, zlib.crc32(x.encode()) % 128] += 1
    size = np.array([len(w) for w in normal])
    linked = []
    for i in range(len(normal)):
        most = 2 * (0.2 * np.maximum(size[i], size[i + 1 :]) + 1e-9)  # each edit moves two counts
        for j in np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(1) <= most) + i + 1:
            if linededup.edit_similar(normal[i], normal[j], linededup.SIMILARITY):
                linked.append((i, int(j)))
    groups = collections.defaultdict(list)
    for i, g in enumerate(brute_groups(len(at), linked)):
        groups[g].append(at[i])
    want = {x for g in groups.values() for x in g if x != min(g)}
    out = linededup.dedup_lines(docs).collect()
    got = {(r.doc_id, i) for r in out for i in r.dropped}
    assert want and not got - want and len(got) >= 0.99 * len(want)  # long lines are found by a sample of n-grams
    text = {r.doc_id: r.text for r in rows}
    for r in out:
        assert r.text == "\n".join(x for i, x in enumerate(text[r.doc_id].split("\n")) if i not in set(r.dropped))


def test_short_and_wordless_lines(spark):
    rows = [(1, "Yes.\n----\n\n今日は、良い天気です\n* * *"), (2, "yes\n----\n\n今日も、良い天気です\nno"), (3, "----- \n----"), (4, "今日は雨が降る")]
    out = {r.doc_id: (r.text, r.dropped) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (rows[0][1], []), 2: ("\nno", [0, 1, 3]), 3: ("----- ", [1]), 4: (rows[3][1], [])}


def test_lines_find_all_similar(spark):
    """Groups by edit similarity alone, at distances up to the limit and past it."""
    rng = random.Random(12)
    vocabulary = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows = []
    for n in [4, 5, 6, 9, 10, 14, 19, 20, 24, 25, 40, 60, 90] * 4:
        line = rng.choices(vocabulary, k=n)
        rows.append(line)
        for edits in (1, max(1, n // 10), max(1, n // 5), n // 5 + 1):
            copy = line[:]
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
            rows.append(copy)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if linededup.edit_similar(rows[i], rows[j], 0.8)]
    first = {}
    for i, g in enumerate(brute_groups(len(rows), linked)):
        first.setdefault(g, i)
    out = linededup.dedup_lines(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if not r.dropped} == set(first.values())


def test_long_lines_that_share_common_n_grams_only(spark):
    """Lines at the limit whose rare n-grams all differ: of the first n-grams they share one."""
    rng = random.Random(21)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    phrases = [[name() for _ in range(4)] for _ in range(50)]
    rows = []
    for _ in range(40):
        line = rng.choices(phrases, k=20)
        rows += [" ".join(w for p in line for w in [*p, name()]) for _ in range(2)]
    rows += ["\n".join([name(), *map(" ".join, phrases)]) for _ in range(300)]  # makes the phrases common
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.dropped and r.doc_id < 80} == set(range(1, 80, 2))


def test_lines_that_share_few_n_grams_are_not_tried(spark):
    """Long lines of common words meet by some n-gram or other, but by six in fitting places only if they are similar."""
    rng = random.Random(5)
    words = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = [rng.choices(words, k=130) for _ in range(180)]
    for line in rows[:10]:
        rows.append([f"x{w}" if i % 6 == 5 else w for i, w in enumerate(line)])

    class Counting(Scratch):
        tried = 0

        def store(self, df, name):
            out = super().store(df, name)
            self.tried += out.count() if name == "tried" else 0
            return out

    scratch = Counting(spark, "few")
    out = linededup.dedup_lines(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string"), scratch).collect()
    assert {r.doc_id for r in out if r.dropped} == set(range(180, 190))
    assert 10 <= scratch.tried < 200  # many more if one n-gram were enough


def test_likely_rows(spark):
    """All wanted rows and few others, whatever their sign and their high bits."""
    rng = random.Random(3)
    rows = [0, -1, 63, 64, (1 << 63) - 1, -(1 << 63), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(4000))]
    big = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "doc_id long, row long")
    got = [r.doc_id for r in _fetch.likely_rows(big, big.where("doc_id < 1000")).collect()]
    assert sorted(got)[:1000] == list(range(1000)) and len(set(got)) == len(got) < 1010


def test_lines_of_few_words_that_repeat(spark):
    """N-grams that a line repeats stand for all that it shares."""
    rng = random.Random(8)
    rows = []
    for n in [24, 30, 48, 75, 100, 130] * 3:
        words = [f"v{chr(97 + len(rows) // 26)}{chr(97 + len(rows) % 26)}{x}" for x in "abcdefgh"[: rng.choice([2, 3, 8])]]
        line = rng.choices(words, k=n)
        rows.append(line)
        for edits in (n // 10, n // 5, n // 5 + 2):
            copy = line[:]
            for at in rng.sample(range(n), edits):
                copy[at] = f"x{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
            rows.append(copy)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if linededup.edit_similar(rows[i], rows[j], 0.8)]
    first = {}
    for i, g in enumerate(brute_groups(len(rows), linked)):
        first.setdefault(g, i)
    out = linededup.dedup_lines(spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if not r.dropped} == set(first.values())


def test_n_grams_are_counted_in_all_documents(spark, docs, monkeypatch):
    levels, real = [], linededup.gram_levels
    monkeypatch.setattr(linededup, "gram_levels", lambda *args: levels.append(real(*args)) or levels[-1])
    linededup.line_classes(docs.repartition(3), Scratch(spark, "levels"))
    want = np.zeros(linededup.COUNTERS, np.int64)
    for r in docs.collect():
        words_, off = _arrays.word_hashes(pa.array((r.text or "").split("\n")), digits_alike=True)
        np.add.at(want, (linededup._tokens(words_, off)[0] % np.uint64(linededup.COUNTERS)).astype(np.int64), 1)
    assert (levels[0] == np.minimum(63, 3 * np.log2(1 + want)).astype(np.uint8)).all()


def test_lines_odd(odd, empty):
    out = linededup.dedup_lines(odd).collect()
    assert len(out) == len(ODD)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[1][0].lines == 0 and by[2][0].text == "" and by[11][0].text == "\n\n\n"
    assert [r.text for r in by[5]] == ["one two three four five six"] * 2 and by[12][0].text == "" and by[8][0].text == ""
    assert by[7][0].text == LONG and by[7][0].key == "x"
    assert linededup.dedup_lines(empty).count() == 0


# --- 2 urls


def test_urls(spark):
    urls = [
        None, "", "no mark", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?x", "https://a.example.org/en/1234",
        "https://example.org/en/2", "https://xexample.org/es/", "x://com/fr/", "x://a.com/de/b", "x://a.b.com/de", "x://org/", "x://example.org:80/es/", "x://ÉX.org/p#q", "a://b://c.org/",
    ]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, None, "z")], "page_id long, url string, rule string")
    got = sorted(map(tuple, urltrie.judge_urls(df, queries.URL_RULES).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u in enumerate(urls)])
    want = con.execute(queries.ORACLE_SQL["op2_url_filter"]).fetchall()
    assert got == sorted([*want, (0, "", "", None, "allow")], key=str)
    assert urltrie.judge_urls(df.where("false"), queries.URL_RULES).count() == 0


def test_trie_longest_match_brute_force():
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("ab") for _ in range(rng.randrange(1, n)))
    host = lambda: ".".join(part(3) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(part(3) if rng.random() < 0.8 else "" for _ in range(rng.randrange(0, 4)))
    rules = [(host() + path(), rng.choice(["allow", "block"])) for _ in range(150)]
    trie = urltrie.UrlTrie(rules)
    for _ in range(2000):
        h, p = host(), rng.choice([path(), ""])
        fit = [
            ((r.partition("/")[0].count("."), len(r.partition("/")[2]), v == "block"), r, v)
            for r, v in rules
            if (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])
        ]
        assert trie.find(h, p) == (max(fit)[1:] if fit else (None, None))


# --- 3 near duplicates


def weights(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    return {k: 1 + math.log(c) for k, c in grams.items()}


def likeness(a, b):
    both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    element = rng.integers(1, 2**63, 300).astype(np.uint64)
    w = rng.uniform(0.2, 3, 300)
    for share in (0.5, 0.8, 0.95):
        n = int(300 * share)
        other = np.concatenate([element[:n], rng.integers(1, 2**63, 300 - n).astype(np.uint64)])
        w2 = np.concatenate([w[:n] * rng.uniform(0.8, 1, n), w[n:]])
        s = dartminhash.signatures(np.concatenate([element, other]), np.concatenate([w, w2]), np.array([0, 300, 600]), 2000)
        both = np.minimum(w[:n], w2[:n]).sum()
        assert abs((s[0] == s[1]).mean() - both / (w.sum() + w2.sum() - both)) < 0.04


def test_near_duplicates_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [weights(r.text) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i].keys() & sets[j].keys() and likeness(sets[i], sets[j]) >= 0.8]
    group = brute_groups(len(rows), linked)
    least, size = {}, collections.Counter(group)
    for g, r in zip(group, rows, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = {r.doc_id: (least[g], size[g]) for g, r in zip(group, rows, strict=True)}
    got = {r.doc_id: (r.class_id, r.class_size) for r in dartminhash.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_odd(odd, empty):
    out = dartminhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[8].class_id == 7 and not by[8].kept and by[7].kept
    assert by[12].class_id == 5 and by[12].class_size == 3 and sum(r.kept for r in out if r.doc_id == 5) == 1
    assert by[2].class_id is None and by[4].class_size == 1  # texts without words are one class; its least id is null
    assert dartminhash.near_duplicates(empty).count() == 0


# --- 4 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_chunk_encoder(tokenizer, docs):
    texts = [t or "" for _, t in ODD] + ["it's o'clock 12ab3, a.b.c ...x", "a,\u0301b", "A\u0301."] + [r.text for r in docs.select("text").collect()]
    # a slice, as batches are cut into slices
    ids, off = ChunkEncoder(queries.tokenizer_path()).encode(pa.array(["Ünused, A.", *texts, "end"])[1:-1])
    for i, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[off[i] : off[i + 1]].tolist() == e.ids


def test_nnls():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a = rng.random((8, 5))
        x = np.maximum(rng.normal(size=5), 0)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
        b = rng.normal(size=8)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.allclose(gradient[x > 0], 0, atol=1e-6)


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2047, 1, 5000], [3] * 1000, [1024] * 7])
def test_pack(lengths):
    lengths = np.array(lengths, np.int64)
    if not len(lengths):
        return
    check_pieces(lengths, *packing.pack(lengths))


def check_pieces(lengths, doc, start, size, seq, off):
    seen = [0] * len(lengths)
    for d, s, n in sorted(zip(doc, start, size, strict=True)):
        assert seen[d] == s and n > 0
        seen[d] += n
    assert seen == list(lengths)
    fill = collections.Counter()
    for q, o, n in sorted(zip(seq, off, size, strict=True)):
        assert fill[q] == o
        fill[q] += n
    pad = sum(0 if n & (n - 1) == 0 else packing.WINDOW - n for n in fill.values())
    assert max(fill.values()) <= packing.WINDOW and pad == 0


def test_pack_random():
    rng = np.random.default_rng(2)
    check_pieces(*(lambda x: (x, *packing.pack(x)))(rng.integers(1, 6000, 700)))


def test_pack_documents(docs, odd, empty, tokenizer):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = collections.Counter()
        for r, e in zip(rows, tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
            want[(r.doc_id, zlib.crc32(np.array([*e.ids, 1], "<u4").tobytes()), len(e.ids) + 1)] += 1
        out = packing.pack_documents(df, queries.tokenizer_path(), shard_tokens=50_000).collect()
        whole = collections.Counter((r.doc_id, r.ids_crc32, r.length) for r in out if r.length == r.doc_tokens)
        assert not whole - want
        assert sum(r.length for r in out) == sum(n * k for (_, _, n), k in want.items())
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


# --- 5 search


@pytest.mark.parametrize("shard_docs", [37, 8192])
def test_bm25_brute_force(docs, monkeypatch, shard_docs):
    monkeypatch.setitem(bm25.build_index.__kwdefaults__, "shard_docs", shard_docs)
    rows = sorted(docs.select("doc_id", "text").collect())
    bag = [collections.Counter(words(r.text)) for r in rows]
    n, mean = len(bag), sum(sum(b.values()) for b in bag) / len(bag)
    df = collections.Counter(t for b in bag for t in b)
    asked = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = collections.defaultdict(list)
    for r in sorted(bm25.search(docs, asked).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.doc_id, r.score))
    for i, q in enumerate(bag):
        if rows[i].doc_id % 10:
            continue
        scored = []
        for j, b in enumerate(bag):
            size = sum(b.values())
            s = sum(
                math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (bm25.K1 + 1) / (b[t] + bm25.K1 * (1 - bm25.B + bm25.B * size / mean))
                for t in q if t in b
            )
            scored.append((-round(s, 9), rows[j].doc_id))
        best = sorted(x for x in scored if x[0] < 0)[: bm25.TOP]
        assert [d for _, d in best] == [d for d, _ in got[rows[i].doc_id]]
        assert np.allclose([-s for s, _ in best], [s for _, s in got[rows[i].doc_id]], atol=1e-7)


def test_bm25_odd(odd, empty):
    out = bm25.search(odd, odd.select(F.col("doc_id").alias("query_id"), "text")).collect()
    assert {r.doc_id for r in out if r.query_id == 5} == {5, 12, 4}
    assert not [r for r in out if r.query_id in (1, 2, 3)]
    assert bm25.search(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


def test_bm25_thresholds_and_work(spark, monkeypatch):
    """Shards that start with the best scores of others find what one shard finds, ties included,
    and a task's later shards score fewer blocks than they would alone."""
    rng = random.Random(5)
    vocabulary = [f"t{int(1.006**i)}x{i % 7}" for i in range(1200)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 30, 90])))) for i in range(2400)]
    rows += [(3000 + i, rows[i % 40][1]) for i in range(300)]  # ties at and around the k-th place
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    asked = docs.where("doc_id % 50 = 0 or doc_id >= 3290").select(F.col("doc_id").alias("query_id"), "text")
    key = lambda r: (r.query_id, r["rank"])
    whole = [(*key(r), r.doc_id, round(r.score, 7)) for r in sorted(bm25.search(docs.coalesce(1), asked).collect(), key=key)]
    real, blocks = bm25.search_shard, []

    def counted(*args):
        seen = []
        real(*args[:-1], np.zeros_like(args[-1]), seen)
        real(*args, seen)
        blocks.append(np.array(seen)[:, 0].tolist())
        return real(*args)

    monkeypatch.setitem(bm25.build_index.__kwdefaults__, "shard_docs", 100)
    parts = [(*key(r), r.doc_id, round(r.score, 7)) for r in sorted(bm25.search(docs, asked).collect(), key=key)]
    assert parts == whole
    # the same, shard after shard in one process
    shard = [bm25._Shard(dict(zip(r.__fields__, r, strict=True))) for r in bm25.build_index(docs).collect()]
    got = sorted(asked.collect())
    bag = bm25.bags(pa.array([r.text for r in got]))
    words_, word = np.unique(bag[1], return_inverse=True)
    best = np.zeros((len(got), bm25.TOP))
    for x in shard:
        q, _, s = counted(x, bag[0].astype(np.int32), word, words_, np.ones(len(words_)), bm25.TOP, 40.0, best[:, -1])
        best = bm25._merged(best, q, s)
    alone, after = np.array(blocks[1:]).sum(0)
    assert after < alone


# --- 6 toxicity


def test_severity_orders_and_generalises(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        level = 0 if rng.random() < 0.7 else rng.choice([1, 2])
        text = rng.choices(common, k=60) + rng.choices([f"bad{j}" for j in range(8)], k=[0, 2, 7][level])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(level > 0), level))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, level int")
    model = severity.train(df.where("doc_id < 900"), df.where("doc_id < 900").select("doc_id", "toxic"))
    out = severity.score_severity(df.where("doc_id >= 900").drop("toxic"), model).toPandas()
    assert ((out.p_toxic >= severity.REJECT) == (out.level > 0)).mean() > 0.98
    means = out.groupby("level").expected_severity.mean()
    assert means[0] < means[1] < means[2] and (np.diff(model.thresholds) >= 0).all()


def test_severity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = severity.train(docs, labels.where("doc_id % 4 != 0"))
    out = severity.score_severity(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).toPandas()
    hit = out.p_toxic >= severity.REJECT
    assert (hit & (out.toxic == 1)).sum() >= 0.8 * (out.toxic == 1).sum()
    assert (hit & (out.toxic == 0)).sum() <= 0.02 * (out.toxic == 0).sum()


def test_severity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = severity.train(odd, labels)
    out = severity.score_severity(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.p_toxic <= 1 for r in out) and out[0].tokens == "y"
    none = severity.train(empty, labels.where("false"))
    assert severity.score_severity(empty, none).count() == 0 and not any(r.p_toxic > 0.5 for r in severity.score_severity(odd, none).collect())


# --- 7 token counts


@pytest.mark.parametrize("block", [2, 10, 64, 1 << 20])
def test_count_tokens(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for name in ("a", "b", "c", "d"):
        ids = [] if name == "d" else [rng.choice([9, 9, 9, 5]) if rng.random() < 0.4 else rng.randrange(10, 60_000) for _ in range(rng.randrange(1, 120))]
        np.array(ids, "<u2").tofile(tmp_path / name)
        start = k = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((name, k, start, i - start, True))
                start, k = i + 1, k + 1
        if start < len(ids):
            want.append((name, k, start, len(ids) - start, False))
    got = tokencount.count_tokens(spark, f"file://{tmp_path}", 9, block_bytes=block)
    assert sorted(map(tuple, got.select("file", "ordinal", "start", "tokens", "closed").collect())) == want


def test_count_tokens_round_trip(spark, odd, empty, tokenizer, tmp_path):
    out = tokencount.write_token_files(odd, f"file://{tmp_path}/t", queries.tokenizer_path(), queries.SEPARATOR).collect()
    got = {(r.file, r.ordinal): r.tokens for r in tokencount.count_tokens(spark, f"file://{tmp_path}/t", queries.SEPARATOR).collect()}
    want = collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD if i != 10)
    assert collections.Counter((r.doc_id, got[r.file, r.ordinal]) for r in out if r.doc_id != 10) == want
    assert tokencount.write_token_files(empty, f"file://{tmp_path}/e", queries.tokenizer_path(), queries.SEPARATOR).count() == 0
    assert tokencount.count_tokens(spark, f"file://{tmp_path}/e", queries.SEPARATOR).count() == 0
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/x").write_bytes(b"abc")
    with pytest.raises(ValueError):
        tokencount.count_tokens(spark, f"file://{tmp_path}/odd", 9)


def test_count_tokens_of_a_text_with_the_end_mark(spark, odd, tokenizer, tmp_path):
    out = tokencount.write_token_files(odd, f"file://{tmp_path}/t", queries.tokenizer_path(), queries.SEPARATOR).collect()
    got = {(r.file, r.ordinal): r.tokens for r in tokencount.count_tokens(spark, f"file://{tmp_path}/t", queries.SEPARATOR).collect()}
    want = collections.Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert collections.Counter((r.doc_id, got[r.file, r.ordinal]) for r in out) == want and len(got) == len(ODD)
    assert queries.SEPARATOR >= tokenizer.get_vocab_size()
    with pytest.raises(Exception, match="separator"):
        tokencount.write_token_files(odd, f"file://{tmp_path}/s", queries.tokenizer_path(), 49407).collect()


# --- 8 mixing


def test_bisection(spark):
    p = np.array([0.5, 0.3, 0.15, 0.05])
    shares = spark.createDataFrame([(float(x),) for x in p], "share double")
    mix = lambda e: p**e / (p**e).sum()
    e = mixing.bisect_exponent(shares, repeats=3.0)
    r = mix(e) / p
    assert r.max() / r.min() == pytest.approx(3.0, abs=1e-5)
    e = mixing.bisect_exponent(shares, repeats=None, entropy=1.25)
    assert -(mix(e) * np.log(mix(e))).sum() == pytest.approx(1.25, abs=1e-6)
    assert mixing.bisect_exponent(shares, repeats=100.0) == 0.0


def test_mixing(docs):
    out = mixing.mix_sources(docs, repeats=1.5).toPandas()
    assert len(out) == docs.count() and (out.copies >= 1).all()
    source = out.groupby("source")
    all_, taken = source.tokens.sum(), (out.tokens * out.copies).groupby(out.source).sum()
    budget = (all_ / source.weight.first()).max()
    largest_block = out.groupby(["source", "block"]).tokens.sum().groupby("source").max()
    miss = source.weight.first() * budget - taken
    assert (miss >= -1e-3).all() and (miss <= largest_block + 1e-3).all()
    small = mixing.mix_sources(docs, repeats=1.5, budget=float(all_.sum()) / 2).toPandas()
    assert (small.tokens * small.copies).sum() <= all_.sum() / 2 + 1e-3 and (small.copies == 0).any()


def test_mixing_odd(odd, empty, spark):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == len(ODD) and {r.copies for r in out if r.doc_id == 5} and out[0].key == "x"
    assert mixing.mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 1)], DOCS)
    assert [r.copies for r in mixing.mix_sources(blank).collect()] == [1, 1]


# --- 9 fingerprints


def brute_prints(text, gram, window, hash_of):
    units = re.findall(r"[\u4e00-\u9fff\u3040-\u30ff]|[a-z0-9à-ÿ]{1,12}", text.lower())
    grams = [hash_of(tuple(units[i : i + gram])) for i in range(max(1, len(units) - gram + 1))]
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        low = min(part)
        at = max(j for j, x in enumerate(part, i) if x == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


def test_winnow_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(n)) for n in (4, 5, 11, 12, 40, 400)] + ["aa " * 50, "été déjà vu là-bas, oui", "日本語のテスト abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = winnow.fingerprint(df, "text", "p").select("i", winnow.places(F.col("p")).alias("at"), F.transform("p", lambda v: F.shiftright(v, 30)).alias("h")).collect()
    for r in got:
        text = texts[r.i]
        # grams' own hashes, read off a window of one
        one = winnow.fingerprint(df.where(F.col("i") == r.i), "text", "p", window=1).select(winnow.places(F.col("p")).alias("at"), F.transform("p", lambda v: F.shiftright(v, 30)).alias("h")).first()
        grams = dict(zip(one.at, one.h, strict=True))
        units = re.findall(r"[\u4e00-\u9fff\u3040-\u30ff]|[a-z0-9à-ÿ]{1,12}", text.lower())
        assert len(grams) == max(1, len(units) - winnow.GRAM + 1)
        by_gram = {tuple(units[i : i + winnow.GRAM]): h for i, h in grams.items()}
        assert list(zip(r.h, r.at, strict=True)) == brute_prints(text, winnow.GRAM, winnow.WINDOW, by_gram.__getitem__)


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        q = len(t) // 4
        yield i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()


@pytest.mark.parametrize("spread", [1, 700])
def test_fingerprint_edited(docs, spread):
    df = docs.withColumn("doc_id", F.col("doc_id") * spread)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = winnow.fingerprint_edited(df).select("doc_id", "n_chars", F.sha2("edited_text", 256), "near_edited", "near_next", "prints", "edited_prints").collect()
    assert sorted(tuple(r)[:3] for r in out) == sorted(edited(rows))
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in out)
    prints = {r.doc_id: {v >> 30 for v in r.prints} for r in out}
    ids = sorted(prints)
    for r in out:
        nxt = prints[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        own, ed = prints[r.doc_id], {v >> 30 for v in r.edited_prints}
        assert r.near_next == pytest.approx(len(own & nxt) / len(own | nxt)) and r.near_edited == pytest.approx(len(own & ed) / len(own | ed))


def test_next_row_of_sparse_null_and_equal_ids(spark):
    rng = random.Random(9)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + [None] * 200 + [5] * 50 + list(range(40))
    rows = [(i, " ".join(rng.choices("abcdef", k=5)) + str(k)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prints", F.array(F.lit(0).cast("long")))
    hashed = dict(df.where("doc_id is null").select("text", F.shiftrightunsigned(F.xxhash64("text"), 52)).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, hashed[r[1]] if r[0] is None else 0, r[0] or 0, r[1]))
    want = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    for per_bucket in (4, 256):
        got = winnow.with_next(df, Scratch(spark, "t"), per_bucket).select("doc_id", "text", "next_text").collect()
        assert {(r.doc_id, r.text): r.next_text for r in got} == want and len(got) == len(rows)


def test_fingerprint_odd(odd, empty):
    out = winnow.fingerprint_edited(odd).select("doc_id", "n_chars", F.sha2("edited_text", 256), winnow.digest(F.col("prints")).alias("d")).collect()
    assert sorted((tuple(r)[:3] for r in out), key=str) == sorted(edited(ODD), key=str)
    assert len({r.d for r in out if r.doc_id in (5, 12)}) == 1 and len({r.d for r in out if r.doc_id in (7, 8)}) == 1
    assert winnow.fingerprint_edited(empty).count() == 0


def test_native_plan(docs, capsys):
    winnow.fingerprint_edited(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# --- 10 html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>a<li>b<ol start=4><li>c</ol></ul>x", "- a\n- b\n  4. c\n\nx"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", "wide  | x\n1 | 2 | 3"),
        ("<head><title>t</title></head><body>b<script>x</script><style>y</style><div hidden>h</div><p style='display:none'>i</p>", "b"),
        ("<a title='hidden'>seen</a> <i data-x=\"hidden\">too</i>", "seen too"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("&lt;b&gt; &amp; &eacute;&nbsp;x", "<b> & é x"), ("<!-- <p>no</p> -->yes<!doctype x>", "yes"), ("<p>a</p", "a"), ("<div><span>a</div>b", "a\nb"),
        ("a<script>never closed", "a"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in | out"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("</p></div>x", "x"), ("x<", "x<"), ("<td>lonely</td>", "lonely"),
    ],
)
def test_render(page, text):
    assert htmltext.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<a href="x"">text</a> more <b class="y">z</b> tail', "text more z tail"), ("<p title=it's>one two</p><p>three</p>", "one two\n\nthree"),
        ("<p ' x>a</p><p>b'c</p>", "a\n\nb'c"), ('<a title = "x>y">t</a>', "t"), ("<a title='x>\"y'>t</a>", "t"), ("<a title=>t</a> u", "t u"),
        ("<a x==\"y>t</a> \"u", 't "u'), ("<div class=a\"b hidden>h</div>s\"", 's"'), ('<a x="never closed', ""),
    ],
)
def test_stray_quotes(page, text):
    assert htmltext.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b", "a x=2 b"),
        ("<svg><title>t</title><desc>d</desc><style>s</style><defs/><defs><text>no</text></defs><path d='x'/><text>label</text></svg>after", "labelafter"),
        ("pick <select><option>one<option selected>two<option>three</select> now", "pick two now"), ("<select><option disabled>a<option>b</select>", "b"),
        ("<select multiple><option>a<option>b</select>c", "a\nb\nc"), ("<select size=3><option>a</option></select>", "a"), ("<select></select>x", "x"),
    ],
)
def test_shown_elements(page, text):
    assert htmltext.render(page) == text


def test_html_deep_and_table(spark):
    assert htmltext.render("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    df = spark.createDataFrame([(1, "<p>a", "k"), (1, "<p>a", "k"), (None, None, "k")], "page_id long, html string, text string")
    assert sorted(map(tuple, htmltext.extract_text(df).collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert htmltext.extract_text(df.where("false")).count() == 0


def test_no_word_is_lost(spark):
    """All words outside of what is never shown are in the text, in order."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = re.sub(r"(?is)<(script|style|title|noscript|template)\b.*?</\1>|<!--.*?-->|<(\"[^\"]*\"|'[^']*'|[^>\"'])*>", " ", r.html)
        import html

        seen = re.sub(r"[-|]|\d+\. ", "", htmltext.render(r.html))
        want = re.sub(r"[-|]|\d+\. ", "", html.unescape(bare))
        assert "".join(seen.split()) == "".join(want.split())
