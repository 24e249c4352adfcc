"""Document fingerprints by winnowing, with DataFrame functions only.

A text is cut into units: runs of up to 12 letters or digits in lower case, and
single Han, kana or Hangul characters. Each run of ``GRAM`` units has a hash, and
each window of ``WINDOW`` consecutive grams gives its least hash, the rightmost
of equals. Two texts that share a run of GRAM + WINDOW - 1 units share at least
one fingerprint; a selected gram's place is kept beside its hash. Fewer grams than
a window are one window; fewer units than a gram are one gram; a text without
units has one gram of all its characters.

A gram's hash and place ride in one long: 33 bits of hash above 30 bits of
reversed place, so the plain minimum is the rightmost least one. A text has at
most 2 ** 31 bytes, of which a unit and what separates it take two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvinlake.scratch import Scratch

GRAM, WINDOW = 4, 8
UNITS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]{1,12}"
_PLACES = 30


def _at(column: str, shift: int):
    return lambda x, i: F.least(x, F.coalesce(F.get(F.col(column), i + shift), x))


def fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: the selected grams of column ``text`` in order of place,
    as longs (``hashes`` and ``places`` read them)."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    tmp = [f"_{out}_{i}" for i in range(10)]
    unit = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(UNITS), F.lit(0))
    df = df.withColumn(tmp[0], F.transform(unit, lambda u: F.xxhash64(u)))
    df = df.withColumn(
        tmp[0],
        F.when(F.size(tmp[0]) == 0, F.array(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))).otherwise(F.col(tmp[0])),
    )
    own = F.col(tmp[0])
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 31), _PLACES).bitwiseOR(
        F.lit((1 << _PLACES) - 1).cast("long") - i.cast("long")
    )
    grams = F.transform(
        F.slice(own, F.lit(1), F.greatest(F.size(own) - (gram - 1), F.lit(1))),
        lambda x, i: packed(F.xxhash64(x, *[F.get(own, i + k) for k in range(1, gram)]), i),
    )
    df = df.withColumn(tmp[1], grams)
    at, step, k = tmp[1], 1, 1
    while step < window:  # minima of 2, 4, ... grams
        k += 1
        df = df.withColumn(tmp[k], F.transform(F.col(at), _at(at, step)))
        at, step = tmp[k], step * 2
    # the last windows that lie wholly in the text; a shorter text has one window
    whole = F.slice(F.col(at), F.lit(1), F.greatest(F.size(at) - (window - 1), F.lit(1)))
    return df.withColumn(out, F.array_distinct(whole)).drop(*tmp)


def hashes(prints: Column) -> Column:
    """The distinct gram hashes of a fingerprint."""
    return F.array_distinct(F.transform(prints, lambda v: F.shiftright(v, _PLACES)))


def places(prints: Column) -> Column:
    """The unit places (from 0) of a fingerprint's grams."""
    return F.transform(prints, lambda v: F.lit((1 << _PLACES) - 1) - v.bitwiseAND(F.lit((1 << _PLACES) - 1)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of hashes, 0 to 1."""
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    return both / (F.size(a) + F.size(b) - both)


def digest(prints: Column) -> Column:
    """SHA-256 of a fingerprint's hashes and places."""
    return F.sha2(F.array_join(F.transform(prints, lambda v: F.hex(v)), ","), 256)


#: Characters of the table of first rows that may be broadcast.
BROADCAST_CHARS = 16_000_000


def with_next(docs: DataFrame, scratch: Scratch, per_bucket: int = 256) -> DataFrame:
    """``docs`` with ``next_text`` and ``next_prints`` (null where the row that follows is
    the first of another range of ids): the row that follows by ascending doc_id (then
    text; nulls first, by 4,096 ranges of their text's hash and then text), the first one
    after the last.

    Rows are grouped by ranges of doc_id that hold ``per_bucket`` rows on average, however
    sparse the ids are, so a window sees a small range. Only the first row of each range
    moves besides: it follows the last one of the range before. Ranges are put in order
    by groups of 1,024 ranges, and the groups' first ones by one small window.
    """
    ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("n")).first()
    width = min(1 << 62, max(1, (ids["high"] - ids["low"] + 1) * per_bucket // ids["n"])) if ids["n"] else 1
    rows = docs.withColumns(
        {
            "_b": F.coalesce(F.expr(f"doc_id div {width}L"), F.lit(-(2**63)).cast("long")),
            "_s": F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 52)).otherwise(4096),
        }
    )
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.col("text").alias("t"))
    first = scratch.store(rows.groupBy("_b", "_s").agg(F.min(place)["t"].alias("_first")), "first")
    range_ = F.struct("_b", "_s")
    grouped = first.select("_b", "_s", F.shiftright("_b", 10).alias("_g"))
    groups = grouped.groupBy("_g").agg(F.min(range_).alias("_head"))
    line = Window.orderBy("_g")
    groups = groups.select("_g", F.coalesce(F.lead("_head").over(line), F.first("_head").over(line)).alias("_then"))
    within = Window.partitionBy("_g").orderBy("_b", "_s")
    follow = grouped.withColumn("_to", F.lead(range_).over(within)).join(groups, "_g")
    follow = follow.select("_b", "_s", F.coalesce("_to", "_then").alias("_to"))
    to = first.select(range_.alias("_to"), F.col("_first").alias("_after"))
    after = scratch.store(follow.join(to, "_to").drop("_to"), "after")
    if (after.agg(F.sum(F.length("_after"))).first()[0] or 0) <= BROADCAST_CHARS:
        after = F.broadcast(after)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    led = rows.withColumn("_next", F.lead(F.struct("text", "prints")).over(Window.partitionBy("_b", "_s").orderBy(*order)))
    out = led.join(after, ["_b", "_s"], "left")
    last = F.col("_next").isNull()
    out = out.withColumns({"next_text": F.when(last, F.col("_after")).otherwise(F.col("_next.text")), "next_prints": F.col("_next.prints")})
    return out.drop("_b", "_s", "_next", "_after")


def fingerprint_edited(docs: DataFrame, scratch: Scratch | None = None, *, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness.

    Edited: the last quarter (floor) of the code points is replaced by as many
    (or all) first ones of the next row's text. Columns: doc_id, n_chars, edited_text,
    prints, edited_prints, near_edited, near_next. A null text counts as empty;
    repeated rows follow each other; a null doc_id comes first; other columns are
    not read. Equal texts have equal fingerprints. Empty in, empty out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "winnow")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprint(base, "text", "prints", gram, window), scratch)
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    rows = rows.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), size - quarter), F.substring("next_text", F.lit(1), quarter)).alias("edited_text"),
        F.when(F.col("next_prints").isNull(), F.col("next_text")).alias("far_text"),
        "prints",
        "next_prints",
    )
    rows = fingerprint(rows, "edited_text", "edited_prints", gram, window)
    # few rows are followed by one of another range; for the others this text is null
    rows = fingerprint(rows, "far_text", "far_prints", gram, window)
    rows = rows.withColumns(
        {
            "set": hashes(F.col("prints")),
            "edited_set": hashes(F.col("edited_prints")),
            "next_set": hashes(F.coalesce(F.col("next_prints"), F.col("far_prints"))),
        }
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_text",
        "prints",
        "edited_prints",
        likeness("set", "edited_set").alias("near_edited"),
        likeness("set", "next_set").alias("near_next"),
    )
