"""Temperature mixing of sources, realised as whole blocks of documents.

A source's weight is its share of the tokens to the power ``exponent``,
normalised. The exponent in [0, 1] is found by bisection: the least one (the
flattest mix) that no source repeats more than ``repeats`` times under, or the
one whose mix has a target entropy. The budget is what the mix takes if its
least repeated source is read exactly once, or a number given.

A source's documents fall into ``BLOCKS`` blocks by a hash. Its target is so many
whole passes, and then the blocks that come first in a seeded permutation, as
far as the target goes, so the last pass misses it by less than one block.
A decision is three numbers per source, and no document moves for it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvinlake.llm._fetch import BROADCAST_ROWS
from kelvinlake.scratch import Scratch

BLOCKS = 4096
REPEATS = 2.0


def token_count(text="text"):
    """Words between spaces and line ends; 0 for a null or blank text."""
    words = F.size(F.filter(F.split(text, "[ \n]+"), lambda w: w != ""))
    return F.when(F.col(text).isNull(), 0).otherwise(words).cast("long")


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(sum of p^e, entropy of the mix, most repeats at the least budget) of each exponent."""
    p = F.col("share")
    cols = []
    for i, e in enumerate(exponents):
        w = F.pow(p, F.lit(e))
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"l{i}")]
        cols += [F.max(w / p).alias(f"hi{i}"), F.min(w / p).alias(f"lo{i}")]
    row = shares.agg(*cols).first()
    return [
        (row[f"z{i}"], math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"hi{i}"] / row[f"lo{i}"])
        for i in range(len(exponents))
    ]


def bisect_exponent(shares: DataFrame, *, repeats: float | None = REPEATS, entropy: float | None = None) -> float:
    """The least exponent in [0, 1] whose mix repeats no source more than ``repeats``
    times, or whose entropy is at most ``entropy`` nats. Both fall or rise steadily
    with the exponent. Eight levels of bisection share one pass over the sources."""
    low, high = 0.0, 1.0

    def flat(m: tuple[float, float, float]) -> bool:  # too flat: the exponent must grow
        return m[1] > entropy + 1e-12 if entropy is not None else m[2] > repeats * (1 + 1e-12)

    if not flat(_moments(shares, [low])[0]):
        return low
    for _ in range(6):
        grid = [low + (high - low) * i / 32 for i in range(1, 32)]
        bad = [e for e, m in zip(grid, _moments(shares, grid), strict=True) if flat(m)]
        low = max(bad, default=low)
        high = min((e for e in grid if e > low), default=high)
    return high


def mix_sources(
    docs: DataFrame,
    *,
    repeats: float | None = REPEATS,
    entropy: float | None = None,
    budget: float | None = None,
    seed: int = 7,
    blocks: int = BLOCKS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``docs`` with the added columns tokens, block, weight, copies.

    ``copies`` says how often a document is in the mix (0: left out; at the least
    budget each is in it once or more). Rows with a null source are one source, as
    are those with an empty one. Rows that repeat doc_id and text share a block.
    If no row has a token, each row is taken once. Columns of ``docs`` pass
    through; ones with the added names are replaced. Empty in, empty out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    base = docs.drop("tokens", "block", "weight", "copies")
    sized = base.withColumn("tokens", token_count()).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(blocks)).cast("int")
    )
    by_block = scratch.store(
        sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks"
    )
    by_source = by_block.groupBy("source").agg(F.sum("tokens").alias("all")).where(F.col("all") > 0)
    by_source = scratch.store(by_source, "sources")
    total = by_source.agg(F.sum("all")).first()[0]
    if not total:
        return sized.withColumn("weight", F.lit(None).cast("double")).withColumn("copies", F.lit(1).cast("long"))
    shares = by_source.select("source", "all", (F.col("all") / F.lit(total)).alias("share"))
    exponent = bisect_exponent(shares, repeats=repeats, entropy=entropy)
    z, _, _ = _moments(shares, [exponent])[0]
    weight = F.pow("share", F.lit(exponent)) / F.lit(z)
    if budget is None:
        budget = shares.agg(F.max(F.col("all") / weight)).first()[0]
    targets = shares.select("source", weight.alias("weight"), "all", (weight * F.lit(float(budget)) / F.col("all")).alias("passes"))
    targets = targets.withColumn("whole", F.floor(F.col("passes") + 1e-9)).withColumn(
        "rest", F.greatest(F.lit(0.0), (F.col("passes") - F.col("whole")) * F.col("all"))
    )
    order = F.xxhash64(F.lit(seed + 1), "source", "block")
    run = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        by_block.withColumn("order", order)
        .withColumn("upto", F.sum("tokens").over(run))
        .join(targets.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("upto") <= F.col("rest") + 1e-6)
        .groupBy("source")
        .agg(F.max("order").alias("upto"))
    )
    decided = targets.join(taken.select(F.col("source").alias("_t"), "upto"), F.col("source").eqNullSafe(F.col("_t")), "left")
    decided = scratch.store(decided.select(F.col("source").alias("_s"), "weight", "whole", "upto"), "decided")
    side = F.broadcast(decided) if decided.count() <= BROADCAST_ROWS else decided
    extra = F.when(order <= F.col("upto"), 1).otherwise(0)
    return (
        sized.join(side, F.col("source").eqNullSafe(F.col("_s")), "left")
        .withColumn("copies", F.coalesce(F.col("whole") + extra, F.lit(1)).cast("long"))
        .drop("_s", "whole", "upto")
        .select(*base.columns, "tokens", "block", "weight", "copies")
    )
