"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of documents. ``run`` writes each stage's
result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm import dartminhash, linededup, mixing, packing, severity
from kelvinlake.llm._fetch import BROADCAST_ROWS
from kelvinlake.llm.queries import tokenizer_path
from kelvinlake.scratch import Scratch


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator needs, and all columns as one, which no name clashes with."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def _unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs``, some of them with a new value."""
    return df.select(*[new.get(c, F.col("_doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of any toxic grade reaches the threshold.

    A null or empty text is scored by the model's intercept alone; repeated rows are judged
    alike; other columns pass whatever their names are; an empty table stays empty."""
    model = severity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = severity.score_severity(_packed(docs, "doc_id", "text"), model)
    return _unpacked(scored.where(F.col("p_toxic") < severity.REJECT), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one occurrence of near-equal lines, and documents of which no
    line is left. A document without a dropped line stays as it is.

    A null text stays null, an empty or blank one as it is; rows that repeat doc_id and text
    get the same text; n_chars follows the text; other columns pass whatever their names
    are; an empty table stays empty."""
    out = linededup.dedup_lines(_packed(docs, "doc_id", "text"))
    kept = out.where((F.size("dropped") == 0) | (F.size("dropped") < F.col("lines")))
    n_chars = F.when(F.size("dropped") == 0, F.col("_doc")["n_chars"]).otherwise(F.length("text")) if "n_chars" in docs.columns else F.lit(None)
    return _unpacked(kept, docs, text=F.col("text"), n_chars=n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: least doc_id (null first), then
    least text hash; of rows that repeat both, one.

    Texts without a word (null, empty, blank) are one group. Other columns pass whatever
    their names are; an empty table stays empty."""
    scratch = Scratch(spark, "neardedup")
    decided = dartminhash.near_duplicates(docs, scratch).groupBy("doc_id", "row").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")
    )
    # rows that go, and those of which one of several stays: far fewer than documents
    decided = scratch.store(decided.where("not kept or n > 1"), "decided").select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "kept")
    if decided.count() <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    rows = _packed(docs, "doc_id", "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    found = rows.join(decided, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    one = found.where("kept").groupBy("doc_id", "_row").agg(F.first("_doc").alias("_doc"))
    return _unpacked(found.where("kept is null").select("_doc").unionByName(one.select("_doc")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, once at least under the
    least budget.

    Null sources are one source; a text without a word (null, empty) weighs nothing and
    stays as often as its block does; rows that repeat doc_id and text share a block; other
    columns pass whatever their names are; an empty table stays empty."""
    mixed = mixing.mix_sources(_packed(docs, "doc_id", "text", "source")).where("copies > 0")
    return _unpacked(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences.

    A null or empty text is one piece of the end token; each of repeated rows is packed; other
    columns are not read; an empty table gives no piece."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Hash joins, trained weights and tokenizers: not in SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        was, docs = docs, scratch.store(stage(spark, docs, sf_dir), name)
        scratch.drop(was)
    return docs
