"""The pipeline's stages on small tables, each against its input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from kelvinlake.llm import dartminhash, severity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, f in pipeline.STAGES:
        docs = f(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs
    return out


def test_columns(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxicity(spark, stages):
    docs = stages["documents"]
    model = severity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in severity.score_severity(docs, model).where(F.col("p_toxic") < severity.REJECT).collect()}
    assert {r.doc_id for r in stages["toxicity"].collect()} == keep


def test_near_dedup_keeps_one_of_each(stages):
    before = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(stages["line_dedup"]).collect()}
    kept = [r.doc_id for r in stages["near_dedup"].collect()]
    assert sorted(kept) == sorted(set(before.values()))


def test_mixing_keeps_every_document(stages):
    assert {r.doc_id for r in stages["mixing"].collect()} == {r.doc_id for r in stages["near_dedup"].collect()}


def test_packing_covers_every_row(stages):
    whole = stages["packing"].where("start = 0")
    assert whole.count() == stages["mixing"].count()


def test_odd_tables(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, "a b c d e f g", "en", "a", 13), (3, "a b c d e f g", "en", "a", 13), (None, "x\ny", "en", "b", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    empty = docs.where("false")
    for _, f in pipeline.STAGES:
        empty = f(spark, empty, SF)
        assert empty.count() == 0
        docs = f(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.where("doc_id = 3").count() >= 1


def test_columns_of_any_name_pass(spark):
    """Columns that operators make themselves, and rows that repeat."""
    names = "row key grade p_toxic expected_severity lines dropped tokens block weight copies _copy _d _r _row kept".split()
    texts = ["a b c d e f g h", "a b c d e f g h", "another line of words\nand one more here", None, ""]
    rows = [(i // 2, t, "en", f"s{i}", None if t is None else len(t), *(f"{c}{i}" for c in names)) for i, t in enumerate(texts)]
    rows.append(rows[2])
    docs = spark.createDataFrame(rows, f"{DOCS}, " + ", ".join(f"`{c}` string" for c in names))
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        for r in out.collect():
            i = int(r.source[1:])
            assert r.doc_id == i // 2 and [r[c] for c in names] == [f"{c}{i}" for c in names], name
    assert pipeline.near_dedup(spark, docs, SF).count() == 3  # of equal rows one stays, and one of those without words


def test_no_copies_give_no_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 3), (2, "c", "en", "x", 1)], DOCS)
    monkeypatch.setattr(pipeline.mixing, "mix_sources", lambda d: d.withColumn("copies", F.when(F.col("doc_id") == 1, 0).otherwise(2).cast("long")))
    assert [r.doc_id for r in pipeline.mix(spark, docs, SF).collect()] == [2, 2]
