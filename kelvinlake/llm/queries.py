"""The queries of this subpackage: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm import bm25, dartminhash, htmltext, linededup, mixing, packing, severity, tokencount, urltrie, winnow
from kelvinlake.scratch import Scratch

#: Host and path of each rule, with its verdict.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "allow"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
TOKENIZER = "word_bpe_49k.json"
#: Beyond the vocabulary, as <|endoftext|> in a text gives the tokenizer's own id 49407.
SEPARATOR = 65535


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("lines").cast("long").alias("lines"),
        F.size("dropped").cast("long").alias("lines_dropped"),
        F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrie.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "words", "kept"
    )


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, queries)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = severity.train(docs, _table(spark, sf_dir, "labels"))
    return severity.score_severity(docs, model).select(
        "doc_id", "expected_severity", "p_toxic", "grade", (F.col("p_toxic") >= severity.REJECT).alias("toxic")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("files")
    docs = _table(spark, sf_dir, "documents")
    manifest = scratch.store(tokencount.write_token_files(docs, folder, tokenizer_path(), SEPARATOR), "manifest")
    counted = tokencount.count_tokens(spark, folder, SEPARATOR, scratch=scratch)
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "tokens", "file", "ordinal", "start")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_edited(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        winnow.digest(F.col("prints")).alias("fingerprint"),
        winnow.digest(F.col("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_url_filter,
        op3_dart_minhash,
        op4_nnls_packing,
        op5_bm25_topk,
        op6_toxicity,
        op7_token_counts,
        op8_temperature_mixing,
        op9_winnowing,
        op10_html_text,
    )
}

_HOST_AND_PATH = r"""
parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
WITH {_HOST_AND_PATH},
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)}),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.rule_verdict,
         row_number() OVER (PARTITION BY s.page_id, s.host, s.path
                            ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS k
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE k = 1
""",
}
