"""Documents as a stream: new files are decoded as they arrive, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelvinlake.operators.search import datasets
from kelvinlake.operators.summary import rankings
from kelvinlake.sources import scan

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, *, per_batch: int = 1000) -> DataFrame:
    """Bronze rows of the XML and JSON files that appear in a folder, one a file. An XML
    file and its JSON twin have one ordinal, that of their common stem."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    xml = F.lower("path").endswith(".xml")
    return files.where(xml | F.col("path").endswith(".json")).select(
        F.xxhash64(F.regexp_replace("path", r"\.(?i:xml|json)$", "")).alias("ordinal"), F.col("path").alias("member"), F.when(xml, F.col("content")).alias("xml"),
        F.when(~xml, F.col("content")).alias("json"),
    )


def ingest(bronze: DataFrame, silver: str, failures: str, checkpoint: str) -> StreamingQuery:
    """Decoded documents to one Parquet folder, failures to another, per batch id. Twins that
    arrive in one batch are one document, and the JSON one stands in for a broken XML."""

    def write(batch: DataFrame, number: int) -> None:
        whole = F.struct(F.col("xml").isNotNull(), "member")
        paired = batch.groupBy("ordinal").agg(
            F.max_by("member", whole).alias("member"), F.first("xml", True).alias("xml"), F.first("json", True).alias("json")
        )
        decoded = scan.decode_documents(paired).withColumn("batch", F.lit(number)).persist()
        for part, to in ((scan.documents(decoded), silver), (decoded.where("error is not null").select("member", "error", "batch"), failures)):
            # a batch that runs again replaces its own partition
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)
        decoded.unpersist()

    return bronze.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def additive_rankings(spark: SparkSession, silver: str) -> DataFrame:
    """Rankings over all ingested batches. Of twins that came in different batches the XML
    one counts, and of a file that came again the last."""
    rows = spark.read.parquet(silver)
    best = rows.groupBy("ordinal").agg(F.max(F.struct("media_type", "batch")).alias("x")).select("ordinal", "x.*")
    return rankings(datasets(rows.join(best, ["ordinal", "media_type", "batch"], "left_semi").drop("batch")))
