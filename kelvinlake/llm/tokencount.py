"""Token counts of the documents in flat token files that have no index.

A flat file holds little-endian token ids, one document after the other, each
closed by a separator id. Files are cut into blocks of bytes; each block is
searched for the separator in one vectorised pass, in parallel, and gives its
separators' places. A prefix scan over the blocks' summaries then gives, for each
block, how many documents ended before it and where the open one began, which
stitches documents that cross block boundaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvinlake.llm._arrays import handing_back, slices
from kelvinlake.llm._fetch import BROADCAST_ROWS
from kelvinlake.llm.wordbpe import TEXT_BYTES, encoder
from kelvinlake.scratch import Scratch

BLOCK_BYTES = 4 << 20


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int, dtype: str = "<u2") -> DataFrame:
    """Writes one flat file per partition of ``docs`` and returns its manifest:
    doc_id, file (name in ``folder``), ordinal (document in the file).

    A file is written under an attempt's own name and moved into place, so a task
    that runs again leaves one whole file. A separator that occurs in a text is an
    error: it would split the document. Files are written when the manifest is
    computed; store the manifest to write them once.
    """

    def run(batches):
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{context.partitionId():06d}.tokens"
        own = f"{root}/_{name}.{context.taskAttemptId()}"
        done = 0
        with store.open_output_stream(own) as out:
            for batch in batches:
                for part in slices(batch, "text", TEXT_BYTES):
                    ids, off = encoder(tokenizer).encode(part.column("text"))
                    if (ids == separator).any():
                        raise ValueError(f"a text holds the token {separator}, which is the separator")
                    out.write(np.insert(ids, off[1:], separator).astype(dtype).tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array([name] * part.num_rows),
                            pa.array(np.arange(done, done + part.num_rows)),
                        ],
                        ["doc_id", "file", "ordinal"],
                    )
                    done += part.num_rows
        if done:
            store.move(own, f"{root}/{name}")
        else:
            store.delete_file(own)

    return docs.select("doc_id", "text").mapInArrow(handing_back(run), "doc_id long, file string, ordinal long")


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files in a folder; hidden names (_ or .) are left out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = [(f.getPath().getName(), f.getLen()) for f in store.listStatus(path) if f.isFile()]
    return sorted(x for x in found if x[0][0] not in "_.")


_BLOCKS = "file string, block long, start long, tokens long, places array<long>"


def _scan(folder: str, separator: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for x in batch.to_pylist():
                with store.open_input_file(f"{root}/{x['file']}") as f:
                    raw = f.read_at(x["bytes"], x["at"])
                ids = np.frombuffer(raw, dtype)
                places = np.flatnonzero(ids == separator) + x["at"] // width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["file"]]),
                        pa.array([x["block"]]),
                        pa.array([x["at"] // width]),
                        pa.array([len(ids)]),
                        pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places)),
                    ],
                    ["file", "block", "start", "tokens", "places"],
                )

    return run


def count_tokens(
    spark: SparkSession,
    folder: str,
    separator: int,
    *,
    dtype: str = "<u2",
    block_bytes: int = BLOCK_BYTES,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document of the files in ``folder``: file, ordinal (from 0),
    start (its first token's place in the file), tokens (without the separator),
    closed (false for tokens after a file's last separator).

    Two adjacent separators make a document of 0 tokens. An empty file or folder
    gives no rows. A file whose size is no whole number of tokens is an error.
    """
    scratch = scratch or Scratch(spark, "tokencount")
    width = np.dtype(dtype).itemsize
    block_bytes = max(width, block_bytes // width * width)
    files = list_files(spark, folder)
    for name, size in files:
        if size % width:
            raise ValueError(f"{name} has {size} bytes, no whole number of {width}-byte tokens")
    blocks = (
        spark.createDataFrame([x for x in files if x[1]], "file string, size long")
        .select("file", "size", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {block_bytes}"))).alias("block"))
        .select("file", F.col("block").cast("long").alias("block"), (F.col("block") * block_bytes).cast("long").alias("at"), "size")
        .withColumn("bytes", F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("at")))
    )
    blocks = blocks.repartition(max(1, min(10_000, sum(-(-s // block_bytes) for _, s in files))), "file", "block")
    found = scratch.store(blocks.mapInArrow(_scan(folder, separator, dtype), _BLOCKS), "blocks")
    # the scan's rows are narrow: one per block, without the places
    summary = found.select(
        "file", "block", "start", "tokens", F.size("places").cast("long").alias("n"), F.try_element_at("places", F.lit(-1)).alias("last")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("open"),
    )
    scanned = scratch.store(scanned, "scan")
    side = F.broadcast(scanned) if scanned.count() <= BROADCAST_ROWS else scanned
    closed = found.join(side, ["file", "block"]).select(
        "file", "ended", "open", "places", F.posexplode("places").alias("k", "place")
    )
    closed = closed.select(
        "file",
        (F.col("ended") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("places", F.col("k") - 1) + 1).alias("start"),
        "place",
    ).select("file", "ordinal", "start", (F.col("place") - F.col("start")).alias("tokens"), F.lit(True).alias("closed"))
    tails = (
        summary.groupBy("file")
        .agg(F.sum("n").alias("ordinal"), (F.max("last") + 1).alias("start"), F.max(F.col("start") + F.col("tokens")).alias("end"))
        .select("file", "ordinal", F.coalesce("start", F.lit(0)).alias("start"), "end")
        .where("end > start")
        .select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("tokens"), F.lit(False).alias("closed"))
    )
    return closed.unionByName(tails)
