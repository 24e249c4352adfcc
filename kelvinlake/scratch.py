"""Tables that cut a lineage, written where every executor can read them back.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where a local
session has no such setting (tests, a laptop), a temporary folder is used; on a cluster
that is an error, as each executor would write to its own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kelvinlake-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(_remove, spark, named)
    return named.rstrip("/")


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already at exit
        return


#: Removes an execution's shuffle files at its end; they are of no use once its table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one query. ``drop`` removes those that its result doesn't read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        at = self.path(name)
        was = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.unset(_CLEANUP) if was is None else self.spark.conf.set(_CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._kelvinlake_path = at  # noqa: SLF001 - lets drop() find the table
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            at = getattr(table, "_kelvinlake_path", None)
            if at:
                _remove(self.spark, at)
