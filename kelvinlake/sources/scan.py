"""Scans: files, bytes and tar archives to one row per document.

``bronze`` rows are (ordinal, member, xml, json): the raw bytes of a document and
of its JSON twin. Decoding is one Arrow stage over them; what fails becomes an
error struct, and in strict mode an error at action time.
"""

from __future__ import annotations

import hashlib
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kelvinlake.errors import ArchiveError, DataError, ParseError
from kelvinlake.sources import decode
from kelvinlake.sources.schema import DECODED

BRONZE = "ordinal long, member string, xml binary, json binary"
XML_TYPE, JSON_TYPE = "application/xml", "application/json"


def _decode_member(row: dict, fallback: bool) -> dict:
    xml, twin = row["xml"], row["json"]
    data, kind = (xml, XML_TYPE) if xml is not None else (twin, JSON_TYPE)
    out = {"ordinal": row["ordinal"], "member": row["member"], "media_type": kind, "recovery": None, "document": None, "error": None}
    out["sha256"] = hashlib.sha256(data).hexdigest()
    try:
        out["document"] = decode.from_xml(xml) if xml is not None else decode.from_json(twin)
    except ParseError as e:
        if xml is None or twin is None or not fallback:
            return out | {"error": {"kind": type(e).__name__, "message": str(e)}}
        try:
            document = decode.from_json(twin)
            if document["related_xml_md5"] != hashlib.md5(xml).hexdigest():
                raise ParseError("the JSON twin names another XML file")
        except DataError as f:
            return out | {"error": {"kind": "ParseError", "message": f"{e} JSON twin: {f}"}}
        recovery = {
            "strategy": "paired-json", "failed_locator": row["member"], "failed_sha256": out["sha256"], "failed_media_type": kind,
            "failure_type": type(e).__name__, "failure_message": str(e), "lexical_numeric_text_preserved": False,
        }
        return out | {"document": document, "recovery": recovery, "sha256": hashlib.sha256(twin).hexdigest(), "media_type": JSON_TYPE}
    except DataError as e:
        out["error"] = {"kind": type(e).__name__, "message": str(e)}
    return out


def _row(row: dict, fallback: bool, schema: pa.Schema) -> pa.RecordBatch:
    """A decoded row; a document that no column can hold (a number beyond its type, half a
    surrogate pair) is a failure of its own, not of its task."""
    try:
        return pa.RecordBatch.from_pylist([_decode_member(row, fallback)], schema)
    except (pa.ArrowException, ArithmeticError, RecursionError, TypeError, ValueError) as e:
        data = row["xml"] if row["xml"] is not None else row["json"]
        message = str(e).encode("utf-8", "replace").decode()
        bad = {"ordinal": row["ordinal"], "member": row["member"], "sha256": hashlib.sha256(data).hexdigest(), "error": {"kind": "ParseError", "message": message}}
        return pa.RecordBatch.from_pylist([bad], schema)


def decode_documents(bronze: DataFrame, *, json_fallback: bool = True, prefilter: list[bytes] | None = None, strict: bool = False) -> DataFrame:
    """Bronze rows to (ordinal, member, sha256, media_type, recovery, document, error).

    ``prefilter``: byte strings that a member's XML must hold, all of them, tested
    before decoding. ``strict``: the first failure fails the action.
    """
    for needle in prefilter or ():
        bronze = bronze.where(F.contains(F.coalesce("xml", "json"), F.lit(needle)))
    schema = _parse_datatype_string(DECODED)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.Table.from_batches([_row(r, json_fallback, arrow) for r in batch.slice(at, 64).to_pylist()]).combine_chunks().to_batches()[0]

    out = bronze.mapInArrow(run, schema)
    if strict:
        ok = F.when(F.col("error").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.col("member"), F.lit(": "), F.col("error.message")))
        )
        out = out.where(ok)
    return out


def failures(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is not null").select("ordinal", "member", "error.kind", "error.message")


def recoveries(decoded: DataFrame) -> DataFrame:
    return decoded.where("recovery is not null").select("ordinal", "member", "recovery.*")


def documents(decoded: DataFrame) -> DataFrame:
    return decoded.where("document is not null").drop("error")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Bronze rows of the XML and JSON files under a path; a pair shares a stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"\.(?i:xml|json)$", "")
    files = files.withColumn("stem", name)
    xml = files.where(F.lower("path").endswith(".xml")).select("path", "stem", F.col("content").alias("xml"))
    twin = files.where(F.col("path").endswith(".json")).select("stem", F.col("content").alias("json"), F.col("path").alias("json_path"))
    both = xml.join(twin, "stem", "full_outer")
    return both.select(
        F.xxhash64(F.coalesce("path", "json_path")).alias("ordinal"), F.coalesce("path", "json_path").alias("member"), "xml", "json"
    )


def read_source(spark: SparkSession, source: str | bytes | os.PathLike, label: str | None = None) -> DataFrame:
    """One bronze row of bytes, inline text (starting with <, { or [) or a path."""
    if isinstance(source, bytes | bytearray):
        data = bytes(source)
    elif hasattr(source, "read"):
        data = source.read()
        data = data.encode() if isinstance(data, str) else data
    elif isinstance(source, str) and source.lstrip()[:1] in ("<", "{", "["):
        data = source.encode()
    elif isinstance(source, str | os.PathLike):
        with open(source, "rb") as f:
            data, label = f.read(), label or os.fspath(source)
    else:
        raise TypeError(f"{type(source).__name__} is no document source")
    is_json = data.lstrip()[:1] in (b"{", b"[")
    return spark.createDataFrame([(0, label, None if is_json else data, data if is_json else None)], BRONZE)


#: Members that one archive may have: ordinals of several archives don't meet.
MEMBERS = 1 << 40


class _Archive(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(path)
        self.number, self.path = number, path


class _TarReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Archive]:
        return [_Archive(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        try:
            with tarfile.open(partition.path, "r|*") as tar:
                for ordinal, member in enumerate(tar, partition.number * MEMBERS):
                    low = member.name.lower()
                    if member.isfile() and (low.endswith(".xml") or member.name.endswith(".json")):
                        yield partition.path, ordinal, member.name, low.endswith(".xml"), tar.extractfile(member).read()
        except tarfile.TarError as e:
            raise ArchiveError(f"{partition.path}: {e}") from e


class TarSource(DataSource):
    """Members of tar archives in one streamed pass each; never extracted to disk."""

    @classmethod
    def name(cls) -> str:
        return "kelvinlake_tar"

    def schema(self) -> str:
        return "archive string, ordinal long, member string, is_xml boolean, content binary"

    def reader(self, schema) -> _TarReader:
        return _TarReader(self.options["path"].split(","))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Bronze rows of a tar archive (or several, by comma). A compressed tar is read
    by one task; land the result once, what follows is parallel."""
    spark.dataSource.register(TarSource)
    members = spark.read.format("kelvinlake_tar").option("path", path).load()
    members = members.withColumn("stem", F.regexp_replace("member", r"\.(?i:xml|json)$", ""))
    xml = members.where("is_xml")
    twins = members.where("not is_xml").select("archive", "stem", F.col("content").alias("json"))
    twins = twins.dropDuplicates(["archive", "stem"])
    return xml.join(twins, ["archive", "stem"], "left").select("ordinal", "member", F.col("content").alias("xml"), "json")
