"""Decoded documents made of the driver's tables, so that its SQL can check the engine.

An order is a document, (order, return flag) a dataset, the brands of its parts are the
components, a line is a point. Price and tax, by group of the part's type, are
properties; quantity and discount are variables; the order's total is a constraint; the
line status is a phase. A brand's maker (by its first digit) stands for its CAS number.

They are written once for a session and folder, as an engine's decoded layer is: queries
read only the nested fields they need, and don't build the documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from kelvinlake.scratch import Scratch
from kelvinlake.sources.schema import CITATION, COMPOUND, DATASET, DOCUMENT, RECOVERY

#: Property groups by the first word of a part's type; other types are groups of their own.
GROUPS = {
    "ECONOMY": "VolumetricProp",
    "STANDARD": "HeatCapacityAndDerivedProp",
    "PROMO": "TransportProp",
    "MEDIUM": "CompositionAtPhaseEquilibrium",
    "LARGE": "Criticals",
}


def group(c: str = "p_type") -> Column:
    out = F
    for k, v in GROUPS.items():
        out = out.when(F.col(c).startswith(k), v)
    return out.otherwise(F.col(c))


def maker(c: str = "p_brand") -> Column:
    return F.concat(F.lit("Maker#"), F.substring(c, 7, 1))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _filled(kind: StructType, **given: Column) -> Column:
    """A struct of ``kind``: the given fields, empty arrays and nulls."""
    fields = []
    for f in kind.fields:
        empty = F.array() if f.dataType.typeName() == "array" else F.lit(None)
        fields.append(given.get(f.name, empty).cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def _element(kind: StructType, name: str) -> StructType:
    return kind[name].dataType.elementType


_NAMES = ("price", "tax")


def _number(group_: Column, k: int) -> Column:
    """A property's number: of its group and name."""
    return (F.pmod(F.crc32(group_.cast("binary")), F.lit(1_000_000_000)) * 2 + k).cast("int")


_STORED: dict[tuple[str, str], DataFrame] = {}


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The table of ``built``, written at a session's first call for the folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = Scratch(spark, "nested").store(built(spark, d), "documents")
    return spark.read.schema(_STORED[key].schema).parquet(_STORED[key]._kelvinlake_path)  # noqa: SLF001


def built(spark: SparkSession, d: str) -> DataFrame:
    """Decoded rows (see ``sources.schema.DECODED``), one for each order that has lines."""
    dataset_type, compound_type, citation_type, document_type = (DataType.fromDDL(x) for x in (DATASET, COMPOUND, CITATION, DOCUMENT))
    point_type = _element(dataset_type, "points")
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    part = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", maker().alias("maker"), group().alias("grp"))
    lines = read("lineitem").join(part, "l_partkey")
    value = lambda kind, n, c: _filled(
        _element(point_type, kind), number=F.lit(n) if isinstance(n, int) else n, value=cents(c).cast("string"), value_double=cents(c)
    )
    point = _filled(
        point_type,
        index=F.col("l_linenumber"),
        variable_values=F.array(value("variable_values", 1, "l_quantity"), value("variable_values", 2, "l_discount")),
        property_values=F.array(
            *[value("property_values", _number(F.col("grp"), k), c) for k, c in enumerate(("l_extendedprice", "l_tax"))]
        ),
    )
    local = F.substring("p_brand", 7, 9).cast("int")
    sets = lines.groupBy("l_orderkey", "l_returnflag").agg(
        F.array_sort(F.collect_list(point)).alias("points"),
        F.array_sort(F.collect_set(local)).alias("ids"),
        F.array_sort(F.collect_set("grp")).alias("groups"),
        F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == "F", "Liquid").otherwise("Gas"))).alias("phases"),
        F.collect_set(F.struct(local.alias("id"), "p_brand", "maker")).alias("parts"),
    )
    prop = _element(dataset_type, "properties")
    properties = F.flatten(
        F.transform(
            "groups",
            lambda g: F.array(
                *[
                    _filled(prop, number=_number(g, k), name=F.lit(n), group=g, method=F.lit("listed" if n == "price" else None))
                    for k, n in enumerate(_NAMES)
                ]
            ),
        )
    )
    variables = F.array(
        *[_filled(_element(dataset_type, "variables"), number=F.lit(i), name=F.lit(n)) for i, n in enumerate(("Quantity, kg", "Discount, %"), 1)]
    )
    total = _filled(_element(dataset_type, "constraints"), number=F.lit(1), name=F.lit("Total"), value=cents("o_totalprice").cast("string"))
    orders = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    dataset = _filled(
        dataset_type,
        number=F.ascii("l_returnflag"),
        purpose=F.col("l_returnflag"),
        component_ids=F.col("ids"),
        phases=F.col("phases"),
        properties=properties,
        variables=variables,
        constraints=F.array(total),
        points=F.col("points"),
    )
    docs = sets.join(orders, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(dataset), lambda x, y: x["number"] - y["number"]).alias("datasets"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("parts"),
    )
    compounds = F.transform("parts", lambda p: _filled(compound_type, local_id=p["id"], common_names=F.array(p["p_brand"]), cas_registry_number=p["maker"]))
    document = _filled(
        document_type,
        version_major=F.lit(1),
        version_minor=F.lit(0),
        citation=_filled(citation_type, doi=F.concat(F.lit("10.0000/o"), "l_orderkey")),
        compounds=compounds,
        datasets=F.col("datasets"),
        reaction_dataset_count=F.lit(0),
    )
    return docs.select(
        F.col("l_orderkey").alias("ordinal"),
        F.lit(None).cast("string").alias("member"),
        F.lit(None).cast("string").alias("sha256"),
        F.lit(None).cast("string").alias("media_type"),
        F.lit(None).cast(RECOVERY).alias("recovery"),
        document.alias("document"),
    )
