"""Totals, rankings and the catalog; each a grouped sum over partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.functions.text import normalize_term
from kelvinlake.operators.identity import preferred_name
from kelvinlake.operators.search import system_label

FIELDS = ("system_types", "dataset_system_types", "data_types", "property_groups", "properties", "systems", "components", "methods", "publications")


def _per_property(sets: DataFrame) -> DataFrame:
    """(set columns, property, category, n) of properties that have observations."""
    values = F.flatten(F.transform("ds.points", lambda p: p["property_values"]))
    rows = sets.withColumn("_v", F.transform(values, lambda v: v["number"])).select(
        "*", F.explode(F.arrays_zip(F.col("ds.properties").alias("p"), F.col("categories").alias("category"))).alias("x")
    )
    n = F.size(F.filter("_v", lambda v: v == F.col("x.p.number")))
    return rows.withColumn("n", n.cast("long")).where("n > 0")


def totals(documents: DataFrame, sets: DataFrame, *, include_reactions: bool = True) -> DataFrame:
    """One row: documents (with datasets or reactions), datasets, data_points,
    observations, reaction_datasets."""
    points = F.size("ds.points")
    observations = F.aggregate("ds.points", F.lit(0).cast("long"), lambda n, p: n + F.size(p["property_values"]))
    per_doc = sets.groupBy("doc").agg(
        F.count(F.lit(1)).alias("k"), F.sum(points).alias("points"), F.sum(observations).alias("observations")
    )
    reactions = F.col("document.reaction_dataset_count") if include_reactions else F.lit(0)
    base = documents.select(F.col("ordinal").alias("doc"), reactions.alias("r")).join(per_doc, "doc", "left").where("k > 0 or r > 0")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return base.agg(
        F.count(F.lit(1)).alias("documents"), zero("k").alias("datasets"), zero("points").alias("data_points"),
        zero("observations").alias("observations"), zero("r").alias("reaction_datasets"),
    )


def rankings(sets: DataFrame) -> DataFrame:
    """(field, label, count), most first within a field: one pass for all of them."""
    publication = F.coalesce("doi", "citation.title", "sha256")
    names = F.transform("members", preferred_name)
    labels = F.concat(
        F.array(
            F.struct(F.lit("system_types").alias("field"), F.col("system_type").alias("label")),
            F.struct(F.lit("data_types").alias("field"), F.col("x.category").alias("label")),
            F.struct(F.lit("property_groups").alias("field"), F.col("x.p.group").alias("label")),
            F.struct(F.lit("properties").alias("field"), F.col("x.p.name").alias("label")),
            F.struct(F.lit("systems").alias("field"), system_label(F.col("members")).alias("label")),
            F.struct(F.lit("methods").alias("field"), F.col("x.p.method").alias("label")),
            F.struct(F.lit("publications").alias("field"), publication.alias("label")),
        ),
        F.transform(names, lambda c: F.struct(F.lit("components").alias("field"), c.alias("label"))),
    )
    weighted = _per_property(sets).select(F.explode(labels).alias("f"), "n").select("f.field", "f.label", "n").where("label is not null")
    plain = sets.select(F.lit("dataset_system_types").alias("field"), F.col("system_type").alias("label"), F.lit(1).cast("long").alias("n"))
    return (
        weighted.unionByName(plain)
        .groupBy("field", "label")
        .agg(F.sum("n").alias("count"))
        .orderBy("field", F.desc("count"), "label")
    )


def top(ranking: DataFrame, field: str, limit: int = 10) -> DataFrame:
    if field not in FIELDS:
        raise ValueError(f"{field!r} is no ranking.")
    if limit < 0:
        raise ValueError("limit must not be negative.")
    return ranking.where(F.col("field") == field).orderBy(F.desc("count"), "label").limit(limit)


def catalog(sets: DataFrame) -> DataFrame:
    """Per (category, property, variable or null): relations, datasets, publications."""
    rows = sets.select(
        "doc", "pos", "key", F.col("ds.variables").alias("variables"),
        F.arrays_zip(F.col("ds.properties").alias("p"), F.col("categories").alias("c")).alias("props"), F.explode("ds.points").alias("pt"),
    )
    names = F.transform("pt.variable_values", lambda v: F.get(F.filter("variables", lambda d: d["number"] == v["number"]), F.lit(0))["name"])
    rows = rows.withColumn("names", names).select("doc", "pos", "key", "props", "names", F.explode("pt.property_values.number").alias("n"))
    rows = rows.withColumn("p", F.get(F.filter("props", lambda x: x["p"]["number"] == F.col("n")), F.lit(0)))
    rows = rows.select(
        "doc", "pos", "key", F.col("p.c").alias("category"), F.col("p.p.name").alias("property"), F.explode_outer("names").alias("variable")
    )
    # nested: dataset, then publication, then entry; no distinct expansion
    three = ["category", "property", "variable"]
    per_set = rows.groupBy(*three, "key", "doc", "pos").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_set.groupBy(*three, "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    out = per_key.groupBy(*three).agg(
        F.sum("n").alias("relations"), F.sum("k").alias("datasets"), F.count(F.lit(1)).alias("publications")
    )
    return out.orderBy(*[normalize_term(F.coalesce(c, F.lit(""))) for c in three])


def catalog_categories(entries: DataFrame) -> DataFrame:
    return entries.groupBy("category").agg(F.sum("relations").alias("relations")).orderBy(F.desc("relations"), "category")


def catalog_properties(entries: DataFrame, category: str | None = None) -> DataFrame:
    if category is not None:
        entries = entries.where(normalize_term(F.col("category")) == normalize_term(F.lit(category)))
    return entries.groupBy("property").agg(F.sum("relations").alias("relations")).orderBy(F.desc("relations"), "property")


def catalog_variables(entries: DataFrame, category: str | None = None, property_name: str | None = None) -> DataFrame:
    entries = entries.where("variable is not null")
    if category is not None:
        entries = entries.where(normalize_term(F.col("category")) == normalize_term(F.lit(category)))
    if property_name is not None:
        entries = entries.where(normalize_term(F.col("property")).contains(normalize_term(F.lit(property_name))))
    return entries.groupBy("variable").agg(F.sum("relations").alias("relations")).orderBy(F.desc("relations"), "variable")
