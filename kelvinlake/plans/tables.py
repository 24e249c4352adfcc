"""Long, relation and analysis tables, and their union.

The long table has one row per selected property value; the relation table pairs
it with each selected variable value of its point. Nested values stay native
until the JSON columns are rendered. The analysis table is a pivot whose
condition and property columns are found in a first, small pass over labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvinlake.functions.citation import publication_strings
from kelvinlake.functions.text import authors_year, condition_priority
from kelvinlake.operators.identity import compound_key, preferred_name
from kelvinlake.operators.search import system_key

ANALYSIS_TAIL = ["DOI", "Authors/Year", "System", "System Type", "Phases", "Method", "Data Category", "Dataset", "metadata"]


def to_json(c) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _compound(i: Column) -> Column:
    return F.get(F.filter("compounds", lambda c: c["local_id"] == i), F.lit(0))


def _names(ids: Column) -> Column:
    return F.transform(ids, lambda i: preferred_name(_compound(i)))


def _defined(defs: Column, number: Column) -> Column:
    return F.get(F.filter(defs, lambda d: d["number"] == number), F.lit(0))


def _condition(value: Column, definition: Column, source: str) -> Column:
    """A variable's or constraint's record; both kinds have the same fields here."""
    null_text = F.lit(None).cast("string")
    own = value if source == "variable" else definition
    return F.struct(
        F.lit(source).alias("source"), definition["number"].alias("number"), definition["name"].alias("name"), definition["phase"].alias("phase"),
        F.when(definition["component_id"].isNotNull(), preferred_name(_compound(definition["component_id"]))).otherwise(null_text).alias("component"),
        _names(definition["solvent_component_ids"]).alias("solvent_components"), own["value"].alias("value"),
        own["significant_digits"].alias("significant_digits"), own["uncertainties"].alias("uncertainties"),
        own["repeatability"].alias("value_repeatability"), definition["uncertainties"].alias("definition_uncertainties"),
        definition["repeatability"].alias("definition_repeatability"), definition["device_specifications"].alias("device_specifications"),
    )


def observations(matches: DataFrame) -> DataFrame:
    """Native long rows: the match's columns, point, value ``v``, definition ``p``,
    ``variables`` and ``constraints`` (arrays of condition records)."""
    variables, constraints = F.col("ds.variables"), F.col("ds.constraints")
    base = matches.withColumn("citation_strings", publication_strings(F.col("citation")))  # once per dataset, not per value
    base = base.withColumn("constraints", F.transform(constraints, lambda c: _condition(c, c, "constraint")))
    points = base.select("*", F.explode("ds.points").alias("pt"))
    points = points.withColumn(
        "variables", F.transform("pt.variable_values", lambda v: _condition(v, _defined(variables, v["number"]), "variable"))
    )
    values = points.select("*", F.posexplode("pt.property_values").alias("v_pos", "v"))
    values = values.where(F.array_contains("property_numbers", F.col("v.number")))
    x = F.arrays_zip(F.col("ds.properties").alias("p"), F.col("categories").alias("category"))
    values = values.withColumn("x", F.get(F.filter(x, lambda y: y["p"]["number"] == F.col("v.number")), F.lit(0)))
    return values.withColumn("p", F.col("x.p")).withColumn("category", F.col("x.category")).drop("x")


def _columns() -> list[Column]:
    c, ds, p, v = F.col("citation"), F.col("ds"), F.col("p"), F.col("v")
    sep = " | "
    samples = F.transform(
        "members",
        lambda m: F.struct(
            preferred_name(m).alias("component"), compound_key(m).alias("stable_identifier"), m["common_names"].alias("common_names"),
            m["iupac_name"].alias("iupac_name"), m["cas_name"].alias("cas_name"), m["formula"].alias("formula"),
            m["standard_inchi"].alias("standard_inchi"), m["standard_inchi_key"].alias("standard_inchi_key"),
            m["cas_registry_number"].alias("cas_registry_number"), m["samples"].alias("samples"),
        ),
    )
    out = {
        "source_locator": F.col("member"), "source_sha256": F.col("sha256"), "source_retrieved_at": F.lit(None).cast("string"),
        "source_media_type": F.col("media_type"), "source_related_xml_md5": F.col("related_xml_md5"),
        "source_recovery_json": F.when(F.col("recovery").isNotNull(), to_json("recovery")), "source_warnings_json": to_json("warnings"),
        "schema_version": F.col("version"), "doi": F.col("doi"), "publication_year": c["year"], "publication_date": c["date"],
        "publication_document_type": c["document_type"], "citation_title": c["title"], "citation_authors": F.array_join(c["authors"], sep),
        "citation_authors_year": authors_year(c["authors"], c["year"]), "citation_apa": F.col("citation_strings.apa"),
        "citation_bibtex": F.col("citation_strings.bibtex"), "publication_name": c["publication_name"], "publication_volume": c["volume"],
        "publication_pages": c["pages"], "citation_url": c["url"], "trc_reference_id": c["trc_reference_id"], "dataset_key": F.col("dataset_key"),
        "dataset_number": ds["number"], "dataset_purpose": ds["purpose"], "dataset_compiler": ds["compiler"],
        "dataset_contributor": ds["contributor"], "dataset_date_added": ds["date_added"], "dataset_phases": F.array_join(ds["phases"], sep),
        "system_key": system_key(F.col("members")), "system_type": F.col("system_type"),
        "components": F.array_join(F.transform("members", preferred_name), sep),
        "component_identifiers": F.array_join(F.transform("members", compound_key), sep), "samples_json": to_json(samples),
        "data_type": F.col("category"), "property_number": p["number"], "property_group": p["group"], "property_name": p["name"],
        "property_method": p["method"], "property_phase": p["phase"],
        "property_component": F.when(p["component_id"].isNotNull(), preferred_name(_compound(p["component_id"]))),
        "property_solvent_components": F.array_join(_names(p["solvent_component_ids"]), sep), "property_presentation": p["presentation"],
        "property_reference_phase": p["reference_phase"], "property_standard_state": p["standard_state"],
        "property_definition_uncertainties_json": to_json(p["uncertainties"]), "property_repeatability_json": to_json(p["repeatability"]),
        "property_device_specifications_json": to_json(p["device_specifications"]), "value": v["value"],
        "significant_digits": v["significant_digits"], "uncertainties_json": to_json(v["uncertainties"]),
        "value_repeatability_json": to_json(v["repeatability"]), "variables_json": to_json("variables"), "constraints_json": to_json("constraints"),
    }
    return [x.alias(k) for k, x in out.items()]


ORDER = ["observation_count", "key", "doc", "pos"]


def experimental_table(matches: DataFrame) -> DataFrame:
    """54 columns, one row per selected property value, best dataset first."""
    rows = observations(matches).orderBy(F.desc("observation_count"), "key", "doc", "pos", "pt.index", "v_pos")
    return rows.select(*_columns())


def relations(matches: DataFrame) -> DataFrame:
    """Native relation rows: an observation's columns, the independent ``iv`` and the
    other conditions ``others``."""
    rows = observations(matches).select("*", F.posexplode("variables").alias("iv_pos", "iv"))
    rows = rows.where(F.array_contains("variable_numbers", F.col("iv.number")))
    others = F.concat(F.filter("variables", lambda x: x["number"] != F.col("iv.number")), F.col("constraints"))
    return rows.withColumn("others", others)


def relation_columns() -> list[Column]:
    iv = F.col("iv")
    more = {
        "number": iv["number"], "name": iv["name"], "phase": iv["phase"], "component": iv["component"],
        "solvent_components": F.array_join(iv["solvent_components"], " | "), "value": iv["value"],
        "significant_digits": iv["significant_digits"], "uncertainties_json": to_json(iv["uncertainties"]),
        "definition_uncertainties_json": to_json(iv["definition_uncertainties"]), "repeatability_json": to_json(iv["value_repeatability"]),
        "definition_repeatability_json": to_json(iv["definition_repeatability"]),
        "device_specifications_json": to_json(iv["device_specifications"]),
    }
    return [
        *_columns(), *[x.alias(f"independent_variable_{k}") for k, x in more.items()], to_json("others").alias("complementary_conditions_json")
    ]


def relation_table(matches: DataFrame) -> DataFrame:
    """67 columns, one row per selected property value and selected variable value."""
    rows = relations(matches).orderBy(F.desc("observation_count"), "key", "doc", "pos", "pt.index", "v_pos", "iv_pos")
    return rows.select(*relation_columns())


def _same(name: str, exact: tuple | None, sign):
    """Whether a condition is the column's: by name, and by meaning where that matters."""

    def test(x):
        named = x["name"] == name
        if exact is None:
            return named
        return named & (sign(x) == F.struct(*[F.lit(e).alias(n) for e, n in zip(exact, ("source", "phase", "component"), strict=True)]))

    return test


def analysis_table(rows: DataFrame) -> DataFrame:
    """Wide rows of native relations (see ``relations``): condition columns, property
    columns, nine fixed ones. A condition's name is qualified by source, phase and
    component if it has several meanings within one row; a property that has a
    condition's name keeps it, and the condition's column is marked as such. Two
    conditions that can't be told apart are an error."""
    given = lambda x, f: F.coalesce(F.nullif(x[f].cast("string"), F.lit("")), F.lit("unspecified"))
    sign = lambda x: F.struct(given(x, "source").alias("source"), given(x, "phase").alias("phase"), given(x, "component").alias("component"))
    rows = rows.withColumn("conditions", F.concat(F.array("iv"), F.col("others")))
    signed = F.transform("conditions", lambda x: F.struct(x["name"].alias("name"), sign(x).alias("sign")))
    # distinct first: what follows is judged once for each kind of row
    seen = rows.select(F.col("p.name").alias("property"), F.array_distinct(signed).alias("s")).distinct()
    entry = lambda is_property, name, many: F.struct(is_property.alias("is_property"), name.alias("name"), many.alias("many"))
    several = lambda x: F.size(F.filter("s", lambda y: y["name"] == x["name"])) > 1
    names = F.concat(
        F.array(entry(F.lit(True), F.col("property"), F.lit(False))), F.transform("s", lambda x: entry(F.lit(False), x["name"], several(x)))
    )
    # as many as there are quantity names, whatever the number of rows or components
    named = seen.select(F.explode(names).alias("x")).groupBy("x.is_property", "x.name").agg(F.max("x.many").alias("many")).collect()
    properties = sorted((r["name"] for r in named if r["is_property"]), key=lambda n: (n.casefold(), n))
    qualified = {r["name"] for r in named if r["many"]}
    found = [(r["name"], None) for r in named if not r["is_property"] and not r["many"]]
    if qualified:  # each of their signatures is a column
        signs = seen.select(F.explode("s").alias("x")).where(F.col("x.name").isin(*qualified)).select("x.name", "x.sign").distinct()
        found += [(r["name"], tuple(r["sign"])) for r in signs.collect()]
    columns: dict[str, tuple[str, tuple | None]] = {}
    for name, exact in found:
        if exact:
            source, phase, component = exact
            parts = [source] + [f"{k}={v}" for k, v in (("phase", phase), ("component", component)) if v != "unspecified"]
            columns[f"{name} [{'; '.join(parts)}]"] = name, exact
        else:
            columns[name] = name, None
    columns = {f"{k} [condition]" if k in properties else k: v for k, v in columns.items()}
    spark = rows.sparkSession
    order = [
        r[0]
        for r in spark.createDataFrame([(k,) for k in columns], "k string")
        .orderBy(condition_priority(F.col("k")), F.lower("k"), "k")
        .collect()
    ]
    out = []
    for k in order:
        name, exact = columns[k]

        hits = F.transform(F.filter("conditions", _same(name, exact, sign)), lambda x: x["value"])
        twice = F.exists(F.slice(hits, F.lit(1), F.greatest(F.size(hits) - 1, F.lit(0))), lambda x: x.isNotNull())
        out.append(F.when(twice, F.raise_error(F.lit(f"two conditions {k!r} in one row"))).otherwise(F.get(hits, F.size(hits) - 1)).alias(k))
    for n in properties:
        out.append(F.when(F.col("p.name") == n, F.col("v.value")).alias(n))
    c = F.col("citation")
    metadata = F.struct(
        F.struct("doi", *[c[f].alias(f) for f in ("title", "authors", "year", "date", "publication_name", "volume", "pages", "url")], "citation_strings").alias("publication"),
        F.struct("member", "sha256", "media_type", "related_xml_md5", "recovery", "warnings", "version").alias("source"),
        F.struct("dataset_key", *[F.col(f"ds.{f}").alias(f) for f in ("number", "purpose", "compiler", "contributor", "date_added")], system_key(F.col("members")).alias("system_key")).alias("dataset"),
        F.struct(F.transform("members", compound_key).alias("component_identifiers"), F.col("members.samples").alias("samples")).alias("system"),
        F.col("p").alias("property"), F.col("v").alias("observation"), "conditions",
    )
    tail = [
        F.col("doi"), authors_year(c["authors"], c["year"]), F.array_join(F.transform("members", preferred_name), " + "), F.col("system_type"),
        F.array_join("ds.phases", " | "), F.col("p.method"), F.col("category"), F.col("dataset_key"), to_json(metadata),
    ]
    return rows.select(*out, *[t.alias(n) for t, n in zip(tail, ANALYSIS_TAIL, strict=True)])


def concatenate(*tables: DataFrame) -> DataFrame:
    """UNION ALL of tables with the same columns in the same order."""
    if not tables:
        raise ValueError("concatenate needs a table")
    if any(t.columns != tables[0].columns for t in tables):
        raise ValueError("the tables' columns differ")
    return reduce(DataFrame.unionByName, tables)
