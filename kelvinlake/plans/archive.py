"""Whole-archive plans: analysis, catalog, component index, query.

All of them start from one decoded table, which callers may store and reuse; a
result holds DataFrames, and counts are taken when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvinlake.errors import ComponentError
from kelvinlake.functions.text import authors_year
from kelvinlake.operators import identity, summary
from kelvinlake.operators.search import datasets, search, system_label, with_component
from kelvinlake.plans import tables
from kelvinlake.scratch import Scratch
from kelvinlake.sources import scan


@dataclass
class Archive:
    """A decoded archive: failures and recoveries beside the documents."""

    decoded: DataFrame

    @property
    def documents(self) -> DataFrame:
        return scan.documents(self.decoded)

    @property
    def datasets(self) -> DataFrame:
        return datasets(self.documents)

    @property
    def failures(self) -> DataFrame:
        return scan.failures(self.decoded)

    @property
    def recoveries(self) -> DataFrame:
        return scan.recoveries(self.decoded)

    def counters(self) -> dict[str, int]:
        row = self.decoded.agg(
            F.count(F.lit(1)).alias("scanned"), F.count("document").alias("parsed"), F.count("error").alias("failed"),
            F.count("recovery").alias("recovered"),
        ).first()
        return row.asDict()

    def index(self, scratch: Scratch | None = None) -> DataFrame:
        return identity.build_index(identity.compounds(self.documents), scratch)


def open_archive(spark, path: str, *, on_error: str = "collect", json_fallback: bool = True, prefilter=(), store: bool = True) -> Archive:
    """Reads and decodes a tar archive once; later plans read the stored result."""
    if on_error not in ("raise", "collect"):
        raise ValueError("on_error must be 'raise' or 'collect'.")
    scratch = Scratch(spark, "archive")
    bronze = scan.read_archive(spark, path)
    bronze = scratch.store(bronze, "bronze") if store else bronze
    needles = [n.encode() if isinstance(n, str) else n for n in prefilter]
    decoded = scan.decode_documents(bronze, json_fallback=json_fallback, prefilter=needles, strict=on_error == "raise")
    return Archive(scratch.store(decoded, "silver") if store else decoded)


@dataclass
class Analysis:
    totals: DataFrame
    rankings: DataFrame
    top_datasets: DataFrame
    matched_documents: int


def analyze(archive: Archive, component: str | identity.Identity | None = None, *, index: DataFrame | None = None, top_datasets: int = 10) -> Analysis:
    if top_datasets < 0:
        raise ValueError("top_datasets must not be negative.")
    sets, docs = archive.datasets, archive.documents
    if component is not None:
        known = identity.resolve(index if index is not None else archive.index(), component)
        sets = with_component(sets, known)
        docs = docs.join(sets.select(F.col("doc").alias("ordinal")).distinct(), "ordinal", "left_semi")
    size = F.aggregate("ds.points", F.lit(0).cast("long"), lambda n, p: n + F.size(p["property_values"]))
    best = (
        sets.select(
            "doi", F.col("citation.title").alias("title"), F.col("ds.number").alias("dataset_number"), system_label(F.col("members")).alias("system"),
            "system_type", size.alias("observation_count"), F.array_distinct("categories").alias("data_types"), "member",
        )
        .orderBy(F.desc("observation_count"), F.coalesce("doi", "member", F.lit("")), "dataset_number")
        .limit(top_datasets)
    )
    return Analysis(
        summary.totals(docs, sets, include_reactions=component is None), summary.rankings(sets), best, docs.count()
    )


def catalog(archive: Archive) -> DataFrame:
    return summary.catalog(archive.datasets)


@dataclass
class QueryResult:
    """Publications, most relations first; rows of the selected ones, native and flat."""

    publications: DataFrame
    relations: DataFrame
    available_publications: int
    matched_datasets: int
    resolved: list[identity.Identity]

    @property
    def table(self) -> DataFrame:
        keys = ["publication_rank", F.desc("observation_count"), "doc", "pos", "pt.index", "v_pos", "iv_pos"]
        return self.relations.orderBy(*keys).select(*tables.relation_columns())

    @property
    def analysis(self) -> DataFrame:
        return tables.analysis_table(self.relations)


def query(
    archive: Archive, *, components, independent_variable: str, required_components=None, component_match: str = "contains",
    index: DataFrame | None = None, data_category: str | None = None, property_name: str | None = None, publication_limit: int | None = None,
) -> QueryResult:
    """Relations of matching datasets. The limit on publications follows the ranking
    of all of them; rows of publications beyond it are never built."""
    if publication_limit is not None and publication_limit < 0:
        raise ValueError("publication_limit must not be negative.")
    asked = [components] if isinstance(components, str | identity.Identity) else list(components)
    if not asked:
        raise ValueError("components must name a component.")
    needed = list(required_components or ())
    if index is None:
        asked, needed = ([identity.explicit_identity(q) or q if isinstance(q, str) else q for q in qs] for qs in (asked, needed))
        if any(isinstance(q, str) for q in (*asked, *needed)):
            index = archive.index()
    matches = search(
        archive.datasets, index, components=asked, required_components=needed or None, component_match=component_match,
        property_name=property_name, data_type=data_category, independent_variable=independent_variable, ranked=False,
    )
    per_key = matches.groupBy("key").agg(
        F.sum("observation_count").alias("relations"), F.count(F.lit(1)).alias("datasets"),
        F.max_by(F.struct("doi", "citation"), F.col("doc")).alias("last"),
    )
    stored = Scratch(archive.decoded.sparkSession, "query").store(per_key, "publications")
    counts = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("datasets"), F.lit(0)).alias("d")).first()
    ranked = stored.orderBy(F.desc("relations"), "key")
    ranked = ranked if publication_limit is None else ranked.limit(publication_limit)
    publications = ranked.select(
        "key", "last.doi", F.col("last.citation.title").alias("title"), F.col("last.citation.year").alias("year"),
        authors_year(F.col("last.citation.authors"), F.col("last.citation.year")).alias("authors_year"),
        tables.publication_strings(F.col("last.citation")).alias("strings"), "relations",
    )
    chosen = ranked.select("key", F.struct((-F.col("relations")).alias("n"), "key").alias("publication_rank"))
    rows = tables.relations(matches.join(chosen, "key"))
    return QueryResult(publications, rows, counts["n"], counts["d"], identity.resolve_many(index, asked))


__all__ = ["Analysis", "Archive", "ComponentError", "QueryResult", "analyze", "catalog", "open_archive", "query"]
