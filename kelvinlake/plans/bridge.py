"""Plain relational steps of the engine on the driver's tables, each with its SQL (see
``checked`` for its operators on nested documents).

Roles: an order is a document, (order, return flag) a dataset, its parts are the
components, a line is a point, extended price and tax are properties, quantity and
discount are variables, the order's total is a constraint, the line status a phase.
Amounts are exact (cents as BIGINT) and every order has a tie-break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvinlake.functions.text import authors_year, classify_property, normalize_alias, normalize_term
from kelvinlake.plans.nested import GROUPS, cents as _cents, group as _group

_GROUP_SQL = "CASE " + " ".join(f"WHEN starts_with(p_type, '{k}') THEN '{v}'" for k, v in GROUPS.items()) + " ELSE p_type END"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@_register("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents FROM lineitem WHERE l_quantity >= 25")
def scan_projection(spark, d):
    return _t(spark, d, "lineitem").where("l_quantity >= 25").select(
        "l_orderkey", "l_linenumber", "l_partkey", _cents("l_extendedprice").alias("price_cents")
    )


@_register("SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS term FROM part")
def normalized_terms(spark, d):
    return _t(spark, d, "part").select(
        "p_partkey", normalize_term(F.concat("p_type", F.lit(" / "), "p_brand")).alias("term")
    )


@_register("SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || '   ' || c_mktsegment), '\\s+', ' ', 'g')) AS alias FROM customer")
def normalized_aliases(spark, d):
    return _t(spark, d, "customer").select(
        "c_custkey", normalize_alias(F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment")).alias("alias")
    )


_CATEGORY_SQL = """CASE grp WHEN 'VolumetricProp' THEN 'volumetric' WHEN 'HeatCapacityAndDerivedProp' THEN 'caloric'
 WHEN 'TransportProp' THEN 'transport' WHEN 'Criticals' THEN 'critical property'
 WHEN 'CompositionAtPhaseEquilibrium' THEN CASE WHEN gas AND liquid THEN 'VLE' ELSE 'phase equilibrium' END ELSE grp END"""


@_register(f"""WITH x AS (SELECT l_orderkey, l_partkey, {_GROUP_SQL} AS grp, bool_or(l_linestatus = 'O') AS gas, bool_or(l_linestatus = 'F') AS liquid
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) SELECT l_orderkey, l_partkey, {_CATEGORY_SQL} AS category FROM x""")
def property_categories(spark, d):
    phase = F.when(F.col("l_linestatus") == "F", "Liquid").otherwise("Gas")
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.collect_set(phase).alias("phases"))
    part = _t(spark, d, "part").select("p_partkey", _group().alias("grp"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_partkey", classify_property(F.col("grp"), F.col("phases")).alias("category")
    )


@_register("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_unreferenced(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@_register("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 10")
def rank_publications_topk(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_orderkey").limit(10)


@_register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS relations FROM lineitem JOIN
 (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_orderkey LIMIT 10) USING (l_orderkey)""")
def publication_rows(spark, d):
    top = F.broadcast(rank_publications_topk(spark, d).withColumnRenamed("n", "relations"))  # ten rows
    return _t(spark, d, "lineitem").join(top, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "relations")


@_register("""SELECT p_name FROM (SELECT l_orderkey, p_name, count(DISTINCT p_brand) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
 GROUP BY 1 HAVING max(k) > 1""")
def ambiguous_condition_labels(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    x = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    span = x.groupBy("l_orderkey", "p_name").agg((F.min("p_brand") != F.max("p_brand")).alias("many"))
    return span.where("many").select("p_name").distinct()


@_register("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_tables(spark, d):
    a = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(_t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


_DEF = "(SELECT DISTINCT p_size AS num, min(p_retailprice) OVER (PARTITION BY p_size) AS std FROM part WHERE p_size % 2 = 0 OR p_size IS NULL)"


@_register(f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS num, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS own FROM part)
SELECT p_partkey, CAST(round(coalesce(own, std) * 100) AS BIGINT) AS std_cents FROM v LEFT JOIN {_DEF} d ON v.num IS NOT DISTINCT FROM d.num""")
def uncertainty_inherit(spark, d):
    part = _t(spark, d, "part")
    v = part.select(
        "p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("num"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("own")
    )
    defs = part.where("p_size % 2 = 0 or p_size is null").groupBy(F.col("p_size").alias("_n")).agg(F.min("p_retailprice").alias("std"))
    return v.join(defs, F.col("num").eqNullSafe(F.col("_n")), "left").select(
        "p_partkey", F.round(F.coalesce("own", "std") * 100).cast("long").alias("std_cents")
    )


@_register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_numbers(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@_register("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal >= 0)")
def dangling_refs(spark, d):
    ok = _t(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(ok, "l_suppkey", "left_anti")


@_register("SELECT lower(p_name) AS key, arg_min(p_name, p_partkey) AS spelling FROM part GROUP BY 1")
def first_spelling(spark, d):
    return _t(spark, d, "part").groupBy(F.lower("p_name").alias("key")).agg(F.min_by("p_name", "p_partkey").alias("spelling"))


@_register("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown author' WHEN o_orderkey % 4 = 1 THEN c_custkey || '' WHEN o_orderkey % 4 = 2 THEN c_custkey || ' & Roe' ELSE c_custkey || ' et al.' END
 || ' (' || year(o_orderdate) || ')' AS authors_year FROM orders JOIN customer ON o_custkey = c_custkey""")
def authors_and_year(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.col("c_custkey").cast("string"), F.lit(", J.")).alias("lead"))
    names = F.slice(F.array(F.col("lead"), F.lit("Jane Roe"), F.lit("Doe, J.[John]")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))
    return _t(spark, d, "orders").join(c, "o_custkey").select(
        "o_orderkey", authors_year(names, F.year("o_orderdate")).alias("authors_year")
    )


@_register("SELECT o_orderkey, 'customer' || year(o_orderdate) || '_' || substr(sha256('10.0000/o' || o_orderkey), 1, 8) AS bibtex_key FROM orders")
def bibtex_key(spark, d):
    digest = F.substring(F.sha2(F.concat(F.lit("10.0000/o"), "o_orderkey"), 256), 1, 8)
    return _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("customer"), F.year("o_orderdate"), F.lit("_"), digest).alias("bibtex_key"))


@_register("SELECT doc_id FROM documents WHERE contains(text, 'tion') AND contains(text, 'the ')")
def doc_prefilter(spark, d):
    raw = F.col("text").cast("binary")
    return _t(spark, d, "documents").where(F.contains(raw, F.lit(b"tion")) & F.contains(raw, F.lit(b"the "))).select("doc_id")


@_register("SELECT sha256(string_agg(CAST(n_name AS VARCHAR), chr(10) ORDER BY n_name) || chr(10)) AS digest, count(*) AS n FROM nation")
def id_census(spark, d):
    joined = F.concat(F.array_join(F.array_sort(F.collect_list("n_name")), "\n"), F.lit("\n"))
    return _t(spark, d, "nation").agg(F.sha2(joined, 256).alias("digest"), F.count(F.lit(1)).alias("n"))


@_register("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS point FROM lineitem""")
def point_numbers(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("point"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The ten publications with most rows, pivoted: rank, cut, join back, pivot."""
    top = F.broadcast(rank_publications_topk(spark, d))
    x = _t(spark, d, "lineitem").join(top, "l_orderkey").select("l_orderkey", "n", "l_returnflag", _cents("l_quantity").alias("q"))
    return x.groupBy("l_orderkey", "n").pivot("l_returnflag", ["A", "N", "R"]).sum("q").toDF("l_orderkey", "n", "quantity_a", "quantity_n", "quantity_r")
