"""Registered queries that run the engine's operators on documents made of the driver's
tables (see ``nested``), each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.operators import identity, search, summary
from kelvinlake.operators.components import components
from kelvinlake.operators.identity import Identity
from kelvinlake.plans import tables
from kelvinlake.plans.nested import GROUPS, documents
from kelvinlake.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str):
    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return search.datasets(documents(spark, d))


def _brand(n: int) -> Identity:
    return Identity(f"Brand#{n}", {"common": (f"Brand#{n}",)})


def _keys(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("doc").alias("l_orderkey"), F.col("ds.purpose").alias("l_returnflag"), *more)


_MAKER = "'Maker#' || substr(p_brand, 7, 1)"
_GROUP = "CASE " + " ".join(f"WHEN starts_with(p_type, '{k}') THEN '{v}'" for k, v in GROUPS.items()) + " ELSE p_type END"
_CATEGORY = """CASE grp WHEN 'VolumetricProp' THEN 'volumetric' WHEN 'HeatCapacityAndDerivedProp' THEN 'caloric'
 WHEN 'TransportProp' THEN 'transport' WHEN 'Criticals' THEN 'critical property'
 WHEN 'CompositionAtPhaseEquilibrium' THEN CASE WHEN gas AND liquid THEN 'VLE' ELSE 'phase equilibrium' END ELSE grp END"""
# lines with their part, and what holds for their dataset
_LINES = f"""x AS (SELECT *, {_GROUP} AS grp, {_MAKER} AS maker FROM lineitem JOIN part ON l_partkey = p_partkey),
flags AS (SELECT l_orderkey, l_returnflag, bool_or(l_linestatus <> 'F') AS gas, bool_or(l_linestatus = 'F') AS liquid, count(DISTINCT p_brand) AS k, count(*) AS n,
 string_agg(DISTINCT p_brand, ' + ' ORDER BY p_brand) AS system,
 array_to_string(['Brand#' || b for b in list_sort(list(DISTINCT CAST(substr(p_brand, 7) AS INT)))], ' + ') AS members FROM x GROUP BY 1, 2),
lines AS (SELECT x.*, {_CATEGORY} AS category, k, n, system, members,
 CASE k WHEN 1 THEN 'pure' WHEN 2 THEN 'binary' WHEN 3 THEN 'ternary' WHEN 4 THEN 'quaternary' ELSE 'other' END AS system_type
 FROM x JOIN flags USING (l_orderkey, l_returnflag))"""
_MATCH = f"WITH {_LINES} SELECT l_orderkey, l_returnflag, 2 * count(*) AS observations FROM lines GROUP BY 1, 2 HAVING "
_HAS = "bool_or(p_brand = 'Brand#{}')"


def _matched(spark, d, **asked) -> DataFrame:
    return _keys(search.search(_sets(spark, d), ranked=False, **asked), F.col("observation_count").alias("observations"))


@_register(_MATCH + f"{_HAS.format(11)} AND {_HAS.format(22)}")
def match_contains(spark, d):
    return _matched(spark, d, components=[_brand(11), _brand(22)])


@_register(_MATCH + f"{_HAS.format(11)} AND {_HAS.format(22)} AND min(k) = 2")
def match_exact(spark, d):
    return _matched(spark, d, components=[_brand(11), _brand(22)], component_match="exact")


@_register(_MATCH + f"{_HAS.format(11)} AND {_HAS.format(22)} AND min(k) = 2")
def match_system(spark, d):
    return _matched(spark, d, system=[_brand(22), _brand(11)])


_POOL = (11, 22, 33, 44)
_IN_POOL = f"bool_and(p_brand IN ({', '.join(f"'Brand#{n}'" for n in _POOL)}))"


@_register(_MATCH + _IN_POOL)
def match_within(spark, d):
    return _matched(spark, d, components=[*map(_brand, _POOL)], component_match="within")


@_register(_MATCH + f"{_IN_POOL} AND {_HAS.format(11)}")
def within_required(spark, d):
    return _matched(spark, d, components=[*map(_brand, _POOL)], component_match="within", required_components=[_brand(11)])


@_register(f"WITH {_LINES} SELECT l_orderkey, l_returnflag, count(*) AS observations FROM lines GROUP BY 1, 2")
def name_substring(spark, d):
    return _matched(spark, d, property_name="PRI")


@_register(f"WITH {_LINES} SELECT l_orderkey, l_returnflag, 2 * count(*) AS observations FROM lines WHERE category = 'VLE' GROUP BY 1, 2")
def category_equality(spark, d):
    return _matched(spark, d, data_type="vle")


@_register(f"WITH {_LINES} SELECT l_orderkey, l_returnflag, 2 * count(*) AS observations FROM lines WHERE grp = 'TransportProp' GROUP BY 1, 2")
def group_equality(spark, d):
    return _matched(spark, d, data_type="TransportProp", independent_variable="quantity, KG")


@_register(f"WITH {_LINES} SELECT l_orderkey, l_returnflag, 4 * count(*) AS observations FROM lines GROUP BY 1, 2")
def variable_substring(spark, d):
    return _matched(spark, d, independent_variable="t")


@_register(f"WITH {_LINES} SELECT DISTINCT l_orderkey, l_returnflag FROM lines WHERE p_brand = 'Brand#11'")
def semi_component_datasets(spark, d):
    return _keys(search.with_component(_sets(spark, d), _brand(11)))


@_register(f"""WITH {_LINES} SELECT l_orderkey, l_returnflag, 2 * count(*) AS observations FROM lines GROUP BY 1, 2
 ORDER BY observations DESC, '10.0000/o' || l_orderkey, ascii(l_returnflag) LIMIT 25""")
def rank_datasets_topk(spark, d):
    return _keys(search.search(_sets(spark, d), limit=25), F.col("observation_count").alias("observations"))


@_register(f"WITH {_LINES} SELECT DISTINCT l_orderkey, l_returnflag, system_type, system AS label FROM lines")
def system_types(spark, d):
    return _keys(_sets(spark, d), "system_type", search.system_label(F.col("members")).alias("label"))


@_register(f"""WITH {_LINES} SELECT l_orderkey, '10.0000/o' || l_orderkey || '#pure-or-mixture-' || ascii(l_returnflag) AS dataset_key,
 string_agg(DISTINCT 'cas:' || maker, ' | ' ORDER BY 'cas:' || maker) AS system_key FROM lines GROUP BY l_orderkey, l_returnflag""")
def system_keys(spark, d):
    return _sets(spark, d).select(F.col("doc").alias("l_orderkey"), "dataset_key", search.system_key(F.col("members")).alias("system_key"))


@_register("""SELECT count(DISTINCT l_orderkey) AS documents, count(DISTINCT (l_orderkey, l_returnflag)) AS datasets, count(*) AS data_points,
 2 * count(*) AS observations, CAST(0 AS BIGINT) AS reaction_datasets FROM lineitem""")
def summary_totals(spark, d):
    docs = documents(spark, d)
    return summary.totals(docs, search.datasets(docs))


@_register(f"""WITH {_LINES}, members AS (SELECT l_orderkey, l_returnflag, p_brand, any_value(n) AS n FROM lines GROUP BY 1, 2, 3)
SELECT field, label, CAST(sum(c) AS BIGINT) AS count FROM (
 SELECT 'system_types' AS field, system_type AS label, 2 AS c FROM lines UNION ALL SELECT 'data_types', category, 2 FROM lines
 UNION ALL SELECT 'property_groups', grp, 2 FROM lines UNION ALL SELECT 'properties', 'price', 1 FROM lines UNION ALL SELECT 'properties', 'tax', 1 FROM lines
 UNION ALL SELECT 'systems', system, 2 FROM lines UNION ALL SELECT 'methods', 'listed', 1 FROM lines
 UNION ALL SELECT 'publications', '10.0000/o' || l_orderkey, 2 FROM lines UNION ALL SELECT 'components', p_brand, 2 * n FROM members
 UNION ALL SELECT 'dataset_system_types', any_value(system_type), 1 FROM lines GROUP BY l_orderkey, l_returnflag) GROUP BY 1, 2""")
def ranking_fields(spark, d):
    return summary.rankings(_sets(spark, d))


_CATALOG = f"""WITH {_LINES} SELECT category, property, variable, count(*) AS relations, count(DISTINCT (l_orderkey, l_returnflag)) AS datasets,
 count(DISTINCT l_orderkey) AS publications FROM lines, (VALUES ('price'), ('tax')) p(property), (VALUES ('Quantity, kg'), ('Discount, %')) v(variable) GROUP BY 1, 2, 3"""


@_register(_CATALOG)
def catalog(spark, d):
    return summary.catalog(_sets(spark, d))


@_register(f"SELECT category, CAST(sum(relations) AS BIGINT) AS relations FROM ({_CATALOG}) GROUP BY 1")
def catalog_categories(spark, d):
    return summary.catalog_categories(catalog(spark, d))


@_register(f"SELECT property, CAST(sum(relations) AS BIGINT) AS relations FROM ({_CATALOG}) WHERE category = 'volumetric' GROUP BY 1")
def catalog_properties(spark, d):
    return summary.catalog_properties(catalog(spark, d), "Volumetric")


@_register(f"SELECT variable, CAST(sum(relations) AS BIGINT) AS relations FROM ({_CATALOG}) WHERE category = 'VLE' AND contains(property, 'pri') GROUP BY 1")
def catalog_variables(spark, d):
    return summary.catalog_variables(catalog(spark, d), "vle", "PRI")


_VALUE = "CASE {} WHEN 'price' THEN l_extendedprice WHEN 'tax' THEN l_tax WHEN 'Quantity, kg' THEN l_quantity ELSE l_discount END"
_CENTS = "CAST(CAST(round({} * 100) AS BIGINT) AS VARCHAR)"
_PROPERTIES = "(VALUES ('price'), ('tax')) p(property)"


@_register(f"SELECT l_orderkey, l_linenumber, property, {_CENTS.format(_VALUE.format('property'))} AS value FROM lineitem, {_PROPERTIES}")
def observation_long(spark, d):
    rows = tables.observations(search.search(_sets(spark, d), ranked=False))
    return rows.select(F.col("doc").alias("l_orderkey"), F.col("pt.index").alias("l_linenumber"), F.col("p.name").alias("property"), F.col("v.value").alias("value"))


_RELATION = f"""SELECT l_orderkey, l_linenumber, property, variable, {_CENTS.format(_VALUE.format('property'))} AS y, {_CENTS.format(_VALUE.format('variable'))} AS x,
 {_CENTS.format("CASE variable WHEN 'Discount, %' THEN l_quantity ELSE l_discount END")} AS other, {_CENTS.format('o_totalprice')} AS fixed
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey, {_PROPERTIES}, (VALUES ('Quantity, kg'), ('Discount, %')) v(variable)"""


def _relations(spark, d) -> DataFrame:
    return tables.relations(search.search(_sets(spark, d), independent_variable="t", ranked=False))


def _related(rows: DataFrame, *more) -> DataFrame:
    first = [F.col("doc").alias("l_orderkey"), F.col("pt.index").alias("l_linenumber"), F.col("p.name").alias("property"), F.col("iv.name").alias("variable")]
    return rows.select(*first, *more)


@_register(f"SELECT l_orderkey, l_linenumber, property, variable, y, x FROM ({_RELATION})")
def property_relation(spark, d):
    return _related(_relations(spark, d), F.col("v.value").alias("y"), F.col("iv.value").alias("x"))


@_register(f"SELECT l_orderkey, l_linenumber, property, variable, other, fixed FROM ({_RELATION})")
def complementary_conditions(spark, d):
    others = F.col("others")
    return _related(_relations(spark, d), F.get(others, F.lit(0))["value"].alias("other"), F.get(others, F.lit(1))["value"].alias("fixed"))


@_register(f"""WITH {_LINES} SELECT '10.0000/o' || l_orderkey AS doi, {_CENTS.format('l_quantity')} AS quantity, {_CENTS.format('l_discount')} AS discount,
 {_CENTS.format('o_totalprice')} AS total, CASE property WHEN 'price' THEN {_CENTS.format('l_extendedprice')} END AS price,
 CASE property WHEN 'tax' THEN {_CENTS.format('l_tax')} END AS tax, members AS system, system_type, category
 FROM lines JOIN orders ON l_orderkey = o_orderkey, {_PROPERTIES}""")
def analysis_pivot(spark, d):
    matches = search.search(_sets(spark, d), independent_variable="quantity", ranked=False)
    names = {
        "DOI": "doi", "Quantity, kg": "quantity", "Discount, %": "discount", "Total": "total", "price": "price", "tax": "tax",
        "System": "system", "System Type": "system_type", "Data Category": "category",
    }
    wide = tables.analysis_table(tables.relations(matches))
    return wide.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


_BRANDS = f"(SELECT DISTINCT p_brand, {_MAKER} AS maker FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _index(spark, d) -> DataFrame:
    return identity.build_index(identity.compounds(documents(spark, d)))


@_register(f"""SELECT 'cas:' || maker AS stable_id, min(p_brand) AS preferred_name, string_agg(p_brand, '|' ORDER BY p_brand) AS names FROM {_BRANDS} GROUP BY maker""")
def identity_index(spark, d):
    return _index(spark, d).select("stable_id", "preferred_name", F.array_join("common_names", "|").alias("names"))


_ALIASES = f"""SELECT kind, lower(p_brand) AS alias, 'cas:' || maker AS stable_id FROM {_BRANDS}, (VALUES ('common'), ('name'), ('auto')) k(kind)
 UNION SELECT kind, lower(maker), 'cas:' || maker FROM {_BRANDS}, (VALUES ('cas'), ('auto')) k(kind)"""


@_register(_ALIASES)
def alias_lookup(spark, d):
    return identity.aliases(_index(spark, d))


# each type of part as a compound whose formula is the type and whose name is its first word: such a name is ambiguous
_TYPES = "(SELECT DISTINCT p_type, split_part(p_type, ' ', 1) AS name FROM part)"


@_register(f"SELECT lower(name) AS alias, count(*) AS identities FROM {_TYPES} GROUP BY 1 HAVING count(*) > 1")
def ambiguous_aliases(spark, d):
    types = spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct()
    none = lambda k: F.lit(None).cast(k)
    compound = F.struct(
        F.lit(1).alias("local_id"), F.array(F.substring_index("p_type", " ", 1)).alias("common_names"), none("string").alias("iupac_name"),
        none("string").alias("cas_name"), F.col("p_type").alias("formula"), none("string").alias("standard_inchi"),
        F.concat(F.lit("KEY "), "p_type").alias("standard_inchi_key"), none("string").alias("cas_registry_number"),
    )
    rows = types.select(F.xxhash64("p_type").alias("doc"), F.lit(0).alias("pos"), compound.alias("c"))
    found = identity.aliases(identity.build_index(rows)).where("kind = 'common'")
    return found.groupBy("alias").agg(F.count(F.lit(1)).alias("identities")).where("identities > 1")


@_register("""WITH q AS (SELECT * FROM (VALUES ('Brand#11', 'none'), (NULL, 'small'), ('Brand#22', 'promo')) q(strong, name)),
x AS (SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_brand END AS strong, split_part(lower(p_type), ' ', 1) AS name FROM part)
SELECT p_partkey, count(*) FILTER (CASE WHEN x.strong IS NOT NULL AND q.strong IS NOT NULL THEN x.strong = q.strong
 ELSE x.name = q.name OR coalesce(lower(x.strong) = lower(q.strong), false) END) AS matched FROM x, q GROUP BY p_partkey""")
def strong_identity_match(spark, d):
    asked = [Identity("a", {"cas": ("Brand#11",), "common": ("none",)}), Identity("b", {"common": ("small",)}), Identity("c", {"cas": ("Brand#22",), "common": ("promo",)})]
    strong = F.when(F.col("p_size") <= 25, F.lower("p_brand"))
    tokens = F.array_compact(F.array(F.concat(F.lit("cas:"), strong)))
    names = F.array_compact(F.array(F.lower(F.substring_index("p_type", " ", 1)), strong))
    x = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tokens.alias("tokens"), names.alias("names"))
    hits = [i.matches(F.col("tokens"), F.col("names")).cast("long") for i in asked]
    return x.select("p_partkey", (hits[0] + hits[1] + hits[2]).alias("matched"))


@_register("""WITH n AS (SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT c_nationkey AS node, c_nationkey AS root FROM n UNION SELECT DISTINCT 1000 + c_custkey, c_nationkey FROM n
UNION ALL SELECT -1 - o_orderkey + 2000000000000, c_nationkey FROM n""")
def identity_components(spark, d):
    """Orders, their customers and those customers' nations: chains and stars over whole tables."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey").join(orders.select("c_custkey").distinct(), "c_custkey")
    far = orders.select((F.lit(1999999999999) - F.col("o_orderkey")).alias("a"), (F.col("c_custkey") + 1000).cast("long").alias("b"))
    near = customers.select((F.col("c_custkey") + 1000).cast("long").alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    return components(far.unionByName(near), Scratch(spark, "identity"))
