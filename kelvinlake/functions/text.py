"""Scalar functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: property groups of the document format, normalised, and their categories
CATEGORIES = {
    "criticals": "critical property",
    "vaporpboilingtazeotroptandp": "vapor pressure and boiling",
    "phasetransition": "phase transition",
    "activityfugacityosmoticprop": "activity, fugacity, and osmotic",
    "volumetricprop": "volumetric",
    "heatcapacityandderivedprop": "caloric",
    "transportprop": "transport",
    "refractionsurfacetensionsoundspeed": "interfacial, optical, and acoustic",
    "excesspartialapparentenergyprop": "excess and partial energy",
    "reactionequilibriumprop": "reaction equilibrium",
    "reactionstatechangeprop": "reaction state change",
    "bioproperties": "biomaterial",
}
EQUILIBRIUM = "compositionatphaseequilibrium"


def fold(x: Column) -> Column:
    """Lower case with the foldings that lower() lacks (sharp s and f-ligatures)."""
    x = F.lower(x)
    for one, many in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ς", "σ")):
        x = F.replace(x, F.lit(one), F.lit(many))
    return x


def normalize_term(x: Column) -> Column:
    """Folded, with runs other than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_alias(x: Column) -> Column:
    """Folded, with white space (of any kind) collapsed."""
    return F.trim(F.regexp_replace(fold(x), r"(?U)\s+", " "))


def clean_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized_doi(doi: Column) -> Column:
    """Trimmed, without one of three resolver prefixes, in lower case; null if empty."""
    bare = F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def system_type(component_ids: Column) -> Column:
    n = F.size(F.array_distinct(component_ids))
    names = ["pure", "binary", "ternary", "quaternary"]
    out = F.when(n == 1, names[0])
    for k, name in enumerate(names[1:], 2):
        out = out.when(n == k, name)
    return out.otherwise("other")


def _bound(x: Column, f) -> Column:
    """``f(x)`` with x evaluated once: lambdas are interpreted, without shared subexpressions."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _equilibrium(seen: Column) -> Column:
    gas = F.arrays_overlap(seen, F.array(F.lit("gas"), F.lit("vapor"), F.lit("vapour")))
    liquids = F.size(F.filter(seen, lambda p: p.startswith("liquid")))
    solid = F.exists(seen, lambda p: p.startswith("solid") | (p == "crystal"))
    return (
        F.when(gas & (liquids > 0), "VLE")
        .when(solid & (liquids > 0), "SLE")
        .when(liquids >= 2, "LLE")
        .otherwise("phase equilibrium")
    )


def classify_property(group: Column, phases: Column) -> Column:
    """Category of a property group; phase equilibria by the phases (array of strings)."""
    known = F.create_map(*[F.lit(x) for pair in (CATEGORIES | {EQUILIBRIUM: ""}).items() for x in pair])
    seen = F.array_distinct(F.transform(F.array_compact(phases), normalize_term))
    return _bound(
        F.try_element_at(known, normalize_term(group)),
        lambda found: F.when(found == "", _bound(seen, _equilibrium)).otherwise(F.coalesce(found, group)),
    )


def stable_identifier(inchikey: Column, inchi: Column, cas: Column, name: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("inchikey:"), F.upper(inchikey)),
        F.concat(F.lit("inchi:"), inchi),
        F.concat(F.lit("cas:"), cas),
        F.concat(F.lit("name:"), fold(name)),
    )


def condition_priority(label: Column) -> Column:
    """Order of condition columns: temperature, pressure, composition, others."""
    low = fold(label)
    return (
        F.when(low.contains("temperature"), 0)
        .when(low.contains("pressure"), 1)
        .when(low.contains("fraction") | low.contains("composition") | low.contains("molality"), 2)
        .otherwise(3)
    )


def author_last_name(author: Column) -> Column:
    raw = F.trim(author)
    name = F.when(raw.contains(","), F.trim(F.substring_index(raw, ",", 1))).otherwise(F.regexp_extract(raw, r"(\S+)$", 1))
    return F.when(name == "", "Unknown").otherwise(name)


def authors_year(authors: Column, year: Column) -> Column:
    """"Last (2020)", "A & B (2020)", "A et al. (n.d.)" or "Unknown author (...)"."""
    last = F.transform(F.filter(authors, lambda a: F.trim(a) != ""), author_last_name)
    date = F.coalesce(year.cast("string"), F.lit("n.d."))
    n = F.coalesce(F.size(last), F.lit(0))
    names = (
        F.when(n <= 0, "Unknown author")
        .when(n == 1, F.get(last, F.lit(0)))
        .when(n == 2, F.concat(F.get(last, F.lit(0)), F.lit(" & "), F.get(last, F.lit(1))))
        .otherwise(F.concat(F.get(last, F.lit(0)), F.lit(" et al.")))
    )
    return F.concat(names, F.lit(" ("), date, F.lit(")"))
