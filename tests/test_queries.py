"""Each registered query of the engine's own operators beside its SQL."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kelvinlake.plans import bridge, checked, tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(bridge.ORACLE_SQL | checked.ORACLE_SQL))
def test_query(spark, name):
    assert compare(spark, entry, name, SMALL) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def _renamed(rows, **fields):
    """Relations whose constraint takes other values in some fields."""
    told = lambda x: x["name"] == "Total"

    def change(x):
        out = x
        for name, value in fields.items():
            out = out.withField(name, F.when(told(x), F.lit(value)).otherwise(x[name]))
        return out

    return rows.withColumn("others", F.transform("others", change))


def test_conditions_of_one_name_are_qualified_or_refused(spark):
    relations = checked._relations(spark, SMALL)
    wide = tables.analysis_table(_renamed(relations, name="Quantity, kg"))
    assert wide.columns[:5] == ["Discount, %", "Quantity, kg [constraint]", "Quantity, kg [variable]", "price", "tax"]
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_quantity").collect()
    got = wide.where("price is not null").select("`Quantity, kg [variable]`").collect()
    assert sorted(int(r[0]) for r in got) == sorted(round(100 * r[0]) for r in lines for _ in range(2))
    with pytest.raises(Exception, match="two conditions 'Quantity, kg' in one row"):
        tables.analysis_table(_renamed(relations, name="Quantity, kg", source="variable")).collect()
