"""Wide steps run in all shuffle partitions, so that a task's memory does not grow to a core's share of the tables."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from marketlake.fixtures import fixture
from marketlake.operators import fundamentals

FACTS = "symbol string, taxonomy string, concept string, unit_pos int, form string, end_date timestamp_ntz, pos long, val double"
DAY = dt.datetime(2024, 3, 31)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("taxonomy", [True, False])
def test_facts_of_a_symbol_are_dealt_to_all_partitions_and_sorted_once(spark, taxonomy):
    rows = [(f"S{i}", "us-gaap", "Revenues", 0, "10-K", DAY, i, float(i)) for i in range(200)]
    facts = spark.createDataFrame(rows, FACTS)
    found = fundamentals.extract_facts(facts if taxonomy else facts.drop("taxonomy"))
    assert found.count() == 200
    plan = executed(found)
    assert len(re.findall(r"hashpartitioning\(symbol#\d+, \d+\), REPARTITION_BY_NUM", plan)) == 1
    assert not re.search(r"Sort \[symbol#\d+ ASC NULLS FIRST\], false", plan)  # one sort serves both windows
    assert len(re.findall(r"Sort \[symbol#\d+ ASC NULLS FIRST, metric#\d+ ASC NULLS FIRST\]", plan)) == 1


def test_choices_of_facts_are_unchanged(spark):
    rows = [
        ("A", "dei", "Revenues", 0, "10-K", DAY, 1, 1.0), ("A", "us-gaap", "Other", 0, "8-K", DAY, 2, 2.0),  # an unknown concept decides
        ("B", "dei", "Assets", 0, "10-Q", DAY, 3, 3.0), ("B", "other", "Assets", 0, "10-K", DAY, 4, 4.0),
        ("C", "us-gaap", "SalesRevenueNet", 0, "10-Q", DAY, 5, 5.0), ("C", "us-gaap", "Revenues", 1, "10-K", DAY, 6, 6.0),
        ("C", "us-gaap", "Revenues", 0, "8-K", DAY, 7, 7.0), ("C", "us-gaap", "Revenues", 2, "10-K", DAY, 8, 8.0),
        (None, "us-gaap", "Revenues", 0, "10-K", DAY, 9, 9.0), (None, "us-gaap", "Revenues", 0, "10-Q", DAY, 10, None),
    ]
    found = fundamentals.extract_facts(spark.createDataFrame(rows, FACTS))
    assert {(r.symbol, r.metric, r.val, r.form) for r in found.collect()} == {
        ("B", "total_assets", 3.0, "10-Q"), ("C", "revenue", 6.0, "10-K"), (None, "revenue", None, "10-Q")}


def test_whole_tables_are_joined_in_all_partitions(spark, tmpdir_path):
    orders = spark.range(300).select(F.col("id").alias("o_orderkey"), F.lit(dt.datetime(1995, 5, 5)).cast("timestamp_ntz").alias("o_orderdate"),
                                     F.col("id").cast("double").alias("o_totalprice"))
    orders.write.parquet(f"{tmpdir_path}/orders.parquet")
    orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).alias("l_suppkey")).write.parquet(f"{tmpdir_path}/lineitem.parquet")
    for name in ("fx_vol", "fx_fund", "fx_fin"):
        made = fixture(spark, tmpdir_path, name)
        plan = executed(made)
        assert made.count() == 7
        assert all(re.search(rf"hashpartitioning\({key}#\d+L, \d+\), REPARTITION_BY_NUM", plan) for key in ("o_orderkey", "l_orderkey"))
