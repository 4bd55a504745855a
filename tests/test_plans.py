"""Plans: columns and filters reach the scans, and nothing is paired or run in Python where expressions do."""

import re

import pytest

from tessella.plans import catalog
from tessella.plans.oracle import ORACLE


def plan(spark, sf, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark, sf):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, sf, "class_means_long"))[1]
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_discount", "l_extendedprice", "l_quantity", "l_returnflag", "l_tax"]


def test_filters_are_pushed_down(spark, sf):
    text = plan(spark, sf, "filter_conjunction")
    assert "GreaterThan(o_totalprice,100000.0)" in text and "EqualTo(o_orderstatus,O)" in text
    assert "In(c_mktsegment" in plan(spark, sf, "filter_isin")


@pytest.mark.parametrize("name", ["class_means_long", "corr_matrix_lower", "column_info", "null_profile", "confusion_matrix"])
def test_one_aggregation_makes_a_profile(spark, sf, name):
    assert plan(spark, sf, name).count("FileScan") == (2 if name == "confusion_matrix" else 1)


def test_no_python_in_expression_queries(spark, sf):
    in_python = ("knn", "grid", "scan_", "jsonl", "tree_shap", "kernel_shap", "generated_texts")  # files, distances, Shapley values and a client
    free = [n for n in ORACLE if not n.startswith(in_python)]
    for name in free:
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan(spark, sf, name)), name
