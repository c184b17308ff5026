"""No registered plan of these compares every row with every row."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", ["adjusted_rand", "correlation_matrix", "detection_by_config", "feature_bundles", "iqr_outliers", "mahalanobis_outlier", "prepare_features",
                                  "quartiles", "second_moments", "select_features", "stability_by_config"])
def test_plan_has_no_product(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
