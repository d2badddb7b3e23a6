"""Plan guards for every batch catalog key (sf0.001, plans only, not run):
no nested-loop or Cartesian join, and every scan of the fact table reads a
pruned column set."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF001

MODEL_KEYS = {"spoilage_model_metrics", "confusion_matrix", "feature_importance", "demand_model_mape",
              "actual_vs_predicted", "recursive_forecast", "score_active_lots",
              "sku_model_mape", "sku_model_forecast", "sku_small_model_mape", "sku_small_model_forecast"}
KEYS = sorted(k for k in E.queries() if k not in MODEL_KEYS and not k.startswith(("stream_", "op")) and k != "pipeline")


#: read no warehouse column, so supplier is not scanned
NO_SUPPLIER = ["wastage_kpi", "wastage_by_category", "wastage_by_month", "wastage_by_sku", "wastage_rollup", "over_ordering_by_category",
               "lot_freshness", "lot_financials", "spoilage_probability", "lot_risk_score", "d_supplier_degradation"]


def _scans(df, table) -> int:
    """Scans of a table in the plan, reused exchanges counted once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"Relation \[[^\]]*{table}[^\]]*\] parquet", plan))


@pytest.mark.parametrize("key", NO_SUPPLIER)
def test_no_supplier_scan(spark, key):
    assert _scans(E.queries()[key](spark, SF001), "s_suppkey") == 0


def test_one_fact_scan(spark):
    q = E.queries()
    assert _scans(q["rule_confusion"](spark, SF001), "l_orderkey") == 1
    # the split needs the counts of the buckets before it can mark a row
    assert _scans(q["d_target_encoding"](spark, SF001), "l_orderkey") == 2


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_plan_guards(spark, key):
    plan = _plan(E.queries()[key](spark, SF001))
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), key
    for schema in re.findall(r"FileScan parquet [^\n]*lineitem\.parquet[^\n]*ReadSchema: (struct<[^>]*>)", plan):
        assert "l_comment" not in schema and "l_shipinstruct" not in schema, (key, schema)
