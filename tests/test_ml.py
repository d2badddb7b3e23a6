"""Spark ML checks with tolerances: small models, real tables."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from shelfcast import config as C
from shelfcast.operators import models as M
from shelfcast.session import scratch_path
from shelfcast.sources import views as V
from shelfcast.sources.tables import Tables, load_model, load_model_table, save_model

from .conftest import SF001, SF01

SMALL = dataclasses.replace(C.DEFAULT, rf_trees=20, rf_depth=6, gbt_iters=8, fiscal_year=2000)


@pytest.fixture(scope="module")
def spoil(spark):
    return M.train_spoilage_model(V.lots(Tables(spark, SF01)), SMALL)


def test_spoilage_beats_majority_baseline(spark, spoil):
    model, test = spoil
    m = M.classification_metrics(test).collect()[0]
    p = m["support_spoil"] / m["n_test"]
    assert m["f1_score"] > 2 * p / (1 + p)  # F1 of always predicting "spoil"
    assert m["n_test"] == test.count()
    cm = M.confusion_matrix(test).collect()
    assert len(cm) == 4 and sum(r["n"] for r in cm) == m["n_test"]


def test_split_is_stratified(spark):
    lots = M.with_split(V.lots(Tables(spark, SF01)))
    rates = {r["did_spoil"]: r["f"] for r in lots.groupBy("did_spoil").agg(F.avg(F.col("is_train").cast("double")).alias("f")).collect()}
    for f in rates.values():
        assert 0.8 - 0.002 <= f <= 0.8  # a bucket at most below the cut


def test_feature_importance_and_model_io(spark, spoil):
    model, _ = spoil
    fi = M.feature_importance(model, spark).collect()
    assert [r["feature"] for r in fi][0] == "age_pct"
    assert sum(r["importance"] for r in fi) == pytest.approx(1.0)
    path = scratch_path(spark, "model")
    save_model(model, path, M.classification_metrics(spoil[1]), M.feature_importance(model, spark))
    again = load_model(path)
    assert load_model_table(spark, path, "metrics").count() == 1
    assert load_model_table(spark, path, "importances").count() == len(C.SPOILAGE_FEATURES)
    a = V.active_lots(Tables(spark, SF001), C.AS_OF, full=True)
    s1 = M.score_active_lots(model, a).orderBy("lot_id").collect()
    s2 = M.score_active_lots(again, a).orderBy("lot_id").collect()
    assert s1 == s2 and all(0 <= r["model_risk_score"] <= 100 for r in s1)


def test_demand_model_and_recursive_forecast(spark):
    dm = V.demand(Tables(spark, SF01), SMALL)
    model, test = M.train_demand_model(dm, SMALL)
    rows = M.demand_feature_rows(dm, SMALL)
    assert test.count() == rows.filter(F.col("split") == "test").count()
    assert test.filter(F.col("predicted") < 0).count() == 0
    mape = M.demand_model_mape(test).collect()
    assert len(mape) == 25 and all(r["mape"] >= 0 for r in mape)
    fc = M.generate_forecast(model, dm, SMALL)
    assert fc.count() == 125 * 14
    assert fc.filter(F.col("forecast_kg") < 0).count() == 0
    assert fc.filter(~((F.col("lower_bound") <= F.col("forecast_kg")) & (F.col("forecast_kg") <= F.col("upper_bound")))).count() == 0


def test_metrics_as_lists(spark):
    dm = V.demand(Tables(spark, SF001), SMALL)
    _, test = M.train_demand_model(dm, SMALL)
    lists = M.metrics_as_lists(test).collect()
    assert sum(len(r["test_actual"]) for r in lists) == test.count()
    assert all(len(r["test_actual"]) == len(r["test_predicted"]) for r in lists)
    rows = M.demand_feature_rows(dm, SMALL).drop("temp_c")
    assert M.available_features(rows) == [f for f in C.DEMAND_FEATURES if f != "temp_c"]
    top = M.feature_importance(M.train_spoilage_model(V.lots(Tables(spark, SF001)), SMALL)[0], spark, k=2).collect()
    assert len(top) == 2


def test_recursive_forecast_known_future(spark):
    dm = V.demand(Tables(spark, SF001), SMALL)
    model, _ = M.train_demand_model(dm, SMALL)
    a = M.recursive_forecast(model, dm, SMALL, horizon=3).collect()
    b = M.recursive_forecast(model, dm, SMALL, horizon=3, known_future=True).collect()
    assert len(a) == len(b) == 3 * dm.select("sku_id", "warehouse_id").distinct().count()
    assert all(r["_f"] >= 0 for r in a + b)
    # the calendar for the first forecast day (2001-01-01) carries the New Year Eve taper
    from shelfcast.sources.views import festival_days, festival_dim
    fd = {r["day"]: r["fest_mult"] for r in festival_days(festival_dim(spark, (2000, 2001))).collect()}
    import datetime as _dt
    assert fd[_dt.date(2001, 1, 1)] == pytest.approx(2.0 * (1 - 1 / 3 * 0.4))


def test_demand_model_with_many_skus(spark):
    """200 SKUs and 100 warehouses: more levels than a tree has bins."""
    rows = (spark.range(200 * 80).select((F.col("id") % 200).alias("s"), F.floor(F.col("id") / 200).cast("int").alias("d")))
    dm = rows.select(F.format_string("S%03d", "s").alias("sku_id"), F.format_string("W%03d", F.col("s") % 100).alias("warehouse_id"),
                     F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("date"), (10.0 + F.col("s") + F.col("d") % 7).alias("actual_demand_kg"),
                     F.lit(20.0).alias("temp_c"), F.lit(1.0).alias("festival_multiplier"), (F.col("d") % 7).alias("day_of_week"), F.lit(1).alias("month"),
                     (F.col("d") + 1).alias("day_of_year"), F.lit(0).alias("is_weekend"))
    p = dataclasses.replace(SMALL, gbt_iters=2)
    _, test = M.train_demand_model(dm, p)
    assert test.select("sku_id").distinct().count() == 200


def _lots(spark, n):
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("lot-"), i).alias("lot_id"), F.when(i % 17 > 0, (i % 3 == 0).cast("int")).alias("did_spoil"),
                                 F.when(i % 5 > 0, F.concat(F.lit("C"), i % 4)).alias("category"))


def test_split_and_weights_write_out_no_label_filter(spark):
    """The label's expression must not become a filter below the joins; lots
    without a label train nothing."""
    df = M.with_split(_lots(spark, 2000).withColumn("did_spoil", F.col("did_spoil") + F.exp(F.lit(0.0)).cast("int") * F.floor(F.log1p(F.length("lot_id") * 0.0)).cast("int")))
    out = M.balanced_weights(df.filter("is_train"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "LOG1P" in line for line in plan.splitlines())
    got = {r["did_spoil"]: (r["n"], r["w"]) for r in out.groupBy("did_spoil").agg(F.count("*").alias("n"), F.max("class_weight").alias("w")).collect()}
    assert set(got) == {0, 1} and df.filter("did_spoil is null and is_train").count() == 0
    total = sum(n for n, _ in got.values())
    assert all(w == pytest.approx(total / (2 * n)) for n, w in got.values())


def test_encoding_shuffles_no_rows_by_level(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.encoded(_lots(spark, 100), "category", "enc")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert {(r["category"], r["enc"]) for r in rows} == {(None, None), ("C0", 1.0), ("C1", 2.0), ("C2", 3.0), ("C3", 4.0)}


def test_training_rows_are_dealt(spark):
    """A frame of one partition goes over all cores, one of many small ones to few."""
    cores = spark.sparkContext.defaultParallelism
    one = _lots(spark, M.TASK_ROWS * cores).coalesce(1)
    assert M._dealt(one, M.TASK_ROWS * cores, ["lot_id"]).rdd.getNumPartitions() == cores
    assert M._dealt(_lots(spark, 100).repartition(64), 100, ["lot_id"]).rdd.getNumPartitions() == 1
