"""The forest grown from histograms against Spark ML's and against plain counts."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shelfcast import config as C
from shelfcast.operators import boosting as BO
from shelfcast.operators import forest as FO
from shelfcast.operators import models as M

NAMES = ["a", "b", "c", "d"]


def _rows(spark, n):
    """Numbers of few and of many values (the latter beyond LEVELS), with nulls
    and a NaN; the class hangs on two of them."""
    u = [F.pmod(F.xxhash64(F.lit(i), F.col("id")), F.lit(1 << 20)) / float(1 << 20) for i in range(6)]
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.floor(u[0] * 4).alias("a"), u[1].alias("b"),
                               F.floor(u[2] * 60).cast("double").alias("c"), F.lit(1).alias("d"), u[3].alias("_u"), F.col("id"))
    y = (F.col("_u") < 0.1 + 0.2 * F.col("a") + F.when(F.col("b") > 0.7, 0.2).otherwise(0.0)).cast("int")
    df = df.withColumn("y", y).withColumn("w", F.when(y == 1, 1.5).otherwise(0.75)).drop("_u")
    return (df.withColumn("c", F.when(F.col("id") % 1000 == 7, None).when(F.col("id") == 8, float("nan")).otherwise(F.col("c"))).drop("id"))


def _estimator(**kw):
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", seed=42, **{"numTrees": 20, "maxDepth": 4, "minInstancesPerNode": 5, **kw})


def test_cuts():
    assert FO.cuts_of([(1.0, 2.0), (3.0, 1.0), (1.0, 1.0)], 32) == [2.0]
    assert FO.cuts_of([(5.0, 1.0)], 32) == []
    got = FO.cuts_of([(float(v), 1.0) for v in range(64)], 32)
    assert len(got) == 31 and got[0] == 1.5 and got[-1] == 61.5


def test_best_split_is_that_of_all_splits():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, (3, 2, 32, 2)).astype(float)
    counts[:, 1] = counts[:, 0][:, rng.permutation(32)]  # every feature has the same rows
    counts[2] = 0
    chosen, weights, n_cuts = np.array([[0, 1]] * 3), np.array([0.5, 2.0]), np.array([31, 31])

    def gini(s):
        return 1 - sum((x / sum(s)) ** 2 for x in s)

    found = FO.best_splits(counts, chosen, weights, n_cuts, 5)
    assert [r[0] for r in found] == [0, 1]
    for node, feature, cut, gain, here, left, right in found:
        gains = {}
        for j in range(2):
            for b in range(31):
                lo, hi = counts[node, j, :b + 1].sum(axis=0), counts[node, j, b + 1:].sum(axis=0)
                if min(lo.sum(), hi.sum()) >= 5:
                    parts = [(s * weights) for s in (lo + hi, lo, hi)]
                    gains[j, b] = gini(parts[0]) - sum(p.sum() * gini(p) for p in parts[1:]) / parts[0].sum()
        assert gain == pytest.approx(max(gains.values())) and gains[feature, cut] == pytest.approx(gain)
        assert (np.array(left) + right).tolist() == here


def test_bags_are_poisson():
    table = FO._bag_table()
    share = np.bincount(table, minlength=8) / len(table)
    assert share[:5] == pytest.approx([math.exp(-1) / math.factorial(i) for i in range(5)], abs=1e-4)


def test_blocks_hold_every_row_and_hang_on_no_layout(spark):
    df = _rows(spark, 30_000).where("c is not null and not isnan(c)")
    cuts, weights = FO.feature_cuts(df, NAMES, "y", "w", 32)
    assert [len(c) for c in cuts] == [3, 31, 31, 0] and weights == {0: 0.75, 1: 1.5}
    was, FO.BLOCK_ROWS = FO.BLOCK_ROWS, 4_000
    try:
        got = [sorted((r.block, bytes(r.rows)) for r in FO.packed_blocks(f, NAMES, "y", "key", cuts, 30_000).collect()) for f in (df, df.repartition(3))]
    finally:
        FO.BLOCK_ROWS = was
    assert got[0] == got[1] and len(got[0]) > 1
    x = np.frombuffer(b"".join(b for _, b in got[0]), np.uint8).reshape(-1, 5)
    assert len(x) == df.count() and int(x[:, 4].sum()) == df.where("y = 1").count()
    a = {r["a"]: r["count"] for r in df.groupBy("a").count().collect()}
    assert np.bincount(x[:, 0]).tolist() == [a[i] for i in range(4)]


def test_forest_is_as_good_as_spark_mls(spark):
    df = BO.stash(_rows(spark, 40_000), "forest-test")
    ready = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="skip").transform(df)
    est = _estimator()
    theirs, ours = est.fit(ready), FO.fit_forest(est, df, NAMES, "key", 40_000)
    assert ours.getNumTrees == 20 and ours.numFeatures == 4 and ours.getOrDefault("maxDepth") == 4
    assert max(t.depth for t in ours.trees) == 4
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)
    p = [{r["key"]: r["p"] for r in m.transform(ready).select("key", M.vector_to_array("probability")[1].alias("p")).collect()} for m in (theirs, ours)]
    assert p[0].keys() == p[1].keys()
    assert np.mean([abs(p[0][k] - p[1][k]) for k in p[0]]) < 0.03
    assert all(t.numNodes > 3 for t in ours.trees)


def test_classes_apart_and_none_to_split(spark):
    """Pure children are leaves; without a split a tree is its root."""
    df = spark.range(400).select(F.col("id").cast("string").alias("key"), (F.col("id") % 2).cast("double").alias("a"),
                                 (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("w"), F.lit(0.0).alias("b"))
    m = FO.fit_forest(_estimator(numTrees=5), df, ["a"], "key", 400)
    assert [t.numNodes for t in m.trees] == [3] * 5
    m = FO.fit_forest(_estimator(numTrees=5), df, ["b"], "key", 400)
    assert [t.numNodes for t in m.trees] == [1] * 5


def test_many_lots_leave_spark_mls_forest(spark, monkeypatch):
    """Above FOREST_ROWS lots no job of Spark ML's forest visits the training rows."""
    i = F.col("id")
    lots = spark.range(4_000).select(
        F.concat(F.lit("lot-"), i).alias("lot_id"), F.concat(F.lit("C"), i % 3).alias("category"), F.concat(F.lit("W"), i % 2).alias("warehouse_id"),
        ((i % 100) / 100 > 0.5).cast("int").alias("did_spoil"), ((i % 100) / 100).alias("age_pct"), (i % 4).cast("int").alias("temp_deviation_c"),
        F.lit(1.2).alias("over_order_factor"), (i % 50).cast("double").alias("quantity_kg"), (2 + i % 14).cast("int").alias("shelf_life_days"),
        (20.0 + i % 25).alias("price_per_kg"))
    fitted = []
    fit = RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    monkeypatch.setattr(M, "FOREST_ROWS", 3_000)
    model, test = M.train_spoilage_model(lots, C.DEFAULT)
    assert fitted == [2] and len(model.stages[-1].trees) == C.DEFAULT.rf_trees
    got = M.classification_metrics(test).collect()[0]
    assert got["n_test"] == test.count() > 700 and got["accuracy"] > 0.97
    assert M.feature_importance(model, spark).first()["feature"] == "age_pct"
