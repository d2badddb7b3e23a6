"""Boosted trees per key against a plain version, and compiled ensembles
against the fitted models and against DuckDB."""

import dataclasses
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfcast import config as C
from shelfcast.operators import boosting as BO
from shelfcast.operators import models as M
from shelfcast.operators import trees as TR
from shelfcast.plans.oracle import with_base
from shelfcast.sources import views as V
from shelfcast.sources.tables import Tables

from .conftest import SF001
from .oracle_compare import duck

SMALL = dataclasses.replace(C.DEFAULT, rf_trees=7, rf_depth=5, gbt_iters=4, gbt_depth=3)


# ------------------------------------------------------------------ boosting
def plain_boosting(x, y, trees, depth, rate, bins, min_leaf=1):
    """Predictions of one key's training rows."""
    lo, hi = x.min(0), x.max(0)
    span = np.where(hi > lo, hi - lo, 1)
    b = np.where(hi > lo, np.clip(np.floor((x - lo) / span * bins), 0, bins - 1), 0).astype(int)
    r = y - y.mean()
    for _ in range(trees):
        node = np.ones(len(y), int)
        for _ in range(depth):
            nxt = 2 * node
            for n in set(node):
                at = node == n
                best = None
                for f in range(x.shape[1]):
                    for cut in sorted(set(b[at, f])):
                        left = at & (b[:, f] <= cut)
                        nl, nr = left.sum(), at.sum() - left.sum()
                        if nl < min_leaf or nr < max(1, min_leaf):
                            continue
                        sl, st = r[left].sum(), r[at].sum()
                        g = np.float32(sl * sl / nl + (st - sl) ** 2 / nr - st * st / at.sum())
                        if g > 0 and (best is None or g > best[0]):
                            best = (g, f, cut)
                if best:
                    nxt = np.where(at & (b[:, best[1]] > best[2]), 2 * node + 1, nxt)
            node = nxt
        for n in set(node):
            r = np.where(node == n, r - r[node == n].mean() * rate, r)
    return y - r


def test_boosting_per_key(spark):
    """Keys of one row, of equal rows, of a constant feature, a hot key, and a null key."""
    rng = np.random.default_rng(4)
    rows = []
    for key, n in (("hot", 400), ("small", 30), ("one", 1), (None, 5)):
        for _ in range(n):
            a, b = rng.integers(0, 20), rng.random()
            rows.append((key, float(a), float(b), 3.0, float(a * 2 + (b > 0.5) * 7 + rng.integers(0, 3))))
    rows += [("same", 1.0, 1.0, 1.0, 5.0)] * 6
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double")
    feats = ["a", "b", "c"]
    model = BO.train_boosted(df, "k", feats, "y", trees=4, depth=3, rate=0.3, bins=8, cut_every=2)
    assert {r.k: len(r.trees) for r in model.collect()} == {"hot": 4, "small": 4, "one": 4, "same": 4}
    got = BO.score_boosted(df, model, "k", feats, depth=3, bins=8).collect()
    assert len(got) == sum(r[0] is not None for r in rows)
    for key in ("hot", "small", "one", "same"):
        mine = [r for r in rows if r[0] == key]
        want = plain_boosting(np.array([r[1:4] for r in mine]), np.array([r[4] for r in mine]), 4, 3, 0.3, 8)
        assert sorted(r.prediction for r in got if r.k == key) == pytest.approx(sorted(want), abs=1e-9)
    hot = [r for r in got if r.k == "hot"]
    assert np.mean([(r.y - r.prediction) ** 2 for r in hot]) < 0.5 * np.var([r.y for r in hot])


def test_boosting_without_rows(spark):
    df = spark.createDataFrame([], "k string, a double, y double")
    assert BO.train_boosted(df, "k", ["a"], "y", trees=1, depth=1).count() == 0


def test_boosting_beats_the_mean(spark):
    """On the features of the given series, with a weekly demand of each sku's own."""
    p = dataclasses.replace(SMALL, fiscal_year=2000, sku_step=0.5)
    weekly = 20.0 + F.pmod(F.xxhash64("sku_id", "day_of_week"), F.lit(9)) * 5.0
    dm = V.demand(Tables(spark, SF001), p).withColumn("actual_demand_kg", weekly)
    own = M.train_sku_models(dm, p, trees=6)[1]
    rows = M.demand_feature_rows(dm, p)
    mean = rows.where("split = 'train'").groupBy("sku_id").agg(F.avg("actual_demand_kg").alias("predicted"))
    flat = rows.where("split = 'test'").join(mean, "sku_id").select("sku_id", F.col("actual_demand_kg").alias("actual"), "predicted")
    a, b = (M.demand_model_mape(t).agg(F.avg("mape"), F.count("*")).first() for t in (own, flat))
    assert a[0] < 0.3 * b[0] and a[1] == b[1] == 25


def test_boosting_shuffles_once_a_level(spark, monkeypatch):
    """By a number of partitions of its own, whatever the session's is; rows that are all equal included."""
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b), float(a + b)) for k in "abc" for a, b in rng.integers(0, 9, (40, 2))] + [("d", 1.0, 1.0, 2.0)] * 300
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    levels, kept = [], BO.stash

    def stash(d, name):
        if name == "boost-state":
            d.collect()
            levels.append(d._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0])  # as it ran
        return kept(d, name)

    monkeypatch.setattr(BO, "stash", stash)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        model = BO.train_boosted(df, "k", ["a", "b"], "y", trees=3, depth=2, rate=0.5, bins=8, cut_every=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(levels) == 6
    assert [p.count("Exchange hashpartitioning") for p in levels] == [1] * 6 and not any(", 37)" in p for p in levels)
    got = BO.score_boosted(df, model, "k", ["a", "b"], depth=2, bins=8).collect()
    for key in "abcd":
        mine = [r for r in rows if r[0] == key]
        want = plain_boosting(np.array([r[1:3] for r in mine]), np.array([r[3] for r in mine]), 3, 2, 0.5, 8)
        assert sorted(r.prediction for r in got if r.k == key) == pytest.approx(sorted(want), abs=1e-9)


def test_boosting_bins_a_row_once(spark):
    """A row's bins are made outside the fold over trees and nodes."""
    df = spark.createDataFrame([("a", float(i), float(i % 5)) for i in range(20)], "k string, a double, y double")
    scored = BO.score_boosted(df, BO.train_boosted(df, "k", ["a"], "y", trees=2, depth=2, bins=8), "k", ["a"], depth=2, bins=8)
    lines = [x for x in scored._jdf.queryExecution().optimizedPlan().toString().split("\n") if "lambdafunction" in x]
    assert lines and all("FLOOR" in x.split("lambdafunction", 1)[0] and "FLOOR" not in x.split("lambdafunction", 1)[1] for x in lines)


# ------------------------------------------------------------------ compiled ensembles
@pytest.fixture(scope="module")
def pooled(spark):
    dm = V.demand(Tables(spark, SF001), dataclasses.replace(SMALL, fiscal_year=2000))
    return dm, M.train_demand_model(dm, SMALL)[0]


def test_forest_as_sql(spark):
    t = Tables(spark, SF001)
    model, test = M.train_spoilage_model(V.lots(t), SMALL)
    labels, trees = TR.compile_pipeline(model, spark)
    got = TR.score_compiled(test, labels, trees, "p").select((F.abs(F.col("p") - F.col("spoil_proba"))).alias("d"), ((F.col("p") > 0.5) != (F.col("prediction") == 1)).alias("o"))
    r = got.agg(F.max("d").alias("d"), F.count_if((F.col("o"))).alias("o"), F.count("*").alias("n")).first()
    assert r.n > 500 and r.d < 1e-9 and r.o == 0
    # the same text in DuckDB scores the lots in stock
    own = ", ".join(f"{x} AS {n}" for n, x in labels.items())
    sql = with_base(f""", a AS (SELECT * REPLACE (round(least(1.0, (shelf_life_days - days_remaining) / greatest(1, shelf_life_days - floor(temp_deviation_c * 0.4))) + 1e-9, 2) AS age_pct), {own} FROM active)
        SELECT lot_id, round(({TR.sum_sql(trees)}) * 100, 1) AS s FROM a""")
    want = dict(duck(SF001).execute(sql).fetchall())
    scored = {x.lot_id: x.model_risk_score for x in M.score_active_lots(model, V.active_lots(t, C.AS_OF, full=True)).collect()}
    assert scored.keys() == want.keys() and all(abs(scored[k] - want[k]) < 0.11 for k in want)


def test_labels_as_sql(spark, pooled):
    """Quotes in a level, and a level that training did not have."""
    from pyspark.ml.feature import StringIndexer
    df = spark.createDataFrame([("it's",), ("b",), ("a",)], "c string")
    m = StringIndexer(inputCol="c", outputCol="_e", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    got = df.unionByName(spark.createDataFrame([("z",)], "c string")).selectExpr("c", f"{TR.label_sql(m)} AS e").collect()
    assert {r.c: r.e for r in got} == {"a": 0.0, "b": 1.0, "it's": 2.0, "z": 3.0}


def test_gbt_as_sql(spark, pooled):
    dm, model = pooled
    rows = model.transform(M.demand_feature_rows(dm, SMALL)).drop("sku_idx", "wh_idx")
    labels, trees = TR.compile_pipeline(model, spark)
    got = TR.score_compiled(rows, labels, trees, "p").agg(F.max(F.abs(F.col("p") - F.col("prediction"))), F.count("*")).first()
    assert got[0] < 1e-9 and got[1] > 1000


def step_by_step(predict, hist, last, temp, fests, horizon):
    out, h = [], list(hist)
    for i in range(1, horizon + 1):
        d = last + dt.timedelta(days=i)
        week = h[-7:]
        x = [h[-1], h[-2], h[-3], h[-7], h[-14], sum(week) / 7, math.sqrt(sum((v - sum(week) / 7) ** 2 for v in week) / 6), sum(h[-14:]) / 14,
             d.weekday(), d.month, d.timetuple().tm_yday, int(d.weekday() >= 5), temp, fests[i - 1]]
        h.append(max(predict(x), 0.0))
        out.append(h[-1])
    return out


def test_forecast_fold_is_step_by_step(spark, pooled):
    dm, model = pooled
    gbt = model.stages[-1]
    index = {s.getInputCol(): {v: i for i, v in enumerate(s.labels)} for s in model.stages if hasattr(s, "labels")}
    got = {}
    for r in M.recursive_forecast(model, dm, SMALL, horizon=9).collect():
        got.setdefault((r.sku_id, r.warehouse_id), []).append((r.step, r.date, r._f))
    state = M.forecast_state(dm, 9).collect()
    assert len(got) == len(state) > 100
    for s in state[:12]:
        tail = [float(index["sku_id"][s.sku_id]), float(index["warehouse_id"][s.warehouse_id])]
        want = step_by_step(lambda x: gbt.predict(Vectors.dense([*x, *tail])), s.hist, s.last_date, s.temps[0], s.fests, 9)
        mine = sorted(got[s.sku_id, s.warehouse_id])
        assert [f for _, _, f in mine] == pytest.approx(want, abs=1e-9)
        assert [d for _, d, _ in mine] == [s.last_date + dt.timedelta(days=i) for i in range(1, 10)]


def test_forecast_fold_is_one_job(spark, pooled):
    dm, model = pooled
    df = M.recursive_forecast(model, dm, SMALL, horizon=5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sku_id") <= 3 and "Scan ExistingRDD" not in plan


def test_forecast_by_sku(spark):
    p = dataclasses.replace(SMALL, fiscal_year=2000)
    dm = V.demand(Tables(spark, SF001), p)
    model, _ = M.train_sku_models(dm, p, trees=2, depth=2, bins=16)
    m = {r.sku_id: r for r in model.collect()}

    def predict(sku, x):
        r = m[sku]
        b = [max(0, min(15, math.floor((v - a) / (z - a) * 16))) if z > a else 0 for v, a, z in zip(x, r.lo, r.hi)]
        total = r.base
        for t in r.trees:
            n = 1
            for _ in range(2):
                n = 2 * n + (b[t.f[n - 1]] > t.b[n - 1])
            total += t.v[n - 4]
        return total

    got = {}
    for r in M.recursive_forecast_by_sku(model, dm, p, 2, 16, horizon=6, known_future=True).collect():
        got.setdefault((r.sku_id, r.warehouse_id), []).append((r.step, r._f))
    for s in M.forecast_state(dm, 6, known_future=True).collect()[:20]:
        h = list(s.hist)
        for i in range(6):
            want = step_by_step(lambda x: predict(s.sku_id, x), h, s.last_date + dt.timedelta(days=i), s.temps[i], s.fests[i:], 1)
            h = [*h[1:], *want]
        assert [f for _, f in sorted(got[s.sku_id, s.warehouse_id])] == pytest.approx(h[-6:], abs=1e-9)
