"""Bucketed layout: no exchange in the part join, pruned months; kept states
equal a full rebuild after any number of increments."""

import datetime as dt
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import kpis as K
from shelfcast.session import scratch_path
from shelfcast.sources import layout as LA
from shelfcast.sources import views as V
from shelfcast.sources.tables import Tables

from .conftest import SF001


@pytest.fixture(scope="module")
def laid(spark):
    name = f"laid_{uuid.uuid4().hex[:8]}"
    LA.write_layout(Tables(spark, SF001), name, 4)
    yield LA.LaidOut(spark, SF001, name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_part_join_without_exchange(spark, laid):
    conf = {"shelfcast.broadcast.maxRows": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = plan_of(V.lines(laid, warehouse=False).groupBy("sku_id").agg(F.sum("l_quantity")))
        flat = plan_of(V.lines(Tables(spark, SF001), warehouse=False).groupBy("sku_id").agg(F.sum("l_quantity")))
        got = V.lines(laid, warehouse=False).groupBy("sku_id").agg(F.sum("l_quantity").alias("q")).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning\([lp]_partkey", plan) and "Bucketed: true" in plan
    assert re.search(r"Exchange hashpartitioning\(l_partkey", flat)
    want = V.lines(Tables(spark, SF001), warehouse=False).groupBy("sku_id").agg(F.sum("l_quantity").alias("q")).collect()
    assert sorted(got) == sorted(want)


def test_months_are_pruned(spark, laid):
    lots = V.lots(laid, dt.date(2000, 3, 5), dt.date(2000, 5, 1))
    assert re.search(r"PartitionFilters: \[[^\]]*ship_month#\d+ >= 200003[^\]]*ship_month#\d+ <= 200004", plan_of(lots))
    want = V.lots(Tables(spark, SF001), dt.date(2000, 3, 5), dt.date(2000, 5, 1))
    cols = lots.columns
    assert sorted(lots.select(*cols).collect()) == sorted(want.select(*cols).collect()) and lots.count() > 0


def test_views_equal(spark, laid):
    a, b = (K.wastage_by_category(V.lots(t)).orderBy("category").collect() for t in (laid, Tables(spark, SF001)))
    assert a == b
    assert V.demand(laid).count() == V.demand(Tables(spark, SF001)).count()


def test_buckets():
    assert LA.buckets_for(100 << 40, 84) == 4876 and LA.buckets_for(1, 84) == 1


def test_table_if_absent(spark):
    name, calls = f"t_{uuid.uuid4().hex[:8]}", []

    def build():
        calls.append(1)
        return spark.range(3)

    assert LA.table_if_absent(spark, name, build).count() == LA.table_if_absent(spark, name, build).count() == 3 and len(calls) == 1
    spark.sql(f"DROP TABLE {name}")


def test_kept_states(spark):
    """Three increments, a repeated update, a broken one, a compaction."""
    t, folder = Tables(spark, SF001), scratch_path(spark, "increments")
    daily, totals = (f(spark, scratch_path(spark, "kept")) for f in (LA.daily_state, LA.series_totals))
    assert daily.read() is None
    for k in range(3):
        t.lineitem.where(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(folder)
        assert daily.update(folder, LA.daily_of(t)) == totals.update(folder, LA.totals_of(t)) == 1
        assert daily.update(folder, LA.daily_of(t)) == 0
        if k == 1:
            daily.compact()
            assert len(daily.deltas()) == 1
    os.makedirs(f"{daily.path}/00000099-new-broken/state".removeprefix("file:"))  # no marker: not there
    whole = spark.read.parquet(folder)
    for state, build in ((daily, LA.daily_of(t)), (totals, LA.totals_of(t))):
        cols = [*state.keys, *state.merge]
        got, want = (sorted(map(tuple, df.select(*cols).collect())) for df in (state.read(), build(whole)))
        assert got == want and got
    assert daily.read().agg(F.sum("n_lines")).first()[0] == t.lineitem.count()
    facts = V.demand_facts(t).select("date", "sku_id", "warehouse_id", "sold_kg")
    assert sorted(facts.collect()) == sorted(daily.read().select(*facts.columns).collect())
