"""Sources and sinks: typed CSV round trip, build-if-absent, pushdown."""

import os

from shelfcast.session import scratch_path
from shelfcast.sources import tables as T
from shelfcast.sources import views as V

from .conftest import SF001


def test_demand_csv_round_trip(spark):
    t = T.Tables(spark, SF001)
    dm = V.demand(t).where("date < '1995-03-01'")
    path = scratch_path(spark, "demand-csv")
    T.save_demand(dm, path)
    back = T.load_demand(spark, path)
    assert back.count() == dm.count() > 0
    assert back.exceptAll(dm.select(*back.columns)).count() == 0


HEADER = ("date,sku_id,sku_name,category,warehouse_id,warehouse_name,city,actual_demand_kg,price_per_kg,revenue,"
          "temp_c,day_of_week,is_weekend,month,day_of_year,festival_multiplier")


def test_sixteen_column_demand_file(spark, tmp_path):
    f = tmp_path / "demand.csv"
    f.write_text(HEADER + "\n2024-01-06,SKU1,Milk,Dairy,WH1,North,Pune,12.5,40.0,500.0,21.3,Saturday,1,1,6,1.0\n")
    r = T.load_demand(spark, str(f)).collect()
    assert [(x.day_name, x.day_of_week, x.actual_demand_kg, x.festival_multiplier) for x in r] == [("Saturday", 5, 12.5, 1.0)]


LOTS = ("lot_id,sku_id,sku_name,category,warehouse_id,warehouse_name,procurement_date,expiry_date,shelf_life_days,"
        "effective_shelf_life,quantity_kg,over_order_factor,ideal_temp_c,actual_temp_c,temp_deviation_c,price_per_kg,"
        "lot_value,did_spoil,spoilage_pct,spoiled_kg,spoiled_value,days_to_expiry,risk_score,age_pct")


def test_lots_file_to_active_lots_kpis_and_model(spark, tmp_path):
    """Lot file -> freshness, money, probability, score -> stock -> KPI -> model."""
    import dataclasses
    import datetime as dt

    from shelfcast import config as C
    from shelfcast.operators import alerts as AL
    from shelfcast.operators import kpis as K
    from shelfcast.operators import lots as L
    from shelfcast.operators import models as M
    from shelfcast.operators import planning as PL
    rows = [f"LOT{i},S{i % 70:02d},Sku {i % 70},{'Dairy' if i % 2 else 'Root Vegetables'},W{i % 40:02d},Hub {i % 40},2024-01-{i % 28 + 1:02d},"
            f"2024-02-10,{10 + i % 40},0,{10 + i % 7},1.2,4,4,{i % 3 * 2},20.0,0,{int(i % 5 == 0)},{0.2 if i % 5 == 0 else 0.0},0,0,0,0,0"
            for i in range(600)]
    f = tmp_path / "lots.csv"
    f.write_text("\n".join([LOTS, *rows]) + "\n")
    day = dt.date(2024, 1, 28)
    lots = L.with_effective_life(T.load_lots(spark, str(f)))
    lots = L.with_risk_score(L.with_spoilage_probability(L.with_financials(L.with_freshness(lots, as_of=day))))
    one = lots.where("lot_id = 'LOT1'").first()
    assert (one.effective_shelf_life, one.days_to_expiry, one.lot_value) == (11, 11 - 26, 220.0)
    assert one.age == 1.0 and 0.02 <= one.spoil_prob <= 0.95 and 0 <= one.risk_score <= 100
    stock = L.active_lots(lots, day)
    assert stock.where("days_remaining < 0").count() == 0
    assert stock.where("shelf_life_days > 16").count() > 0  # no bound from the fixture
    assert AL.risk_level_summary(stock).first().n_critical is not None
    assert K.wastage_kpi(lots).first().wastage_pct > 0
    good, bad = L.split_valid(lots.withColumn("sku_id", L.F.when(L.F.col("lot_id") != "LOT3", L.F.col("sku_id"))))
    assert (good.count(), bad.count()) == (599, 1) and bad.first().broken == ["null_key"]
    assert {r.rule: r.n_lots for r in PL.validate_lots(lots).collect()} == {"valid": 600}
    p = dataclasses.replace(C.DEFAULT, rf_trees=3, rf_depth=3)
    model, test = M.train_spoilage_model(lots, p)  # 40 warehouses
    assert test.count() > 0
    assert M.score_active_lots(model, stock.select("*")).count() == stock.count()


def test_missing_dimension_rows_are_kept_and_reported(spark, tmp_path):
    from shelfcast.operators import planning as PL
    for name in ("lineitem", "supplier", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF001}/{name}.parquet")
    spark.read.parquet(f"{SF001}/part.parquet").where("p_partkey % 10 <> 0").write.parquet(str(tmp_path / "part.parquet"))
    t = T.Tables(spark, str(tmp_path))
    lots = V.lots(t)
    assert lots.count() == 6000
    got = {r.rule: r.n_lots for r in PL.validate_lots(lots).collect()}
    assert got["unknown_key"] == t.lineitem.where("l_partkey % 10 = 0").count() and sum(got.values()) == 6000


def test_unfinished_folder_is_built_again(spark, tmp_path):
    (tmp_path / "t").mkdir()
    assert T.build_if_absent(spark, str(tmp_path / "t"), lambda: spark.range(3)).count() == 3


def test_session_without_checkpoint_dir(spark):
    """Run apart, as the test session already has a folder."""
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
            ".getOrCreate(); import __spark_entry__ as E; q = E.queries();"
            f"print('ROWS', q['d_supplier_degradation'](s, '{SF001}').count(), q['expected_demand'](s, '{SF001}').count() > 0); s.stop()")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    away = scratch_dir()  # also holds no Spark configuration
    out = subprocess.run([sys.executable, "-c", code], cwd=away, env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": away}, capture_output=True, text=True, timeout=300)
    assert "ROWS 10 True" in out.stdout, out.stderr[-2000:]


def scratch_dir() -> str:
    import tempfile
    return tempfile.mkdtemp(prefix="shelfcast-cwd-")


def test_build_if_absent_only_builds_once(spark):
    t = T.Tables(spark, SF001)
    path = scratch_path(spark, "lots")
    calls = []

    def build():
        calls.append(1)
        return V.lots(t).select("lot_id", "lot_value")

    a = T.build_if_absent(spark, path, build)
    b = T.build_if_absent(spark, path, build)
    assert len(calls) == 1 and a.count() == b.count() == 6000


def test_shipdate_filter_reaches_scan(spark):
    t = T.Tables(spark, SF001)
    plan = V.active_lots(t)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_checkpoint_dir_is_set(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert root and os.path.isdir(root.replace("file:", ""))


def test_cluster_conf_sizes_partitions():
    from shelfcast.session import cluster_conf
    c = cluster_conf(100 * (1 << 40), executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // 4 // (256 << 20)
    small = cluster_conf(1 << 30, executors=10, cores_per_executor=4)
    assert small["spark.sql.shuffle.partitions"] == "80"


def test_views_defined_once_per_session(spark):
    from shelfcast.sources import views as V
    t1, t2 = T.Tables(spark, SF001), T.Tables(spark, SF001)
    assert V.lots(t1) is V.lots(t2)
    import datetime as dt
    assert V.lots(t1) is not V.lots(t1, dt.date(2000, 1, 1), None)
    T.clear_views()
    assert V.lots(T.Tables(spark, SF001)).count() == 6000
