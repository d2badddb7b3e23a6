"""Facts whose sku or warehouse has no dimension row, wrong dates, and
dimension tables of the caller's own."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shelfcast import config as C
from shelfcast.operators import forecast as FC
from shelfcast.operators import planning as PL
from shelfcast.plans import catalog
from shelfcast.sources import views as V
from shelfcast.sources.tables import TABLES, Tables

from .conftest import SF001

KEYS = sorted(catalog.queries())


@pytest.fixture(scope="module")
def holes(spark, tmp_path_factory):
    """sf0.001 without a tenth of part and of supplier."""
    root = tmp_path_factory.mktemp("holes")
    for name in TABLES:
        if name not in ("part", "supplier"):
            (root / f"{name}.parquet").symlink_to(f"{SF001}/{name}.parquet")
    spark.read.parquet(f"{SF001}/part.parquet").where("p_partkey % 10 <> 0").write.parquet(str(root / "part.parquet"))
    spark.read.parquet(f"{SF001}/supplier.parquet").where("s_suppkey % 10 <> 0").write.parquet(str(root / "supplier.parquet"))
    return str(root)


@pytest.fixture(scope="module", autouse=True)
def small_models():
    was = catalog.P
    catalog.P = dataclasses.replace(was, rf_trees=3, rf_depth=3, gbt_iters=2, gbt_depth=2, sku_iters=1)
    yield
    catalog.P = was


@pytest.mark.parametrize("key", KEYS)
def test_every_key_runs(spark, holes, key):
    assert E.queries()[key](spark, holes).count() >= 0


def test_unknown_series(spark, holes):
    t = Tables(spark, holes)
    sold = t.lineitem.agg(F.sum("l_quantity")).first()[0]
    dm = V.demand(t)
    assert dm.agg(F.sum("sold_kg")).first()[0] == pytest.approx(sold)
    r = dm.where("sku_id = 'UNKNOWN'").select("category", "base_demand", "price_per_kg").distinct().collect()
    assert [tuple(x) for x in r] == [("UNKNOWN", 0.0, None)]
    assert dm.where("warehouse_id = 'UNKNOWN'").count() > 0
    f = FC.heuristic_forecast(dm).where("sku_id = 'UNKNOWN'")
    assert f.count() > 0 and f.where("forecast_kg is null").count() == 0
    q = PL.category_newsvendor(dm)
    assert q.count() == dm.select("sku_id", "warehouse_id").distinct().count()
    one = q.where("category = 'UNKNOWN'").first()
    assert one.critical_ratio == pytest.approx(0.2) and one.optimal_order is not None


def test_one_wrong_date_stretches_nothing(spark, tmp_path):
    for name in ("part", "supplier", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF001}/{name}.parquet")
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").limit(500).cache()
    n = li.count()
    wrong = li.limit(1).withColumn("l_shipdate", F.lit(dt.datetime(9999, 12, 31)).cast("timestamp_ntz")).unionByName(
        li.limit(1).withColumn("l_shipdate", F.lit(None).cast("timestamp_ntz")))
    li.unionByName(wrong).write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    a, z = V.bounds(t)
    assert (z - a).days < 4000 and V.demand(t).agg(F.max("date")).first()[0] == z
    got = {r.rule: r.n_lots for r in PL.validate_lots(V.lots(t)).collect()}
    assert got["implausible_date"] == 2 and sum(got.values()) >= n + 2
    li.unpersist()


def test_own_dimensions(spark):
    """Attributes come from the tables given; a brand that they lack is kept."""
    skus = V.sku_dim(Tables(spark, SF001)).withColumn("price_per_kg", F.lit(7.0)).withColumn("category", F.lit("Own")).where("sku_id <> 'Brand#11'")
    wh = V.warehouse_dim(Tables(spark, SF001)).withColumn("warehouse_name", F.concat(F.lit("Depot "), "warehouse_id"))
    t = Tables(spark, SF001, skus=skus, warehouses=wh)
    lots = V.lots(t)
    assert lots.count() == 6000
    assert {r[0] for r in lots.select("category").distinct().collect()} == {"Own", C.UNKNOWN}
    dm = V.demand(t)
    assert dm.where("category = 'Own' and price_per_kg <> 7.0").count() == 0
    assert {r[0] for r in dm.select("warehouse_name").distinct().collect()} == {f"Depot {r.warehouse_id}" for r in wh.collect()}
    assert V.demand(Tables(spark, SF001)).where("category = 'Own'").count() == 0  # views are kept apart
