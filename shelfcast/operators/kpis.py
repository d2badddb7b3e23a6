"""KPI and wastage operators.

Global KPIs over two tables are one aggregate over a ``unionByName`` of the
two inputs' projected columns (no join of one-row frames); every grouped
aggregate is a partial + final hash aggregate, so hot categories or months
are combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import month_name, r2, r4, rnd


def _d0():
    return F.lit(0.0)


def _ratio_pct(num, den) -> F.Column:
    return r4(F.try_divide(num, den) * 100.0)


# ------------------------------------------------------------------ A1
def wastage_kpi(lots: DataFrame) -> DataFrame:
    """A1: spoiled value over lot value, percent (ratio of sums)."""
    return lots.agg(r2(F.sum("lot_value")).alias("total_value"),
                    r2(F.sum("spoiled_value")).alias("spoiled_value"),
                    _ratio_pct(F.sum("spoiled_value"), F.sum("lot_value")).alias("wastage_pct"))


# ------------------------------------------------------------------ A2
def fill_rate_kpi(lots: DataFrame, demand: DataFrame) -> DataFrame:
    """A2: min(100, round((sum kg - sum spoiled kg) / sum demand * 100, 1))."""
    u = (lots.select(F.col("quantity_kg").alias("q"), F.col("spoiled_kg").alias("s"), _d0().alias("d"))
         .unionByName(demand.select(_d0().alias("q"), _d0().alias("s"), F.col("actual_demand_kg").alias("d"))))
    a = u.agg((F.sum("q") - F.sum("s")).alias("sup"), F.sum("d").alias("dem"))
    return a.select(r2("sup").alias("total_supplied_kg"), r2("dem").alias("total_demand_kg"),
                    F.least(F.lit(100.0), rnd(F.try_divide(F.col("sup"), F.col("dem")) * 100.0, 1))
                    .alias("fill_rate"))


# ------------------------------------------------------------------ A3
def _inventory_parts(lots: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, sku): mean lot kg, price sum and count (for the mean price)."""
    return lots.groupBy(*keys, "sku_id").agg(F.avg("quantity_kg").alias("m"),
                                             F.sum("price_per_kg").alias("ps"),
                                             F.count("*").alias("n"))


def inventory_turnover_kpi(lots: DataFrame, demand: DataFrame) -> DataFrame:
    """A3: min(cap, round(sum revenue / max(inv value, 1), 1)); inventory =
    (sum over SKU of mean lot kg) * (mean lot price)."""
    inv = _inventory_parts(lots, [])
    u = (inv.select("m", "ps", F.col("n").cast("double").alias("n"), _d0().alias("rev"))
         .unionByName(demand.select(_d0().alias("m"), _d0().alias("ps"), _d0().alias("n"),
                                    F.col("revenue").alias("rev"))))
    a = u.agg(F.sum("rev").alias("cogs"), (F.sum("m") * (F.sum("ps") / F.sum("n"))).alias("inv"))
    return a.select(r2("cogs").alias("annual_cogs"), r2("inv").alias("avg_inventory_value"),
                    F.least(F.lit(C.TURNOVER_CAP),
                            rnd(F.col("cogs") / F.greatest(F.col("inv"), F.lit(1.0)), 1))
                    .alias("inventory_turnover"))


# ------------------------------------------------------------------ A6-A9, A13
def wastage_by_category(lots: DataFrame) -> DataFrame:
    """A6."""
    return (lots.groupBy("category")
            .agg(F.sum("lot_value").alias("tv"), F.sum("spoiled_value").alias("sv"))
            .select("category", r2("tv").alias("total_value"), r2("sv").alias("spoiled_value"),
                    _ratio_pct(F.col("sv"), F.col("tv")).alias("wastage_pct"))
            .orderBy("wastage_pct", "category"))


def wastage_by_month(lots: DataFrame) -> DataFrame:
    """By calendar month of procurement date; spoiled value also in lakhs."""
    g = (lots.groupBy(F.year("procurement_date").alias("year"), F.month("procurement_date").alias("month"))
         .agg(F.sum("spoiled_value").alias("sv"), F.sum("lot_value").alias("tv")))
    return g.select("year", "month",
                    month_name(F.make_date(F.lit(2000), F.col("month"), F.lit(1))).alias("month_name"),
                    r2("sv").alias("spoiled"), r2("tv").alias("total"),
                    _ratio_pct(F.col("sv"), F.col("tv")).alias("wastage_pct"),
                    r4(F.col("sv") / 1e5).alias("spoiled_lakhs")).orderBy("year", "month")


def wastage_by_sku(lots: DataFrame) -> DataFrame:
    """Mean of lot spoilage fractions (unspoiled lots count as 0)."""
    return (lots.groupBy("sku_name", "category")
            .agg(r4(F.avg("spoilage_pct")).alias("mean_spoilage_pct")))


def wastage_rollup(sku_waste: DataFrame) -> DataFrame:
    """Two-level hierarchy; a parent's value is the sum of its children."""
    return (sku_waste.rollup("category", "sku_name")
            .agg(r4(F.sum("mean_spoilage_pct")).alias("value"), F.grouping_id().alias("gid"))
            .select("category", "sku_name",
                    F.when(F.col("gid") == 0, "sku").when(F.col("gid") == 1, "category")
                    .otherwise("total").alias("node_level"),
                    "value"))


def over_ordering_by_category(lots: DataFrame) -> DataFrame:
    """A13."""
    return (lots.groupBy("category")
            .agg(r4(F.avg("over_order_factor")).alias("avg_over_order"),
                 r2(F.sum("spoiled_value")).alias("total_spoiled_value")))


# ------------------------------------------------------------------ W8
def monthly_kpis(lots: DataFrame, demand: DataFrame) -> DataFrame:
    """Wastage %, fill rate and turnover per procurement/demand month."""
    # one pass over the lots: per (month, sku) partial sums, then per month
    ms = (lots.groupBy(F.year("procurement_date").alias("year"), F.month("procurement_date").alias("month"), "sku_id")
          .agg(F.sum("lot_value").alias("tv"), F.sum("spoiled_value").alias("sv"),
               F.sum("quantity_kg").alias("q"), F.sum("spoiled_kg").alias("s"),
               F.avg("quantity_kg").alias("m"), F.sum("price_per_kg").alias("ps"), F.count("*").alias("n")))
    lm = ms.groupBy("year", "month").agg(F.sum("tv").alias("tv"), F.sum("sv").alias("sv"),
                                 (F.sum("q") - F.sum("s")).alias("sup"),
                                 (F.sum("m") * (F.sum("ps") / F.sum("n"))).alias("inv"))
    dm = demand.groupBy(F.year("date").alias("year"), "month").agg(F.sum("actual_demand_kg").alias("dem"), F.sum("revenue").alias("rev"))
    j = dm.join(lm, ["year", "month"], "left")
    return j.select(
        "year", "month",
        _ratio_pct(F.col("sv"), F.col("tv")).alias("wastage_pct"),
        F.least(F.lit(100.0), rnd(F.try_divide(F.col("sup"), F.col("dem")) * 100.0, 1)).alias("fill_rate"),
        F.least(F.lit(C.TURNOVER_CAP), rnd(F.col("rev") / F.greatest(F.coalesce(F.col("inv"), F.lit(0.0)),
                                                                     F.lit(1.0)), 1)).alias("turnover"))


def kpi_month_delta(lots: DataFrame, demand: DataFrame) -> DataFrame:
    """Month-over-month change of each KPI (lag over one row per month)."""
    m = monthly_kpis(lots, demand)
    w = Window.orderBy("year", "month")
    out = m
    for k in ["wastage_pct", "fill_rate", "turnover"]:
        out = out.withColumn(f"{k}_delta", r4(F.col(k) - F.lag(k, 1).over(w)))
    return out


# ------------------------------------------------------------------ A19
def impact_summary(lots: DataFrame, mape_by_sku: DataFrame, mape_col: str = "mape") -> DataFrame:
    """Baseline and target wastage, projected recovery and forecast
    accuracy (100 - mean SKU MAPE), in one aggregate over a union."""
    u = (lots.select(F.col("lot_value").alias("tv"), F.col("spoiled_value").alias("sv"),
                     F.lit(None).cast("double").alias("mape"))
         .unionByName(mape_by_sku.select(_d0().alias("tv"), _d0().alias("sv"), F.col(mape_col).alias("mape"))))
    a = u.agg(F.sum("tv").alias("tv"), F.sum("sv").alias("sv"), F.avg("mape").alias("am"))
    base = F.try_divide(F.col("sv"), F.col("tv")) * 100.0
    return a.select(
        r4(base).alias("baseline_wastage_pct"),
        r4(base * C.WASTAGE_TARGET_FACTOR).alias("target_wastage_pct"),
        rnd((F.col("sv") - F.col("sv") * C.WASTAGE_TARGET_FACTOR) / 1e5, 0).cast("bigint").alias("recovery_lakhs"),
        rnd(F.lit(100.0) - F.col("am"), 0).cast("bigint").alias("forecast_accuracy"),
        r4("am").alias("avg_mape"))


# ------------------------------------------------------------------ P1, A14
def apply_filters(df: DataFrame, warehouse: str = "All Warehouses", categories=None,
                  warehouse_col: str = "warehouse_name", category_col: str = "category") -> DataFrame:
    """P1: "All Warehouses" means no warehouse filter; an empty (or None)
    category list means no category filter."""
    if warehouse and warehouse != "All Warehouses":
        df = df.filter(F.col(warehouse_col) == warehouse)
    if categories:
        df = df.filter(F.col(category_col).isin(list(categories)))
    return df


def sku_options(demand: DataFrame) -> DataFrame:
    return demand.select("sku_id", "sku_name").distinct()


def warehouse_options(demand: DataFrame) -> DataFrame:
    return demand.select("warehouse_id", "warehouse_name").distinct()
