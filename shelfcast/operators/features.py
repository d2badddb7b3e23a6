"""Calendar and time-series feature operators.

Every per-series window uses the same ``partitionBy(series).orderBy(date)``
spec, so Catalyst plans one Exchange + one Sort for all lag and rolling
columns. Series come from the densified demand grid: exactly one row per
day, so every window partition is bounded by the calendar, not by data
volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import day_name, dow_multiplier, is_weekend, r4, rnd, weekday

SERIES = ["sku_id", "warehouse_id"]


def series_window(keys=SERIES, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


# ------------------------------------------------------------------ B1
def calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """B1: weekday (Mon=0), day name, weekend flag, month, day of year."""
    d = F.col(date_col)
    return df.select("*",
                     weekday(d).cast("int").alias("day_of_week"),
                     day_name(d).alias("day_name"),
                     is_weekend(d).alias("is_weekend"),
                     F.month(d).alias("month"),
                     F.dayofyear(d).alias("day_of_year"))


# ------------------------------------------------------------------ B3 + A20
def warehouse_scale(demand: DataFrame) -> DataFrame:
    """Learned warehouse scale = warehouse mean / network mean, from a
    single grouped aggregate plus a window over the (few) warehouse rows."""
    g = demand.groupBy("warehouse_id").agg(F.sum("actual_demand_kg").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy()
    return g.select("warehouse_id",
                    ((F.col("s") / F.col("n")) / (F.sum("s").over(w) / F.sum("n").over(w))).alias("wh_scale"))


def expected_demand(demand: DataFrame) -> DataFrame:
    """Base x dow x annual cycle x festival x heat effect x warehouse scale
    (the random noise of a simulator is left out)."""
    doy = F.col("day_of_year")
    annual = F.lit(1.0) + F.lit(0.15) * F.sin(F.lit(2.0) * F.pi() * (doy - 60) / F.lit(365.0))
    heat = (F.when((F.col("temp_c") > 38) & (F.col("category") == "Meat & Poultry"), F.lit(0.85))
            .when((F.col("temp_c") > 35) & (F.col("category") == "Dairy"), F.lit(1.10))
            .otherwise(F.lit(1.0)))
    # one row per warehouse: AQE broadcasts it at run time by its measured size
    j = demand.join(warehouse_scale(demand), "warehouse_id")
    val = (F.col("base_demand") * F.col("wh_scale") * dow_multiplier("date") * annual
           * F.col("festival_multiplier") * heat)
    return j.select("date", "sku_id", "warehouse_id", r4("wh_scale").alias("wh_scale"),
                    r4(val).alias("expected_demand_kg"))


# ------------------------------------------------------------------ W1-W4, M10
def lag_features(df: DataFrame, y: str = "actual_demand_kg", lags=C.DEMAND_LAGS,
                 keys=SERIES) -> DataFrame:
    """W1."""
    w = series_window(keys)
    return df.select("*", *[F.lag(y, n).over(w).alias(f"lag_{n}") for n in lags])


def _gated(agg: Column, y: str, w, n: int) -> Column:
    """Value only once the frame holds ``n`` rows (pandas ``rolling(n)``)."""
    return F.when(F.count(y).over(w) == n, agg.over(w))


def rolling_features(df: DataFrame, y: str = "actual_demand_kg", keys=SERIES) -> DataFrame:
    """7/14-row means and the 7-row *sample* std of the previous rows."""
    base = series_window(keys)
    w7, w14 = base.rowsBetween(-7, -1), base.rowsBetween(-14, -1)
    return df.select("*",
                     _gated(F.avg(y), y, w7, 7).alias("rolling_7_mean"),
                     _gated(F.stddev_samp(y), y, w7, 7).alias("rolling_7_std"),
                     _gated(F.avg(y), y, w14, 14).alias("rolling_14_mean"))


def build_lag_features(df: DataFrame, y: str = "actual_demand_kg", keys=SERIES) -> DataFrame:
    """Lags + rolling + calendar, then drop rows with a null in any column
    (P7), but for ``sold_kg``, which this library adds and which is null on
    days without a sale, and for price, revenue and shelf life, which a sku
    without attributes lacks. Partitioned by (sku, warehouse), Q1."""
    f = rolling_features(lag_features(df, y, keys=keys), y, keys)
    return f.na.drop("any", subset=[c for c in f.columns if c not in ("sold_kg", "price_per_kg", "revenue", "shelf_life_days")])


def train_test_split(features: DataFrame, p: C.Params = C.DEFAULT, keys=SERIES) -> DataFrame:
    """Chronological split; train = first max(30, int(n * 0.85)) rows."""
    w = series_window(keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    cut = F.greatest(F.lit(p.min_train_rows), F.floor(n * F.lit(p.train_fraction)).cast("int"))
    return (features.withColumn("_rn", F.row_number().over(w)).withColumn("_cut", cut)
            .withColumn("split", F.when(F.col("_rn") <= F.col("_cut"), "train").otherwise("test"))
            .withColumn("row_in_series", F.col("_rn")).drop("_rn", "_cut"))


# ------------------------------------------------------------------ P2, W5, A10
def series_rows(demand: DataFrame, sku_id: str | None = None, warehouse_id: str | None = None) -> DataFrame:
    """The rows of one sku, one warehouse or one series; of all by default."""
    out = demand.select("date", *SERIES, "actual_demand_kg")
    for name, value in (("sku_id", sku_id), ("warehouse_id", warehouse_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def tail_rows(df: DataFrame, n: int, keys=SERIES, order: str = "date") -> DataFrame:
    """Last ``n`` rows per series (window rank, no global sort)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def dow_pattern(demand: DataFrame, keys=SERIES) -> DataFrame:
    """A10 + J5: mean demand per day name in Monday..Sunday order. One
    aggregate pivoted on the fixed 7-day domain (listed values: no extra
    job to find them), then unpivoted; a day a series never has is null."""
    wide = demand.groupBy(*keys).pivot("day_name", C.DAY_NAMES).agg(F.avg("actual_demand_kg"))
    days = F.array(*[F.struct(F.lit(d).alias("day_name"), F.lit(i).alias("dow_rank"),
                              F.col(f"`{d}`").alias("v")) for i, d in enumerate(C.DAY_NAMES)])
    return (wide.select(*keys, F.explode(days).alias("d"))
            .select(*keys, "d.day_name", "d.dow_rank", r4("d.v").alias("avg_demand_kg"))
            .orderBy(*keys, "dow_rank"))


# ------------------------------------------------------------------ D21
def season_of_month(m: Column) -> Column:
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Summer")
            .when(m.isin(6, 7, 8, 9), "Monsoon").otherwise("Post-monsoon"))


def season_features(demand: DataFrame) -> DataFrame:
    """Season, ISO week and festival flag."""
    return demand.select("date", "sku_id", "warehouse_id",
                         season_of_month(F.col("month")).alias("season"),
                         F.weekofyear("date").alias("week_of_year"),
                         (F.col("festival_multiplier") > 1.0).cast("int").alias("is_festival"))



def series_lists(rows: DataFrame, y: str = "actual_demand_kg", keys=SERIES) -> DataFrame:
    """per series, its rows as a date-ordered list: length, first,
    last, sum of the last seven and the rounded values as JSON text. ``rows``
    is a bounded tail of each series."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", F.col(y).alias("y")))).alias("_r"))
    v = F.col("_r.y")
    return g.select(*keys, F.size(v).alias("n"), F.element_at(v, 1).alias("first_y"), F.element_at(v, -1).alias("last_y"),
                    r4(F.aggregate(F.slice(v, -7, 7), F.lit(0.0), lambda a, x: a + x)).alias("last_7_sum"),
                    F.to_json(F.transform(v, lambda x: rnd(x, 0).cast("bigint"))).alias("values_json"))
