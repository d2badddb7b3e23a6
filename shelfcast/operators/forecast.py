"""Forecasting and order-quantity operators (A15-A18, B15-B17, B19-B21, U1,
D4, D19).

All series are forecast in one job: a per-series window ranks the tail rows,
one grouped aggregate reduces each series to its state (level, spread,
trend, last date), and ``explode(sequence(1, h))`` fans the state out to
the horizon. Nothing is looped per series on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import clamp0, dow_multiplier, newsvendor_qty, r4, rnd, z_value
from .features import SERIES, series_window

Y = "actual_demand_kg"


# ------------------------------------------------------------------ A15, A16, W6
def ranked(demand: DataFrame, keys=SERIES, extra=()) -> DataFrame:
    """Rows of each series ranked newest first (one window over the bounded
    per-series grid); shared by the state, the history tail and the union."""
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return demand.select(*keys, *extra, "date", Y, F.row_number().over(w).alias("_rk"))


def series_state(demand: DataFrame, p: C.Params = C.DEFAULT, keys=SERIES, carry=(),
                 observed: str | None = None) -> DataFrame:
    """Per series: last date, last-N mean and population std (A15, A16),
    the damped trend over the last 14 rows (W6), the row count (P8) and the
    mean over all rows, in one aggregate. ``carry`` are columns that depend
    on the series key only (e.g. category); ``observed`` counts non-null
    values of a column (e.g. days with a recorded sale)."""
    r = ranked(demand, keys, tuple(carry) + ((observed,) if observed else ()))
    in_level = F.col("_rk") <= p.level_window
    aggs = [F.max("date").alias("last_date"),
            F.count("*").alias("n_rows"),
            F.avg(F.when(in_level, F.col(Y))).alias("mu"),
            F.stddev_pop(F.when(in_level, F.col(Y))).alias("sigma"),
            F.max(F.when(F.col("_rk") == 1, F.col(Y))).alias("y_last"),
            F.max(F.when(F.col("_rk") == p.trend_window, F.col(Y))).alias("y_first"),
            F.avg(Y).alias("mean_all")]
    if observed:
        aggs.append(F.count(observed).alias("n_observed"))
    return (r.groupBy(*keys, *carry).agg(*aggs)
            .withColumn("trend", (F.col("y_last") - F.col("y_first")) / float(p.trend_window) * p.trend_damping))


# ------------------------------------------------------------------ B15
def newsvendor(stats: DataFrame, mu: str = "mu", sigma: str = "sigma",
               p: C.Params = C.DEFAULT, out: str = "optimal_order") -> DataFrame:
    """B15 over any frame holding a mean and a spread column."""
    z = z_value(p.cost_under, p.cost_over)
    return stats.withColumn(out, newsvendor_qty(mu, sigma, z, p.sigma_floor))


# ------------------------------------------------------------------ B16 + B17
def heuristic_forecast(demand: DataFrame, p: C.Params = C.DEFAULT, keys=SERIES,
                       horizon: int | None = None) -> DataFrame:
    """B16 + B17 for every series with at least ``min_history`` rows."""
    return forecast_from_state(series_state(demand, p, keys), p, keys, horizon)


def forecast_from_state(state: DataFrame, p: C.Params = C.DEFAULT, keys=SERIES,
                        horizon: int | None = None, keep=()) -> DataFrame:
    """B16 + B17 from per-series state rows (no access to the history);
    ``keep`` carries state columns onto the forecast rows."""
    h = horizon or p.horizon
    st = state.filter(F.col("n_rows") >= p.min_history)
    f = st.select(*keys, "last_date", "mu", "sigma", "trend", *[c for c in keep if c not in ("mu", "sigma")],
                  F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    f = f.withColumn("date", F.date_add("last_date", F.col("step")))
    base = clamp0((F.col("mu") + F.col("trend") * F.col("step")) * dow_multiplier("date"))
    return forecast_band(f.withColumn("_f", base), p, keys, keep=keep)


def forecast_band(f: DataFrame, p: C.Params = C.DEFAULT, keys=SERIES, value: str = "_f", keep=()) -> DataFrame:
    """Uncertainty widens 4% per step; band +-1.5u; newsvendor order."""
    u = F.col("sigma") * (F.lit(1.0) + F.col("step") * p.band_growth)
    z = z_value(p.cost_under, p.cost_over)
    fv = F.col(value)
    return f.select(*keys, *keep, "date", "step",
                    rnd(fv, 1).alias("forecast_kg"),
                    rnd(clamp0(fv - u * p.band_width), 1).alias("lower_bound"),
                    rnd(fv + u * p.band_width, 1).alias("upper_bound"),
                    newsvendor_qty(fv, u, z, p.sigma_floor).alias("optimal_order"),
                    F.lit("Forecast").alias("type"))


# ------------------------------------------------------------------ B20 + J6 + P13
def inventory_recommendations(demand: DataFrame, skus: DataFrame, p: C.Params = C.DEFAULT,
                              keys=SERIES) -> DataFrame:
    """B20 per (sku, warehouse) over the last 30 days (Q3); the SKU dimension
    drives the rows (J6 inner join: SKUs without demand are skipped)."""
    st = newsvendor(series_state(demand, p, keys), p=p)
    naive = rnd("mu", 1)
    j = skus.select("sku_id", "sku_name", "category", "shelf_life_days", "price_per_kg").join(st, "sku_id")
    saved = F.when(naive > 0, rnd((naive - F.col("optimal_order")) / naive * 100.0, 1)).otherwise(F.lit(0.0))
    return j.select("sku_id", "warehouse_id", "sku_name", "category",
                    rnd("mu", 1).alias("avg_demand_kg"), naive.alias("naive_order_kg"),
                    "optimal_order", saved.alias("saved_pct"),
                    "shelf_life_days", "price_per_kg",
                    (saved > 20).alias("needs_attention"))


# ------------------------------------------------------------------ U1
def history_and_forecast(demand: DataFrame, forecast: DataFrame, p: C.Params = C.DEFAULT,
                         keys=SERIES) -> DataFrame:
    """Last 60 history rows + forecast rows as one typed series."""
    hist = (ranked(demand, keys).filter(F.col("_rk") <= p.history_tail)
            .select(*keys, "date", F.col(Y).alias("demand_kg")).withColumn("type", F.lit("History")))
    fc = forecast.select(*keys, "date", F.col("forecast_kg").alias("demand_kg"),
                         "lower_bound", "upper_bound", "optimal_order", "type")
    return hist.unionByName(fc, allowMissingColumns=True)


# ------------------------------------------------------------------ D19, M12, B21, A17, A18
def _ape(y, pred):
    return F.abs(F.col(y) - F.col(pred)) / F.greatest(F.abs(F.col(y)), F.lit(C.MAPE_EPS))


def naive_predictions(demand: DataFrame, p: C.Params = C.DEFAULT, keys=SERIES) -> DataFrame:
    """The two naive baselines on the chronological test tail (same
    feature rows and split as the demand model: those with 14 values before
    them): 7-day moving average of the previous days and same day last week."""
    w = series_window(keys)
    rows = demand.select(*keys, "date", F.col(Y).alias("actual"), F.avg(Y).over(w.rowsBetween(-7, -1)).alias("pred_ma7"),
                         F.lag(Y, 7).over(w).alias("pred_lag7"), F.count(Y).over(w.rowsBetween(-14, -1)).alias("_before"))
    rows = rows.where("_before = 14 and actual is not null").drop("_before")
    s = rows.select("*", F.row_number().over(w).alias("row_in_series"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    cut = F.greatest(F.lit(p.min_train_rows), F.floor(F.col("_n") * F.lit(p.train_fraction)).cast("int"))
    return s.where(F.col("row_in_series") > cut).select(*keys, "date", "row_in_series", "actual", "pred_ma7", "pred_lag7")


def naive_mape_by_sku(demand: DataFrame, p: C.Params = C.DEFAULT) -> DataFrame:
    """D19 + M12 + B21 per SKU: MAPE of both baselines, improvement of the
    moving average over last week, and the mean MAPE as a reference column."""
    pr = naive_predictions(demand, p)
    g = pr.groupBy("sku_id").agg((F.avg(_ape("actual", "pred_ma7")) * 100).alias("m7"),
                                 (F.avg(_ape("actual", "pred_lag7")) * 100).alias("l7"),
                                 F.count("*").alias("n_test"))
    return g.select("sku_id", r4("m7").alias("mape"), r4("l7").alias("mape_lag7"),
                    r4(F.try_divide(F.col("l7") - F.col("m7"), F.col("l7")) * 100).alias("improvement_pct"),
                    "n_test", r4(F.avg("m7").over(Window.partitionBy())).alias("avg_mape"))  # a row per sku


def mape_summary(mape: DataFrame, col: str = "mape") -> DataFrame:
    """Unweighted mean, best, count over SKUs."""
    return mape.agg(r4(F.avg(col)).alias("avg_mape"), r4(F.min(col)).alias("best_mape"),
                    F.count("*").alias("n_skus"))


def mape_histogram(mape: DataFrame, col: str = "mape", bins: int = 15) -> DataFrame:
    """Equal-width histogram between min and max, at most ``bins`` bins.
    The limits are windows over the per-SKU table (a row per SKU)."""
    every = Window.partitionBy()
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = (mape.select(col, F.min(col).over(every).alias("_lo"), F.max(col).over(every).alias("_hi"))
         .withColumn("bucket", F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
             F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int"))))
    return (b.groupBy("bucket").agg(F.count("*").alias("n_skus"), F.first("_lo").alias("_lo"),
                                    F.first("_hi").alias("_hi"))
            .select("bucket", r4(F.col("_lo") + F.col("bucket") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                    r4(F.col("_lo") + (F.col("bucket") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_end"),
                    "n_skus").orderBy("bucket"))


def regression_metrics(pred: DataFrame, actual: str, predicted: str, keys=("sku_id",)) -> DataFrame:
    """MAE, RMSE and R2 per key, from one grouped aggregate."""
    err = F.col(actual) - F.col(predicted)
    g = pred.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                                F.sum(err * err).alias("sse"),
                                (F.count("*") * F.var_pop(actual)).alias("sst"),
                                F.count("*").alias("n"))
    return g.select(*keys, r4("mae").alias("mae"), r4("rmse").alias("rmse"),
                    r4(F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"), "n")
