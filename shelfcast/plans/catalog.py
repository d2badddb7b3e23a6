"""Named query plans: ``key -> (spark, sf_dir) -> DataFrame``.

Each entry composes views and operators into one lazy plan over the given
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import lakhs_text, lot_code, money_text, pct_text, r2, r4, rnd, thousands_text
from ..operators import alerts as AL
from ..operators import features as FE
from ..operators import forecast as FC
from ..operators import kpis as K
from ..operators import models as M
from ..operators import planning as PL
from ..operators.boosting import stash
from ..operators.models import with_split
from ..session import ensure_checkpoint_dir
from ..sources import views as V
from ..sources.tables import Tables
from ..streaming import streams as ST
from ..streaming import tier_state as TI

P = C.DEFAULT
QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def _grid(t: Tables) -> DataFrame:
    """The demand grid materialised once (reliable checkpoint in the shared
    folder) for plans that read it in several branches: it is bounded by
    series x days at any scale, while recomputing it re-reads the fiscal
    year of lineitem."""
    ensure_checkpoint_dir(t.spark)
    return V.demand(t, P).checkpoint(eager=True)


# ------------------------------------------------------------------ KPIs
@query("wastage_kpi")
def q_wastage_kpi(spark, d):
    return K.wastage_kpi(V.lots(_t(spark, d), warehouse=False))


@query("fill_rate_kpi")
def q_fill_rate_kpi(spark, d):
    t = _t(spark, d)
    return K.fill_rate_kpi(V.fy_lots(t, P, warehouse=False), V.demand(t, P))


@query("inventory_turnover_kpi")
def q_inventory_turnover_kpi(spark, d):
    t = _t(spark, d)
    return K.inventory_turnover_kpi(V.fy_lots(t, P, warehouse=False), V.demand(t, P))


@query("impact_summary")
def q_impact_summary(spark, d):
    t = _t(spark, d)
    return K.impact_summary(V.lots(t, warehouse=False), FC.naive_mape_by_sku(V.demand(t, P), P))


@query("wastage_by_category")
def q_wastage_by_category(spark, d):
    return K.wastage_by_category(V.lots(_t(spark, d), warehouse=False))


@query("wastage_by_month")
def q_wastage_by_month(spark, d):
    return K.wastage_by_month(V.lots(_t(spark, d), warehouse=False))


@query("wastage_by_sku")
def q_wastage_by_sku(spark, d):
    return K.wastage_by_sku(V.lots(_t(spark, d), warehouse=False))


@query("wastage_rollup")
def q_wastage_rollup(spark, d):
    return K.wastage_rollup(K.wastage_by_sku(V.lots(_t(spark, d), warehouse=False)))


@query("kpi_month_delta")
def q_kpi_month_delta(spark, d):
    t = _t(spark, d)
    return K.kpi_month_delta(V.fy_lots(t, P, warehouse=False), V.demand(t, P))


@query("over_ordering_by_category")
def q_over_ordering(spark, d):
    return K.over_ordering_by_category(V.lots(_t(spark, d), warehouse=False))


@query("filtered_lots")
def q_filtered_lots(spark, d):
    lo = K.apply_filters(V.lots(_t(spark, d)), P.warehouse_filter, P.categories_filter)
    return lo.select("lot_id", "sku_id", "category", "warehouse_name", "procurement_date",
                     "quantity_kg", "lot_value", "spoiled_value")


@query("sku_options")
def q_sku_options(spark, d):
    return K.sku_options(V.lines(_t(spark, d), warehouse=False))


@query("warehouse_options")
def q_warehouse_options(spark, d):
    return K.warehouse_options(V.lines(_t(spark, d)))


# ------------------------------------------------------------------ lots and alerts
@query("active_lots")
def q_active_lots(spark, d):
    return AL.sorted_active(V.active_lots(_t(spark, d), P.as_of))


@query("risk_level_counts")
def q_risk_level_counts(spark, d):
    return AL.risk_level_counts(V.active_lots(_t(spark, d), P.as_of))


@query("risk_level_summary")
def q_risk_level_summary(spark, d):
    return AL.risk_level_summary(V.active_lots(_t(spark, d), P.as_of))


@query("value_at_risk_by_category")
def q_value_at_risk(spark, d):
    return AL.value_at_risk_by_category(V.active_lots(_t(spark, d), P.as_of))


@query("top_critical_alerts")
def q_top_critical(spark, d):
    return AL.top_critical_alerts(V.active_lots(_t(spark, d), P.as_of), P.top_alerts)


@query("alert_table")
def q_alert_table(spark, d):
    return AL.alert_table(V.active_lots(_t(spark, d), P.as_of), P.alert_filter)


@query("procurement_schedule")
def q_procurement_schedule(spark, d):
    t = _t(spark, d)
    series = (V.series(V.lines(t))
              .transform(lambda s: V.with_series_attributes(t, s)).select("sku_id", "warehouse_id", "shelf_life_days"))
    return AL.procurement_schedule(series, *V.bounds(t, P))


@query("lot_freshness")
def q_lot_freshness(spark, d):
    return AL.lot_freshness(V.lots(_t(spark, d), warehouse=False))


@query("lot_financials")
def q_lot_financials(spark, d):
    return AL.lot_financials(V.lots(_t(spark, d), warehouse=False))


@query("spoilage_probability")
def q_spoilage_probability(spark, d):
    return AL.spoilage_probability(V.lots(_t(spark, d), warehouse=False))


@query("lot_risk_score")
def q_lot_risk_score(spark, d):
    return AL.lot_risk_score(V.lots(_t(spark, d), warehouse=False))


# ------------------------------------------------------------------ demand and calendar
@query("demand_facts")
def q_demand_facts(spark, d):
    f = V.demand_facts(_t(spark, d))
    return f.select("date", "sku_id", "sku_name", "category", "warehouse_id", "warehouse_name",
                    F.col("sold_kg").alias("demand_kg"), "price_per_kg",
                    rnd(F.col("sold_kg") * F.col("price_per_kg"), 2).alias("revenue"))


@query("demand_grid")
def q_demand_grid(spark, d):
    return V.demand(_t(spark, d), P).drop("base_demand", "sold_kg")


@query("calendar_features")
def q_calendar_features(spark, d):
    f = V.demand_facts(_t(spark, d)).select("date", "sku_id", "warehouse_id")
    return FE.calendar_features(f)


@query("festival_multiplier")
def q_festival_multiplier(spark, d):
    t = _t(spark, d)
    days = t.lineitem.select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    out = V.with_festival(days, F.broadcast(V.festival_dim(spark, V.years_of(*V.bounds(t, P)))), "date", "fm")
    return out.select("date", r4("fm").alias("festival_multiplier"))


@query("expected_demand")
def q_expected_demand(spark, d):
    return FE.expected_demand(_grid(_t(spark, d)))


# ------------------------------------------------------------------ features
@query("lag_features")
def q_lag_features(spark, d):
    dm = V.demand(_t(spark, d), P).select("date", "sku_id", "warehouse_id", "actual_demand_kg")
    return FE.lag_features(dm)


@query("rolling_features")
def q_rolling_features(spark, d):
    dm = V.demand(_t(spark, d), P).select("date", "sku_id", "warehouse_id", "actual_demand_kg")
    r = FE.rolling_features(dm)
    return r.select("date", "sku_id", "warehouse_id", "actual_demand_kg",
                    *[r4(c).alias(c) for c in ["rolling_7_mean", "rolling_7_std", "rolling_14_mean"]])


@query("train_test_split")
def q_train_test_split(spark, d):
    dm = V.demand(_t(spark, d), P)
    s = FE.train_test_split(FE.build_lag_features(dm), P)
    return s.select("sku_id", "warehouse_id", "date", "row_in_series", "split")


@query("dow_pattern")
def q_dow_pattern(spark, d):
    return FE.dow_pattern(V.demand(_t(spark, d), P))


@query("history_tail")
def q_history_tail(spark, d):
    dm = V.demand(_t(spark, d), P).select("sku_id", "warehouse_id", "date", "actual_demand_kg")
    return FE.tail_rows(dm, P.history_tail)


# ------------------------------------------------------------------ forecast
@query("newsvendor")
def q_newsvendor(spark, d):
    st = FC.newsvendor(FC.series_state(V.demand(_t(spark, d), P), P), p=P)
    return st.select("sku_id", "warehouse_id", r4("mu").alias("mu"), r4("sigma").alias("sigma"),
                     "optimal_order")


@query("heuristic_forecast")
def q_heuristic_forecast(spark, d):
    return FC.heuristic_forecast(V.demand(_t(spark, d), P), P)


@query("forecast_30_days")
def q_forecast_30_days(spark, d):
    return FC.heuristic_forecast(V.demand(_t(spark, d), P), P, horizon=30)


@query("lot_texts")
def q_lot_texts(spark, d):
    a = V.active_lots(_t(spark, d), P.as_of)
    return a.select("lot_id", lot_code("days_remaining").alias("code"), money_text("lot_value_inr").alias("money"),
                    lakhs_text("lot_value_inr").alias("lakhs"), thousands_text("lot_value_inr").alias("thousands"),
                    pct_text("pct_shelf_remaining").alias("pct"))


@query("series_lists")
def q_series_lists(spark, d):
    return FE.series_lists(FE.tail_rows(V.demand(_t(spark, d), P).select("sku_id", "warehouse_id", "date", "actual_demand_kg"), 14))


@query("inventory_recommendations")
def q_inventory_recommendations(spark, d):
    t = _t(spark, d)
    return FC.inventory_recommendations(V.demand(t, P), V.sku_dim(t), P)


@query("history_and_forecast")
def q_history_and_forecast(spark, d):
    dm = _grid(_t(spark, d))
    return FC.history_and_forecast(dm, FC.heuristic_forecast(dm, P), P)


@query("naive_mape_by_sku")
def q_naive_mape_by_sku(spark, d):
    return FC.naive_mape_by_sku(V.demand(_t(spark, d), P), P).orderBy("mape", "sku_id")


@query("mape_summary")
def q_mape_summary(spark, d):
    return FC.mape_summary(FC.naive_mape_by_sku(V.demand(_t(spark, d), P), P))


@query("mape_histogram")
def q_mape_histogram(spark, d):
    return FC.mape_histogram(FC.naive_mape_by_sku(V.demand(_t(spark, d), P), P))


@query("d_regression_metrics")
def q_regression_metrics(spark, d):
    pr = FC.naive_predictions(V.demand(_t(spark, d), P), P)
    return FC.regression_metrics(pr, "actual", "pred_ma7")


# ------------------------------------------------------------------ tier D batch operators
def _stock_at_year_end(t):
    return PL.stock_by_series(V.active_lots(t, V.bounds(t, P)[1]))


@query("d_dedup_lines")
def q_d_dedup_lines(spark, d):
    return PL.dedup_lines(_t(spark, d).lineitem)


@query("d_missing_fill")
def q_d_missing_fill(spark, d):
    return PL.fill_missing(V.demand(_t(spark, d), P))


@query("d_validation")
def q_d_validation(spark, d):
    return PL.validate_lots(V.lots(_t(spark, d)))


@query("d_stock_aware_purchase")
def q_d_stock_aware_purchase(spark, d):
    t = _t(spark, d)
    return PL.stock_aware_purchase(FC.heuristic_forecast(V.demand(t, P), P), _stock_at_year_end(t))


@query("d_stockout_rate")
def q_d_stockout_rate(spark, d):
    t = _t(spark, d)
    start, end = V.bounds(t, P)
    lo = V.lots(t, start - dt.timedelta(days=0 if P.fiscal_year is None else V.longest_shelf_life(t)), end + dt.timedelta(days=1))
    return PL.stockout_rate(V.with_series_attributes(t, PL.stock_events(lo)), start, end)


@query("d_overview_counts")
def q_d_overview_counts(spark, d):
    t = _t(spark, d)
    return PL.overview_counts(V.active_lots(t, P.as_of), V.demand(t, P))


@query("d_net_wastage_saved")
def q_d_net_wastage_saved(spark, d):
    return PL.net_wastage_saved(V.fy_lots(_t(spark, d), P, warehouse=False))


@query("d_over_order_factor")
def q_d_over_order_factor(spark, d):
    t = _t(spark, d)
    return PL.over_order_factor(FC.heuristic_forecast(V.demand(t, P), P), _stock_at_year_end(t))


@query("d_target_encoding")
def q_d_target_encoding(spark, d):
    return PL.target_encoding(with_split(V.lots(_t(spark, d)), P.spoil_test_fraction))


@query("d_discount_rule")
def q_d_discount_rule(spark, d):
    return PL.discount_rule(V.active_lots(_t(spark, d), P.as_of, full=True))


@query("d_approval_flags")
def q_d_approval_flags(spark, d):
    return PL.approval_flags(V.demand(_t(spark, d), P), P)


@query("d_sensor_gaps")
def q_d_sensor_gaps(spark, d):
    return PL.sensor_gaps(V.sensor_readings(_t(spark, d)), P.sensor_gap_minutes)


@query("d_sensor_offline")
def q_d_sensor_offline(spark, d):
    r = V.sensor_readings(_t(spark, d))
    return PL.sensor_offline(r, PL.sensor_gaps(r, P.sensor_gap_minutes))


@query("d_cold_start")
def q_d_cold_start(spark, d):
    return PL.cold_start_levels(V.demand(_t(spark, d), P), P)


@query("d_disruption_override")
def q_d_disruption_override(spark, d):
    t = _t(spark, d)
    return PL.disruption_override(V.demand(t, P), V.fy_lots(t, P), P.disruption_uplift)


@query("d_fifo")
def q_d_fifo(spark, d):
    return PL.fifo_check(V.active_lots(_t(spark, d), P.as_of, full=True))


@query("d_fifo_allocation")
def q_d_fifo_allocation(spark, d):
    a = V.active_lots(_t(spark, d), P.as_of, full=True)
    out = a.where("dispatched").select("sku_id", "warehouse_id", F.col("lot_id").alias("dispatch_id"), F.col("expiry_date").alias("dispatch_date"), F.col("quantity_kg").alias("kg"))
    got = PL.fifo_allocation(a, out)
    return got.select("sku_id", "warehouse_id", "dispatch_id", "lot_id", r2("kg").alias("kg"), F.coalesce(F.col("dispatch_id") != F.col("lot_id"), F.lit(True)).alias("other_lot"))


@query("d_supplier_degradation")
def q_d_supplier_degradation(spark, d):
    return PL.supplier_degradation(V.lots(_t(spark, d), warehouse=False))


@query("d_naive_baselines")
def q_d_naive_baselines(spark, d):
    return PL.naive_baselines_by_series(V.demand(_t(spark, d), P), P)


@query("d_demand_growth")
def q_d_demand_growth(spark, d):
    return PL.demand_growth(V.demand(_t(spark, d), P), P)


@query("d_season_features")
def q_d_season_features(spark, d):
    return FE.season_features(V.demand(_t(spark, d), P))


@query("d_category_newsvendor")
def q_d_category_newsvendor(spark, d):
    return PL.category_newsvendor(V.demand(_t(spark, d), P), P)


@query("d_unconstrained_demand")
def q_d_unconstrained_demand(spark, d):
    return PL.unconstrained_demand(_t(spark, d).events)


@query("d_scenario_value")
def q_d_scenario_value(spark, d):
    return PL.scenario_value(V.lots(_t(spark, d)))


# ------------------------------------------------------------------ streaming (availableNow -> Parquet sink)
@query("stream_lot_alerts")
def q_stream_lot_alerts(spark, d):
    return ST.run(ST.lot_alerts(ST.stream_table(spark, d, "lineitem", ST.BATCH_BYTES), _t(spark, d)), "lot_alerts")


@query("stream_tier_changes")
def q_stream_tier_changes(spark, d):
    t = _t(spark, d)
    far = {"l_shipdate": dt.datetime(2200, 1, 1), "l_orderkey": -1, "l_linestatus": "O", "l_linenumber": 0, "l_partkey": t.part.agg(F.min("p_partkey")).first()[0]}
    got = ST.run_bounded(ST.stream_table(spark, d, "lineitem"), lambda li: TI.tier_changes(ST.lot_readings(li, t), buckets=TI.buckets_for(t.row_count("lineitem"))), "tier_changes", flush_row=far)
    return got.where("not startswith(lot_id, '-1-')")


@query("stream_dedup_events")
def q_stream_dedup_events(spark, d):
    return ST.run_bounded(ST.stream_table(spark, d, "events"), ST.dedup_events, "dedup_events").where("event_type <> 'flush'")


@query("stream_daily_kpi")
def q_stream_daily_kpi(spark, d):
    return ST.run_bounded(ST.stream_table(spark, d, "events"), ST.daily_kpis, "daily_kpi")


@query("stream_coldchain_windows")
def q_stream_coldchain(spark, d):
    return ST.run_bounded(ST.stream_table(spark, d, "events"), ST.coldchain_windows, "coldchain")


@query("stream_sensor_sessions")
def q_stream_sensor_sessions(spark, d):
    return ST.run_bounded(ST.stream_table(spark, d, "events"), ST.sensor_sessions, "sensor_sessions")


@query("stream_dedup_readings")
def q_stream_dedup(spark, d):
    return ST.run_bounded(ST.stream_table(spark, d, "events"), ST.dedup_readings, "dedup_readings")


# ------------------------------------------------------------------ model layer that SQL can repeat
@query("series_rows")
def q_series_rows(spark, d):
    return FE.series_rows(V.demand(_t(spark, d), P))


@query("spoilage_features")
def q_spoilage_features(spark, d):
    lo = M.encoded(M.encoded(V.lots(_t(spark, d)), "category", "category_enc"), "warehouse_id", "warehouse_enc")
    return lo.select("lot_id", *C.SPOILAGE_FEATURES)


@query("spoilage_split")
def q_spoilage_split(spark, d):
    lo = M.with_split(V.lots(_t(spark, d), warehouse=False), P.spoil_test_fraction)
    return lo.groupBy("did_spoil", "is_train").agg(F.count("*").alias("n_lots"))


@query("class_weights")
def q_class_weights(spark, d):
    labels = stash(V.lots(_t(spark, d), warehouse=False).select("lot_id", "did_spoil"), "lot-labels")  # read by split, weights and counts
    lo = M.balanced_weights(M.with_split(labels, P.spoil_test_fraction).filter("is_train"))
    return lo.groupBy("did_spoil").agg(r4(F.max("class_weight")).alias("class_weight"), F.count("*").alias("n_train"))


def _ruled(spark, d):
    """Lots with the rule 'spoils when its probability is at least one half'."""
    return V.lots(_t(spark, d), warehouse=False).withColumn("prediction", (F.col("spoil_prob") >= 0.5).cast("double"))


@query("rule_metrics")
def q_rule_metrics(spark, d):
    return M.classification_metrics(_ruled(spark, d))


@query("rule_confusion")
def q_rule_confusion(spark, d):
    return M.confusion_matrix(_ruled(spark, d))


@query("naive_actual_vs_predicted")
def q_naive_actual_vs_predicted(spark, d):
    pr = FC.naive_predictions(V.demand(_t(spark, d), P), P).withColumnRenamed("pred_ma7", "predicted")
    return M.actual_vs_predicted(pr)


# ------------------------------------------------------------------ ML (rows-only checks)
def _spoil(spark, d):
    return M.train_spoilage_model(V.lots(_t(spark, d)), P, cache_key=(d, P))


def _demand_model(spark, d, grid=None):
    return M.train_demand_model(V.demand(_t(spark, d), P) if grid is None else grid, P, cache_key=(d, P))


@query("spoilage_model_metrics")
def q_spoilage_model_metrics(spark, d):
    return M.classification_metrics(_spoil(spark, d)[1])


@query("confusion_matrix")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(_spoil(spark, d)[1])


@query("feature_importance")
def q_feature_importance(spark, d):
    return M.feature_importance(_spoil(spark, d)[0], spark)


@query("demand_model_mape")
def q_demand_model_mape(spark, d):
    return M.demand_model_mape(_demand_model(spark, d)[1]).orderBy("mape", "sku_id")


@query("actual_vs_predicted")
def q_actual_vs_predicted(spark, d):
    return M.actual_vs_predicted(_demand_model(spark, d)[1])


@query("recursive_forecast")
def q_recursive_forecast(spark, d):
    dm = _grid(_t(spark, d))
    return M.generate_forecast(_demand_model(spark, d, dm)[0], dm, P)


#: a small ensemble per SKU that SQL can grow as well
SMALL = {"trees": 2, "depth": 2, "bins": 16}


@query("sku_model_mape")
def q_sku_model_mape(spark, d):
    return M.demand_model_mape(M.train_sku_models(V.demand(_t(spark, d), P), P, cache_key=(d, P))[1]).orderBy("mape", "sku_id")


@query("sku_model_forecast")
def q_sku_model_forecast(spark, d):
    dm = _grid(_t(spark, d))
    f = M.recursive_forecast_by_sku(M.train_sku_models(dm, P, cache_key=(d, P))[0], dm, P, P.gbt_depth)
    return FC.forecast_band(f.join(FC.series_state(dm, P).select(*FE.SERIES, "sigma"), FE.SERIES), P)


@query("sku_small_model_mape")
def q_sku_small_model_mape(spark, d):
    return M.demand_model_mape(M.train_sku_models(V.demand(_t(spark, d), P), P, **SMALL, cache_key=(d, P))[1])


@query("sku_small_model_forecast")
def q_sku_small_model_forecast(spark, d):
    dm = V.demand(_t(spark, d), P)
    model = M.train_sku_models(dm, P, **SMALL, cache_key=(d, P))[0]
    f = M.recursive_forecast_by_sku(model, dm, P, SMALL["depth"], SMALL["bins"])
    return f.select("sku_id", "warehouse_id", "step", "date", r4("_f").alias("forecast_kg"))


@query("score_active_lots")
def q_score_active_lots(spark, d):
    return M.score_active_lots(_spoil(spark, d)[0], V.active_lots(_t(spark, d), P.as_of, full=True))


def queries() -> dict[str, QueryFn]:
    return dict(REGISTRY)
