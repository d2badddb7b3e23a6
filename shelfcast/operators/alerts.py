"""Lot-level risk, alert and schedule operators (B5-B14, O1, O3, A4, A5,
A11, A12, P3-P5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import money_text, r2, risk_label, tier_rank

HIGH_RISK = ["CRITICAL", "HIGH"]


# ------------------------------------------------------------------ B6-B9
def lot_freshness(lots: DataFrame) -> DataFrame:
    """B6."""
    return lots.select("lot_id", "procurement_date", "effective_shelf_life", "expiry_date",
                       "age_pct", "days_to_expiry")


def lot_financials(lots: DataFrame) -> DataFrame:
    """B7."""
    return lots.select("lot_id", "quantity_kg", "price_per_kg", "lot_value", "spoilage_pct",
                       "spoiled_kg", "spoiled_value")


def spoilage_probability(lots: DataFrame) -> DataFrame:
    """B8."""
    return lots.select("lot_id", "category", F.round("spoil_prob", 6).alias("spoil_prob"), "did_spoil")


def lot_risk_score(lots: DataFrame) -> DataFrame:
    """B9."""
    return lots.select("lot_id", "age_pct", "temp_deviation_c", "category", "risk_score")


# ------------------------------------------------------------------ B5
def procurement_schedule(series: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One procurement every max(1, shelf_life // 2) days per series,
    generated by a per-row ``sequence`` (no join)."""
    step = F.greatest(F.lit(1), F.floor(F.col("shelf_life_days") / 2).cast("int"))
    days = F.sequence(F.lit(start), F.lit(end), F.make_dt_interval(step))
    return series.select("sku_id", "warehouse_id", "shelf_life_days",
                         step.alias("interval_days"), F.explode(days).alias("procurement_date"))


# ------------------------------------------------------------------ O1, A4, A5, A11, A12
def sorted_active(active: DataFrame) -> DataFrame:
    """O1: by risk score descending (lot id as tie-break)."""
    return active.orderBy(F.desc("risk_score"), "lot_id")


def risk_level_counts(active: DataFrame) -> DataFrame:
    """A11 with O5 ordering."""
    return (active.groupBy("risk_level").agg(F.count("*").alias("lot_count"))
            .withColumn("level_rank", tier_rank("risk_level"))
            .orderBy("level_rank"))


def risk_level_summary(active: DataFrame) -> DataFrame:
    """A5 + A4: one row of counts per level and the value at risk."""
    lvl = F.col("risk_level")
    return active.agg(
        *[F.count_if(lvl == x).alias(f"n_{x.lower()}") for x in C.RISK_LEVELS],
        r2(F.coalesce(F.sum(F.when(lvl.isin(HIGH_RISK), F.col("lot_value_inr"))), F.lit(0.0)))
        .alias("value_at_risk"))


def value_at_risk_by_category(active: DataFrame) -> DataFrame:
    """A12 (P3 filter + grouped sum), ascending."""
    return (active.filter(F.col("risk_level").isin(HIGH_RISK)).groupBy("category")
            .agg(r2(F.sum("lot_value_inr")).alias("lot_value_inr"))
            .orderBy("lot_value_inr", "category"))


# ------------------------------------------------------------------ O3, P5
def top_critical_alerts(active: DataFrame, k: int = 5) -> DataFrame:
    """O3: the first ``k`` CRITICAL lots in alert order (a top-k report:
    TakeOrderedAndProject, no global sort)."""
    return (active.filter(F.col("risk_level") == "CRITICAL")
            .orderBy(F.desc("risk_score"), "lot_id", "quantity_kg", "lot_value_inr")
            .limit(k)
            .select("lot_id", "sku_name", "category", "warehouse_name", "days_remaining",
                    "quantity_kg", money_text("lot_value_inr").alias("value_text"),
                    "temp_deviation_c", "recommended_action"))


def alert_table(active: DataFrame, levels=C.DEFAULT.alert_filter) -> DataFrame:
    """P5 + F2 + F3: the filtered alert table with display columns."""
    f = active.filter(F.col("risk_level").isin(list(levels)))
    return f.select(
        F.col("lot_id"), F.col("sku_name").alias("sku"), "category",
        F.col("warehouse_name").alias("warehouse"),
        F.col("days_remaining").cast("int").alias("days_left"),
        F.col("pct_shelf_remaining").alias("pct_shelf_life_left"),
        F.round("quantity_kg", 1).alias("qty_kg"),
        money_text("lot_value_inr").alias("value_text"),
        F.col("risk_score").cast("int").alias("risk_score"),
        risk_label("risk_level").alias("risk_label"),
        "recommended_action")
