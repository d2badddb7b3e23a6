"""Operators on any lots frame.

Each adds columns to a frame that has the columns its docstring names (the
reader of ``sources.tables.load_lots`` gives them); none knows where the frame
comes from. Null inputs give null outputs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import clip, lookup, recommended_action, risk_tier, rnd, sigmoid, tier_score


def with_effective_life(lots: DataFrame) -> DataFrame:
    """effective_shelf_life from shelf_life_days and temp_deviation_c: 0.4
    days less for each degree, one day at least."""
    life = F.col("shelf_life_days") - F.floor(F.col("temp_deviation_c") * F.lit(0.4)).cast("int")
    return lots.withColumn("effective_shelf_life", F.when(life.isNotNull(), F.greatest(F.lit(1), life)).cast("int"))


def with_freshness(lots: DataFrame, as_of: dt.date | None = None, age_days: Column | None = None) -> DataFrame:
    """expiry_date, age (share of the effective life used, at most 1),
    age_pct and days_to_expiry, from procurement_date and
    effective_shelf_life, on the day ``as_of`` or at ``age_days``."""
    if (as_of is None) == (age_days is None):
        raise ValueError("give as_of or age_days")
    days = age_days if age_days is not None else F.datediff(F.lit(as_of), F.col("procurement_date"))
    life = F.col("effective_shelf_life")
    share = days / life
    age = F.when(share.isNotNull(), F.least(F.lit(1.0), share))
    return (lots.withColumn("expiry_date", F.date_add("procurement_date", life)).withColumn("age", age)
            .withColumn("age_pct", rnd("age", 2)).withColumn("days_to_expiry", (life - days).cast("int")))


def with_financials(lots: DataFrame) -> DataFrame:
    """lot_value, spoiled_kg and spoiled_value from quantity_kg,
    price_per_kg and spoilage_pct (a fraction)."""
    return (lots.withColumn("lot_value", rnd(F.col("quantity_kg") * F.col("price_per_kg"), 2))
            .withColumn("spoiled_kg", rnd(F.col("quantity_kg") * F.col("spoilage_pct"), 1))
            .withColumn("spoiled_value", rnd(F.col("spoiled_kg") * F.col("price_per_kg"), 2)))


def _category_rate() -> Column:
    return lookup(C.CATEGORY_BASE_SPOIL, "category", C.DEFAULT_BASE_SPOIL)


def with_spoilage_probability(lots: DataFrame, over_order: Column | None = None) -> DataFrame:
    """spoil_prob from age (else age_pct), temp_deviation_c,
    over_order_factor and category."""
    age = F.col("age" if "age" in lots.columns else "age_pct")
    over = over_order if over_order is not None else F.col("over_order_factor")
    x = (age * 2.5 + F.col("temp_deviation_c") / 6.0 * 1.8 + (over - 1.0) * 0.6 + _category_rate() * 1.5)
    return lots.withColumn("spoil_prob", F.when(x.isNotNull(), clip(sigmoid((x - 2.0) * 2.5), 0.02, 0.95)))


def with_risk_score(lots: DataFrame) -> DataFrame:
    """risk_score 0-100 from age (else age_pct), temp_deviation_c and category."""
    age = F.col("age" if "age" in lots.columns else "age_pct")
    risk = F.floor(age * 45 + F.col("temp_deviation_c") * 7 + _category_rate() * 80)
    return lots.withColumn("risk_score", F.when(risk.isNotNull(), clip(risk, 0, 100)).cast("int"))


def shelf_remaining(lots: DataFrame, as_of: dt.date) -> DataFrame:
    """days_remaining and _pct of the base shelf life left on ``as_of``,
    from procurement_date and shelf_life_days."""
    old = F.datediff(F.lit(as_of), F.col("procurement_date"))
    return (lots.withColumn("days_remaining", (F.col("shelf_life_days") - old).cast("int"))
            .withColumn("_pct", F.col("days_remaining") / F.col("shelf_life_days")))


def active_lots(lots: DataFrame, as_of: dt.date) -> DataFrame:
    """Lots in stock on ``as_of``, with tier, in-band score and action;
    needs the columns of B10 and lot_value."""
    a = shelf_remaining(lots, as_of).where((F.col("procurement_date") <= F.lit(as_of)) & (F.col("days_remaining") >= 0))
    return (a.withColumn("risk_level", risk_tier("_pct"))
            .withColumn("risk_score", tier_score("_pct"))
            .withColumn("pct_shelf_remaining", rnd(F.col("_pct") * 100.0, 1))
            .withColumn("recommended_action", recommended_action("risk_level"))
            .withColumn("lot_value_inr", F.col("lot_value"))
            .withColumn("expiry_date", F.date_add("procurement_date", F.col("shelf_life_days"))))


def split_valid(lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: (good, bad) lots; the bad ones with the names of the rules they
    break in ``broken``."""
    from .planning import broken_rules
    tagged = lots.withColumn("broken", broken_rules())
    return tagged.where(F.size("broken") == 0).drop("broken"), tagged.where(F.size("broken") > 0)
