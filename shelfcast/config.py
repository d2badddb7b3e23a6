"""Configuration: fixed values that must equal the source domain's, and the
tunable parameters (one object, so thresholds are not scattered literals)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# FIXED VALUES (domain constants; results depend on them exactly)
# --------------------------------------------------------------------------

# Product categories, indexed by brand number % 5.
CATEGORIES = ["Leafy Vegetables", "Other Vegetables", "Root Vegetables", "Dairy", "Meat & Poultry"]

# Ideal storage temperature (C) per category, same order as CATEGORIES.
CATEGORY_IDEAL_TEMP = [4, 10, 12, 4, 2]

# Base spoilage rate per category; unknown categories use the default.
CATEGORY_BASE_SPOIL = {
    "Leafy Vegetables": 0.22,
    "Other Vegetables": 0.10,
    "Root Vegetables": 0.04,
    "Dairy": 0.12,
    "Meat & Poultry": 0.18,
}
DEFAULT_BASE_SPOIL = 0.10

# Day-of-week demand multipliers, Monday (0) .. Sunday (6).
DOW_MULTIPLIER = [0.75, 0.90, 1.00, 1.05, 1.10, 1.20, 1.15]

# Day names in calendar order (fixed domain for day-of-week patterns).
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Festival calendar: (name, month-day, demand multiplier, window days).
# Dates are moved to each year of the demand view.
FESTIVALS = [
    ("Pongal / Makar Sankranti", "01-15", 1.6, 3),
    ("Republic Day", "01-26", 1.3, 2),
    ("Maha Shivratri", "03-08", 1.5, 2),
    ("Holi", "03-25", 2.0, 3),
    ("Ram Navami", "04-17", 1.4, 2),
    ("Eid ul-Fitr", "04-10", 2.2, 4),
    ("Independence Day", "08-15", 1.4, 2),
    ("Onam", "09-15", 1.7, 5),
    ("Navratri / Durga Puja", "10-03", 1.9, 9),
    ("Diwali", "11-01", 2.5, 5),
    ("Eid ul-Adha", "06-17", 2.0, 3),
    ("Christmas", "12-25", 1.8, 4),
    ("New Year Eve", "12-31", 2.0, 2),
]
FESTIVAL_TAPER = 0.4

# Shelf-life tiers: fraction of shelf life remaining, strict upper bounds.
TIER_CRITICAL = 0.20
TIER_HIGH = 0.40
TIER_MEDIUM = 0.60
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# Score band per tier (high, low), scored linearly in pct inside the band.
RISK_SCORE_BANDS = {"CRITICAL": (99, 82), "HIGH": (81, 62), "MEDIUM": (61, 40), "LOW": (39, 10)}

# Recommended action text and marker per tier.
RISK_ACTIONS = {
    "CRITICAL": "🔴 Redistribute or discount immediately (< 12h)",
    "HIGH": "🟠 Offer 25% discount to bulk buyers today",
    "MEDIUM": "🟡 Prioritise dispatch in next shipment",
    "LOW": "🟢 Monitor — on track for normal dispatch",
}
RISK_EMOJI = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}

# Newsvendor cost of under- and over-ordering (fractions of value).
COST_UNDER = 0.25
COST_OVER = 1.00

# Cap on the reported inventory turnover and the wastage target factor.
TURNOVER_CAP = 68.0
WASTAGE_TARGET_FACTOR = 0.65

# Spoilage-model feature order.
SPOILAGE_FEATURES = ["age_pct", "temp_deviation_c", "over_order_factor", "quantity_kg",
                     "shelf_life_days", "price_per_kg", "category_enc", "warehouse_enc"]

# Demand-model feature order.
DEMAND_FEATURES = ["lag_1", "lag_2", "lag_3", "lag_7", "lag_14",
                   "rolling_7_mean", "rolling_7_std", "rolling_14_mean",
                   "day_of_week", "month", "day_of_year", "is_weekend",
                   "temp_c", "festival_multiplier"]
DEMAND_LAGS = [1, 2, 3, 7, 14]

# Epsilon used as the MAPE divisor floor (float64 machine epsilon).
MAPE_EPS = 2.220446049250313e-16

# --------------------------------------------------------------------------
# Parameters of the views over the driver tables and of the operators
# --------------------------------------------------------------------------

AS_OF = _dt.date(2000, 6, 30)
# Member of a dimension for facts whose key it lacks.
UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class Params:
    fiscal_year: int | None = None  # None: the whole date range of the data
    first_day: _dt.date = _dt.date(1970, 1, 1)  # plausible ship dates: others are
    last_day: _dt.date = _dt.date(2069, 12, 31)  # reported and no part of the demand range
    as_of: _dt.date = AS_OF
    horizon: int = 14
    level_window: int = 30          # last-N rows for mean / std of a series
    trend_window: int = 14          # tail used for the damped trend
    trend_damping: float = 0.3
    history_tail: int = 60
    min_history: int = 30           # series shorter than this get no forecast
    min_feature_rows: int = 50      # series with fewer feature rows get no model
    band_width: float = 1.5
    band_growth: float = 0.04
    cost_under: float = COST_UNDER
    cost_over: float = COST_OVER
    sigma_floor: float = 0.01
    train_fraction: float = 0.85
    min_train_rows: int = 30
    spoil_test_fraction: float = 0.20
    rf_trees: int = 150
    rf_depth: int = 8
    rf_min_leaf: int = 5
    gbt_iters: int = 100
    gbt_depth: int = 4
    gbt_step: float = 0.08
    sku_iters: int = 16             # boosted models per SKU: fewer, larger steps, as
    sku_step: float = 0.35          # each tree is four jobs over all SKUs
    seed: int = 42
    alert_filter: tuple = ("CRITICAL", "HIGH", "MEDIUM")
    top_alerts: int = 5
    sensor_gap_minutes: int = 30
    disruption_uplift: float = 0.20
    approval_tolerance: float = 0.20
    categories_filter: tuple = field(default=("Dairy", "Meat & Poultry"))
    warehouse_filter: str = "ASIA HUB"


DEFAULT = Params()
