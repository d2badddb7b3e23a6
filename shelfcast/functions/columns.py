"""Scalar column functions (F1-F22, B11-B13, B15 helpers).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# Rounding nudge: half-up rounding that agrees between engines on values that
# sit at a decimal tie but are stored a hair below it in binary.
NUDGE = 1e-9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, n: int = 0) -> Column:
    """Half-up round with the tie nudge."""
    return F.round(col(c) + F.lit(NUDGE), n)


def r4(c) -> Column:
    """Report precision for ratios and means (stable across engines)."""
    return rnd(c, 4)


def r2(c) -> Column:
    """Report precision for money and kg sums."""
    return rnd(c, 2)


def clamp0(c) -> Column:
    """Non-negative clamp (P12); ``+ 0.0`` turns a -0.0 into 0.0."""
    return F.greatest(col(c), F.lit(0.0)) + F.lit(0.0)


def clip(c, lo, hi) -> Column:
    """F14."""
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def sigmoid(c) -> Column:
    """F16."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def lookup(keys_values: dict, c, default=None) -> Column:
    """Key -> value lookup with a default (J4, F20) as a literal map."""
    m = F.create_map(*[F.lit(x) for kv in keys_values.items() for x in kv])
    v = F.try_element_at(m, col(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def pick(values: list, idx0) -> Column:
    """0-based positional lookup into a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), col(idx0).cast("int") + 1)


# ---------------------------------------------------------------- calendar
def weekday(d) -> Column:
    """Monday = 0 .. Sunday = 6 (F9; not ``dayofweek`` which is Sunday = 1)."""
    return F.weekday(col(d))


def day_name(d) -> Column:
    return F.date_format(col(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(col(d), "MMM")


def is_weekend(d) -> Column:
    return (F.weekday(col(d)) >= 5).cast("int")


def dow_multiplier(d) -> Column:
    return pick(C.DOW_MULTIPLIER, weekday(d))


# ---------------------------------------------------------------- tiers
def risk_tier(pct) -> Column:
    """Strict thresholds on the fraction of shelf life remaining."""
    p = col(pct)
    return (F.when(p < C.TIER_CRITICAL, "CRITICAL")
            .when(p < C.TIER_HIGH, "HIGH")
            .when(p < C.TIER_MEDIUM, "MEDIUM")
            .otherwise("LOW"))


def tier_rank(level) -> Column:
    """Custom order CRITICAL < HIGH < MEDIUM < LOW."""
    return F.array_position(F.array(*[F.lit(x) for x in C.RISK_LEVELS]), col(level)).cast("int")


def tier_score(pct) -> Column:
    """Score inside the tier's band, linear in pct (high at band start)."""
    p = col(pct)
    edges = [(0.0, C.TIER_CRITICAL, "CRITICAL"), (C.TIER_CRITICAL, C.TIER_HIGH, "HIGH"),
             (C.TIER_HIGH, C.TIER_MEDIUM, "MEDIUM"), (C.TIER_MEDIUM, 1.0, "LOW")]

    def band(lo, hi, lvl):
        top, bottom = C.RISK_SCORE_BANDS[lvl]
        frac = (p - F.lit(lo)) / F.lit(round(hi - lo, 12))
        return (F.lit(top) - F.floor(frac * F.lit(float(top - bottom)) + F.lit(NUDGE))).cast("int")

    out = None
    for lo, hi, lvl in edges[:-1]:
        out = (F.when(p < hi, band(lo, hi, lvl)) if out is None else out.when(p < hi, band(lo, hi, lvl)))
    return out.otherwise(band(*edges[-1]))


def recommended_action(level) -> Column:
    """B13."""
    return lookup(C.RISK_ACTIONS, level)


def risk_label(level) -> Column:
    """marker + level text."""
    return F.concat_ws(" ", lookup(C.RISK_EMOJI, level), col(level))


# ---------------------------------------------------------------- text
def money_text(c) -> Column:
    """rupee amount with thousands separators, no decimals."""
    return F.concat(F.lit("₹"), F.format_number(rnd(c, 0).cast("bigint"), 0))


def lakhs_text(c) -> Column:
    return F.concat(F.lit("₹"), F.format_string("%.1f", rnd(col(c) / F.lit(1e5), 1)), F.lit("L"))


def thousands_text(c) -> Column:
    """rupee amount in thousands, no decimals ("K")."""
    return F.concat(F.lit("₹"), F.format_string("%.0f", rnd(col(c) / F.lit(1e3), 0)), F.lit("K"))


def lot_code(n) -> Column:
    """zero-padded lot code."""
    return F.format_string("LOT%04d", col(n))


def pct_text(c) -> Column:
    return F.concat(F.format_string("%.1f", rnd(c, 1)), F.lit("%"))


# ---------------------------------------------------------------- newsvendor
def critical_ratio(cu: float = C.COST_UNDER, co: float = C.COST_OVER) -> float:
    return cu / (cu + co)


def z_value(cu: float = C.COST_UNDER, co: float = C.COST_OVER) -> float:
    """inverse normal CDF at the critical ratio, folded on the driver
    (a constant, not per row)."""
    return statistics.NormalDist().inv_cdf(critical_ratio(cu, co))


def newsvendor_qty(mu, sigma, z=None, sigma_floor: float = 0.01) -> Column:
    """max(0, round(mu + z * max(sigma, floor), 1)); ``z`` may be a float
    or a column (per-row cost ratios)."""
    zc = F.lit(z_value() if z is None else z) if not isinstance(z, Column) else z
    q = col(mu) + zc * F.greatest(col(sigma), F.lit(sigma_floor))
    return clamp0(rnd(q, 1))
