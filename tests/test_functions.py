"""Scalar column functions on hand-made values (FIXTURES 4, SURVEY 5.3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import columns as fc
from shelfcast.sources import views as V


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_tier_edges(spark):
    pcts = [0.0, 0.19, 0.20, 0.40, 0.60, 1.0]
    got = _one(spark, fc.risk_tier("p"), [(p,) for p in pcts], "p double")
    assert got == ["CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW"]


def test_tier_score_bands(spark):
    pcts = [0.0, 0.19, 0.2, 0.39, 0.4, 0.59, 0.6, 1.0]
    scores = _one(spark, fc.tier_score("p"), [(p,) for p in pcts], "p double")
    assert scores[0] == 99 and scores[-1] == 10
    bands = [(82, 99), (82, 99), (62, 81), (62, 81), (40, 61), (40, 61), (10, 39), (10, 39)]
    for s, (lo, hi) in zip(scores, bands):
        assert lo <= s <= hi
    assert scores == sorted(scores, reverse=True)


def test_newsvendor_worked_value(spark):
    # mu 100, sigma 10, CR 0.20 -> 100 - 8.416 = 91.6
    got = _one(spark, fc.newsvendor_qty("mu", "s"), [(100.0, 10.0)], "mu double, s double")
    assert got == [91.6]


def test_newsvendor_sigma_floor_and_clamp(spark):
    got = _one(spark, fc.newsvendor_qty("mu", "s"), [(50.0, 0.0), (0.0, 5.0)], "mu double, s double")
    assert got[0] == round(50.0 - 0.8416212335729142 * 0.01, 1)
    assert got[1] == 0.0 and str(got[1]) == "0.0"


def test_critical_ratio_and_z():
    assert fc.critical_ratio() == pytest.approx(0.2)
    assert fc.z_value() == pytest.approx(-0.8416212335729142)


def test_weekday_is_monday_zero(spark):
    d = [(dt.date(2000, 1, 3),), (dt.date(2000, 1, 9),)]  # Monday, Sunday
    assert _one(spark, fc.weekday("d"), d, "d date") == [0, 6]
    assert _one(spark, fc.is_weekend("d"), d, "d date") == [0, 1]
    assert _one(spark, fc.day_name("d"), d, "d date") == ["Monday", "Sunday"]


def test_money_text(spark):
    assert _one(spark, fc.money_text("v"), [(1234567.5,)], "v double") == ["₹1,234,568"]


def test_festival_taper_and_window_edge(spark):
    # Holi 2000-03-25, mult 2.0, window 3: delta 3 -> 2.0 * (1 - 3/4 * 0.4) = 1.4; delta 4 -> 1.0
    days = [(dt.date(2000, 3, 25),), (dt.date(2000, 3, 28),), (dt.date(2000, 3, 29),)]
    df = V.with_festival(spark.createDataFrame(days, "date date"), V.festival_dim(spark, (2000,)), "date", "m")
    got = {r["date"]: r["m"] for r in df.collect()}
    assert got[dt.date(2000, 3, 25)] == pytest.approx(2.0)
    assert got[dt.date(2000, 3, 28)] == pytest.approx(1.4)
    assert got[dt.date(2000, 3, 29)] == pytest.approx(1.0)


def test_overlapping_festivals_max_wins(spark):
    # Eid ul-Fitr 04-10 (2.2, w4) and Ram Navami 04-17 (1.4, w2) do not overlap;
    # 04-13: Eid delta 3 -> 2.2*(1-3/5*0.4)=1.672 ; Christmas/New Year Eve overlap on 12-29..12-31.
    days = [(dt.date(2000, 12, 29),), (dt.date(2000, 4, 13),)]
    df = V.with_festival(spark.createDataFrame(days, "date date"), V.festival_dim(spark, (2000,)), "date", "m")
    got = {r["date"]: r["m"] for r in df.collect()}
    christmas = 1.8 * (1 - 4 / 5 * 0.4)
    new_year = 2.0 * (1 - 2 / 3 * 0.4)
    assert got[dt.date(2000, 12, 29)] == pytest.approx(max(christmas, new_year))
    assert got[dt.date(2000, 4, 13)] == pytest.approx(2.2 * (1 - 3 / 5 * 0.4))


def test_lookup_default(spark):
    c = fc.lookup({"a": 1.0}, "k", 0.1)
    assert _one(spark, c, [("a",), ("zz",)], "k string") == [1.0, 0.1]


def test_rounding_is_half_up_with_nudge(spark):
    got = _one(spark, fc.rnd("x", 2), [(2.675,), (0.125,)], "x double")
    assert got == [2.68, 0.13]
    assert _one(spark, F.round("x", 2), [(0.125,)], "x double") == [0.13]


def test_norm_ppf_udf_matches_stdlib(spark):
    import statistics
    from shelfcast.functions.udfs import norm_ppf
    vals = [0.2, 0.2, 0.5, 0.975, 0.01]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "p double").select(norm_ppf("p")).collect()]
    assert got == [statistics.NormalDist().inv_cdf(v) for v in vals]


def test_category_newsvendor_per_row_z_matches_folded(spark):
    from shelfcast.operators import planning as PL
    from shelfcast.sources import views as V
    from shelfcast.sources.tables import Tables
    from .conftest import SF001
    dm = V.demand(Tables(spark, SF001))
    a = sorted(map(tuple, PL.category_newsvendor(dm).collect()))
    b = sorted(map(tuple, PL.category_newsvendor(dm, per_row_z=True).collect()))
    assert a == b
