"""FIXTURES.md section 3 trial results and SURVEY 7.7, reproduced."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shelfcast import config as C
from shelfcast.sources import views as V
from shelfcast.sources.tables import Tables

from .conftest import SF001, SF01

TRIAL = {
    SF001: dict(lots=6000, spoiled=2649, active=25, fy_lines=907, filled=892, series=125),
    SF01: dict(lots=60000, spoiled=25806, active=225, fy_lines=8762, filled=7920, series=125),
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_trial_counts(spark, sf):
    t = Tables(spark, sf)
    exp = TRIAL[sf]
    lo = V.lots(t).agg(F.count("*").alias("n"), F.sum("did_spoil").alias("s")).first()
    assert (lo["n"], lo["s"]) == (exp["lots"], exp["spoiled"])
    assert V.active_lots(t).count() == exp["active"]
    year = dataclasses.replace(C.DEFAULT, fiscal_year=2000)
    assert V.fy_lots(t, year).count() == exp["fy_lines"]
    assert V.demand(t, year).filter("sold_kg is not null").count() == exp["filled"]
    assert V.series(V.demand_facts(t)).count() == exp["series"]
    first, last = V.bounds(t)
    assert V.demand(t).count() == exp["series"] * ((last - first).days + 1)
    assert V.demand(t).agg(F.sum("sold_kg")).first()[0] == t.lineitem.agg(F.sum("l_quantity")).first()[0]


def test_forecast_starts_after_the_last_day(spark):
    fc = E.queries()["heuristic_forecast"](spark, SF01)
    assert fc.count() == 1750
    assert fc.agg(F.min("date")).first()[0] == V.bounds(Tables(spark, SF01))[1] + dt.timedelta(days=1)
    assert fc.filter(F.col("optimal_order") > 0).count() > 1500
