"""Domain views over the driver tables (see FIXTURES.md section 2).

* sku attributes are pure functions of ``p_brand`` -> a projection on ``part``
  (no dimension join needed for lots or demand);
* warehouse = region reached through supplier -> nation -> region;
* lots = one row per ``lineitem`` row (J3 star join + B6-B9 projections);
* demand = sums per (date, sku, warehouse), densified per series (J8);
* active lots = lots in stock at ``as_of`` (B10-B14);
* sensor readings = ``events`` with a room and temperature.

All are lazy plans. Date-bounded variants filter the raw ``l_shipdate``
column so the predicate reaches the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import clip, day_name, is_weekend, pick, rnd, weekday
from ..operators import lots as L
from .tables import Tables


def _ts(d: dt.date) -> Column:
    return F.lit(dt.datetime(d.year, d.month, d.day)).cast("timestamp_ntz")


def shipdate_between(lineitem: DataFrame, start: dt.date | None = None,
                     end_exclusive: dt.date | None = None) -> DataFrame:
    """Pushable range filter on the raw ship timestamp, and on the month where
    the table is partitioned by it."""
    months = "ship_month" in lineitem.columns
    if start is not None:
        lineitem = lineitem.filter(F.col("l_shipdate") >= _ts(start))
        lineitem = lineitem.filter(F.col("ship_month") >= start.year * 100 + start.month) if months else lineitem
    if end_exclusive is not None:
        last = end_exclusive - dt.timedelta(days=1)
        lineitem = lineitem.filter(F.col("l_shipdate") < _ts(end_exclusive))
        lineitem = lineitem.filter(F.col("ship_month") <= last.year * 100 + last.month) if months else lineitem
    return lineitem


# ------------------------------------------------------------------ dimensions
def brand_number(brand="p_brand") -> Column:
    """Null for a brand without a number (the member UNKNOWN, foreign names)."""
    return F.substring(F.col(brand), 7, 8).try_cast("int")


def sku_attrs(brand: str = "p_brand") -> dict[str, Column]:
    """SKU attributes derived from the brand (FIXTURES 2: sku), by name."""
    bn = brand_number(brand)
    cat_idx = bn % 5
    return {
        "sku_id": F.col(brand),
        "sku_name": F.col(brand),
        "category": F.when(bn.isNotNull(), pick(C.CATEGORIES, cat_idx)),
        "shelf_life_days": (F.lit(2) + bn % 14).cast("int"),
        "ideal_temp_c": F.when(bn.isNotNull(), pick(C.CATEGORY_IDEAL_TEMP, cat_idx)).cast("int"),
        "price_per_kg": (F.lit(20) + F.lit(17) * bn).cast("double"),
        "base_demand": (F.lit(10) + F.lit(3) * bn).cast("double"),
    }


def sku_columns(brand: str = "p_brand") -> list[Column]:
    return [c.alias(n) for n, c in sku_attrs(brand).items()]


def part_skus(t: Tables) -> DataFrame:
    """p_partkey -> sku attributes: a projection, or a join of the caller's
    own sku dimension (``Tables(skus=...)``)."""
    if t.skus is None:
        return t.part.select("p_partkey", *sku_columns())
    return t.part.select("p_partkey", F.col("p_brand").alias("sku_id")).join(t.skus.select(*sku_attrs()), "sku_id", "left")


def sku_dim(t: Tables) -> DataFrame:
    """S6 sku dimension: one row per brand (partial + final distinct), or the
    caller's own."""
    return t.part.select("p_brand").distinct().select(*sku_columns()) if t.skus is None else t.skus.select(*sku_attrs())


def warehouse_dim(t: Tables) -> DataFrame:
    """S6 warehouse dimension: one row per region, or the caller's own."""
    if t.warehouses is not None:
        return t.warehouses.select("warehouse_id", "warehouse_name", "city")
    return t.region.select(F.col("r_name").alias("warehouse_id"),
                           F.concat(F.col("r_name"), F.lit(" HUB")).alias("warehouse_name"),
                           F.col("r_name").alias("city"))


def supplier_warehouse(t: Tables) -> DataFrame:
    """s_suppkey -> warehouse. nation (25 rows) and region (5 rows) are
    fixed-size TPC-H dimensions; Catalyst broadcasts them by size."""
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("n_nationkey", "r_name")
    out = (t.supplier.select("s_suppkey", "s_nationkey")
           .join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
           .select("s_suppkey", F.col("r_name").alias("warehouse_id"),
                   F.concat(F.col("r_name"), F.lit(" HUB")).alias("warehouse_name")))
    if t.warehouses is None:
        return out
    return out.drop("warehouse_name").join(t.warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id", "left")


def festival_dim(spark, years: tuple[int, ...]) -> DataFrame:
    """S6 default festival calendar in each of ``years`` (13 rows a year)."""
    rows = [(n, dt.date.fromisoformat(f"{y}-{md}"), float(m), int(w)) for y in years for n, md, m, w in C.FESTIVALS]
    return spark.createDataFrame(rows, "name string, date date, demand_multiplier double, window_days int")


def years_of(start: dt.date, end: dt.date) -> tuple[int, ...]:
    """Calendar years whose festivals can reach a day of the range."""
    return tuple(range(start.year - 1, end.year + 2))


def festival_days(f: DataFrame) -> DataFrame:
    """J2 as an equi-join table: each festival of a calendar (date,
    demand_multiplier, window_days) exploded to the days of its window with
    the tapered multiplier, max over overlapping festivals."""
    days = f.select("demand_multiplier", "window_days", "date",
                    F.explode(F.sequence(F.date_sub("date", F.col("window_days")),
                                         F.date_add("date", F.col("window_days")))).alias("day"))
    delta = F.abs(F.datediff("day", "date"))
    val = F.col("demand_multiplier") * (F.lit(1.0) - delta / (F.col("window_days") + 1) * F.lit(C.FESTIVAL_TAPER))
    return days.groupBy("day").agg(F.max(val).alias("fest_mult"))


def with_festival(df: DataFrame, festivals: DataFrame, date_col: str = "date", out: str = "festival_multiplier") -> DataFrame:
    """B2: max(1.0, best festival match) per row, by an equi join. A calendar
    of the caller's own is joined as Spark sees fit."""
    fd = festival_days(festivals).withColumnRenamed("day", "_fday")
    return (df.join(fd, F.col(date_col) == F.col("_fday"), "left")
            .withColumn(out, F.greatest(F.lit(1.0), F.coalesce(F.col("fest_mult"), F.lit(1.0))))
            .drop("_fday", "fest_mult"))


# ------------------------------------------------------------------ lines + dims
def lines(t: Tables, start: dt.date | None = None, end_exclusive: dt.date | None = None,
          lineitem_df: DataFrame | None = None, warehouse: bool = True) -> DataFrame:
    """lineitem x part attributes x supplier warehouse (J3, left joins: every
    line stays, with the member UNKNOWN where a dimension lacks its key).
    ``lineitem_df`` replaces the lineitem scan (e.g. a file stream:
    stream-static joins); without ``warehouse`` supplier is not joined."""
    li = shipdate_between(lineitem_df if lineitem_df is not None else t.lineitem, start, end_exclusive).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    if lineitem_df is None or lineitem_df.isStreaming:
        li = t.spread(li)
    parts = t.broadcast_if_small(part_skus(t), "part")
    j = li.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
    unknown = [F.coalesce(c, F.lit(C.UNKNOWN)).alias(c) for c in ("sku_id", "sku_name", "category")]
    j = j.select(*[c for c in j.columns if c not in ("sku_id", "sku_name", "category")], *unknown)
    if not warehouse:
        return j
    sups = t.broadcast_if_small(supplier_warehouse(t), "supplier")
    j = j.join(sups, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey")
    return (j.withColumn("warehouse_id", F.coalesce("warehouse_id", F.lit(C.UNKNOWN)))
            .withColumn("warehouse_name", F.coalesce("warehouse_name", F.lit(f"{C.UNKNOWN} HUB"))))


def _temp_deviation(k: Column) -> Column:
    return (F.when(k < 85, 0).when(k < 93, 2).when(k < 98, 4).otherwise(6)).cast("int")


def lots(t: Tables, start: dt.date | None = None, end_exclusive: dt.date | None = None,
         lineitem_df: DataFrame | None = None, warehouse: bool = True) -> DataFrame:
    """Historical lots (FIXTURES 2: lots) with B6-B9 columns, without the
    warehouse columns (and their joins) on request. Over the table scan the
    view is defined once per session (``Tables.view``)."""
    if lineitem_df is None:
        return t.view("lots", (start, end_exclusive, warehouse, t.dims(), t.broadcast_cap(), t.spark.conf.get("shelfcast.scan.partitions", None)),
                      lambda: _lots(t, start, end_exclusive, None, warehouse))
    return _lots(t, start, end_exclusive, lineitem_df, warehouse)


def _lots(t: Tables, start: dt.date | None, end_exclusive: dt.date | None,
          lineitem_df: DataFrame | None, warehouse: bool) -> DataFrame:
    base = lines(t, start, end_exclusive, lineitem_df, warehouse)
    dev = _temp_deviation((F.col("l_orderkey") + F.col("l_linenumber")) % 100)
    b = base.select(
        "*",
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_shipdate").cast("date")).alias("lot_id"),
        F.col("l_shipdate").cast("date").alias("procurement_date"),
        dev.alias("temp_deviation_c"),
    )
    b = b.withColumn("quantity_kg", F.col("l_quantity")).withColumn("_over", F.lit(1.1) + F.lit(5.0) * F.abs(F.col("l_discount")))
    b = L.with_effective_life(b)
    b = b.withColumn("inspection_day", (F.col("l_orderkey") % (F.col("effective_shelf_life") + 1)).cast("int"))
    b = L.with_freshness(b, age_days=F.col("inspection_day"))
    b = L.with_spoilage_probability(b, over_order=F.col("_over"))
    u = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 1000) / 1000.0
    b = b.withColumn("did_spoil", (u < F.col("spoil_prob")).cast("int"))
    b = b.withColumn("spoilage_pct", F.when(F.col("did_spoil") == 1,
                                            rnd(F.lit(0.15) + F.lit(8.0) * F.abs(F.col("l_tax")), 2))
                     .otherwise(F.lit(0.0)))
    b = L.with_risk_score(L.with_financials(b))
    return b.select(
        "lot_id",
        F.col("l_suppkey").alias("supplier_id"),
        "sku_id", "sku_name", "category", *(["warehouse_id", "warehouse_name"] if warehouse else []),
        "procurement_date",
        "expiry_date", "shelf_life_days", "effective_shelf_life", "quantity_kg",
        rnd("_over", 2).alias("over_order_factor"),
        "ideal_temp_c",
        (F.col("ideal_temp_c") + F.col("temp_deviation_c")).cast("int").alias("actual_temp_c"),
        "temp_deviation_c", "price_per_kg", "lot_value",
        "did_spoil", "spoilage_pct", "spoiled_kg", "spoiled_value", "days_to_expiry", "risk_score",
        rnd("age", 2).alias("age_pct"),
        "spoil_prob", "inspection_day",
        (F.col("l_linestatus") == "F").alias("dispatched"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def bounds(t: Tables, p: C.Params = C.DEFAULT) -> tuple[dt.date, dt.date]:
    """First and last day of the demand view: the range of the data's plausible
    ship dates, or one fiscal year on request."""
    if p.fiscal_year is None:
        return t.date_range(p.first_day, p.last_day)
    return dt.date(p.fiscal_year, 1, 1), dt.date(p.fiscal_year, 12, 31)


def fy_lots(t: Tables, p: C.Params = C.DEFAULT, warehouse: bool = True) -> DataFrame:
    """Lots procured in the period of the demand view (for fill rate and
    turnover); the whole range needs no filter."""
    if p.fiscal_year is None:
        return lots(t, warehouse=warehouse)
    start, end = bounds(t, p)
    return lots(t, start, end + dt.timedelta(days=1), warehouse=warehouse)


# ------------------------------------------------------------------ demand
def seasonal_temp(day_of_year: Column) -> Column:
    """Temperature cycle of the demand view: 28 + 7 sin(2 pi (doy - 30) / 365),
    rounded to 0.1, clipped to 15..45."""
    return clip(rnd(F.lit(28.0) + F.lit(7.0) * F.sin(F.lit(2.0) * F.pi() * (day_of_year - 30) / F.lit(365.0)), 1),
                15.0, 45.0)


SKU_VALUES = ["sku_name", "category", "shelf_life_days", "price_per_kg", "base_demand"]


def with_series_attributes(t: Tables, df: DataFrame) -> DataFrame:
    """sku and warehouse attributes by the keys, so aggregates group on keys
    only: recomputed (they are pure functions of brand and region), or joined
    from the caller's dimensions. A sku without attributes has its id as name,
    the category UNKNOWN, no base demand, and null price and shelf life."""
    if t.skus is None:
        out = df.select("*", *[c.alias(n) for n, c in sku_attrs("sku_id").items() if n in SKU_VALUES])
    else:
        out = df.join(t.skus.select("sku_id", *SKU_VALUES), "sku_id", "left")
    if t.warehouses is None:
        out = out.withColumn("warehouse_name", F.concat("warehouse_id", F.lit(" HUB")))
    else:
        out = (out.join(t.warehouses.select("warehouse_id", "warehouse_name"), "warehouse_id", "left")
               .withColumn("warehouse_name", F.coalesce("warehouse_name", F.concat("warehouse_id", F.lit(" HUB")))))
    defaults = {"sku_name": F.col("sku_id"), "category": F.lit(C.UNKNOWN), "base_demand": F.lit(0.0)}
    return out.withColumns({n: F.coalesce(n, d) for n, d in defaults.items()})


def demand_facts(t: Tables, start: dt.date | None = None, end_exclusive: dt.date | None = None) -> DataFrame:
    """Kg sold per (date, sku, warehouse), with sku/warehouse attributes
    projected from the keys. One partial + final aggregate over the lines."""
    ln = lines(t, start, end_exclusive)
    g = (ln.groupBy(F.col("l_shipdate").cast("date").alias("date"), "sku_id", "warehouse_id")
         .agg(F.sum("l_quantity").alias("sold_kg")))
    return with_series_attributes(t, g.select("date", "sku_id", "warehouse_id", "sold_kg"))


def series(df: DataFrame) -> DataFrame:
    return df.select("sku_id", "warehouse_id").distinct()


def demand(t: Tables, p: C.Params = C.DEFAULT) -> DataFrame:
    """The demand fact table (FIXTURES 2: demand): every series seen in the
    period (by default the data's own date range), densified over all its
    days (J8). The daily facts of a series are gathered (one entry a day at
    most, so bounded by the calendar), the days it lacks are added and the
    list is exploded: no self-join, and the lines are scanned once. Each series
    has exactly one row per day, so per-series windows downstream are bounded.
    Defined once per session."""
    return t.view("demand", (p, t.dims(), t.broadcast_cap(), t.spark.conf.get("shelfcast.scan.partitions", None)), lambda: _demand(t, p))


def _demand(t: Tables, p: C.Params) -> DataFrame:
    start, end = bounds(t, p)
    ln = lines(t, start, end + dt.timedelta(days=1))
    facts = (ln.groupBy(F.col("l_shipdate").cast("date").alias("date"), "sku_id", "warehouse_id")
             .agg(F.sum("l_quantity").alias("sold_kg")))
    # a series' own days and those it lacks (linear: array_except hashes); the
    # outer explode keeps Catalyst from making the array twice for a filter
    own = facts.groupBy("sku_id", "warehouse_id").agg(F.collect_list(F.struct("date", "sold_kg")).alias("own"))
    gaps = F.transform(F.array_except(F.sequence(F.lit(start), F.lit(end)), F.col("own.date")),
                       lambda d: F.struct(d.alias("date"), F.lit(None).cast("double").alias("sold_kg")))
    values = [*SKU_VALUES, "warehouse_name"]
    own = with_series_attributes(t, own)
    g = own.select("sku_id", "warehouse_id", *values, F.explode_outer(F.concat("own", gaps)).alias("r")).select("sku_id", "warehouse_id", *values, "r.*")
    kg = F.col("base_demand") + F.coalesce(F.col("sold_kg"), F.lit(0.0))
    doy = F.dayofyear("date")
    temp = seasonal_temp(doy)
    g = g.select(
        "date", "sku_id", "sku_name", "category", "warehouse_id", "warehouse_name",
        F.col("warehouse_id").alias("city"),
        kg.alias("actual_demand_kg"), "price_per_kg",
        rnd(kg * F.col("price_per_kg"), 2).alias("revenue"),
        temp.alias("temp_c"),
        day_name("date").alias("day_name"),
        weekday("date").cast("int").alias("day_of_week"),
        is_weekend("date").alias("is_weekend"),
        F.month("date").alias("month"),
        doy.alias("day_of_year"),
        "base_demand", "sold_kg",
    )
    g = with_festival(g, F.broadcast(festival_dim(t.spark, years_of(start, end))), "date", "_fest")
    return g.withColumn("festival_multiplier", rnd("_fest", 2)).drop("_fest")


# ------------------------------------------------------------------ active lots
def active_lots(t: Tables, as_of: dt.date = C.AS_OF, full: bool = False) -> DataFrame:
    """Lots in stock at ``as_of`` (base shelf life, Q14), with tier,
    in-band score and action. The scan is bounded to the longest shelf life
    of the SKU dimension before ``as_of`` (pushed to Parquet). Defined once
    per session."""
    return t.view("active_lots", (as_of, full, t.dims(), t.broadcast_cap(), t.spark.conf.get("shelfcast.scan.partitions", None)), lambda: _active_lots(t, as_of, full))


def longest_shelf_life(t: Tables) -> int:
    """Days, from the SKU dimension (one row; once per session and folder)."""
    return t.view("longest_shelf_life", (t.dims(),), lambda: part_skus(t).agg(F.max("shelf_life_days")).first()[0]) or 0


def _active_lots(t: Tables, as_of: dt.date, full: bool) -> DataFrame:
    from ..operators.lots import active_lots as in_stock
    lo = lots(t, as_of - dt.timedelta(days=longest_shelf_life(t)), as_of + dt.timedelta(days=1))
    a = in_stock(lo, as_of)
    cols = ["lot_id", "sku_id", "sku_name", "category", "warehouse_id", "warehouse_name",
            "procurement_date", "expiry_date", "days_remaining", "shelf_life_days",
            "pct_shelf_remaining", "quantity_kg", "price_per_kg", "lot_value_inr",
            "risk_score", "risk_level", "recommended_action", "temp_deviation_c"]
    if full:
        cols += ["supplier_id", "over_order_factor", "age_pct", "dispatched", "effective_shelf_life", "_pct"]
    return a.select(*cols)


# ------------------------------------------------------------------ sensors
def sensor_readings(t: Tables, for_stream: bool = False) -> DataFrame:
    """Cold-room readings from ``events`` (FIXTURES 2: sensor readings).

    Batch code keeps the zone-less ``TIMESTAMP_NTZ`` of the file (wall-clock
    arithmetic, no session-zone dependence); a stream needs ``TIMESTAMP`` for
    its watermark, so ``for_stream`` casts it."""
    e = t.events
    ts = F.col("ts").cast("timestamp") if for_stream else F.col("ts")
    return e.select(
        "event_id",
        ts.alias("ts"),
        (F.col("user_id") % 10).cast("int").alias("room"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
        .otherwise(F.col("value") / 10.0).alias("temp_c"),
        "event_type", "user_id", "value",
    )
