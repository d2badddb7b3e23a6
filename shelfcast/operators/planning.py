"""Planning, data-quality and sensor operators documented by the source
project without code (tier D: D1-D3, D5-D23, D25).

Conventions: grouped aggregates before joins (hot keys combine map-side),
per-series windows only over the bounded demand grid, per-room sensor logic
through ``with_previous`` (time-bucketed), global ordering through
``global_rank``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import clamp0, newsvendor_qty, r2, r4, rnd, z_value
from .features import SERIES
from .forecast import _ape, forecast_from_state, naive_predictions, series_state
from .ordering import global_rank, with_previous

# Per-category newsvendor costs (cu, co) and the order margin (D22). These
# are parameters of this library: perishable, high-cost categories lean to
# caution, long-life root vegetables carry a larger buffer.
CATEGORY_COSTS = {
    "Leafy Vegetables": (0.25, 1.00),
    "Other Vegetables": (0.25, 0.80),
    "Root Vegetables": (0.25, 0.40),
    "Dairy": (0.25, 0.90),
    "Meat & Poultry": (0.25, 1.00),
}
ORDER_MARGIN = 0.05


# ------------------------------------------------------------------ D1
def dedup_lines(lineitem: DataFrame) -> DataFrame:
    """One row per lot key (order, line, part, supplier, day) with its
    number of copies and the largest quantity among them. A hash aggregate
    over plain columns, combined map-side, so a hot key is never gathered."""
    return (lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("ship_date"))
            .agg(F.count("*").alias("n_copies"), F.max("l_quantity").alias("quantity_kg")))


# ------------------------------------------------------------------ D2
def fill_missing(demand_sold: DataFrame) -> DataFrame:
    """Forward fill of the last observed sale per series over the dense
    grid (``last(ignorenulls)``), leading gaps filled with 0."""
    w = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return demand_sold.select("date", *SERIES, "sold_kg",
                              F.coalesce(F.last("sold_kg", ignorenulls=True).over(w), F.lit(0.0)).alias("filled_kg"))


# ------------------------------------------------------------------ D3
def rules() -> list:
    """Validation rules: (name, violated-when column)."""
    return [
        ("negative_quantity", F.col("quantity_kg") < 0),
        ("expiry_before_procurement", F.col("expiry_date") < F.col("procurement_date")),
        ("null_key", F.col("sku_id").isNull() | F.col("warehouse_id").isNull()),
        ("unknown_key", (F.col("sku_id") == C.UNKNOWN) | (F.col("warehouse_id") == C.UNKNOWN)),
        ("implausible_date", ~F.coalesce(F.col("procurement_date").between(F.lit(C.DEFAULT.first_day), F.lit(C.DEFAULT.last_day)), F.lit(False))),
        ("spoiled_exceeds_quantity", F.col("spoiled_kg") > F.col("quantity_kg")),
    ]


def broken_rules():
    """Names of the rules that a lot breaks."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules()]))


def validate_lots(lots: DataFrame) -> DataFrame:
    """D3: rule names broken per lot (``array_compact``) -> counts per rule
    plus the count of valid lots."""
    broken = broken_rules()
    tags = F.when(F.size(broken) == 0, F.array(F.lit("valid"))).otherwise(broken)
    return (lots.select(F.explode(tags).alias("rule"))
            .groupBy("rule").agg(F.count("*").alias("n_lots")))


# ------------------------------------------------------------------ stock
def stock_by_series(active: DataFrame) -> DataFrame:
    return active.groupBy(*SERIES).agg(F.sum("quantity_kg").alias("stock_kg"))


# ------------------------------------------------------------------ D5
def stock_aware_purchase(forecast: DataFrame, stock: DataFrame) -> DataFrame:
    """purchase = max(0, forecast - stock left), stock drawn down by the
    forecasts of the earlier steps (window over the <= horizon steps)."""
    j = forecast.join(stock, SERIES, "left").withColumn("stock_kg", F.coalesce("stock_kg", F.lit(0.0)))
    w = Window.partitionBy(*SERIES).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("forecast_kg").over(w), F.lit(0.0))
    left = clamp0(F.col("stock_kg") - used)
    return j.select(*SERIES, "date", "step", "forecast_kg", r2("stock_kg").alias("stock_kg"),
                    r2(left).alias("stock_left_kg"),
                    r2(clamp0(F.col("forecast_kg") - left)).alias("purchase_kg"))


# ------------------------------------------------------------------ D6
def stock_events(lots: DataFrame) -> DataFrame:
    """Changes of a series' stock by day: what arrives on its procurement day
    and leaves on its expiry day, with the kg sold that day (in these tables a
    lot is sold as it arrives). Two rows a batch, however long it keeps; a lot
    without an expiry day is no stock."""
    batches = lots.groupBy(*SERIES, "procurement_date", "expiry_date").agg(F.sum("quantity_kg").alias("kg"))
    both = F.array(F.struct(F.col("procurement_date").alias("date"), F.when(F.col("expiry_date").isNotNull(), F.col("kg")).otherwise(F.lit(0.0)).alias("delta_kg"), F.col("kg").alias("sold_kg")),
                   F.struct(F.col("expiry_date").alias("date"), (-F.col("kg")).alias("delta_kg"), F.lit(0.0).alias("sold_kg")))
    return (batches.select(*SERIES, F.explode(both).alias("e")).where("e.date is not null").groupBy(*SERIES, "e.date")
            .agg(F.sum("e.delta_kg").alias("delta_kg"), F.sum("e.sold_kg").alias("sold_kg")))


def stockout_rate(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Unfilled kg / demanded kg per warehouse over the days ``start`` to
    ``end``, from ``stock_events`` with each series' daily ``base_demand``. A
    sweep: between two events of a series stock and demand stay as they are, so
    an interval counts by its days and no day is a row. Demand of a day is the
    base and what was sold; stock is what arrived less what expired by then.
    Series without a sale in the period have no demand."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    whole = Window.partitionBy(*SERIES)
    day = F.col("date")
    a, z = F.lit(start), F.lit(end)
    inside = day.between(a, z)
    e = events.select(*SERIES, "date", "base_demand", "sold_kg", F.sum("delta_kg").over(w).alias("stock"),
                      F.coalesce(F.lead("date").over(w), F.date_add(z, 1)).alias("next"), F.lag("date").over(w).alias("prev"),
                      F.max(F.when(F.col("sold_kg") > 0, inside).otherwise(F.lit(False))).over(whole).alias("live")).where("live")
    # days of [date, next) after the day itself, and those before the first event
    quiet = F.greatest(F.lit(0), F.datediff(F.least("next", F.date_add(z, 1)), F.greatest(F.date_add("date", 1), a)))
    ahead = F.when(F.col("prev").isNull(), F.greatest(F.lit(0), F.datediff(F.least(day, F.date_add(z, 1)), a))).otherwise(F.lit(0))
    base, today = F.col("base_demand"), F.col("base_demand") + F.col("sold_kg")
    dem = F.when(inside, today).otherwise(F.lit(0.0)) + base * (quiet + ahead)
    unf = F.when(inside, clamp0(today - F.col("stock"))).otherwise(F.lit(0.0)) + clamp0(base - F.col("stock")) * quiet + base * ahead
    g = e.groupBy("warehouse_id").agg(F.sum(dem).alias("dem"), F.sum(unf).alias("unf"))
    return g.select("warehouse_id", r2("dem").alias("demand_kg"), r2("unf").alias("unfilled_kg"),
                    r4(F.try_divide(F.col("unf"), F.col("dem")) * 100).alias("stockout_rate_pct"))


# ------------------------------------------------------------------ D7
def overview_counts(active: DataFrame, demand: DataFrame) -> DataFrame:
    """One aggregate over a union of stock rows and demand rows."""
    hi = F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), F.col("sku_id"))
    u = (active.select(F.col("quantity_kg").alias("q"), F.col("sku_id").alias("sku"), hi.alias("hi"),
                       F.lit(0.0).alias("d"), F.lit(None).cast("date").alias("day"))
         .unionByName(demand.select(F.lit(0.0).alias("q"), F.lit(None).cast("string").alias("sku"),
                                    F.lit(None).cast("string").alias("hi"),
                                    F.col("actual_demand_kg").alias("d"), F.col("date").alias("day"))))
    return u.agg(r2(F.sum("q")).alias("total_inventory_kg"),
                 F.count_distinct("sku").alias("active_products"),
                 r2(F.sum("d") / F.count_distinct("day")).alias("daily_demand_kg"),
                 F.count_distinct("hi").alias("high_risk_products"))


# ------------------------------------------------------------------ D8
def net_wastage_saved(lots: DataFrame) -> DataFrame:
    """Per calendar month, saving against the baseline rate of all earlier
    months (window over one row per month)."""
    m = (lots.groupBy(F.year("procurement_date").alias("year"), F.month("procurement_date").alias("month"))
         .agg(F.sum("lot_value").alias("tv"), F.sum("spoiled_value").alias("sv")))
    w = Window.orderBy("year", "month").rowsBetween(Window.unboundedPreceding, -1)
    base = F.sum("sv").over(w) / F.sum("tv").over(w) * 100
    cur = F.col("sv") / F.col("tv") * 100
    return m.select("year", "month", r2("tv").alias("total_value"), r4(cur).alias("wastage_pct"),
                    r4(base).alias("baseline_pct"), r2((base - cur) / 100 * F.col("tv")).alias("net_saved"))


# ------------------------------------------------------------------ D9
def over_order_factor(forecast: DataFrame, stock: DataFrame, days: int = 3) -> DataFrame:
    """Stock on hand / forecast of the next ``days`` days."""
    f3 = forecast.filter(F.col("step") <= days).groupBy(*SERIES).agg(F.sum("forecast_kg").alias("f3"))
    j = f3.join(stock, SERIES, "left").withColumn("stock_kg", F.coalesce("stock_kg", F.lit(0.0)))
    return j.select(*SERIES, r2("stock_kg").alias("stock_kg"), r2("f3").alias("next3_forecast_kg"),
                    r4(F.try_divide(F.col("stock_kg"), F.col("f3"))).alias("over_order_factor"))


# ------------------------------------------------------------------ D10
def target_encoding(lots_split: DataFrame, label: str = "did_spoil") -> DataFrame:
    """Mean label per category and per warehouse on the training rows, in
    one pass: each row counts once for either feature."""
    features = ["category", "warehouse_id"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in features]))
    return (lots_split.filter("is_train").select(F.col(label).alias("_y"), pairs.alias("_p"))
            .groupBy("_p.feature", "_p.level").agg(r4(F.avg("_y")).alias("encoding"), F.count("*").alias("n_train"))
            .select("level", "encoding", "n_train", "feature"))


def apply_target_encoding(df: DataFrame, encoding: DataFrame, default: float | None = None) -> DataFrame:
    """D10 applied: ``category_te`` / ``warehouse_te`` columns from the
    encoding table (one row per category or warehouse); unseen
    levels take ``default`` (e.g. the training base rate)."""
    out = df
    for feat, col in [("category", "category_te"), ("warehouse_id", "warehouse_te")]:
        e = (encoding.filter(F.col("feature") == feat)
             .select(F.col("level").alias(f"_{col}_lvl"), F.col("encoding").alias(col)))
        out = out.join(e, F.col(feat) == F.col(f"_{col}_lvl"), "left").drop(f"_{col}_lvl")
        if default is not None:
            out = out.withColumn(col, F.coalesce(col, F.lit(default)))
    return out


# ------------------------------------------------------------------ D11
def discount_rule(active_full: DataFrame, lo: float = 0.40, hi: float = 0.60,
                  max_off: float = 30.0, min_off: float = 15.0) -> DataFrame:
    """Lots with 40-60% shelf life left get 30% (at 40%) down to 15%
    (at 60%) off, linear in the fraction left."""
    p = F.col("_pct")
    off = F.lit(max_off) - (p - F.lit(lo)) / F.lit(round(hi - lo, 12)) * F.lit(max_off - min_off)
    f = active_full.filter((p >= lo) & (p <= hi)).withColumn("_off", off)
    return f.select("lot_id", "sku_id", "warehouse_id", "pct_shelf_remaining",
                    r2("_off").alias("discount_pct"),
                    r2(F.col("lot_value_inr") * (F.lit(1.0) - F.col("_off") / 100)).alias("discounted_value"))


# ------------------------------------------------------------------ D12
def approval_flags(demand: DataFrame, p: C.Params = C.DEFAULT) -> DataFrame:
    """A recommendation needs approval when it is off the series'
    historical mean by more than the tolerance."""
    j = (series_state(demand, p).withColumnRenamed("mean_all", "hmean")
         .withColumn("opt", newsvendor_qty("mu", "sigma", z_value(p.cost_under, p.cost_over), p.sigma_floor)))
    dev = F.abs(F.col("opt") - F.col("hmean")) / F.col("hmean")
    return j.select(*SERIES, F.col("opt").alias("optimal_order"), r4("hmean").alias("history_mean"),
                    r4(dev * 100).alias("deviation_pct"), (dev > p.approval_tolerance).alias("needs_approval"))


# ------------------------------------------------------------------ D13, D14
def sensor_gaps(readings: DataFrame, gap_minutes: int = 30, unit: str = "hour") -> DataFrame:
    """Gaps longer than ``gap_minutes`` between consecutive events of a
    room; the missing temperature is imputed with the room's maximum so far."""
    r = with_previous(readings.select("room", "ts", "event_id", "temp_c"), ["room"], "ts", "event_id",
                      "temp_c", unit)
    gap = F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts")) / 6.0e7
    return (r.filter(F.col("prev_ts").isNotNull() & (gap > gap_minutes))
            .select("room", F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"),
                    r4(gap).alias("gap_minutes"), F.col("prior_max").alias("imputed_temp_c")))


def sensor_offline(readings: DataFrame, gaps: DataFrame, inspect_after_minutes: float = 120.0) -> DataFrame:
    """For every room, whether it was ever offline, its gaps, offline
    minutes and whether it needs inspection."""
    u = (gaps.select("room", F.lit(1).alias("g"), F.col("gap_minutes").alias("m"))
         .unionByName(readings.select("room", F.lit(0).alias("g"), F.lit(0.0).alias("m"))))
    g = u.groupBy("room").agg(F.sum("g").alias("n_gaps"), F.sum("m").alias("m"))
    return g.select("room", "n_gaps", r2("m").alias("offline_minutes"),
                    (F.col("n_gaps") > 0).cast("int").alias("sensor_offline_flag"),
                    (F.col("m") > inspect_after_minutes).alias("needs_inspection"))


# ------------------------------------------------------------------ D15
def cold_start_levels(demand: DataFrame, p: C.Params = C.DEFAULT, min_days: int = 30,
                      observed: str = "sold_kg") -> DataFrame:
    """A series with fewer than ``min_days`` observed sale days takes the
    mean level of the warm series in its category. One aggregate over the
    demand grid gives level, category and observed days per series; the
    category levels are an aggregate of that per-series table."""
    st = (series_state(demand, p, carry=("category",), observed=observed)
          .withColumn("n_observed_days", F.col("n_observed").cast("bigint"))
          .withColumn("is_cold_start", F.col("n_observed_days") < min_days))
    # category levels: an aggregate (a hot category combines before the shuffle), joined back
    level = st.where("not is_cold_start").groupBy("category").agg(F.avg("mu").alias("category_level"))
    o = st.join(level, "category", "left")
    lvl = F.when(F.col("is_cold_start"), F.coalesce("category_level", "mu")).otherwise(F.col("mu"))
    return o.select(*SERIES, "category", "n_observed_days", "is_cold_start", r4("mu").alias("series_level"),
                    r4("category_level").alias("category_level"), r4(lvl).alias("planning_level"))


# ------------------------------------------------------------------ D16
def disruption_override(demand: DataFrame, lots: DataFrame, uplift: float = 0.20) -> DataFrame:
    """+20% demand on warehouse-days flagged as disrupted (a lot arrived
    with the worst cold-chain deviation)."""
    flags = (lots.filter(F.col("temp_deviation_c") >= 6)
             .select("warehouse_id", F.col("procurement_date").alias("date")).distinct()
             .withColumn("disrupted", F.lit(True)))
    j = demand.select("date", *SERIES, "actual_demand_kg").join(flags, ["warehouse_id", "date"], "left")
    d = F.coalesce("disrupted", F.lit(False))
    return j.select("date", *SERIES, "actual_demand_kg", d.alias("disrupted"),
                    r4(F.when(d, F.col("actual_demand_kg") * (1 + uplift)).otherwise(F.col("actual_demand_kg")))
                    .alias("adjusted_demand_kg"))


# ------------------------------------------------------------------ D17
def fifo_check(active_full: DataFrame) -> DataFrame:
    """FIFO rank (dense rank of procurement date in the series) and
    violations: a dispatched lot while an older lot of the same series is
    still in stock. One grouped summary per (series, date) (map-side
    combined) carries the smallest undispatched lot of the day; the rank and
    the series' oldest undispatched lot are windows over that small summary
    (one row per day in stock), joined back once."""
    a = active_full.select("lot_id", *SERIES, "procurement_date", "dispatched")
    day = (a.groupBy(*SERIES, "procurement_date")
           .agg(F.min(F.when(~F.col("dispatched"), F.col("lot_id"))).alias("_u")))
    ws = Window.partitionBy(*SERIES)
    day = day.select(*SERIES, "procurement_date",
                     F.dense_rank().over(ws.orderBy("procurement_date")).alias("fifo_rank"),
                     F.min(F.when(F.col("_u").isNotNull(), F.struct(F.col("procurement_date").alias("d"),
                                                                     F.col("_u").alias("l")))).over(ws).alias("o"))
    j = a.join(day, [*SERIES, "procurement_date"])
    older = (F.col("o.d") < F.col("procurement_date")) | (
        (F.col("o.d") == F.col("procurement_date")) & (F.col("o.l") < F.col("lot_id")))
    return j.select("lot_id", *SERIES, "procurement_date", F.col("fifo_rank").cast("int").alias("fifo_rank"),
                    "dispatched", (F.col("dispatched") & F.coalesce(older, F.lit(False))).alias("fifo_violation"))


def _tiled(df: DataFrame, day: str, key: str, kg: str) -> DataFrame:
    """Places [lo, hi) of rows on their series' line of kg, by day and key:
    running sums inside a (series, day) behind the sums of the days before, so
    that a hot series is spread over its days."""
    d = df.where(F.col(kg) > 0).select(*SERIES, F.col(day).alias("_day"), F.col(key).alias("_key"), F.col(kg).alias("_kg"))
    upto = Window.partitionBy(*SERIES).orderBy("_day")
    days = (d.groupBy(*SERIES, "_day").agg(F.sum("_kg").alias("_sum"), F.count("*").alias("_n"))
            .select(*SERIES, "_day", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"),
                    F.sum("_sum").over(Window.partitionBy(*SERIES)).alias("total"), F.sum("_n").over(Window.partitionBy(*SERIES)).alias("n")))
    inside = Window.partitionBy(*SERIES, "_day").orderBy("_key")
    return (d.withColumn("_in", F.sum("_kg").over(inside)).join(days, [*SERIES, "_day"])
            .select(*SERIES, "_key", (F.col("_before") + F.col("_in") - F.col("_kg")).alias("lo"), (F.col("_before") + F.col("_in")).alias("hi"), "total", "n"))


def fifo_allocation(lots: DataFrame, dispatches: DataFrame, bucket_rows: int = 4096) -> DataFrame:
    """D17 as quantities: the kg of each dispatch (series, dispatch_id,
    dispatch_date, kg) taken from the series' lots (lot_id, procurement_date,
    quantity_kg), oldest first; ties by id. Both sides tile a line of kg from 0,
    and a piece on which neither changes is one allocation, so no pairs are
    formed. The line is cut into stretches of about ``bucket_rows`` rows, which
    the windows work on. What the lots cannot cover has a null lot_id; kg of 0
    or less and null kg take no part."""
    a = _tiled(lots, "procurement_date", "lot_id", "quantity_kg")
    b = _tiled(dispatches, "dispatch_date", "dispatch_id", "kg")
    size = (a.select(*SERIES, "total", "n").unionByName(b.select(*SERIES, "total", "n")).groupBy(*SERIES)
            .agg((F.max("total") / F.ceil(F.sum(F.lit(1)) / bucket_rows)).alias("width")))
    line = (a.withColumn("kind", F.lit("lot")).unionByName(b.withColumn("kind", F.lit("dispatch")))
            .select(*SERIES, "kind", F.struct(F.col("_key").alias("id")).alias("what"), "lo", "hi", "total"))
    # behind its last row a side has nothing: an interval without an id
    ends = line.groupBy(*SERIES, "kind").agg(F.max("hi").alias("lo")).withColumn("hi", F.lit(float("inf"))).withColumn("what", F.struct(F.lit(None).cast("string").alias("id")))
    line = line.drop("total").unionByName(ends).join(size, SERIES)
    last = F.floor(F.when(F.col("hi") == float("inf"), F.col("lo")).otherwise(F.col("hi")) / F.col("width"))
    cut = (line.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), last)))
           .withColumn("lo", F.greatest("lo", F.col("bucket") * F.col("width"))).where("lo < hi"))
    w = Window.partitionBy(*SERIES, "bucket").orderBy("lo")
    edge = (F.col("bucket") + 1) * F.col("width")
    one = cut.groupBy(*SERIES, "bucket", "lo").agg(F.max(F.when(F.col("kind") == "lot", F.struct("what", "hi"))).alias("lot"),
                                                   F.max(F.when(F.col("kind") == "dispatch", F.struct("what", "hi"))).alias("dispatch"), F.max("width").alias("width"))
    held = one.select(*SERIES, "lo", F.last("lot", ignorenulls=True).over(w).alias("lot"), F.last("dispatch", ignorenulls=True).over(w).alias("dispatch"),
                      F.coalesce(F.lead("lo").over(w), edge).alias("edge"))
    end = F.least(F.col("edge"), F.col("dispatch.hi"), F.coalesce("lot.hi", F.lit(float("inf"))))
    kg = held.select(*SERIES, F.col("dispatch.what.id").alias("dispatch_id"), F.col("lot.what.id").alias("lot_id"), (end - F.col("lo")).alias("kg"))
    return (kg.where("dispatch_id is not null and kg > 0").groupBy(*SERIES, "dispatch_id", "lot_id").agg(F.sum("kg").alias("kg")))


# ------------------------------------------------------------------ D18
def supplier_degradation(lots: DataFrame) -> DataFrame:
    """Spoilage by supplier with a global degradation rank."""
    g = lots.groupBy("supplier_id").agg(F.count("*").alias("n_lots"), F.sum("did_spoil").alias("n_spoiled"),
                                        r2(F.sum("spoiled_value")).alias("spoiled_value"))
    g = g.withColumn("spoil_rate", F.col("n_spoiled") / F.col("n_lots"))
    ranked = global_rank(g, [F.desc("spoil_rate"), F.desc("spoiled_value"), F.asc("supplier_id")],
                         "degradation_rank")
    return ranked.select("supplier_id", "n_lots", F.col("n_spoiled").cast("bigint").alias("n_spoiled"),
                         r4("spoil_rate").alias("spoil_rate"), "spoiled_value", "degradation_rank")


# ------------------------------------------------------------------ D19
def naive_baselines_by_series(demand: DataFrame, p: C.Params = C.DEFAULT) -> DataFrame:
    """D19 per series: MAPE of the 7-day moving average and of the same day
    last week on the test tail, and the improvement of the former."""
    pr = naive_predictions(demand, p)
    g = pr.groupBy(*SERIES).agg((F.avg(_ape("actual", "pred_ma7")) * 100).alias("m7"),
                                (F.avg(_ape("actual", "pred_lag7")) * 100).alias("l7"))
    return g.select(*SERIES, r4("m7").alias("mape_ma7"), r4("l7").alias("mape_lag7"),
                    r4(F.try_divide(F.col("l7") - F.col("m7"), F.col("l7")) * 100).alias("improvement_pct"))


# ------------------------------------------------------------------ D20
def demand_growth(demand: DataFrame, p: C.Params = C.DEFAULT) -> DataFrame:
    """Mean forecast over the horizon against the current level."""
    f = forecast_from_state(series_state(demand, p), p, keep=("mu",))
    j = (f.withColumn("fl", F.avg("forecast_kg").over(Window.partitionBy(*SERIES)))
         .filter(F.col("step") == 1))
    return j.select(*SERIES, r4("mu").alias("current_level"), r4("fl").alias("forecast_level"),
                    r4(F.try_divide(F.col("fl") - F.col("mu"), F.col("mu")) * 100).alias("growth_pct"))


# ------------------------------------------------------------------ D22
def category_newsvendor(demand: DataFrame, p: C.Params = C.DEFAULT, costs=None,
                        margin: float = ORDER_MARGIN, per_row_z: bool = False) -> DataFrame:
    """Per-category cost ratios; z is folded on the driver per category
    (a constant table with one row per category; a category without a row has
    the default costs) and the order gets a safety margin. ``per_row_z`` computes z from the ratio column with
    the vectorised UDF instead (for cost tables too large to fold)."""
    costs = costs or CATEGORY_COSTS
    spark = demand.sparkSession
    rows = [(c, cu, co, cu / (cu + co), z_value(cu, co)) for c, (cu, co) in costs.items()]
    tbl = spark.createDataFrame(rows, "category string, cu double, co double, critical_ratio double, z double")
    if per_row_z:
        from ..functions.udfs import norm_ppf
        tbl = tbl.withColumn("z", norm_ppf(F.col("cu") / (F.col("cu") + F.col("co"))))
    st = series_state(demand, p, carry=("category",))
    j = (st.join(F.broadcast(tbl), "category", "left")
         .withColumn("critical_ratio", F.coalesce("critical_ratio", F.lit(p.cost_under / (p.cost_under + p.cost_over)))))
    q = newsvendor_qty("mu", "sigma", F.coalesce("z", F.lit(z_value(p.cost_under, p.cost_over))), p.sigma_floor)
    return j.select(*SERIES, "category", r4("critical_ratio").alias("critical_ratio"),
                    q.alias("optimal_order"), rnd(q * (1 + margin), 1).alias("order_with_margin"))


# ------------------------------------------------------------------ D23
def unconstrained_demand(events: DataFrame) -> DataFrame:
    """Sold kg plus intent (views, clicks) on out-of-stock days, per
    (sku, day); one grouped aggregate with conditional sums."""
    e = events.select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("sku_id"),
                      F.col("ts").cast("date").alias("date"), "event_type", "value")
    g = e.groupBy("sku_id", "date").agg(
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("sold"),
        F.sum(F.when(F.col("event_type").isin("view", "click"), F.col("value")).otherwise(0.0)).alias("intent"),
        F.max((F.col("event_type") == "error").cast("int")).alias("oos"))
    return g.select("sku_id", "date", r2("sold").alias("sold_kg"), r2("intent").alias("intent_kg"),
                    (F.col("oos") == 1).alias("out_of_stock"),
                    r2(F.col("sold") + F.when(F.col("oos") == 1, F.col("intent")).otherwise(0.0))
                    .alias("unconstrained_kg"))


# ------------------------------------------------------------------ D25
def scenario_value(lots: DataFrame, factor: float = C.WASTAGE_TARGET_FACTOR) -> DataFrame:
    """Wastage before/after and the saving per month and year per hub."""
    g = lots.groupBy("warehouse_id").agg(
        F.sum("lot_value").alias("tv"), F.sum("spoiled_value").alias("sv"),
        F.count_distinct(F.date_trunc("month", F.col("procurement_date"))).alias("months"))
    before = F.col("sv") / F.col("tv") * 100
    monthly = F.col("tv") / F.col("months")
    saved_m = monthly * (before - before * factor) / 100
    return g.select("warehouse_id", r2(monthly).alias("monthly_sourcing_value"),
                    r4(before).alias("wastage_before_pct"), r4(before * factor).alias("wastage_after_pct"),
                    r2(saved_m).alias("saved_per_month"), r2(saved_m * 12).alias("saved_per_year"))
