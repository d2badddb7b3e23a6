"""Independent DuckDB SQL for each catalog key (the correctness oracle).

Written as plain SQL over the driver tables (registered as views). Decimal
literals that meet double columns are cast to DOUBLE so both engines do the
same IEEE arithmetic; every rounding uses the same +1e-9 tie nudge.
"""

from __future__ import annotations

import statistics

FY_START = "(SELECT d0 FROM rng)"
FY_END = "(SELECT d1 FROM rng)"
AS_OF = "DATE '2000-06-30'"

RNG = """
rng AS (SELECT CAST(min(l_shipdate) AS DATE) AS d0, CAST(max(l_shipdate) AS DATE) AS d1 FROM lineitem)"""

SKU_PART = """
sku_part AS (
  SELECT p_partkey, p_brand AS sku_id, p_brand AS sku_name,
         CASE bn % 5 WHEN 0 THEN 'Leafy Vegetables' WHEN 1 THEN 'Other Vegetables'
              WHEN 2 THEN 'Root Vegetables' WHEN 3 THEN 'Dairy' ELSE 'Meat & Poultry' END AS category,
         CAST(2 + bn % 14 AS INTEGER) AS shelf_life_days,
         CAST(CASE bn % 5 WHEN 0 THEN 4 WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 4 ELSE 2 END AS INTEGER) AS ideal_temp_c,
         CAST(20 + 17 * bn AS DOUBLE) AS price_per_kg,
         CAST(10 + 3 * bn AS DOUBLE) AS base_demand
  FROM (SELECT p_partkey, p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS bn FROM part) x
)"""

SKU_DIM = """
sku_dim AS (SELECT DISTINCT sku_id, sku_name, category, shelf_life_days, ideal_temp_c, price_per_kg, base_demand FROM sku_part)"""

SUP_WH = """
sup_wh AS (
  SELECT s_suppkey, r_name AS warehouse_id, r_name || ' HUB' AS warehouse_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

LINES = """
lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_linestatus, l_shipdate,
         sp.sku_id, sp.sku_name, sp.category, sp.shelf_life_days, sp.ideal_temp_c, sp.price_per_kg, sp.base_demand,
         sw.warehouse_id, sw.warehouse_name
  FROM lineitem LEFT JOIN sku_part sp ON l_partkey = sp.p_partkey LEFT JOIN sup_wh sw ON l_suppkey = sw.s_suppkey
)"""

LOTS = """
lots0 AS (
  SELECT *,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS lot_id,
         CAST(l_shipdate AS DATE) AS procurement_date,
         CAST(CASE WHEN (l_orderkey + l_linenumber) % 100 < 85 THEN 0
                   WHEN (l_orderkey + l_linenumber) % 100 < 93 THEN 2
                   WHEN (l_orderkey + l_linenumber) % 100 < 98 THEN 4 ELSE 6 END AS INTEGER) AS temp_deviation_c,
         CAST(1.1 AS DOUBLE) + CAST(5.0 AS DOUBLE) * abs(l_discount) AS over_raw,
         CAST(CASE category WHEN 'Leafy Vegetables' THEN 0.22 WHEN 'Other Vegetables' THEN 0.10
                            WHEN 'Root Vegetables' THEN 0.04 WHEN 'Dairy' THEN 0.12
                            WHEN 'Meat & Poultry' THEN 0.18 ELSE 0.10 END AS DOUBLE) AS cat_rate
  FROM lines
),
lots1 AS (SELECT *, CAST(greatest(1, shelf_life_days - CAST(floor(temp_deviation_c * 0.4) AS INTEGER)) AS INTEGER)
                 AS effective_shelf_life FROM lots0),
lots2 AS (SELECT *, CAST(l_orderkey % (effective_shelf_life + 1) AS INTEGER) AS inspection_day FROM lots1),
lots3 AS (SELECT *, least(CAST(1.0 AS DOUBLE), inspection_day / effective_shelf_life) AS age FROM lots2),
lots4 AS (SELECT *, least(greatest(CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-(((age * 2.5
                    + temp_deviation_c / CAST(6.0 AS DOUBLE) * 1.8 + (over_raw - 1.0) * 0.6 + cat_rate * 1.5)
                    - 2.0) * 2.5))), CAST(0.02 AS DOUBLE)), CAST(0.95 AS DOUBLE)) AS spoil_prob FROM lots3),
lots5 AS (SELECT *, CAST(((l_orderkey * 31 + l_partkey * 17) % 1000) / CAST(1000.0 AS DOUBLE) < spoil_prob AS INTEGER)
                 AS did_spoil FROM lots4),
lots6 AS (SELECT *, CASE WHEN did_spoil = 1 THEN round(CAST(0.15 AS DOUBLE) + CAST(8.0 AS DOUBLE) * abs(l_tax) + 1e-9, 2)
                         ELSE CAST(0.0 AS DOUBLE) END AS spoilage_pct FROM lots5),
lots7 AS (SELECT *, round(l_quantity * spoilage_pct + 1e-9, 1) AS spoiled_kg FROM lots6),
lots AS (
  SELECT lot_id, l_suppkey AS supplier_id, sku_id, sku_name, category, warehouse_id, warehouse_name,
         procurement_date, procurement_date + effective_shelf_life AS expiry_date,
         shelf_life_days, effective_shelf_life, l_quantity AS quantity_kg,
         round(over_raw + 1e-9, 2) AS over_order_factor, ideal_temp_c,
         CAST(ideal_temp_c + temp_deviation_c AS INTEGER) AS actual_temp_c, temp_deviation_c, price_per_kg,
         round(l_quantity * price_per_kg + 1e-9, 2) AS lot_value,
         did_spoil, spoilage_pct, spoiled_kg,
         round(spoiled_kg * price_per_kg + 1e-9, 2) AS spoiled_value,
         CAST(effective_shelf_life - inspection_day AS INTEGER) AS days_to_expiry,
         CAST(least(greatest(floor(age * 45 + temp_deviation_c * 7 + cat_rate * 80), 0), 100) AS INTEGER) AS risk_score,
         round(age + 1e-9, 2) AS age_pct, spoil_prob, inspection_day,
         l_linestatus = 'F' AS dispatched, l_orderkey, l_linenumber, l_partkey, l_shipdate
  FROM lots7
)"""

FY_LOTS = f"""
fy_lots AS (SELECT * FROM lots WHERE procurement_date BETWEEN {FY_START} AND {FY_END})"""

FESTIVALS = """
festivals0(name, fdate, mult, win) AS (VALUES
  ('Pongal / Makar Sankranti', DATE '2000-01-15', CAST(1.6 AS DOUBLE), 3),
  ('Republic Day', DATE '2000-01-26', CAST(1.3 AS DOUBLE), 2),
  ('Maha Shivratri', DATE '2000-03-08', CAST(1.5 AS DOUBLE), 2),
  ('Holi', DATE '2000-03-25', CAST(2.0 AS DOUBLE), 3),
  ('Ram Navami', DATE '2000-04-17', CAST(1.4 AS DOUBLE), 2),
  ('Eid ul-Fitr', DATE '2000-04-10', CAST(2.2 AS DOUBLE), 4),
  ('Independence Day', DATE '2000-08-15', CAST(1.4 AS DOUBLE), 2),
  ('Onam', DATE '2000-09-15', CAST(1.7 AS DOUBLE), 5),
  ('Navratri / Durga Puja', DATE '2000-10-03', CAST(1.9 AS DOUBLE), 9),
  ('Diwali', DATE '2000-11-01', CAST(2.5 AS DOUBLE), 5),
  ('Eid ul-Adha', DATE '2000-06-17', CAST(2.0 AS DOUBLE), 3),
  ('Christmas', DATE '2000-12-25', CAST(1.8 AS DOUBLE), 4),
  ('New Year Eve', DATE '2000-12-31', CAST(2.0 AS DOUBLE), 2)),
festivals AS (SELECT name, make_date(CAST(y AS BIGINT), month(fdate), day(fdate)) AS fdate, mult, win
              FROM festivals0, (SELECT unnest(range(year(d0) - 1, year(d1) + 2)) AS y FROM rng) yy)"""

DEMAND = f"""
facts AS (
  SELECT CAST(l_shipdate AS DATE) AS date, sku_id, warehouse_id, sum(l_quantity) AS sold_kg
  FROM lines GROUP BY 1, 2, 3
),
series AS (
  SELECT DISTINCT f.sku_id, d.sku_name, d.category, f.warehouse_id, f.warehouse_id || ' HUB' AS warehouse_name,
         d.price_per_kg, d.base_demand
  FROM (SELECT DISTINCT sku_id, warehouse_id FROM facts) f JOIN sku_dim d ON f.sku_id = d.sku_id
),
grid AS (
  SELECT s.*, CAST(unnest(generate_series({FY_START}, {FY_END}, INTERVAL 1 DAY)) AS DATE) AS date FROM series s
),
fest_day AS (
  SELECT g.date, max(f.mult * (1.0 - abs(g.date - f.fdate) / (f.win + 1) * 0.4)) AS fm
  FROM (SELECT DISTINCT date FROM grid) g JOIN festivals f ON abs(g.date - f.fdate) <= f.win
  GROUP BY g.date
),
demand AS (
  SELECT g.date, g.sku_id, g.sku_name, g.category, g.warehouse_id, g.warehouse_name, g.warehouse_id AS city,
         g.base_demand + coalesce(fa.sold_kg, 0.0) AS actual_demand_kg, g.price_per_kg,
         round((g.base_demand + coalesce(fa.sold_kg, 0.0)) * g.price_per_kg + 1e-9, 2) AS revenue,
         least(greatest(round(28.0 + 7.0 * sin(2.0 * pi() * (dayofyear(g.date) - 30) / 365.0) + 1e-9, 1),
                        CAST(15.0 AS DOUBLE)), CAST(45.0 AS DOUBLE)) AS temp_c,
         dayname(g.date) AS day_name, CAST(isodow(g.date) - 1 AS INTEGER) AS day_of_week,
         CAST(isodow(g.date) >= 6 AS INTEGER) AS is_weekend, CAST(month(g.date) AS INTEGER) AS month,
         CAST(dayofyear(g.date) AS INTEGER) AS day_of_year,
         round(greatest(CAST(1.0 AS DOUBLE), coalesce(fd.fm, 1.0)) + 1e-9, 2) AS festival_multiplier,
         g.base_demand, fa.sold_kg
  FROM grid g LEFT JOIN facts fa ON g.date = fa.date AND g.sku_id = fa.sku_id AND g.warehouse_id = fa.warehouse_id
  LEFT JOIN fest_day fd ON g.date = fd.date
)"""

ACTIVE = f"""
active_full AS (
  SELECT *, CAST(shelf_life_days - ({AS_OF} - procurement_date) AS INTEGER) AS days_remaining
  FROM lots WHERE procurement_date <= {AS_OF} AND ({AS_OF} - procurement_date) <= shelf_life_days
),
active_p AS (SELECT *, days_remaining / shelf_life_days AS pct FROM active_full),
active AS (
  SELECT lot_id, sku_id, sku_name, category, warehouse_id, warehouse_name, procurement_date,
         procurement_date + shelf_life_days AS expiry_date, days_remaining, shelf_life_days,
         round(pct * 100.0 + 1e-9, 1) AS pct_shelf_remaining, quantity_kg, price_per_kg,
         lot_value AS lot_value_inr,
         CASE WHEN pct < 0.2 THEN CAST(99 - floor((pct - 0.0) / CAST(0.2 AS DOUBLE) * 17.0 + 1e-9) AS INTEGER)
              WHEN pct < 0.4 THEN CAST(81 - floor((pct - 0.2) / CAST(0.2 AS DOUBLE) * 19.0 + 1e-9) AS INTEGER)
              WHEN pct < 0.6 THEN CAST(61 - floor((pct - 0.4) / CAST(0.2 AS DOUBLE) * 21.0 + 1e-9) AS INTEGER)
              ELSE CAST(39 - floor((pct - 0.6) / CAST(0.4 AS DOUBLE) * 29.0 + 1e-9) AS INTEGER) END AS risk_score,
         CASE WHEN pct < 0.2 THEN 'CRITICAL' WHEN pct < 0.4 THEN 'HIGH' WHEN pct < 0.6 THEN 'MEDIUM' ELSE 'LOW' END
           AS risk_level,
         CASE WHEN pct < 0.2 THEN '🔴 Redistribute or discount immediately (< 12h)'
              WHEN pct < 0.4 THEN '🟠 Offer 25% discount to bulk buyers today'
              WHEN pct < 0.6 THEN '🟡 Prioritise dispatch in next shipment'
              ELSE '🟢 Monitor — on track for normal dispatch' END AS recommended_action,
         temp_deviation_c, supplier_id, over_order_factor, age_pct, dispatched, pct
  FROM active_p
)"""

# Per-series feature rows (lags, gated rolling stats) and the W7 split.
FEATURES = """
feat0 AS (
  SELECT *,
    lag(actual_demand_kg, 1) OVER w AS lag_1, lag(actual_demand_kg, 2) OVER w AS lag_2,
    lag(actual_demand_kg, 3) OVER w AS lag_3, lag(actual_demand_kg, 7) OVER w AS lag_7,
    lag(actual_demand_kg, 14) OVER w AS lag_14,
    CASE WHEN count(actual_demand_kg) OVER w7 = 7 THEN avg(actual_demand_kg) OVER w7 END AS rolling_7_mean,
    CASE WHEN count(actual_demand_kg) OVER w7 = 7 THEN stddev_samp(actual_demand_kg) OVER w7 END AS rolling_7_std,
    CASE WHEN count(actual_demand_kg) OVER w14 = 14 THEN avg(actual_demand_kg) OVER w14 END AS rolling_14_mean
  FROM demand
  WINDOW w AS (PARTITION BY sku_id, warehouse_id ORDER BY date),
         w7 AS (PARTITION BY sku_id, warehouse_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w14 AS (PARTITION BY sku_id, warehouse_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)
),
feat AS (
  SELECT * FROM feat0 WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL AND lag_7 IS NOT NULL
    AND lag_14 IS NOT NULL AND rolling_7_mean IS NOT NULL AND rolling_7_std IS NOT NULL AND rolling_14_mean IS NOT NULL
),
split AS (
  SELECT *, row_number() OVER (PARTITION BY sku_id, warehouse_id ORDER BY date) AS row_in_series,
         greatest(30, CAST(floor(count(*) OVER (PARTITION BY sku_id, warehouse_id) * 0.85) AS INTEGER)) AS cut
  FROM feat
),
split2 AS (SELECT *, CASE WHEN row_in_series <= cut THEN 'train' ELSE 'test' END AS split FROM split),
naive AS (
  SELECT sku_id, warehouse_id, date, row_in_series, actual_demand_kg AS actual,
         rolling_7_mean AS pred_ma7, lag_7 AS pred_lag7
  FROM split2 WHERE split = 'test'
),
naive_sku AS (
  SELECT sku_id,
    avg(abs(actual - pred_ma7) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS m7,
    avg(abs(actual - pred_lag7) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS l7,
    count(*) AS n_test
  FROM naive GROUP BY sku_id
),
mape_sku AS (
  SELECT sku_id, round(m7 + 1e-9, 4) AS mape, round(l7 + 1e-9, 4) AS mape_lag7,
         round((l7 - m7) / l7 * 100 + 1e-9, 4) AS improvement_pct, n_test,
         round(avg(m7) OVER () + 1e-9, 4) AS avg_mape
  FROM naive_sku
)"""

# Series state for the heuristic forecast and the newsvendor.
STATE = """
ranked AS (
  SELECT sku_id, warehouse_id, date, actual_demand_kg,
         row_number() OVER (PARTITION BY sku_id, warehouse_id ORDER BY date DESC) AS rk
  FROM demand
),
state AS (
  SELECT sku_id, warehouse_id, max(date) AS last_date, count(*) AS n_rows,
         avg(CASE WHEN rk <= 30 THEN actual_demand_kg END) AS mu,
         stddev_pop(CASE WHEN rk <= 30 THEN actual_demand_kg END) AS sigma,
         max(CASE WHEN rk = 1 THEN actual_demand_kg END) AS y_last,
         max(CASE WHEN rk = 14 THEN actual_demand_kg END) AS y_first
  FROM ranked GROUP BY sku_id, warehouse_id
),
state2 AS (SELECT *, (y_last - y_first) / CAST(14.0 AS DOUBLE) * 0.3 AS trend FROM state),
fc0 AS (
  SELECT sku_id, warehouse_id, mu, sigma, trend, step, last_date + CAST(step AS INTEGER) AS date
  FROM state2, range(1, 15) r(step) WHERE n_rows >= 30
),
fc1 AS (
  SELECT *, greatest((mu + trend * step) * CASE isodow(date) WHEN 1 THEN 0.75 WHEN 2 THEN 0.90 WHEN 3 THEN 1.00
              WHEN 4 THEN 1.05 WHEN 5 THEN 1.10 WHEN 6 THEN 1.20 ELSE 1.15 END, CAST(0.0 AS DOUBLE)) + 0.0 AS f,
         sigma * (CAST(1.0 AS DOUBLE) + step * CAST(0.04 AS DOUBLE)) AS u
  FROM fc0
),
forecast AS (
  SELECT sku_id, warehouse_id, date, CAST(step AS INTEGER) AS step,
         round(f + 1e-9, 1) AS forecast_kg,
         round(greatest(f - u * 1.5, CAST(0.0 AS DOUBLE)) + 0.0 + 1e-9, 1) AS lower_bound,
         round(f + u * 1.5 + 1e-9, 1) AS upper_bound,
         greatest(round(f + -0.8416212335729142 * greatest(u, CAST(0.01 AS DOUBLE)) + 1e-9, 1), CAST(0.0 AS DOUBLE)) + 0.0
           AS optimal_order,
         'Forecast' AS type
  FROM fc1
)"""

BASE = [RNG, SKU_PART, SKU_DIM, SUP_WH, LINES, LOTS, FY_LOTS, FESTIVALS, DEMAND, ACTIVE, FEATURES, STATE]


def with_base(body: str) -> str:
    return "WITH " + ",".join(BASE) + "\n" + body


def r4(x: str) -> str:
    return f"round({x} + 1e-9, 4)"


def r2(x: str) -> str:
    return f"round({x} + 1e-9, 2)"


ORACLE: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    ORACLE[name] = with_base(body)


# ------------------------------------------------------------------ boosted trees per sku
def boosted(trees: int, depth: int, bins: int, rate: float) -> str:
    """CTEs that grow the trees: per tree and level the nodes of all rows, their
    histograms and the best split of each node; r holds residuals of the
    training rows and minus the prediction's sum of leaves for the others."""
    names = ["lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "rolling_7_mean", "rolling_7_std", "rolling_14_mean",
             "day_of_week", "month", "day_of_year", "is_weekend", "temp_c", "festival_multiplier"]
    xs = "[" + ", ".join(f"CAST({n} AS DOUBLE)" for n in names) + "]"
    out = [f"""
brows AS MATERIALIZED (
  SELECT sku_id, warehouse_id, date, actual_demand_kg AS y, split = 'train' AS tr, {xs} AS f
  FROM (SELECT *, count(*) OVER (PARTITION BY sku_id, warehouse_id) AS nf FROM split2) q WHERE nf >= 50
)""", """
bbounds AS MATERIALIZED (
  SELECT sku_id, list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi, any_value(base) AS base
  FROM (SELECT sku_id, i, min(f[i]) AS lo, max(f[i]) AS hi, avg(y) AS base FROM brows, range(1, 15) r(i) WHERE tr GROUP BY sku_id, i) q GROUP BY sku_id
)""", f"""
n_1_0 AS MATERIALIZED (
  SELECT sku_id, warehouse_id, date, y, tr, y - base AS r, 1 AS node, CAST(0 AS DOUBLE) AS p,
         list_transform(range(1, 15), lambda i: CASE WHEN hi[i] > lo[i] THEN greatest(0, least({bins - 1}, CAST(floor((f[i] - lo[i]) / (hi[i] - lo[i]) * {bins}) AS INTEGER))) ELSE 0 END) AS x
  FROM brows JOIN bbounds USING (sku_id)
)"""]
    for k in range(1, trees + 1):
        for d in range(depth):
            out.append(f"""
s_{k}_{d} AS MATERIALIZED (
  SELECT sku_id, node, i, bin FROM (
    SELECT *, row_number() OVER (PARTITION BY sku_id, node ORDER BY g DESC, i, bin) AS rn FROM (
      SELECT *, CAST(sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS FLOAT) AS g FROM (
        SELECT sku_id, node, i, bin, sum(s) OVER u AS sl, sum(n) OVER u AS nl, sum(s) OVER w AS st, sum(n) OVER w AS nt
        FROM (SELECT sku_id, node, i, x[i] AS bin, sum(r) AS s, count(*) AS n FROM n_{k}_{d}, range(1, 15) t(i) WHERE tr GROUP BY 1, 2, 3, 4) h
        WINDOW w AS (PARTITION BY sku_id, node, i), u AS (PARTITION BY sku_id, node, i ORDER BY bin)) c
      WHERE nt > nl) q) z WHERE rn = 1 AND g > 0
)""")
            out.append(f"""
n_{k}_{d + 1} AS MATERIALIZED (
  SELECT n.* REPLACE (2 * n.node + CASE WHEN x[s.i] > s.bin THEN 1 ELSE 0 END AS node)
  FROM n_{k}_{d} n LEFT JOIN s_{k}_{d} s ON n.sku_id = s.sku_id AND n.node = s.node
)""")
        out.append(f"""
v_{k} AS MATERIALIZED (SELECT sku_id, node, avg(r) * CAST({rate} AS DOUBLE) AS v FROM n_{k}_{depth} WHERE tr GROUP BY 1, 2)""")
        out.append(f"""
n_{k + 1}_0 AS MATERIALIZED (
  SELECT n.* REPLACE (n.r - coalesce(v, 0) AS r, n.p + coalesce(v, 0) AS p, 1 AS node)
  FROM n_{k}_{depth} n LEFT JOIN v_{k} v ON n.sku_id = v.sku_id AND n.node = v.node
)""")
    return "," + ",".join(out)


def boosted_value(trees: int, depth: int, x: str) -> str:
    """Sum of the leaves that the binned features reach, from columns of bmodel."""
    def node(k, at):
        if at >= 1 << depth:
            return f"v_{k}_{at}"
        return f"CASE WHEN i_{k}_{at} IS NOT NULL AND {x}[i_{k}_{at}] > b_{k}_{at} THEN {node(k, 2 * at + 1)} ELSE {node(k, 2 * at)} END"
    return " + ".join(f"({node(k, 1)})" for k in range(1, trees + 1))


def boosted_model(trees: int, depth: int) -> str:
    """bmodel: one row per sku, a column per node."""
    cols, joins = [], []
    for k in range(1, trees + 1):
        for d in range(depth):
            inner = ", ".join(f"max(CASE WHEN node = {n} THEN i END) AS i_{k}_{n}, max(CASE WHEN node = {n} THEN bin END) AS b_{k}_{n}" for n in range(1 << d, 2 << d))
            cols += [f"{c}_{k}_{n}" for n in range(1 << d, 2 << d) for c in "ib"]
            joins.append(f"LEFT JOIN (SELECT sku_id, {inner} FROM s_{k}_{d} GROUP BY sku_id) q_{k}_{d} USING (sku_id)")
        inner = ", ".join(f"max(CASE WHEN node = {n} THEN v END) AS w_{k}_{n}" for n in range(1 << depth, 2 << depth))
        cols += [f"coalesce(w_{k}_{n}, 0) AS v_{k}_{n}" for n in range(1 << depth, 2 << depth)]
        joins.append(f"LEFT JOIN (SELECT sku_id, {inner} FROM v_{k} GROUP BY sku_id) l_{k} USING (sku_id)")
    return f"""
, bmodel AS MATERIALIZED (SELECT sku_id, lo, hi, base, {', '.join(cols)} FROM bbounds {' '.join(joins)})"""


SMALL = (2, 2, 16, 0.35)
sql("sku_small_model_mape", boosted(*SMALL) + f"""
, m AS (SELECT n.sku_id, avg(abs(y - greatest(base + p, 0)) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS m, count(*) AS n_test
        FROM n_{SMALL[0] + 1}_0 n JOIN bbounds USING (sku_id) WHERE NOT tr GROUP BY n.sku_id)
SELECT sku_id, {r4('m')} AS mape, n_test, round(avg(m) OVER () + 1e-9, 4) AS avg_mape FROM m""")

sql("sku_small_model_forecast", boosted(*SMALL) + boosted_model(*SMALL[:2]) + f"""
, start AS (
  SELECT sku_id, warehouse_id, max(date) AS last_date, arg_max(temp_c, date) AS t, list(actual_demand_kg ORDER BY date) AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, warehouse_id ORDER BY date DESC) AS rk FROM demand) q WHERE rk <= 14 GROUP BY 1, 2),
fold AS (
  WITH RECURSIVE z AS (
    SELECT sku_id, warehouse_id, last_date, t, h, 0 AS step, CAST(NULL AS DOUBLE) AS y FROM start
    UNION ALL
    SELECT sku_id, warehouse_id, last_date, t, list_append(h[2:14], y), step, y FROM (
      SELECT sku_id, warehouse_id, last_date, t, h, step, greatest(base + {boosted_value(*SMALL[:2], 'x')}, 0) AS y FROM (
        SELECT c.* EXCLUDE (f), m.*  EXCLUDE (sku_id),
               list_transform(range(1, 15), lambda i: CASE WHEN hi[i] > lo[i] THEN greatest(0, least({SMALL[2] - 1}, CAST(floor((f[i] - lo[i]) / (hi[i] - lo[i]) * {SMALL[2]}) AS INTEGER))) ELSE 0 END) AS x
        FROM (SELECT sku_id, warehouse_id, last_date, t, h, step + 1 AS step,
                     [h[14], h[13], h[12], h[8], h[1], list_avg(h[8:14]), list_stddev_samp(h[8:14]), list_avg(h),
                      CAST(isodow(last_date + CAST(step + 1 AS INTEGER)) - 1 AS DOUBLE), CAST(month(last_date + CAST(step + 1 AS INTEGER)) AS DOUBLE),
                      CAST(dayofyear(last_date + CAST(step + 1 AS INTEGER)) AS DOUBLE),
                      CAST(CASE WHEN isodow(last_date + CAST(step + 1 AS INTEGER)) >= 6 THEN 1 ELSE 0 END AS DOUBLE), t, CAST(1.0 AS DOUBLE)] AS f
              FROM z WHERE step < 14) c JOIN bmodel m ON c.sku_id = m.sku_id) e) g)
  SELECT * FROM z)
SELECT sku_id, warehouse_id, CAST(step AS INTEGER) AS step, last_date + CAST(step AS INTEGER) AS date, {r4('y')} AS forecast_kg FROM fold WHERE step > 0""")

# ------------------------------------------------------------------ KPIs
sql("wastage_kpi", f"""
SELECT {r2('sum(lot_value)')} AS total_value, {r2('sum(spoiled_value)')} AS spoiled_value,
       {r4('sum(spoiled_value) / sum(lot_value) * 100.0')} AS wastage_pct FROM lots""")

sql("fill_rate_kpi", f"""
SELECT {r2('sup')} AS total_supplied_kg, {r2('dem')} AS total_demand_kg,
       least(CAST(100.0 AS DOUBLE), round(sup / dem * 100.0 + 1e-9, 1)) AS fill_rate
FROM (SELECT (SELECT sum(quantity_kg) - sum(spoiled_kg) FROM fy_lots) AS sup,
             (SELECT sum(actual_demand_kg) FROM demand) AS dem) x""")

sql("inventory_turnover_kpi", f"""
SELECT {r2('cogs')} AS annual_cogs, {r2('inv')} AS avg_inventory_value,
       least(CAST(68.0 AS DOUBLE), round(cogs / greatest(inv, CAST(1.0 AS DOUBLE)) + 1e-9, 1)) AS inventory_turnover
FROM (SELECT (SELECT sum(revenue) FROM demand) AS cogs,
             (SELECT sum(m) * (sum(ps) / sum(n)) FROM (SELECT sku_id, avg(quantity_kg) AS m, sum(price_per_kg) AS ps,
                     count(*) AS n FROM fy_lots GROUP BY sku_id) s) AS inv) x""")

sql("impact_summary", f"""
SELECT {r4('b')} AS baseline_wastage_pct, {r4('b * 0.65')} AS target_wastage_pct,
       CAST(round((sv - sv * 0.65) / 1e5 + 1e-9, 0) AS BIGINT) AS recovery_lakhs,
       CAST(round(100.0 - am + 1e-9, 0) AS BIGINT) AS forecast_accuracy, {r4('am')} AS avg_mape
FROM (SELECT sv, sv / tv * 100.0 AS b, am FROM
      (SELECT (SELECT sum(spoiled_value) FROM lots) AS sv, (SELECT sum(lot_value) FROM lots) AS tv,
              (SELECT avg(mape) FROM mape_sku) AS am) y) x""")

sql("wastage_by_category", f"""
SELECT category, {r2('sum(lot_value)')} AS total_value, {r2('sum(spoiled_value)')} AS spoiled_value,
       {r4('sum(spoiled_value) / sum(lot_value) * 100.0')} AS wastage_pct
FROM lots GROUP BY category""")

sql("wastage_by_month", f"""
SELECT CAST(year(procurement_date) AS INTEGER) AS year, CAST(month(procurement_date) AS INTEGER) AS month, strftime(make_date(2000, CAST(month(procurement_date) AS INTEGER), 1), '%b') AS month_name,
       {r2('sum(spoiled_value)')} AS spoiled, {r2('sum(lot_value)')} AS total,
       {r4('sum(spoiled_value) / sum(lot_value) * 100.0')} AS wastage_pct,
       {r4('sum(spoiled_value) / 1e5')} AS spoiled_lakhs
FROM lots GROUP BY 1, 2, 3""")

sql("wastage_by_sku", f"""
SELECT sku_name, category, {r4('avg(spoilage_pct)')} AS mean_spoilage_pct FROM lots GROUP BY sku_name, category""")

sql("wastage_rollup", f"""
, s AS (SELECT sku_name, category, {r4('avg(spoilage_pct)')} AS v FROM lots GROUP BY sku_name, category)
SELECT category, sku_name, 'sku' AS node_level, {r4('v')} AS value FROM s
UNION ALL SELECT category, NULL, 'category', {r4('sum(v)')} FROM s GROUP BY category
UNION ALL SELECT NULL, NULL, 'total', {r4('sum(v)')} FROM s""")

sql("over_ordering_by_category", f"""
SELECT category, {r4('avg(over_order_factor)')} AS avg_over_order, {r2('sum(spoiled_value)')} AS total_spoiled_value
FROM lots GROUP BY category""")

sql("kpi_month_delta", f"""
, lm AS (SELECT CAST(year(procurement_date) AS INTEGER) AS year, CAST(month(procurement_date) AS INTEGER) AS month,
               sum(lot_value) AS tv, sum(spoiled_value) AS sv,
               sum(quantity_kg) - sum(spoiled_kg) AS sup FROM fy_lots GROUP BY 1, 2),
inv AS (SELECT year, month, sum(m) * (sum(ps) / sum(n)) AS inv FROM
        (SELECT CAST(year(procurement_date) AS INTEGER) AS year, CAST(month(procurement_date) AS INTEGER) AS month, sku_id,
                avg(quantity_kg) AS m, sum(price_per_kg) AS ps, count(*) AS n FROM fy_lots GROUP BY 1, 2, 3) q GROUP BY 1, 2),
dm AS (SELECT CAST(year(date) AS INTEGER) AS year, month, sum(actual_demand_kg) AS dem, sum(revenue) AS rev FROM demand GROUP BY 1, 2),
k AS (
  SELECT dm.year, dm.month, {r4('lm.sv / lm.tv * 100.0')} AS wastage_pct,
         least(CAST(100.0 AS DOUBLE), round(lm.sup / dm.dem * 100.0 + 1e-9, 1)) AS fill_rate,
         least(CAST(68.0 AS DOUBLE), round(dm.rev / greatest(coalesce(inv.inv, 0.0), CAST(1.0 AS DOUBLE)) + 1e-9, 1)) AS turnover
  FROM dm LEFT JOIN lm USING (year, month) LEFT JOIN inv USING (year, month))
SELECT year, month, wastage_pct, fill_rate, turnover,
       {r4('wastage_pct - lag(wastage_pct) OVER (ORDER BY year, month)')} AS wastage_pct_delta,
       {r4('fill_rate - lag(fill_rate) OVER (ORDER BY year, month)')} AS fill_rate_delta,
       {r4('turnover - lag(turnover) OVER (ORDER BY year, month)')} AS turnover_delta
FROM k""")

sql("filtered_lots", """
SELECT lot_id, sku_id, category, warehouse_name, procurement_date, quantity_kg, lot_value, spoiled_value
FROM lots WHERE warehouse_name = 'ASIA HUB' AND category IN ('Dairy', 'Meat & Poultry')""")

sql("sku_options", "SELECT DISTINCT sku_id, sku_name FROM demand")
sql("warehouse_options", "SELECT DISTINCT warehouse_id, warehouse_name FROM demand")

# ------------------------------------------------------------------ lots and alerts
sql("active_lots", """
SELECT lot_id, sku_id, sku_name, category, warehouse_id, warehouse_name, procurement_date, expiry_date,
       days_remaining, shelf_life_days, pct_shelf_remaining, quantity_kg, price_per_kg, lot_value_inr,
       risk_score, risk_level, recommended_action, temp_deviation_c
FROM active""")

sql("risk_level_counts", """
SELECT risk_level, count(*) AS lot_count,
       CAST(CASE risk_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS INTEGER) AS level_rank
FROM active GROUP BY risk_level""")

sql("risk_level_summary", f"""
SELECT count(*) FILTER (WHERE risk_level = 'CRITICAL') AS n_critical,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS n_medium,
       count(*) FILTER (WHERE risk_level = 'LOW') AS n_low,
       {r2("coalesce(sum(CASE WHEN risk_level IN ('CRITICAL', 'HIGH') THEN lot_value_inr END), 0.0)")} AS value_at_risk
FROM active""")

sql("value_at_risk_by_category", f"""
SELECT category, {r2('sum(lot_value_inr)')} AS lot_value_inr FROM active
WHERE risk_level IN ('CRITICAL', 'HIGH') GROUP BY category""")

sql("top_critical_alerts", """
SELECT lot_id, sku_name, category, warehouse_name, days_remaining, quantity_kg,
       '₹' || format('{:,}', CAST(round(lot_value_inr + 1e-9, 0) AS BIGINT)) AS value_text,
       temp_deviation_c, recommended_action
FROM active WHERE risk_level = 'CRITICAL'
ORDER BY risk_score DESC, lot_id, quantity_kg, lot_value_inr LIMIT 5""")

sql("alert_table", """
SELECT lot_id, sku_name AS sku, category, warehouse_name AS warehouse, days_remaining AS days_left,
       pct_shelf_remaining AS pct_shelf_life_left, round(quantity_kg, 1) AS qty_kg,
       '₹' || format('{:,}', CAST(round(lot_value_inr + 1e-9, 0) AS BIGINT)) AS value_text, risk_score,
       CASE risk_level WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END
         || ' ' || risk_level AS risk_label,
       recommended_action
FROM active WHERE risk_level IN ('CRITICAL', 'HIGH', 'MEDIUM')""")

sql("procurement_schedule", f"""
, s AS (SELECT sku_id, warehouse_id, any_value(shelf_life_days) AS shelf_life_days FROM lots GROUP BY 1, 2)
SELECT sku_id, warehouse_id, shelf_life_days, CAST(greatest(1, shelf_life_days // 2) AS INTEGER) AS interval_days,
       CAST(unnest(generate_series({FY_START}, {FY_END}, to_days(CAST(greatest(1, shelf_life_days // 2) AS INTEGER))))
            AS DATE) AS procurement_date
FROM s""")

sql("lot_freshness", """
SELECT lot_id, procurement_date, effective_shelf_life, expiry_date, age_pct, days_to_expiry FROM lots""")

sql("lot_financials", """
SELECT lot_id, quantity_kg, price_per_kg, lot_value, spoilage_pct, spoiled_kg, spoiled_value FROM lots""")

sql("spoilage_probability", """
SELECT lot_id, category, round(spoil_prob, 6) AS spoil_prob, did_spoil FROM lots""")

sql("lot_risk_score", """
SELECT lot_id, age_pct, temp_deviation_c, category, risk_score FROM lots""")

# ------------------------------------------------------------------ demand and calendar
sql("demand_facts", """
SELECT CAST(l_shipdate AS DATE) AS date, sku_id, any_value(sku_name) AS sku_name, any_value(category) AS category,
       warehouse_id, any_value(warehouse_name) AS warehouse_name, sum(l_quantity) AS demand_kg,
       any_value(price_per_kg) AS price_per_kg, round(sum(l_quantity) * any_value(price_per_kg) + 1e-9, 2) AS revenue
FROM lines GROUP BY 1, sku_id, warehouse_id""")

sql("demand_grid", """
SELECT date, sku_id, sku_name, category, warehouse_id, warehouse_name, city, actual_demand_kg, price_per_kg,
       revenue, temp_c, day_name, day_of_week, is_weekend, month, day_of_year, festival_multiplier
FROM demand""")

sql("calendar_features", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, sku_id, warehouse_id,
       CAST(isodow(CAST(l_shipdate AS DATE)) - 1 AS INTEGER) AS day_of_week, dayname(CAST(l_shipdate AS DATE)) AS day_name,
       CAST(isodow(CAST(l_shipdate AS DATE)) >= 6 AS INTEGER) AS is_weekend,
       CAST(month(CAST(l_shipdate AS DATE)) AS INTEGER) AS month,
       CAST(dayofyear(CAST(l_shipdate AS DATE)) AS INTEGER) AS day_of_year
FROM lines""")

sql("festival_multiplier", f"""
, d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
m AS (SELECT d.date, max(f.mult * (1.0 - abs(d.date - f.fdate) / (f.win + 1) * 0.4)) AS fm
      FROM d JOIN festivals f ON abs(d.date - f.fdate) <= f.win GROUP BY d.date)
SELECT d.date, {r4('greatest(CAST(1.0 AS DOUBLE), coalesce(m.fm, 1.0))')} AS festival_multiplier
FROM d LEFT JOIN m ON d.date = m.date""")

sql("expected_demand", f"""
, ws AS (SELECT warehouse_id, (s / n) / (sum(s) OVER () / sum(n) OVER ()) AS wh_scale
         FROM (SELECT warehouse_id, sum(actual_demand_kg) AS s, count(*) AS n FROM demand GROUP BY warehouse_id) q)
SELECT d.date, d.sku_id, d.warehouse_id, {r4('ws.wh_scale')} AS wh_scale,
       {r4('''d.base_demand * ws.wh_scale * (CASE isodow(d.date) WHEN 1 THEN 0.75 WHEN 2 THEN 0.90 WHEN 3 THEN 1.00
              WHEN 4 THEN 1.05 WHEN 5 THEN 1.10 WHEN 6 THEN 1.20 ELSE 1.15 END)
         * (CAST(1.0 AS DOUBLE) + 0.15 * sin(2.0 * pi() * (d.day_of_year - 60) / 365.0))
         * d.festival_multiplier
         * (CASE WHEN d.temp_c > 38 AND d.category = 'Meat & Poultry' THEN 0.85
                 WHEN d.temp_c > 35 AND d.category = 'Dairy' THEN 1.10 ELSE 1.0 END)''')} AS expected_demand_kg
FROM demand d JOIN ws ON d.warehouse_id = ws.warehouse_id""")

# ------------------------------------------------------------------ features
sql("lag_features", """
SELECT date, sku_id, warehouse_id, actual_demand_kg,
  lag(actual_demand_kg, 1) OVER w AS lag_1, lag(actual_demand_kg, 2) OVER w AS lag_2,
  lag(actual_demand_kg, 3) OVER w AS lag_3, lag(actual_demand_kg, 7) OVER w AS lag_7,
  lag(actual_demand_kg, 14) OVER w AS lag_14
FROM demand WINDOW w AS (PARTITION BY sku_id, warehouse_id ORDER BY date)""")

sql("rolling_features", f"""
SELECT date, sku_id, warehouse_id, actual_demand_kg, {r4('rolling_7_mean')} AS rolling_7_mean,
       {r4('rolling_7_std')} AS rolling_7_std, {r4('rolling_14_mean')} AS rolling_14_mean FROM feat0""")

sql("train_test_split", """
SELECT sku_id, warehouse_id, date, CAST(row_in_series AS INTEGER) AS row_in_series, split FROM split2""")

sql("dow_pattern", f"""
, g AS (SELECT sku_id, warehouse_id, day_name, {r4('avg(actual_demand_kg)')} AS avg_demand_kg
        FROM demand GROUP BY 1, 2, 3),
dom(day_name, dow_rank) AS (VALUES ('Monday', 0), ('Tuesday', 1), ('Wednesday', 2), ('Thursday', 3),
                                   ('Friday', 4), ('Saturday', 5), ('Sunday', 6)),
s AS (SELECT DISTINCT sku_id, warehouse_id FROM demand)
SELECT s.sku_id, s.warehouse_id, dom.day_name, CAST(dom.dow_rank AS INTEGER) AS dow_rank, g.avg_demand_kg
FROM s CROSS JOIN dom LEFT JOIN g ON s.sku_id = g.sku_id AND s.warehouse_id = g.warehouse_id
     AND dom.day_name = g.day_name""")

sql("history_tail", """
SELECT sku_id, warehouse_id, date, actual_demand_kg FROM ranked WHERE rk <= 60""")

# ------------------------------------------------------------------ forecast
sql("newsvendor", f"""
SELECT sku_id, warehouse_id, {r4('mu')} AS mu, {r4('sigma')} AS sigma,
       greatest(round(mu + -0.8416212335729142 * greatest(sigma, CAST(0.01 AS DOUBLE)) + 1e-9, 1), CAST(0.0 AS DOUBLE)) + 0.0
         AS optimal_order
FROM state""")

sql("heuristic_forecast", """
SELECT sku_id, warehouse_id, date, step, forecast_kg, lower_bound, upper_bound, optimal_order, type FROM forecast""")

sql("inventory_recommendations", """
, r AS (
  SELECT s.sku_id, s.warehouse_id, d.sku_name, d.category, s.mu,
         round(s.mu + 1e-9, 1) AS naive,
         greatest(round(s.mu + -0.8416212335729142 * greatest(s.sigma, CAST(0.01 AS DOUBLE)) + 1e-9, 1), CAST(0.0 AS DOUBLE)) + 0.0 AS opt,
         d.shelf_life_days, d.price_per_kg
  FROM state s JOIN sku_dim d ON s.sku_id = d.sku_id),
r2 AS (SELECT *, CASE WHEN naive > 0 THEN round((naive - opt) / naive * 100.0 + 1e-9, 1) ELSE 0.0 END AS saved FROM r)
SELECT sku_id, warehouse_id, sku_name, category, round(mu + 1e-9, 1) AS avg_demand_kg, naive AS naive_order_kg,
       opt AS optimal_order, saved AS saved_pct, shelf_life_days, price_per_kg, saved > 20 AS needs_attention
FROM r2""")

sql("history_and_forecast", """
SELECT sku_id, warehouse_id, date, actual_demand_kg AS demand_kg, 'History' AS type,
       CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound, CAST(NULL AS DOUBLE) AS optimal_order
FROM ranked WHERE rk <= 60
UNION ALL
SELECT sku_id, warehouse_id, date, forecast_kg, type, lower_bound, upper_bound, optimal_order FROM forecast""")

sql("naive_mape_by_sku", "SELECT * FROM mape_sku")

sql("mape_summary", f"""
SELECT {r4('avg(mape)')} AS avg_mape, {r4('min(mape)')} AS best_mape, count(*) AS n_skus FROM mape_sku""")

sql("mape_histogram", f"""
, b AS (SELECT mape, min(mape) OVER () AS lo, max(mape) OVER () AS hi FROM mape_sku),
b2 AS (SELECT *, CASE WHEN hi = lo THEN 0
                      ELSE CAST(least(floor((mape - lo) / ((hi - lo) / 15)), 14) AS INTEGER) END AS bucket FROM b)
SELECT CAST(bucket AS INTEGER) AS bucket, {r4('any_value(lo) + bucket * (any_value(hi) - any_value(lo)) / 15')} AS bin_start,
       {r4('any_value(lo) + (bucket + 1) * (any_value(hi) - any_value(lo)) / 15')} AS bin_end, count(*) AS n_skus
FROM b2 GROUP BY bucket""")

sql("d_regression_metrics", f"""
SELECT sku_id, {r4('avg(abs(actual - pred_ma7))')} AS mae, {r4('sqrt(avg((actual - pred_ma7) * (actual - pred_ma7)))')} AS rmse,
       {r4('1.0 - sum((actual - pred_ma7) * (actual - pred_ma7)) / (count(*) * var_pop(actual))')} AS r2, count(*) AS n
FROM naive GROUP BY sku_id""")


# ------------------------------------------------------------------ tier D
YE_STOCK = """
, st AS (SELECT sku_id, warehouse_id, sum(quantity_kg) AS stock_kg FROM lots
         WHERE procurement_date <= (SELECT d1 FROM rng) AND ((SELECT d1 FROM rng) - procurement_date) <= shelf_life_days
         GROUP BY 1, 2)"""

sql("d_dedup_lines", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_date, count(*) AS n_copies,
       max(l_quantity) AS quantity_kg
FROM lineitem GROUP BY 1, 2, 3, 4, 5""")

sql("d_missing_fill", """
SELECT date, sku_id, warehouse_id, sold_kg,
       coalesce(last_value(sold_kg IGNORE NULLS) OVER (PARTITION BY sku_id, warehouse_id ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS filled_kg
FROM demand""")

sql("d_validation", """
SELECT 'valid' AS rule, count(*) AS n_lots FROM lots
WHERE NOT (quantity_kg < 0 OR expiry_date < procurement_date OR sku_id IS NULL OR warehouse_id IS NULL
           OR spoiled_kg > quantity_kg)
UNION ALL SELECT 'negative_quantity', count(*) FROM lots WHERE quantity_kg < 0 HAVING count(*) > 0
UNION ALL SELECT 'expiry_before_procurement', count(*) FROM lots WHERE expiry_date < procurement_date HAVING count(*) > 0
UNION ALL SELECT 'null_key', count(*) FROM lots WHERE sku_id IS NULL OR warehouse_id IS NULL HAVING count(*) > 0
UNION ALL SELECT 'spoiled_exceeds_quantity', count(*) FROM lots WHERE spoiled_kg > quantity_kg HAVING count(*) > 0""")

sql("d_stock_aware_purchase", YE_STOCK + f"""
, j AS (SELECT f.*, coalesce(st.stock_kg, 0.0) AS stock_kg FROM forecast f LEFT JOIN st USING (sku_id, warehouse_id)),
k AS (SELECT *, greatest(stock_kg - coalesce(sum(forecast_kg) OVER (PARTITION BY sku_id, warehouse_id ORDER BY step
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), CAST(0.0 AS DOUBLE)) + 0.0 AS left_kg FROM j)
SELECT sku_id, warehouse_id, date, step, forecast_kg, {r2('stock_kg')} AS stock_kg, {r2('left_kg')} AS stock_left_kg,
       {r2('greatest(forecast_kg - left_kg, CAST(0.0 AS DOUBLE)) + 0.0')} AS purchase_kg
FROM k""")

sql("d_stockout_rate", f"""
, av0 AS (SELECT sku_id, warehouse_id, quantity_kg,
                 CAST(unnest(generate_series(procurement_date, expiry_date - 1, INTERVAL 1 DAY)) AS DATE) AS date
          FROM lots),
av AS (SELECT sku_id, warehouse_id, date, sum(quantity_kg) AS avail_kg FROM av0
       WHERE date BETWEEN {FY_START} AND {FY_END} GROUP BY 1, 2, 3),
j AS (SELECT d.warehouse_id, d.actual_demand_kg AS dem,
             greatest(d.actual_demand_kg - coalesce(av.avail_kg, 0.0), CAST(0.0 AS DOUBLE)) + 0.0 AS unf
      FROM demand d LEFT JOIN av ON d.sku_id = av.sku_id AND d.warehouse_id = av.warehouse_id AND d.date = av.date)
SELECT warehouse_id, {r2('sum(dem)')} AS demand_kg, {r2('sum(unf)')} AS unfilled_kg,
       {r4('sum(unf) / sum(dem) * 100')} AS stockout_rate_pct
FROM j GROUP BY warehouse_id""")

sql("d_overview_counts", f"""
SELECT (SELECT {r2('sum(quantity_kg)')} FROM active) AS total_inventory_kg,
       (SELECT count(DISTINCT sku_id) FROM active) AS active_products,
       (SELECT {r2('sum(actual_demand_kg) / count(DISTINCT date)')} FROM demand) AS daily_demand_kg,
       (SELECT count(DISTINCT sku_id) FROM active WHERE risk_level IN ('CRITICAL', 'HIGH')) AS high_risk_products""")

sql("d_net_wastage_saved", f"""
, m AS (SELECT CAST(year(procurement_date) AS INTEGER) AS year, CAST(month(procurement_date) AS INTEGER) AS month,
              sum(lot_value) AS tv, sum(spoiled_value) AS sv FROM fy_lots GROUP BY 1, 2),
b AS (SELECT *, sum(sv) OVER w / sum(tv) OVER w * 100 AS base, sv / tv * 100 AS cur FROM m
      WINDOW w AS (ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT year, month, {r2('tv')} AS total_value, {r4('cur')} AS wastage_pct, {r4('base')} AS baseline_pct,
       {r2('(base - cur) / 100 * tv')} AS net_saved
FROM b""")

sql("d_over_order_factor", YE_STOCK + f"""
, f3 AS (SELECT sku_id, warehouse_id, sum(forecast_kg) AS f3 FROM forecast WHERE step <= 3 GROUP BY 1, 2)
SELECT f3.sku_id, f3.warehouse_id, {r2('coalesce(st.stock_kg, 0.0)')} AS stock_kg, {r2('f3.f3')} AS next3_forecast_kg,
       CASE WHEN f3.f3 = 0 THEN NULL ELSE {r4('coalesce(st.stock_kg, 0.0) / f3.f3')} END AS over_order_factor
FROM f3 LEFT JOIN st ON f3.sku_id = st.sku_id AND f3.warehouse_id = st.warehouse_id""")

SPLIT = """
, sb AS (SELECT *, CAST('0x' || substr(md5(lot_id), 1, 3) AS INTEGER) AS b FROM lots),
sc AS (SELECT did_spoil, b, count(*) AS n FROM sb GROUP BY 1, 2),
sk AS (SELECT did_spoil, max(b) AS cut FROM (SELECT *, sum(n) OVER (PARTITION BY did_spoil ORDER BY b) AS upto,
              sum(n) OVER (PARTITION BY did_spoil) AS total FROM sc) q WHERE upto <= CAST(0.8 AS DOUBLE) * total GROUP BY 1),
sp AS (SELECT sb.*, coalesce(sb.b <= sk.cut, false) AS is_train FROM sb LEFT JOIN sk ON sb.did_spoil = sk.did_spoil)"""

sql("d_target_encoding", SPLIT + f"""
, tr AS (SELECT * FROM sp WHERE is_train)
SELECT category AS level, {r4('avg(did_spoil)')} AS encoding, count(*) AS n_train, 'category' AS feature
FROM tr GROUP BY category
UNION ALL
SELECT warehouse_id, {r4('avg(did_spoil)')}, count(*), 'warehouse_id' FROM tr GROUP BY warehouse_id""")

sql("spoilage_split", SPLIT + " SELECT did_spoil, is_train, count(*) AS n_lots FROM sp GROUP BY 1, 2")

sql("class_weights", SPLIT + f"""
SELECT did_spoil, {r4('sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE))')} AS class_weight, count(*) AS n_train
FROM sp WHERE is_train GROUP BY 1""")

sql("spoilage_features", """
, ce AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS DOUBLE) AS category_enc FROM (SELECT DISTINCT category FROM lots) q),
we AS (SELECT warehouse_id, CAST(row_number() OVER (ORDER BY warehouse_id) - 1 AS DOUBLE) AS warehouse_enc FROM (SELECT DISTINCT warehouse_id FROM lots) q)
SELECT lot_id, age_pct, temp_deviation_c, over_order_factor, quantity_kg, shelf_life_days, price_per_kg, category_enc, warehouse_enc
FROM lots JOIN ce USING (category) JOIN we USING (warehouse_id)""")

_RULED = ", z AS (SELECT did_spoil AS y, CAST(spoil_prob >= 0.5 AS INTEGER) AS p FROM lots)"

sql("rule_metrics", _RULED + f"""
, c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
               count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM z)
SELECT {r4('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {r4('2 * tp / (2 * tp + fp + fn)')} AS f1_score,
       {r4('tp / (tp + fp)')} AS precision_spoil, {r4('tp / (tp + fn)')} AS recall_spoil, tp + fn AS support_spoil,
       {r4('tn / (tn + fn)')} AS precision_no_spoil, {r4('tn / (tn + fp)')} AS recall_no_spoil, tn + fp AS support_no_spoil,
       tp + tn + fp + fn AS n_test FROM c""")

sql("rule_confusion", _RULED + """
SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted, (SELECT count(*) FROM z WHERE y = a AND p = b) AS n
FROM range(0, 2) r(a), range(0, 2) s(b)""")

sql("series_rows", """
SELECT date, sku_id, warehouse_id, actual_demand_kg FROM demand""")

sql("naive_actual_vs_predicted", f"""
SELECT sku_id, warehouse_id, date, CAST(row_number() OVER (PARTITION BY sku_id, warehouse_id ORDER BY date) AS INTEGER) AS step,
       {r4('actual')} AS actual, {r4('pred_ma7')} AS predicted
FROM naive""")

sql("d_discount_rule", f"""
, x AS (SELECT *, 30.0 - (pct - 0.4) / CAST(0.2 AS DOUBLE) * 15.0 AS off FROM active WHERE pct >= 0.4 AND pct <= 0.6)
SELECT lot_id, sku_id, warehouse_id, pct_shelf_remaining, {r2('off')} AS discount_pct,
       {r2('lot_value_inr * (1.0 - off / 100)')} AS discounted_value
FROM x""")

sql("d_approval_flags", f"""
, h AS (SELECT sku_id, warehouse_id, avg(actual_demand_kg) AS hmean FROM demand GROUP BY 1, 2),
o AS (SELECT s.sku_id, s.warehouse_id, h.hmean,
             greatest(round(s.mu + -0.8416212335729142 * greatest(s.sigma, CAST(0.01 AS DOUBLE)) + 1e-9, 1),
                      CAST(0.0 AS DOUBLE)) + 0.0 AS opt
      FROM state s JOIN h ON s.sku_id = h.sku_id AND s.warehouse_id = h.warehouse_id)
SELECT sku_id, warehouse_id, opt AS optimal_order, {r4('hmean')} AS history_mean,
       {r4('abs(opt - hmean) / hmean * 100')} AS deviation_pct, abs(opt - hmean) / hmean > 0.2 AS needs_approval
FROM o""")

SENSOR_GAPS = f"""
, rd AS (SELECT CAST(user_id % 10 AS INTEGER) AS room, ts, event_id,
                CASE WHEN event_type = 'error' THEN NULL ELSE value / 10.0 END AS temp_c FROM events),
gp AS (SELECT room, ts, lag(ts) OVER (PARTITION BY room ORDER BY ts, event_id) AS prev_ts,
              max(temp_c) OVER (PARTITION BY room ORDER BY ts, event_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max FROM rd),
gaps AS (SELECT room, prev_ts AS gap_start, ts AS gap_end, {r4('(epoch_us(ts) - epoch_us(prev_ts)) / 6.0e7')} AS gap_minutes,
                prior_max AS imputed_temp_c
         FROM gp WHERE prev_ts IS NOT NULL AND (epoch_us(ts) - epoch_us(prev_ts)) / 6.0e7 > 30)"""

sql("d_sensor_gaps", SENSOR_GAPS + "\nSELECT * FROM gaps")

sql("d_sensor_offline", SENSOR_GAPS + f"""
SELECT r.room, CAST(coalesce(n, 0) AS BIGINT) AS n_gaps, {r2('coalesce(m, 0.0)')} AS offline_minutes,
       CAST(n IS NOT NULL AS INTEGER) AS sensor_offline_flag, coalesce(m, 0.0) > 120.0 AS needs_inspection
FROM (SELECT DISTINCT room FROM rd) r LEFT JOIN (SELECT room, count(*) AS n, sum(gap_minutes) AS m FROM gaps GROUP BY room) g
  ON r.room = g.room""")

sql("d_cold_start", f"""
, seen AS (SELECT sku_id, warehouse_id, count(DISTINCT date) AS n_obs FROM facts GROUP BY 1, 2),
cj AS (SELECT s.sku_id, s.warehouse_id, c.category, CAST(coalesce(seen.n_obs, 0) AS BIGINT) AS n_observed_days,
              coalesce(seen.n_obs, 0) < 30 AS is_cold_start, s.mu
       FROM state s JOIN (SELECT DISTINCT sku_id, warehouse_id, category FROM demand) c
         ON s.sku_id = c.sku_id AND s.warehouse_id = c.warehouse_id
       LEFT JOIN seen ON s.sku_id = seen.sku_id AND s.warehouse_id = seen.warehouse_id),
warm AS (SELECT category, avg(mu) AS category_level FROM cj WHERE NOT is_cold_start GROUP BY category)
SELECT cj.sku_id, cj.warehouse_id, cj.category, n_observed_days, is_cold_start, {r4('mu')} AS series_level,
       {r4('w.category_level')} AS category_level,
       {r4('CASE WHEN is_cold_start THEN coalesce(w.category_level, mu) ELSE mu END')} AS planning_level
FROM cj LEFT JOIN warm w ON cj.category = w.category""")

sql("d_disruption_override", f"""
, fl AS (SELECT DISTINCT warehouse_id, procurement_date AS date FROM fy_lots WHERE temp_deviation_c >= 6)
SELECT d.date, d.sku_id, d.warehouse_id, d.actual_demand_kg, fl.date IS NOT NULL AS disrupted,
       {r4('CASE WHEN fl.date IS NOT NULL THEN d.actual_demand_kg * 1.2 ELSE d.actual_demand_kg END')} AS adjusted_demand_kg
FROM demand d LEFT JOIN fl ON d.warehouse_id = fl.warehouse_id AND d.date = fl.date""")

sql("d_fifo", """
, a AS (SELECT lot_id, sku_id, warehouse_id, procurement_date, dispatched FROM active),
o AS (SELECT sku_id, warehouse_id, procurement_date AS o_date, lot_id AS o_lot FROM
      (SELECT *, row_number() OVER (PARTITION BY sku_id, warehouse_id ORDER BY procurement_date, lot_id) AS rn
       FROM a WHERE NOT dispatched) q WHERE rn = 1),
rk AS (SELECT sku_id, warehouse_id, procurement_date,
              dense_rank() OVER (PARTITION BY sku_id, warehouse_id ORDER BY procurement_date) AS fifo_rank
       FROM (SELECT DISTINCT sku_id, warehouse_id, procurement_date FROM a) q)
SELECT a.lot_id, a.sku_id, a.warehouse_id, a.procurement_date, CAST(rk.fifo_rank AS INTEGER) AS fifo_rank, a.dispatched,
       a.dispatched AND coalesce(o.o_date < a.procurement_date OR (o.o_date = a.procurement_date AND o.o_lot < a.lot_id),
                                 false) AS fifo_violation
FROM a LEFT JOIN o ON a.sku_id = o.sku_id AND a.warehouse_id = o.warehouse_id
JOIN rk ON a.sku_id = rk.sku_id AND a.warehouse_id = rk.warehouse_id AND a.procurement_date = rk.procurement_date""")

sql("stream_tier_changes", """
, a AS (SELECT lot_id, risk_level, CAST(procurement_date AS TIMESTAMP) + to_milliseconds(CAST(effective_shelf_life AS BIGINT) * pct * 864000 + 1) AS alert_ts,
               CASE WHEN dispatched THEN CAST(procurement_date + inspection_day AS TIMESTAMP) END AS gone
        FROM lots, (VALUES ('HIGH', 60), ('CRITICAL', 80)) v(risk_level, pct))
SELECT lot_id, alert_ts, risk_level FROM a WHERE gone IS NULL OR alert_ts <= gone""")

sql("stream_dedup_events", """
SELECT DISTINCT event_id, ts, event_type, user_id, value FROM events""")

sql("d_fifo_allocation", f"""
, la AS (SELECT sku_id, warehouse_id, lot_id, quantity_kg AS kg, sum(quantity_kg) OVER (PARTITION BY sku_id, warehouse_id ORDER BY procurement_date, lot_id) AS hi FROM active),
di AS (SELECT sku_id, warehouse_id, lot_id, quantity_kg AS kg, sum(quantity_kg) OVER (PARTITION BY sku_id, warehouse_id ORDER BY expiry_date, lot_id) AS hi FROM active WHERE dispatched)
SELECT d.sku_id, d.warehouse_id, d.lot_id AS dispatch_id, l.lot_id, {r2('least(l.hi, d.hi) - greatest(l.hi - l.kg, d.hi - d.kg)')} AS kg, d.lot_id <> l.lot_id AS other_lot
FROM di d JOIN la l ON d.sku_id = l.sku_id AND d.warehouse_id = l.warehouse_id
WHERE least(l.hi, d.hi) > greatest(l.hi - l.kg, d.hi - d.kg)""")

sql("d_supplier_degradation", f"""
, g AS (SELECT supplier_id, count(*) AS n_lots, CAST(sum(did_spoil) AS BIGINT) AS n_spoiled,
               {r2('sum(spoiled_value)')} AS spoiled_value FROM lots GROUP BY 1)
SELECT supplier_id, n_lots, n_spoiled, {r4('n_spoiled / n_lots')} AS spoil_rate, spoiled_value,
       row_number() OVER (ORDER BY n_spoiled / n_lots DESC, spoiled_value DESC, supplier_id) AS degradation_rank
FROM g""")

sql("d_naive_baselines", f"""
, nb AS (SELECT sku_id, warehouse_id,
                avg(abs(actual - pred_ma7) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS m7,
                avg(abs(actual - pred_lag7) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS l7
         FROM naive GROUP BY 1, 2)
SELECT sku_id, warehouse_id, {r4('m7')} AS mape_ma7, {r4('l7')} AS mape_lag7,
       {r4('(l7 - m7) / l7 * 100')} AS improvement_pct
FROM nb""")

sql("d_demand_growth", f"""
, fl AS (SELECT sku_id, warehouse_id, avg(forecast_kg) AS fl FROM forecast GROUP BY 1, 2)
SELECT s.sku_id, s.warehouse_id, {r4('s.mu')} AS current_level, {r4('fl.fl')} AS forecast_level,
       {r4('(fl.fl - s.mu) / s.mu * 100')} AS growth_pct
FROM state s JOIN fl ON s.sku_id = fl.sku_id AND s.warehouse_id = fl.warehouse_id""")

sql("d_season_features", """
SELECT date, sku_id, warehouse_id,
       CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Summer'
            WHEN month IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-monsoon' END AS season,
       CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(festival_multiplier > 1.0 AS INTEGER) AS is_festival
FROM demand""")

_CZ = ",\n".join(f"  ('{c}', CAST({cu / (cu + co)!r} AS DOUBLE), CAST({statistics.NormalDist().inv_cdf(cu / (cu + co))!r} AS DOUBLE))"
                 for c, (cu, co) in {"Leafy Vegetables": (0.25, 1.00), "Other Vegetables": (0.25, 0.80),
                                     "Root Vegetables": (0.25, 0.40), "Dairy": (0.25, 0.90),
                                     "Meat & Poultry": (0.25, 1.00)}.items())

sql("d_category_newsvendor", f"""
, cz(category, cr, z) AS (VALUES
{_CZ}),
q AS (SELECT s.sku_id, s.warehouse_id, c.category, cz.cr,
             greatest(round(s.mu + cz.z * greatest(s.sigma, CAST(0.01 AS DOUBLE)) + 1e-9, 1), CAST(0.0 AS DOUBLE)) + 0.0 AS q
      FROM state s JOIN (SELECT DISTINCT sku_id, warehouse_id, category FROM demand) c
        ON s.sku_id = c.sku_id AND s.warehouse_id = c.warehouse_id JOIN cz ON c.category = cz.category)
SELECT sku_id, warehouse_id, category, {r4('cr')} AS critical_ratio, q AS optimal_order,
       round(q * CAST(1.05 AS DOUBLE) + 1e-9, 1) AS order_with_margin
FROM q""")

sql("d_unconstrained_demand", f"""
, e AS (SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS sku_id, CAST(ts AS DATE) AS date, event_type, value
        FROM events),
g AS (SELECT sku_id, date, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END) AS sold,
             sum(CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0.0 END) AS intent,
             max(CAST(event_type = 'error' AS INTEGER)) AS oos
      FROM e GROUP BY 1, 2)
SELECT sku_id, date, {r2('sold')} AS sold_kg, {r2('intent')} AS intent_kg, oos = 1 AS out_of_stock,
       {r2('sold + CASE WHEN oos = 1 THEN intent ELSE 0.0 END')} AS unconstrained_kg
FROM g""")

sql("d_scenario_value", f"""
, g AS (SELECT warehouse_id, sum(lot_value) AS tv, sum(spoiled_value) AS sv,
               count(DISTINCT date_trunc('month', procurement_date)) AS months FROM lots GROUP BY 1)
SELECT warehouse_id, {r2('tv / months')} AS monthly_sourcing_value, {r4('sv / tv * 100')} AS wastage_before_pct,
       {r4('sv / tv * 100 * 0.65')} AS wastage_after_pct,
       {r2('tv / months * (sv / tv * 100 - sv / tv * 100 * 0.65) / 100')} AS saved_per_month,
       {r2('tv / months * (sv / tv * 100 - sv / tv * 100 * 0.65) / 100 * 12')} AS saved_per_year
FROM g""")


# ------------------------------------------------------------------ streaming (final sink tables)
sql("stream_lot_alerts", f"""
, a AS (SELECT *, days_to_expiry / effective_shelf_life AS p FROM lots)
SELECT lot_id, sku_id, category, warehouse_id, procurement_date, days_to_expiry, effective_shelf_life,
       {r4('p')} AS pct_left, CASE WHEN p < 0.2 THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level,
       CASE WHEN p < 0.2 THEN '🔴 Redistribute or discount immediately (< 12h)'
            ELSE '🟠 Offer 25% discount to bulk buyers today' END AS recommended_action
FROM a WHERE p < 0.4""")

sql("stream_daily_kpi", f"""
, d AS (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
               event_type, value FROM events)
SELECT window_start, window_end, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
       round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END), 2) AS sold_value,
       count(*) FILTER (WHERE event_type = 'error') AS n_errors
FROM d GROUP BY 1, 2""")

sql("stream_coldchain_windows", f"""
, rd AS (SELECT CAST(user_id % 10 AS INTEGER) AS room, ts, value / 10.0 AS temp_c,
                date_trunc('hour', ts) + INTERVAL (CAST(floor(minute(ts) / 15) * 15 AS INTEGER)) MINUTE AS b
         FROM events WHERE event_type <> 'error'),
w AS (SELECT room, temp_c, b - INTERVAL (k * 15) MINUTE AS window_start FROM rd, range(0, 4) r(k))
SELECT room, window_start, window_start + INTERVAL 1 HOUR AS window_end, max(temp_c) AS max_temp_c,
       {r4('avg(temp_c)')} AS avg_temp_c, count(*) AS n_readings
FROM w GROUP BY 1, 2""")

sql("stream_sensor_sessions", f"""
, rd AS (SELECT CAST(user_id % 10 AS INTEGER) AS room, ts, event_id,
                CASE WHEN event_type = 'error' THEN NULL ELSE value / 10.0 END AS temp_c FROM events),
s0 AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY room ORDER BY ts, event_id) IS NULL
                        OR ts >= lag(ts) OVER (PARTITION BY room ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                      THEN 1 ELSE 0 END AS new_s FROM rd),
s1 AS (SELECT *, sum(new_s) OVER (PARTITION BY room ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s0)
SELECT room, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_readings,
       max(temp_c) AS max_temp_c
FROM s1 GROUP BY room, sid""")

sql("stream_dedup_readings", """
SELECT event_id, room, ts, temp_c FROM (
  SELECT event_id, CAST(user_id % 10 AS INTEGER) AS room, ts,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 10.0 END AS temp_c,
         row_number() OVER (PARTITION BY user_id % 10, ts ORDER BY event_id) AS rn
  FROM events) x WHERE rn = 1""")


# the same forecast with 30 steps
ORACLE["forecast_30_days"] = ORACLE["heuristic_forecast"].replace("range(1, 15) r(step)", "range(1, 31) r(step)")

sql("lot_texts", """
SELECT lot_id, 'LOT' || lpad(CAST(days_remaining AS VARCHAR), 4, '0') AS code,
       '₹' || format('{:,}', CAST(round(lot_value_inr + 1e-9, 0) AS BIGINT)) AS money,
       '₹' || printf('%.1f', round(lot_value_inr / 1e5 + 1e-9, 1)) || 'L' AS lakhs,
       '₹' || printf('%.0f', round(lot_value_inr / 1e3 + 1e-9, 0)) || 'K' AS thousands,
       printf('%.1f', round(pct_shelf_remaining + 1e-9, 1)) || '%' AS pct
FROM active""")

sql("series_lists", f"""
, tl AS (SELECT * FROM ranked WHERE rk <= 14)
SELECT sku_id, warehouse_id, CAST(count(*) AS INTEGER) AS n, max(actual_demand_kg) FILTER (WHERE rk = 14) AS first_y,
       max(actual_demand_kg) FILTER (WHERE rk = 1) AS last_y, {r4('sum(actual_demand_kg) FILTER (WHERE rk <= 7)')} AS last_7_sum,
       '[' || string_agg(CAST(CAST(round(actual_demand_kg + 1e-9, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY date) || ']' AS values_json
FROM tl GROUP BY 1, 2""")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
