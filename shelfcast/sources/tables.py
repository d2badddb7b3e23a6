"""Scans and sinks.

Driver tables are Parquet; column pruning and filter pushdown reach the scan
because every view below is a lazy DataFrame plan over ``spark.read``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Row cap under which a dimension may be broadcast (about 50-100 bytes per
# projected row -> <= ~100 MB per executor). Override per session with the
# ``shelfcast.broadcast.maxRows`` conf.
BROADCAST_MAX_ROWS = 1_000_000

# Views defined once per (session, table folder, view, arguments). A
# DataFrame is an immutable lazy plan, so handing the same one to every query
# is what a temp view does: the Parquet footers are read and the view's
# expressions are built once instead of on every query. The cached frames
# hold their session, so a session's id is never reused while its entries
# exist.
_VIEWS: dict[tuple, tuple] = {}


def clear_views(stopped_only: bool = False) -> None:
    """Forget defined views and fitted models (all, or only those of stopped
    sessions): needed after tables changed on disk."""
    from ..operators import models
    models.clear_models(stopped_only)
    for k in [k for k, (s, _) in _VIEWS.items() if not stopped_only or s.sparkContext._jsc is None]:
        del _VIEWS[k]


class _Same:
    """Equal to itself over the same frame only."""

    def __init__(self, df: DataFrame | None):
        self.df = df

    def __hash__(self) -> int:
        return id(self.df)

    def __eq__(self, other) -> bool:
        return isinstance(other, _Same) and self.df is other.df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` -> DataFrame. ``skus``
    and ``warehouses`` are dimension tables of the caller's own (one row per
    sku_id with name, category, shelf life, ideal temperature, price and base
    demand; one per warehouse_id with name and city) in place of the attributes
    that the views derive from brand and region."""

    def __init__(self, spark: SparkSession, root: str, skus: DataFrame | None = None, warehouses: DataFrame | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.skus, self.warehouses = skus, warehouses

    def dims(self) -> tuple:
        """Names the caller's dimensions in the key of a view (the frames
        themselves: an id could be that of a frame long gone)."""
        return (_Same(self.skus), _Same(self.warehouses))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.view(f"table:{name}", (), lambda: self.spark.read.parquet(self.path(name)))

    def view(self, name: str, args: tuple, build) -> DataFrame:
        """``build()`` once per session, folder, view name and arguments."""
        key = (id(self.spark), self.root, name, args)
        hit = _VIEWS.get(key)
        if hit is None or hit[0] is not self.spark:
            clear_views(stopped_only=True)
            hit = _VIEWS[key] = (self.spark, build())
        return hit[1]

    def spread(self, df: DataFrame) -> DataFrame:
        """``df`` dealt round-robin over ``shelfcast.scan.partitions``, or as
        it is where that setting is unset. For tables kept as files of one row
        group, which scan as one task however large they are."""
        n = self.spark.conf.get("shelfcast.scan.partitions", None)
        return df.repartition(int(n)) if n else df

    def date_range(self, first: dt.date, last: dt.date) -> tuple[dt.date, dt.date]:
        """First and last ship date within the plausible days (one row of one
        column; once per session and folder), so that one wrong date does not
        stretch every series. Without such a row it is the one day 1970-01-01."""
        def scan():
            day = F.col("l_shipdate").cast("date")
            return self.lineitem.where(day.between(F.lit(first), F.lit(last))).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("z")).first()
        r = self.view("date_range", (first, last), scan)
        return (r.a.date(), r.z.date()) if r.a else (dt.date(1970, 1, 1), dt.date(1970, 1, 1))

    def broadcast_cap(self) -> int:
        return int(self.spark.conf.get("shelfcast.broadcast.maxRows", str(BROADCAST_MAX_ROWS)))

    def row_count(self, name: str) -> int:
        """Row count of a table (Parquet footers only), forgotten with the views."""
        return self.view(f"rows:{name}", (), lambda: self.spark.read.parquet(self.path(name)).count())

    def broadcast_if_small(self, df: DataFrame, base_table: str) -> DataFrame:
        """Broadcast ``df`` only when its base table (whose row count bounds
        ``df``'s, e.g. a projection or a many-to-one join of it) is under the
        row cap; otherwise leave the join strategy to Catalyst and AQE
        (shuffle join, runtime broadcast when small, skew-join splitting)."""
        return F.broadcast(df) if self.row_count(base_table) <= self.broadcast_cap() else df


# ------------------------------------------------------------------ schemas
DEMAND_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("sku_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("warehouse_id", T.StringType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("actual_demand_kg", T.DoubleType()),
    T.StructField("price_per_kg", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("temp_c", T.DoubleType()),
    T.StructField("day_of_week", T.StringType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day_of_year", T.IntegerType()),
    T.StructField("festival_multiplier", T.DoubleType()),
])

LOTS_SCHEMA = T.StructType([
    T.StructField("lot_id", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("sku_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("warehouse_id", T.StringType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("procurement_date", T.DateType()),
    T.StructField("expiry_date", T.DateType()),
    T.StructField("shelf_life_days", T.IntegerType()),
    T.StructField("effective_shelf_life", T.IntegerType()),
    T.StructField("quantity_kg", T.DoubleType()),
    T.StructField("over_order_factor", T.DoubleType()),
    T.StructField("ideal_temp_c", T.IntegerType()),
    T.StructField("actual_temp_c", T.IntegerType()),
    T.StructField("temp_deviation_c", T.IntegerType()),
    T.StructField("price_per_kg", T.DoubleType()),
    T.StructField("lot_value", T.DoubleType()),
    T.StructField("did_spoil", T.IntegerType()),
    T.StructField("spoilage_pct", T.DoubleType()),
    T.StructField("spoiled_kg", T.DoubleType()),
    T.StructField("spoiled_value", T.DoubleType()),
    T.StructField("days_to_expiry", T.IntegerType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("age_pct", T.DoubleType()),
])

ACTIVE_LOTS_SCHEMA = T.StructType([
    T.StructField("lot_id", T.StringType()),
    T.StructField("sku_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("procurement_date", T.DateType()),
    T.StructField("expiry_date", T.DateType()),
    T.StructField("days_remaining", T.IntegerType()),
    T.StructField("shelf_life_days", T.IntegerType()),
    T.StructField("pct_shelf_remaining", T.DoubleType()),
    T.StructField("quantity_kg", T.DoubleType()),
    T.StructField("price_per_kg", T.DoubleType()),
    T.StructField("lot_value_inr", T.DoubleType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("temp_deviation_c", T.IntegerType()),
])

SCHEMAS = {"demand": DEMAND_SCHEMA, "lots": LOTS_SCHEMA, "active_lots": ACTIVE_LOTS_SCHEMA}


# ------------------------------------------------------------------ S1-S3
def read_csv_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Typed CSV scan with header; dates parsed at read, no inference."""
    return (spark.read.schema(SCHEMAS[kind]).option("header", True)
            .option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(path))


def load_demand(spark, path):
    """The 16-column demand file, whose day_of_week is a day name: read as
    day_name, with day_of_week (0 = Monday) from the date."""
    d = read_csv_table(spark, path, "demand").withColumnRenamed("day_of_week", "day_name")
    return d.withColumn("day_of_week", F.weekday("date").cast("int"))


def save_demand(df: DataFrame, path: str) -> None:
    """The same file from a demand frame (day_name written as day_of_week)."""
    cols = [F.col("day_name" if f.name == "day_of_week" else f.name).alias(f.name) for f in DEMAND_SCHEMA.fields]
    write_table(df.select(*cols), path, fmt="csv")


def load_lots(spark, path):
    return read_csv_table(spark, path, "lots")


def load_active_lots(spark, path):
    return read_csv_table(spark, path, "active_lots")


# ------------------------------------------------------------------ S4 / S8
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list | None = None) -> None:
    """Sink: Parquet by default (CSV with header on request). ``mode='ignore'``
    gives build-if-absent (S8)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        w.format(fmt).save(path)


def build_if_absent(spark: SparkSession, path: str, build) -> DataFrame:
    """Derive and write a table only when it is missing or was left
    unfinished (no _SUCCESS), then read it."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        write_table(build(), path, mode="overwrite")
    return spark.read.parquet(path)


# ------------------------------------------------------------------ S5
def save_model(model, path: str, metrics: DataFrame | None = None, importances: DataFrame | None = None) -> None:
    """The model, with its metrics and importances beside it where given."""
    model.write().overwrite().save(f"{path}/model")
    for name, df in (("metrics", metrics), ("importances", importances)):
        if df is not None:
            write_table(df, f"{path}/{name}")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_model_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``metrics`` or ``importances`` of a saved model."""
    return spark.read.parquet(f"{path}/{name}")
