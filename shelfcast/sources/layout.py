"""Storage layout and upkeep (S4, S7, S8): fact and dimension bucketed alike, the
fact partitioned by month, and states kept up to date from new files only."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

#: bytes of a file, from which the number of buckets follows
FILE_BYTES = 256 << 20


def month_of(day: Column) -> Column:
    """Month of a day as a number, the partition column of the fact table."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def buckets_for(input_bytes: int, months: int) -> int:
    """Buckets for files of about FILE_BYTES: every month has one per bucket."""
    return max(1, round(input_bytes / max(1, months) / FILE_BYTES))


# ------------------------------------------------------------------ S4
def write_layout(t: Tables, database: str, buckets: int) -> None:
    """``lineitem`` by ship month and bucketed by part, ``part`` bucketed alike,
    as tables of ``database`` (made where absent). A task holds a bucket, so a
    month gets one file of it. Lines without a ship date are a month of their own."""
    spark = t.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    fact = t.lineitem.withColumn("ship_month", month_of(F.col("l_shipdate")))
    (fact.repartition(buckets, "l_partkey").sortWithinPartitions("ship_month", "l_partkey")
     .write.mode("overwrite").partitionBy("ship_month").bucketBy(buckets, "l_partkey").sortBy("l_partkey").saveAsTable(f"{database}.lineitem"))
    (t.part.repartition(buckets, "p_partkey").sortWithinPartitions("p_partkey")
     .write.mode("overwrite").bucketBy(buckets, "p_partkey").sortBy("p_partkey").saveAsTable(f"{database}.part"))


class LaidOut(Tables):
    """``Tables`` whose lineitem and part come from a layout; the join of both
    needs no exchange, and bounds on the ship date prune months."""

    def __init__(self, spark: SparkSession, root: str, database: str, **dims):
        super().__init__(spark, root, **dims)
        self.database = database

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("lineitem", "part"):
            return self.view(f"layout:{self.database}:{name}", (), lambda: self.spark.table(f"{self.database}.{name}"))
        return super().__getattr__(name)

    def dims(self) -> tuple:
        return (*super().dims(), self.database)


# ------------------------------------------------------------------ S8
def table_if_absent(spark: SparkSession, table: str, build) -> DataFrame:
    """S8 over the catalog: ``build()`` is written as ``table`` only where the
    catalog has none."""
    if not spark.catalog.tableExists(table):
        build().write.saveAsTable(table)
    return spark.table(table)


# ------------------------------------------------------------------ S7, B4
class KeptState:
    """A grouped state over a growing folder of files, kept as deltas: each
    update reads the files that no delta has seen, aggregates them and adds one
    delta with the names it covers. ``merge`` maps a state column to the
    aggregate that joins two of its values, so deltas of any cut of the files
    give the same state. A delta counts once its marker is there: an update
    that dies leaves nothing behind. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: dict[str, str]):
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), keys, merge

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str, suffix: str = "") -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix)) if fs.exists(p) else []

    def deltas(self) -> list[str]:
        """Finished deltas that no later one replaces."""
        done = [d for d in self._list(self.path) if self._fs(f"{d}/_DONE")[1].exists(self._fs(f"{d}/_DONE")[0])]
        whole = [d for d in done if re.search(r"/\d{8}-all-", d)]
        return [d for d in done if not whole or d >= whole[-1]]

    def _write(self, state: DataFrame, files: list[str], kind: str) -> None:
        at = f"{self.path}/{len(self._list(self.path)):08d}-{kind}-{uuid.uuid4().hex[:8]}"
        state.write.parquet(f"{at}/state")
        self.spark.createDataFrame([(f,) for f in files], "file string").write.parquet(f"{at}/files")
        p, fs = self._fs(f"{at}/_DONE")
        fs.create(p).close()

    def seen(self) -> set[str]:
        got = [f"{d}/files" for d in self.deltas()]
        return {r.file for r in self.spark.read.parquet(*got).collect()} if got else set()  # names of files, as a listing has them

    def update(self, folder: str, build) -> int:
        """Adds the Parquet files of ``folder`` that are new: ``build(rows)`` gives
        their state by the keys. Returns the number of new files."""
        new = sorted(set(self._list(folder, ".parquet")) - self.seen())
        if new:
            self._write(build(self.spark.read.parquet(*new)).select(*self.keys, *self.merge), new, "new")
        return len(new)

    def read(self) -> DataFrame | None:
        """The state of all files seen, or None before the first update."""
        parts = [f"{d}/state" for d in self.deltas()]
        if not parts:
            return None
        return self.spark.read.parquet(*parts).groupBy(*self.keys).agg(*[F.expr(f"{how}({c})").alias(c) for c, how in self.merge.items()])

    def compact(self) -> None:
        """All deltas as one; older ones stay on disk but are no longer read."""
        if (state := self.read()) is not None and len(self.deltas()) > 1:
            self._write(state, sorted(self.seen()), "all")


def daily_state(spark: SparkSession, path: str) -> KeptState:
    """B4 kept: kg and lines per day, sku and warehouse."""
    return KeptState(spark, path, ["date", "sku_id", "warehouse_id"], {"sold_kg": "sum", "n_lines": "sum"})


def series_totals(spark: SparkSession, path: str) -> KeptState:
    """Per series its first and last day, lines, kg and squared kg of lines."""
    return KeptState(spark, path, ["sku_id", "warehouse_id"],
                     {"first_date": "min", "last_date": "max", "n_lines": "sum", "kg": "sum", "kg2": "sum"})


def daily_of(t: Tables):
    """``build`` of ``daily_state`` over files of lines."""
    from . import views as V
    return lambda li: (V.lines(t, lineitem_df=li).where("l_shipdate is not null")
                       .groupBy(F.col("l_shipdate").cast("date").alias("date"), "sku_id", "warehouse_id")
                       .agg(F.sum("l_quantity").alias("sold_kg"), F.count("*").alias("n_lines")))


def totals_of(t: Tables):
    """``build`` of ``series_totals`` over files of lines."""
    from . import views as V
    q = F.col("l_quantity")
    return lambda li: (V.lines(t, lineitem_df=li).where("l_shipdate is not null").groupBy("sku_id", "warehouse_id")
                       .agg(F.min(F.col("l_shipdate").cast("date")).alias("first_date"), F.max(F.col("l_shipdate").cast("date")).alias("last_date"),
                            F.count("*").alias("n_lines"), F.sum(q).alias("kg"), F.sum(q * q).alias("kg2")))
