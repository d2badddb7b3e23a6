"""Structured Streaming operators.

Sources are file streams over the driver's Parquet tables (a glob on the
table file, since a file stream needs a directory or pattern). Sinks are
Parquet folders under the shared checkpoint root, each with its own
checkpoint location, so a restarted query resumes exactly-once. ``run``
drives a query with ``trigger(availableNow=True)`` (all data present now,
then the trailing no-data batch that closes watermark-expired state) and
reads the sink back as a batch DataFrame.

Output mode is ``append``: a window or session is written once, when the
watermark passes its end; rows older than the watermark are dropped.
``run_bounded`` is for an input that ends: one row of the far future is read
with it, which moves the watermark past every window still open, so all of them
are in the sink after one run. Such an input is read in one micro-batch: files
come by modification time, not by ``ts``, and after a first batch the watermark
would drop rows of later files. State lies in RocksDB, on disk and not on the
heap, and in the checkpoint.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r4, recommended_action, risk_tier
from ..session import scratch_path
from ..sources import views as V
from ..sources.tables import Tables

DELAY = "1 hour"
BATCH_BYTES = 16 << 30
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_bytes: int | None = None) -> DataFrame:
    """A file stream over one driver table (schema from the batch reader), in
    micro-batches of at most ``max_bytes`` of files, where given: for live
    streams, whose late rows go, and for stateless plans."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(f"{root}/{name}*.parquet")


def run(df: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a streaming plan to completion into a Parquet sink; return the sink."""
    spark = df.sparkSession
    out = path or scratch_path(spark, f"stream-{name}")
    with rocks_store(spark):
        q = (df.writeStream.format("parquet").outputMode(mode)
             .option("path", out).option("checkpointLocation", out + "-checkpoint")
             .queryName(f"{name}_{abs(hash(out)) % 10**8}")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_bounded(events: DataFrame, build, name: str, path: str | None = None, flush_row: dict | None = None) -> DataFrame:
    """Run ``build(events)`` over a stream that ends, until every window and
    session is written. ``path`` names the sink of a run to resume; what comes
    after its first run is late."""
    spark = events.sparkSession
    out = path or scratch_path(spark, f"stream-{name}")
    flush = out + "-flush"
    far = {"ts": dt.datetime(9999, 1, 1), "event_type": "flush", "value": 0.0, "user_id": -1, "event_id": -1, **(flush_row or {})}
    spark.createDataFrame([tuple(far.get(c) for c in events.columns)], events.schema).write.mode("ignore").parquet(flush)
    return run(build(events.unionByName(spark.readStream.schema(events.schema).parquet(flush))), name, path=out)


def _ntz(c):
    return c.cast("timestamp_ntz")


# ------------------------------------------------------------------ T1
def lot_alerts(lineitem_stream: DataFrame, t: Tables) -> DataFrame:
    """Each arriving lot -> tier at its inspection point + action; only
    CRITICAL and HIGH are emitted (stateless, stream-static joins)."""
    lo = V.lots(t, lineitem_df=lineitem_stream)
    pct = F.col("days_to_expiry") / F.col("effective_shelf_life")
    a = lo.withColumn("_pct", pct).withColumn("risk_level", risk_tier("_pct"))
    return (a.filter(F.col("risk_level").isin("CRITICAL", "HIGH"))
            .select("lot_id", "sku_id", "category", "warehouse_id", "procurement_date",
                    "days_to_expiry", "effective_shelf_life", r4("_pct").alias("pct_left"),
                    "risk_level", recommended_action("risk_level").alias("recommended_action")))


# ------------------------------------------------------------------ T2
def daily_kpis(events_stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Daily tumbling-window KPIs with a watermark."""
    e = events_stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    g = (e.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"))
         .agg(F.count("*").alias("n_events"),
              F.count_if(F.col("event_type") == "purchase").alias("n_purchases"),
              F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("sold"),
              F.count_if(F.col("event_type") == "error").alias("n_errors")))
    return g.select(_ntz(F.col("window.start")).alias("window_start"), _ntz(F.col("window.end")).alias("window_end"),
                    "n_events", "n_purchases", F.round("sold", 2).alias("sold_value"), "n_errors")


def _readings(events_stream: DataFrame) -> DataFrame:
    return events_stream.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).cast("int").alias("room"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value") / 10.0)
        .alias("temp_c"))


# ------------------------------------------------------------------ T3
def coldchain_windows(events_stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Sliding 1-hour windows every 15 minutes per room: max / mean temp."""
    r = _readings(events_stream).filter(F.col("temp_c").isNotNull())
    g = (r.withWatermark("ts", delay).groupBy("room", F.window("ts", "1 hour", "15 minutes"))
         .agg(F.max("temp_c").alias("max_temp_c"), F.avg("temp_c").alias("avg_temp_c"),
              F.count("*").alias("n_readings")))
    return g.select("room", _ntz(F.col("window.start")).alias("window_start"),
                    _ntz(F.col("window.end")).alias("window_end"), "max_temp_c",
                    r4("avg_temp_c").alias("avg_temp_c"), "n_readings")


# ------------------------------------------------------------------ T4
def sensor_sessions(events_stream: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """T4: sessions of readings per room; a gap of ``gap`` or more closes a
    session (the sensor was offline)."""
    r = _readings(events_stream)
    g = (r.withWatermark("ts", delay).groupBy("room", F.session_window("ts", gap))
         .agg(F.count("*").alias("n_readings"), F.max("temp_c").alias("max_temp_c")))
    return g.select("room", _ntz(F.col("session_window.start")).alias("session_start"),
                    _ntz(F.col("session_window.end")).alias("session_end"), "n_readings", "max_temp_c")


# ------------------------------------------------------------------ T5
def dedup_readings(events_stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """T5: one reading per room and timestamp, the one with the smallest
    event_id; written when the watermark passes it, which also releases its
    state."""
    g = (_readings(events_stream).withWatermark("ts", delay).groupBy("room", "ts")
         .agg(F.min("event_id").alias("event_id"), F.min_by("temp_c", "event_id").alias("temp_c")))
    return g.select("event_id", "room", _ntz(F.col("ts")).alias("ts"), "temp_c")


def dedup_events(events_stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """T5: the first event of each event_id, as it comes; the id stays in the
    state until the watermark is ``delay`` past it, so repeats that are later
    than that are late themselves."""
    e = events_stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    return e.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).withColumn("ts", _ntz(F.col("ts")))


# ------------------------------------------------------------------ T1 with state
def lot_readings(lineitem: DataFrame, t: Tables) -> DataFrame:
    """Readings of each lot, from a table or a stream of lines: as it arrives,
    and, where it was dispatched, on its inspection day, when it is gone."""
    lo = V.lots(t, lineitem_df=lineitem, warehouse=False)
    came = F.struct(F.col("procurement_date").cast("timestamp").alias("ts"), F.lit(False).alias("gone"))
    left = F.struct(F.date_add("procurement_date", F.col("inspection_day")).cast("timestamp").alias("ts"), F.lit(True).alias("gone"))
    both = F.when(F.col("dispatched"), F.array(came, left)).otherwise(F.array(came))
    return (lo.select("lot_id", F.col("procurement_date").cast("timestamp").alias("procured"), F.col("effective_shelf_life").alias("days"), F.explode(both).alias("r"))
            .select("lot_id", "r.ts", "procured", "days", "r.gone"))
