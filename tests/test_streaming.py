"""Streaming: availableNow results equal the batch oracle (see test_oracle);
here a late record is dropped by the watermark and duplicates are removed."""

import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq

from shelfcast.streaming import streams as ST

SCHEMA = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                    ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])


_SEQ = [1_700_000_000]


def _write(folder, name, rows):
    """Write one file; modification times increase so the file source
    reads the files in the order they are written."""
    cols = list(zip(*rows))
    tbl = pa.table({f.name: pa.array(c, f.type) for f, c in zip(SCHEMA, cols)}, schema=SCHEMA)
    path = os.path.join(folder, name)
    pq.write_table(tbl, path)
    _SEQ[0] += 60
    os.utime(path, (_SEQ[0], _SEQ[0]))


def _stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_record_dropped(spark):
    """Spark drops a late row against the previous batch's watermark (the
    late-event watermark lags the eviction watermark by one batch), so the
    late record comes two files after the one that moved the watermark."""
    d = tempfile.mkdtemp(prefix="shelfcast-stream-")
    day1, day2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 12)
    _write(d, "events-1.parquet", [(1, day1, 1, "purchase", 5.0, "{}"), (2, day2, 2, "purchase", 7.0, "{}")])
    _write(d, "events-2.parquet", [(3, day2 + dt.timedelta(hours=1), 3, "purchase", 1.0, "{}")])
    # behind the watermark (day2 12:00 - 1h): belongs to the closed day-1 window
    _write(d, "events-3.parquet", [(4, day1 + dt.timedelta(hours=1), 3, "purchase", 9.0, "{}"),
                                   (5, day2 + dt.timedelta(days=2), 4, "view", 1.0, "{}")])
    out = ST.run(ST.daily_kpis(_stream(spark, d)), "late_test").collect()
    by_day = {r["window_start"].date(): r for r in out}
    assert by_day[dt.date(2024, 1, 1)]["n_events"] == 1  # event 4 dropped
    assert by_day[dt.date(2024, 1, 1)]["sold_value"] == 5.0
    assert by_day[dt.date(2024, 1, 2)]["n_events"] == 2
    assert dt.date(2024, 1, 4) not in by_day  # still open at the end


def test_duplicate_reading_removed(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-stream-")
    t0 = dt.datetime(2024, 1, 1, 10)
    _write(d, "events-1.parquet", [(1, t0, 11, "view", 40.0, "{}"), (2, t0, 21, "view", 40.0, "{}"),
                                   (3, t0 + dt.timedelta(minutes=5), 11, "view", 41.0, "{}")])
    out = ST.run_bounded(_stream(spark, d), ST.dedup_readings, "dup_test").collect()
    # rooms 1 and 1 at the same ts collapse (11 % 10 == 21 % 10); the smaller event_id stays
    assert sorted(r["event_id"] for r in out) == [1, 3]


def test_sessions_split_on_gap(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-stream-")
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [(1, t0, 1, "view", 40.0, "{}"), (2, t0 + dt.timedelta(minutes=20), 1, "view", 40.0, "{}"),
            (3, t0 + dt.timedelta(minutes=51), 1, "view", 40.0, "{}"),
            (4, t0 + dt.timedelta(hours=5), 2, "view", 40.0, "{}")]
    _write(d, "events-1.parquet", rows)
    out = sorted(ST.run(ST.sensor_sessions(_stream(spark, d)), "sess_test").collect(),
                 key=lambda r: (r["room"], r["session_start"]))
    # room 1: [10:00, 10:50) and [10:51, 11:21); room 2's session is still open
    assert [(r["room"], r["n_readings"]) for r in out] == [(1, 2), (1, 1)]
    # a bounded input is flushed: nothing stays open
    out = ST.run_bounded(_stream(spark, d), ST.sensor_sessions, "sess_bounded").collect()
    assert sorted((r["room"], r["n_readings"]) for r in out) == [(1, 1), (1, 2), (2, 1)]


def test_bounded_daily_kpis_count_every_event(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-stream-")
    day = dt.datetime(2024, 1, 1, 10)
    _write(d, "events-1.parquet", [(i, day + dt.timedelta(hours=i), 1, "purchase", 1.0, "{}") for i in range(40)])
    out = ST.run_bounded(_stream(spark, d), ST.daily_kpis, "bounded_kpi").collect()
    assert sum(r["n_events"] for r in out) == 40 and len(out) == 3


def test_bounded_keys_take_every_row_of_overlapping_files(spark, monkeypatch):
    """Files that each span all days, with any byte limit that a key sets
    shrunk to one byte: the keys equal the batch results."""
    from pyspark.sql.streaming.readwriter import DataStreamReader

    import __spark_entry__ as E
    option = DataStreamReader.option
    monkeypatch.setattr(DataStreamReader, "option", lambda self, key, value: option(self, key, 1 if key == "maxBytesPerTrigger" else value))
    d = tempfile.mkdtemp(prefix="shelfcast-stream-")
    folder = os.path.join(d, "events.parquet")
    os.makedirs(folder)
    t0 = dt.datetime(2024, 1, 1, 10)
    for k in range(5):
        _write(folder, f"part-{k}.parquet", [(100 * k + i, t0 + dt.timedelta(hours=7 * i, minutes=11 * (k % 4)), i, "purchase", float(i), "{}") for i in range(12)])
    batch = spark.read.parquet(folder)
    for key, build in (("stream_daily_kpi", ST.daily_kpis), ("stream_coldchain_windows", ST.coldchain_windows),
                       ("stream_sensor_sessions", ST.sensor_sessions), ("stream_dedup_readings", ST.dedup_readings)):
        got, want = (sorted(map(tuple, df.collect())) for df in (E.queries()[key](spark, d), build(batch)))
        assert got == want, key


# ------------------------------------------------------------------ state in RocksDB, restarts
def test_duplicates_late_rows_and_a_restart(spark):
    """Repeats within the watermark go, in one batch, over batches and over a
    restart; what is behind the watermark goes as late; the state holds no more
    ids than the delay allows."""
    from shelfcast.session import scratch_path
    d, out = tempfile.mkdtemp(prefix="shelfcast-stream-"), scratch_path(spark, "dedup-restart")
    t0 = dt.datetime(2024, 1, 1, 10)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    _write(d, "e-1.parquet", [(1, at(0), 1, "view", 1.0, "{}"), (1, at(0), 1, "view", 1.0, "{}"), (2, at(5), 1, "view", 2.0, "{}")])
    _write(d, "e-2.parquet", [(2, at(5), 1, "view", 2.0, "{}"), (3, at(30), 1, "view", 3.0, "{}")])
    first = ST.run(ST.dedup_events(_stream(spark, d)), "dedup_restart", path=out)
    assert sorted(r.event_id for r in first.collect()) == [1, 2, 3]
    # after a restart: a repeat of an id in the state, then the watermark moves far on
    _write(d, "e-3.parquet", [(3, at(30), 1, "view", 3.0, "{}"), (4, at(600), 1, "view", 4.0, "{}")])
    _write(d, "e-4.parquet", [(5, at(610), 1, "view", 5.0, "{}")])
    _write(d, "e-5.parquet", [(6, at(2), 1, "view", 6.0, "{}"), (4, at(600), 1, "view", 4.0, "{}")])  # 6 is late
    df = ST.dedup_events(_stream(spark, d))
    with ST.rocks_store(spark):
        q = (df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-checkpoint")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]
    state = q.recentProgress[-1]["stateOperators"][0]
    assert state["numRowsTotal"] <= 2 and any("rocksdb" in k for k in state["customMetrics"])


def _readings(spark, rows):
    return spark.createDataFrame(rows, "lot_id string, ts timestamp, procured timestamp, days int, gone boolean")


def test_tier_changes_equal_the_batch_version(spark):
    """By time alone, by a reading that shortens the shelf life, none for lots
    that are gone before, again after a fall, a jump over a level; over batches
    and after a restart."""
    from shelfcast.session import scratch_path
    from shelfcast.streaming import tier_state as TI
    t0 = dt.datetime(2024, 1, 1)
    day = lambda x: t0 + dt.timedelta(days=x)
    rows = [
        ("time", day(0), day(0), 10, False),
        ("gone", day(0), day(0), 10, False), ("gone", day(7), day(0), 10, True),
        ("never", day(0), day(0), 20, False), ("never", day(2), day(0), 20, True),
        ("warm", day(0), day(0), 20, False), ("warm", day(5), day(0), 6, False),
        ("cold", day(7), day(0), 10, False), ("cold", day(7.5), day(0), 40, False),
        ("late start", day(9), day(0), 10, False), ("old", day(12), day(0), 10, False),
        ("back", day(0), day(0), 10, False), ("back", day(1), day(0), 10, True), ("back", day(3), day(2), 5, False),
    ]
    far = ("~", day(400), day(400), 10, False)
    want = sorted(map(tuple, TI.tier_changes_batch(_readings(spark, [*rows, far])).where("lot_id <> '~'").collect()))
    assert {(r[0], r[2]) for r in want} == {("time", "HIGH"), ("time", "CRITICAL"), ("gone", "HIGH"), ("warm", "CRITICAL"), ("cold", "HIGH"), ("cold", "CRITICAL"),
                                            ("late start", "CRITICAL"), ("old", "CRITICAL"), ("back", "HIGH"), ("back", "CRITICAL")}
    assert sum(r[0] == "cold" for r in want) == 3  # HIGH by the first reading, and again as time passes
    folder, out = scratch_path(spark, "readings"), scratch_path(spark, "tiers")
    schema = _readings(spark, rows).schema
    by_time = sorted(rows, key=lambda r: r[1])
    for part in (by_time[:6], by_time[6:11], [*by_time[11:], far], [("~~", day(401), day(401), 10, False)]):
        _readings(spark, part).coalesce(1).write.mode("append").parquet(folder)
        got = ST.run(TI.tier_changes(spark.readStream.schema(schema).parquet(folder)), "tiers", path=out)  # a restart each time
    assert sorted(map(tuple, got.where("not startswith(lot_id, '~')").collect())) == want


def test_lot_readings(spark):
    from shelfcast.sources.tables import Tables

    from .conftest import SF001
    t = Tables(spark, SF001)
    r = ST.lot_readings(t.lineitem, t)
    assert r.where("not gone").count() == 6000 and r.where("gone and ts < procured").count() == 0


def test_tier_changes_keep_lots_by_buckets(spark):
    """200 lots in 4 buckets: one state row a bucket, the alerts of the batch version."""
    from shelfcast.session import scratch_path
    from shelfcast.streaming import tier_state as TI
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"lot-{i}", t0 + dt.timedelta(days=i % 5), t0 + dt.timedelta(days=i % 5), 4 + i % 9, False) for i in range(200)]
    rows += [(f"lot-{i}", t0 + dt.timedelta(days=i % 5 + 3), t0 + dt.timedelta(days=i % 5), 4 + i % 9, True) for i in range(0, 200, 3)]
    far = ("~", t0 + dt.timedelta(days=400), t0 + dt.timedelta(days=400), 10, False)
    want = sorted(map(tuple, TI.tier_changes_batch(_readings(spark, [*rows, far])).where("lot_id <> '~'").collect()))
    folder, out = scratch_path(spark, "bucket-readings"), scratch_path(spark, "bucket-tiers")
    _readings(spark, [*rows, far]).write.parquet(folder)
    df = TI.tier_changes(spark.readStream.schema(_readings(spark, rows).schema).parquet(folder), buckets=4)
    with ST.rocks_store(spark):
        q = (df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-checkpoint")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).where("lot_id <> '~'").collect())) == want
    assert q.recentProgress[0]["numInputRows"] == len(rows) + 1
    assert TI.buckets_for(0) == 1 and TI.buckets_for(1000) == 1 and TI.buckets_for(1001) == 2 and TI.buckets_for(600_000) == 1024
    kept = spark.read.format("statestore").option("stateVarName", "lots").load(out + "-checkpoint")
    assert 1 <= kept.count() <= 4
