"""T1 with state: an alert when a lot's tier rises, by a reading or by time.

The state of a lot is its procurement, shelf life and level; lots are kept by
buckets, with an event-time timer at the moment a share of shelf life next falls
below a tier's bound. The watermark fires it, so the alert needs no new event of
the lot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C

DAY_MS = 86_400_000
#: levels by rising risk, with the percent of shelf life below which each begins
LEVELS = [("MEDIUM", round(C.TIER_MEDIUM * 100)), ("HIGH", round(C.TIER_HIGH * 100)), ("CRITICAL", round(C.TIER_CRITICAL * 100))]
CHANGES = "lot_id string, alert_ms long, risk_level string"


def begins(procured: int, days: int, level: int) -> int:
    """First millisecond of a level (0 is the first of LEVELS)."""
    return procured + days * (100 - LEVELS[level][1]) * (DAY_MS // 100) + 1


def risen(lot: tuple, now: int, out: list) -> tuple:
    """The lot (procured, days, level) after time alone has passed to ``now``;
    what that raises goes to ``out``."""
    procured, days, level = lot
    while level + 1 < len(LEVELS) and begins(procured, days, level + 1) <= now:
        level += 1
        out.append((begins(procured, days, level), LEVELS[level][0]))
    return procured, days, level


class TierChanges(StatefulProcessor):
    """Rows (bucket, lot_id, ms, procured, days, gone) -> one row per rise of a
    lot to one of ``wanted``. A reading may change the shelf life: a lot that
    jumps levels by it gives one alert, of the new level; a lot that falls back
    rises anew. A lot that is gone, or at the last level, needs no timer; gone
    lots leave the state. Rows of a batch are taken in time order, and what
    time alone would have raised in between is raised first, so batches do not
    matter. The lots of a bucket share one state value (parallel arrays) and
    one timer, at the earliest moment that any of them rises: reading, writing
    and timers are round trips to the store, which a lot each would not bear."""

    def __init__(self, wanted: tuple = ("HIGH", "CRITICAL")):
        self.wanted = wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lots = handle.getValueState("lots", "ids array<string>, procured array<long>, days array<int>, levels array<int>")

    def _held(self) -> dict:
        """Lots of the bucket: id -> (procured, days, level)."""
        got = self.lots.get()
        return {} if got is None else dict(zip(got[0], zip(*got[1:])))

    def _keep(self, lots: dict, was: list) -> None:
        """Write the lots; of the timers ``was`` only the one still due stays."""
        if lots:
            self.lots.update((list(lots), *map(list, zip(*lots.values()))))
        else:
            self.lots.clear()
        due = min((begins(p, d, k + 1) for p, d, k in lots.values() if k + 1 < len(LEVELS)), default=None)
        for t in was:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in was:
            self.handle.registerTimer(due)

    def _rows(self, out: list) -> Iterator[pd.DataFrame]:
        out = [x for x in out if x[2] in self.wanted]
        if out:
            yield pd.DataFrame(out, columns=["lot_id", "alert_ms", "risk_level"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lots, out = self._held(), []
        timers = list(self.handle.listTimers()) if lots else []
        taken = sorted(x for df in rows for x in zip(df["lot_id"], df["ms"].tolist(), df["gone"].tolist(), df["procured"].tolist(), df["days"].tolist()))
        for lot_id, ms, gone, procured, days in taken:
            lot, own = lots.get(lot_id), []
            if lot is not None:
                lot = risen(lot, ms, own)
            if gone:
                lots.pop(lot_id, None)
            else:
                level = max((k for k in range(len(LEVELS)) if begins(procured, days, k) <= ms), default=-1)
                if level > (lot[2] if lot is not None else -1):
                    own.append((ms, LEVELS[level][0]))
                lots[lot_id] = (procured, days, level)
            out.extend((lot_id, *x) for x in own)
        self._keep(lots, timers)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lots, out, now = self._held(), [], timerValues.getCurrentWatermarkInMs()
        for lot_id, lot in lots.items():
            own: list = []
            lots[lot_id] = risen(lot, now, own)
            out.extend((lot_id, *x) for x in own)
        self._keep(lots, [])  # the timer that fired is gone
        yield from self._rows(out)

    def close(self) -> None:
        pass


#: lots that a bucket is meant to hold, and buckets where their number is not known
BUCKET_LOTS, BUCKETS = 1_000, 1 << 14


def buckets_for(lots: int) -> int:
    """Buckets for a stream of that many lots, a power of two."""
    return 1 << max(0, -(-lots // BUCKET_LOTS) - 1).bit_length()


def tier_changes(readings: DataFrame, delay: str = "1 hour", wanted: tuple = ("HIGH", "CRITICAL"), buckets: int = BUCKETS) -> DataFrame:
    """Alerts from a stream of readings (lot_id, ts, procured, days, gone);
    rows without a shelf life or behind the watermark take no part. Lots are
    kept by ``buckets`` of the hash of their id: a number that a checkpoint
    keeps, for about BUCKET_LOTS lots in stock each."""
    r = (readings.where("lot_id is not null and days > 0 and procured is not null").withWatermark("ts", delay)
         .select(F.pmod(F.xxhash64("lot_id"), F.lit(buckets)).alias("bucket"), "lot_id", "ts", F.unix_millis("ts").alias("ms"), F.unix_millis("procured").alias("procured"),
                 F.col("days").cast("int").alias("days"), F.coalesce("gone", F.lit(False)).alias("gone")))
    got = r.groupBy("bucket").transformWithStateInPandas(TierChanges(wanted), CHANGES, "Append", "EventTime")
    return got.select("lot_id", F.timestamp_millis("alert_ms").cast("timestamp_ntz").alias("alert_ts"), "risk_level")


def tier_changes_batch(readings: DataFrame, wanted: tuple = ("HIGH", "CRITICAL")) -> DataFrame:
    """The same from a table of readings, by windows over each lot's readings:
    what time raises before the next one, and what a reading raises itself."""
    from pyspark.sql import Window
    w = Window.partitionBy("lot_id").orderBy("ms", "gone", "procured", "days")
    r = (readings.where("lot_id is not null and days > 0 and procured is not null")
         .select("lot_id", F.unix_millis("ts").alias("ms"), F.unix_millis("procured").alias("procured"), F.col("days").cast("int").alias("days"), "gone"))
    at = [F.col("procured") + F.col("days") * F.lit((100 - pct) * (DAY_MS // 100)).cast("long") + 1 for _, pct in LEVELS]
    r = r.withColumn("upto", F.lead("ms").over(w))

    def level(ms):
        out = F.lit(-1)
        for k, b in enumerate(at):
            out = F.when(b <= ms, k).otherwise(out)
        return out

    r = r.withColumn("own", level(F.col("ms"))).withColumn("left", F.greatest("own", F.when(F.col("upto").isNull(), len(LEVELS) - 1).otherwise(level(F.col("upto")))))
    r = r.withColumn("before", F.when(F.lag("gone").over(w), -1).otherwise(F.coalesce(F.lag("left").over(w), F.lit(-1)))).where("not gone")
    jump = F.when(F.col("own") > F.col("before"), F.array(F.struct(F.col("ms").alias("ms"), F.col("own").alias("k"))))
    later = F.filter(F.array(*[F.struct(b.alias("ms"), F.lit(k).alias("k")) for k, b in enumerate(at)]),
                     lambda x: (x["k"] > F.col("own")) & (x["k"] <= F.col("left")))
    names = F.array(*[F.lit(n) for n, _ in LEVELS])
    got = r.select("lot_id", F.explode(F.concat(F.coalesce(jump, F.array().cast("array<struct<ms: bigint, k: int>>")), later)).alias("x"))
    return (got.select("lot_id", F.timestamp_millis("x.ms").cast("timestamp_ntz").alias("alert_ts"), F.get(names, F.col("x.k")).alias("risk_level"))
            .where(F.col("risk_level").isin(*wanted)))
