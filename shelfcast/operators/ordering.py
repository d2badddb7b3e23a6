"""Scale-safe ordering helpers.

* ``global_rank``: a position in a global order without a window over one
  partition. The frame is range-partitioned and sorted (``orderBy``), each
  row gets ``monotonically_increasing_id`` (partition id in the high bits,
  row index in the low 33 bits), the per-partition row counts become
  offsets (a table with one row per partition) and rank = offset + index.
  The sorted frame is checkpointed so both consumers see the same rows.
* ``with_previous``: the previous row's timestamp (and the running max of a
  value before it) per key, computed inside (key, time bucket) partitions;
  the first row of a bucket takes the last row of the key's previous
  non-empty bucket from a small per-bucket summary. A hot key is split over
  its buckets instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in ``order`` (which must be a total order,
    i.e. end with a unique key)."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = df.columns
    s = (df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    s = s.select(*cols, F.shiftright("_mid", 33).alias("_pid"), F.col("_mid").bitwiseAND(_LOW).alias("_idx"))
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    # one row per partition of the sorted frame: bounded by the partition count
    return (s.join(F.broadcast(offsets), "_pid")
            .select(*cols, (F.col("_base") + F.col("_idx") + 1).alias(name)))


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, value: str | None = None,
                  unit: str = "hour") -> DataFrame:
    """Adds ``prev_ts`` and (when ``value`` is given) ``prior_max`` = max of
    ``value`` over all earlier rows of the key."""
    d = df.withColumn("_b", F.date_trunc(unit, F.col(ts)))
    wb = Window.partitionBy(*keys, "_b").orderBy(ts, tie)
    d = d.withColumn("_prev_in", F.lag(ts).over(wb))
    aggs = [F.max(ts).alias("_bmax_ts")]
    if value:
        d = d.withColumn("_max_in", F.max(value).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
        aggs.append(F.max(value).alias("_bmax_v"))
    s = d.groupBy(*keys, "_b").agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy("_b")
    sel = [*keys, "_b", F.lag("_bmax_ts").over(ws).alias("_prev_b_ts")]
    if value:
        sel.append(F.max("_bmax_v").over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias("_prior_b_v"))
    s = s.select(*sel)
    j = d.join(s, [*keys, "_b"]).withColumn("prev_ts", F.coalesce("_prev_in", "_prev_b_ts"))
    drop = ["_b", "_prev_in", "_prev_b_ts"]
    if value:
        j = j.withColumn("prior_max", F.greatest("_max_in", "_prior_b_v"))
        drop += ["_max_in", "_prior_b_v"]
    return j.drop(*drop)
