"""Session helpers: building a session for tests/bench and locating the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # session windows (T4) merge a partition's rows into sessions before the
    # shuffle, so a hot room ships one row per session, not one per reading
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shelfcast", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, users build their
    own session; every operator only needs a ``SparkSession``."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("SHELFCAST_DRIVER_MEM", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Recommended settings for a cluster run over ``input_bytes`` of Parquet.

    * initial shuffle partitions sized so the largest shuffle (about the
      projected lineitem columns, taken as 1/4 of the input) lands near
      ``target_partition_bytes`` per reducer, and never below 2 waves of the
      cluster's cores; AQE coalesces the small ones;
    * scan splits of 256 MB (row groups are the unit of a split);
    * skew join splitting at 4x the median (and 512 MB), broadcast left to
      AQE's runtime size measurement (64 MB).
    """
    cores = executors * cores_per_executor
    shuffle = max(2 * cores, (input_bytes // 4) // target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint root, set on the context where that has none:
    ``spark.checkpoint.dir`` of the session (the cluster's shared folder), else
    the folder the context has, else, on a local master only (tests, bench), a
    folder below the warehouse."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if current := sc.getCheckpointDir():
            return os.path.dirname(current)  # the context adds a folder of its own
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root (stream sinks, model
    artifacts, materialised intermediates)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH[path] = spark
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch folders of this session; those left go at exit."""
    for p in [p for p, s in _SCRATCH.items() if s is spark]:
        del _SCRATCH[p]
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_all() -> None:
    for s in {id(s): s for s in _SCRATCH.values()}.values():
        with contextlib.suppress(Exception):  # the session may be gone
            release_scratch(s)
