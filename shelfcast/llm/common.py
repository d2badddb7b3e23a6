"""Helpers shared by the corpus operators: written intermediates, Arrow batch
mapping and word / shingle hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.session import scratch_path

#: ASCII white space that separates words: 0x20 and 0x09-0x0D (``bytes.split()`` uses the same set)
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SHINGLE = 5


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: a lineage cut that survives lost executors. Folders go at exit, or
    by ``session.release_scratch``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB, where the session has the default of 64 MB: JVM
    and Python hold several each, and texts gain nothing from larger ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(4 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows. ``make()`` runs once
    per task and returns ``f(columns: dict[str, list]) -> dict[str, list]``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                got = f({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def utf8(name: str = "text"):
    """Text as UTF-8 bytes; null text counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


# ---------------------------------------------------------------- hashing
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * _ODD[0] + h[i:n + i] * _ODD[1]
    return mix(s)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the lower-cased (A-Z)
    text; a text of fewer words has its whole sequence as its one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(words) < k:
        return mix(grams(h, len(words)) + np.uint64(len(words)))
    return np.unique(grams(h, k))


# ---------------------------------------------------------------- places in an order
def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` (cheap to read twice) with ``idx``, the 0-based place of a row in
    its group by ``order``, and ``n``, the rows of the group. One range shuffle
    over group and order deals a hot group over many tasks; the places come
    from the partitions' own counts, so no task sees a whole group. Rows equal
    in all of ``order`` take places in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order]
    at = stash(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
               .withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    inside = Window.partitionBy(group).orderBy("_part")
    heads = (at.groupBy(part.alias("_part"), group).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
             .select("_part", group, (F.sum("_c").over(inside) - F.col("_c") - F.col("_first")).alias("_base"),
                     F.sum("_c").over(Window.partitionBy(group)).alias("n")))
    return (at.withColumn("_part", part).join(heads, ["_part", group])
            .withColumn("idx", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base"))


# ---------------------------------------------------------------- SQL
#: crc32 by bytes, for DuckDB: the table of its 256 steps
CRC_SQL = r"""
crc_table AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
              FROM range(256) AS r(i))"""
