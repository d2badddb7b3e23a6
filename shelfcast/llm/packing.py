"""op5: hierarchical residual packing of token pieces into sequences.

Leaves (bounded groups of pieces, dealt by hash) pack best-fit decreasing.
Nearly full bins are final; the underfull ones go up a tree, where they are
items of further best-fit rounds, eight nodes to one, until one node is left.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_rows, stash, utf8
from .tokens import Holder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each size, taken in the given order: the fullest bin with
    room, else a new one. Bins wait in stacks by room, found by a bit mask."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, mask, bins = np.empty(len(sizes), np.int64), 0, 0
    for i, s in enumerate(sizes.tolist()):
        m = mask >> s
        if m:
            r = s + (m & -m).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r, bins = bins, capacity, bins + 1
        out[i] = b
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return out


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Whole texts as ids and the end id; documents longer than ``capacity``
    are cut into pieces of that many ids, the last may be shorter."""
    holder = Holder(df.sparkSession, tokenizer_path)
    end = struct.pack("<I", end_id)

    def make():
        enc = holder.encoder()

        def f(c):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for d, raw in zip(c["doc_id"], enc.encode(c["text"])):
                raw += end
                for p, lo in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[lo:lo + 4 * capacity]
                    for k, v in zip(out, (d, p, lo // 4, len(cut) // 4, zlib.crc32(cut))):
                        out[k].append(v)
            return out
        return f

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()), make, PIECES, rows=128)


def pack(pieces: DataFrame, capacity: int, leaf_items: int = 65536, fan_in: int = 8, nearly_full: float = 0.995) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Rows that are equal in every
    column are packed separately. At most one bin of a node is at most half
    full, so of the rest a node sends up the emptiest ones, as many as there
    are leaves: no more can ever take one in."""
    n = pieces.count()
    leaves = max(1, -(-n // leaf_items))

    def pack_leaf(t: pa.Table) -> pa.Table:
        size = t.column("length").to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").fill_null(-(1 << 62)).to_numpy(), -size))
        t, size = t.take(pa.array(order)), size[order]
        b = best_fit(size, capacity)
        by = np.argsort(b, kind="stable")  # offsets: running sums inside each bin
        run = np.cumsum(size[by]) - size[by]
        first = np.r_[True, b[by][1:] != b[by][:-1]]
        off = np.empty(len(by), np.int64)
        off[by] = run - np.maximum.accumulate(np.where(first, run, 0))
        return t.append_column("bin", pa.array(b, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    dealt = pieces.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(leaves)))
    placed = stash(dealt.groupBy("leaf").applyInArrow(pack_leaf, PIECES + ", leaf long, bin long, offset long"), "packed")
    if leaves == 1:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")

    member = "array<struct<leaf: bigint, bin: bigint, fill: bigint>>"
    merged = f"node long, fill long, members {member}"

    def merge(t: pa.Table) -> pa.Table:
        fill = t.column("fill").to_numpy()
        rows = t.column("members").to_pylist()
        key = [(m[0]["leaf"], m[0]["bin"]) for m in rows]
        order = sorted(range(len(fill)), key=lambda i: (-fill[i], key[i]))
        bins: dict[int, list[int]] = {}
        for i, b in zip(order, best_fit(fill[order], capacity)):
            bins.setdefault(int(b), []).append(i)
        got = sorted(((int(fill[m].sum()), [x for i in m for x in rows[i]]) for m in bins.values()), key=lambda x: (x[0], x[1][0]["leaf"], x[1][0]["bin"]))
        node = t.column("node")[0].as_py()
        return pa.table({"node": pa.array([node] * len(got), pa.int64()), "fill": pa.array([x[0] for x in got], pa.int64()),
                         "members": pa.array([x[1] for x in got], pa.list_(pa.struct([(k, pa.int64()) for k in ("leaf", "bin", "fill")])))})

    bins = (placed.groupBy("leaf", "bin").agg(F.sum("length").alias("fill"))
            .where(F.col("fill") < int(capacity * nearly_full)))
    level = bins.select(F.col("leaf").alias("node"), "fill", F.array(F.struct("leaf", "bin", "fill")).alias("members"))
    done, nodes = [], leaves
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = stash(level.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("node").applyInArrow(merge, merged), "packing-round")
        done.append(level.where(F.size("members") > 1))
        if nodes > 1:
            half = F.col("fill") * 2 <= capacity
            rank = F.row_number().over(Window.partitionBy("node").orderBy("fill"))
            level = level.withColumn("_r", rank).where((F.col("_r") <= leaves) | half).drop("_r")
    # a bin merged in several rounds: its last list holds all earlier members
    alls = done[0].withColumn("round", F.lit(0))
    for r, d in enumerate(done[1:], 1):
        alls = alls.unionByName(d.withColumn("round", F.lit(r)))
    one = alls.select("round", "members", F.posexplode("members").alias("i", "m"))
    base = F.expr("aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.fill)")
    moved = (one.select(F.col("m.leaf").alias("leaf"), F.col("m.bin").alias("bin"), F.struct(
        "round", F.element_at("members", 1).getField("leaf").alias("hl"), F.element_at("members", 1).getField("bin").alias("hb"), base.alias("base")).alias("to"))
        .groupBy("leaf", "bin").agg(F.max("to").alias("to")))
    j = placed.join(moved, ["leaf", "bin"], "left")
    seq = F.coalesce(F.col("to.hl"), F.col("leaf")) * F.lit(1 << 32) + F.coalesce(F.col("to.hb"), F.col("bin"))
    return j.select("doc_id", "piece", "start", "length", "ids_crc32", seq.alias("sequence_id"),
                    (F.col("offset") + F.coalesce(F.col("to.base"), F.lit(0))).alias("offset"))


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, leaf_items: int = 65536) -> DataFrame:
    """Sequences of at most ``capacity`` ids from whole documents (null text:
    the end id alone; an empty table gives no rows)."""
    return pack(stash(token_pieces(df, tokenizer_path, end_id, capacity), "pieces"), capacity, leaf_items)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` in sequences of at most 4096 ids."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
