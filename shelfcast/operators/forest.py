"""M5 over many rows: the forest of a ``RandomForestClassifier`` (two classes,
numbers as features, a weight per class) grown from grouped histograms.

Spark ML visits every row for every tree at each level through hash maps, and
keeps a row's bag as an array of one number a tree. Here a row is a byte a
feature, rows are dealt into blocks by their hash, and a task counts a block for
one tree after the other, so a tree's counts stay in the cache. What moves
between executors is counts of (tree, node, feature, bin, class); the driver
gets the splits. The rules are Spark ML's: Poisson bags of all rows, a fresh
choice of features at each node, weighted Gini, least instances per node,
sibling leaves of one class merged. A bag depends on the block and the tree
only, so the forest does not hang on files, partitions or cores. The result is
an ordinary ``RandomForestClassificationModel``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import scratch_path
from .boosting import stash

#: rows of a block on average; distinct values of a feature up to which all are counted, and quantiles of one with more
BLOCK_ROWS, LEVELS = 65_536, 1_000
#: bits of a bin in a packed row
BITS = 5
register_pickle_by_value(sys.modules[__name__])  # tasks get these functions, not the name of a module that executors may lack
_SPLITS = "tree int, node int, feature int, bin int, gain double, here array<double>, left array<double>, right array<double>"


# ------------------------------------------------------------------ bins
def cuts_of(points: list[tuple[float, float]], bins: int) -> list[float]:
    """Thresholds of a feature from its values and their weights, as Spark ML
    places them: between all neighbours where there are at most ``bins``
    values, else where the weight so far is nearest to a multiple of its share."""
    sums: dict[float, float] = {}
    for v, w in points:
        sums[v] = sums.get(v, 0.0) + w
    values = sorted(sums)
    if len(values) <= bins:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    stride = sum(sums.values()) / bins
    out, target, seen = [], stride, sums[values[0]]
    for a, b in zip(values, values[1:]):
        before, seen = seen, seen + sums[b]
        if abs(before - target) < abs(seen - target):
            out.append((a + b) / 2)
            target += stride
    return out[:bins - 1]


def feature_cuts(train: DataFrame, features: list[str], label: str, weight: str, bins: int) -> tuple[list[list[float]], dict[int, float]]:
    """(thresholds per feature, weight per class) over all rows. A feature of at
    most LEVELS values has each of them counted, one of more is described by
    LEVELS quantiles per class: bounded for the driver either way."""
    number = [F.col(f).cast("double") for f in features]
    per_class = train.groupBy(label).agg(F.max(weight).alias("w"),
                                         *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(number)]).collect()
    few = [i for i in range(len(features)) if max((r[f"n{i}"] for r in per_class), default=0) <= LEVELS]
    points: list[list[tuple[float, float]]] = [[] for _ in features]
    if few:
        each = F.array(*[F.struct(F.lit(i).alias("i"), number[i].alias("v")) for i in few])
        for r in train.select(F.explode(each).alias("r"), weight).groupBy("r.i", "r.v").agg(F.sum(weight).alias("w")).collect():
            points[r["i"]].append((r["v"], r["w"]))
    if many := [i for i in range(len(features)) if i not in few]:
        shares = [(i + 0.5) / LEVELS for i in range(LEVELS)]
        for r in train.groupBy(label).agg(F.sum(weight).alias("w"), *[F.percentile_approx(number[i], shares, 10 * LEVELS).alias(f"q{i}") for i in many]).collect():
            for i in many:
                points[i] += [(v, r["w"] / LEVELS) for v in r[f"q{i}"]]
    return [cuts_of(p, bins) for p in points], {int(r[label]): r["w"] for r in per_class}


# ------------------------------------------------------------------ rows
def packed_blocks(train: DataFrame, features: list[str], label: str, key: str, cuts: list[list[float]], rows: int) -> DataFrame:
    """Blocks of rows as bytes: per row the bin of each feature, then the class.
    Rows are dealt by the hash of all they hold and ordered by it and their
    bins, so a block is the same whatever files and partitions they come from."""
    if (len(features) * BITS + 1) > 63 or max(map(len, cuts)) >= 1 << BITS:
        raise ValueError("a packed row holds 12 features of 32 bins")
    spark, k = train.sparkSession, len(features)
    blocks = max(1, round(rows / BLOCK_ROWS))
    edges = [np.array(c) for c in cuts]

    def bin_rows(batches):
        for b in batches:
            x = np.asarray(b.column(k + 1), dtype=np.int64)
            for i in range(k):
                x = (x << BITS) | np.searchsorted(edges[i], np.asarray(b.column(i + 1)), "left")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x)], names=["h", "x"])

    def pack(block, parts):
        x = np.concatenate(parts)
        out = np.empty((len(x), k + 1), np.uint8)
        for i in range(k, 0, -1):
            out[:, i - 1] = x & ((1 << BITS) - 1)
            x = x >> BITS
        out[:, k] = x
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["block", "rows"])

    def pack_rows(batches):
        open_block, parts = None, []
        for b in batches:
            blocks_, x = np.asarray(b.column(0)), np.asarray(b.column(2))
            at = [0, *(np.flatnonzero(np.diff(blocks_)) + 1), len(blocks_)]
            for start, end in zip(at, at[1:]):
                if start == end:
                    continue
                if open_block is not None and blocks_[start] != open_block:
                    yield pack(open_block, parts)
                    parts = []
                open_block = int(blocks_[start])
                parts.append(x[start:end])
        if parts:
            yield pack(open_block, parts)

    given = train.select(F.xxhash64(key, label, *features).alias("h"), *[F.col(f).cast("double") for f in features], F.col(label).cast("long"))
    binned = given.mapInArrow(bin_rows, "h long, x long").select(F.pmod("h", F.lit(blocks)).alias("block"), "h", "x")
    n = max(1, min(blocks, spark.sparkContext.defaultParallelism))
    dealt = binned.repartitionById(n, F.pmod("block", F.lit(n)).cast("int")).sortWithinPartitions("block", "h", "x")
    return stash(dealt.mapInArrow(pack_rows, "block long, rows binary"), "forest-blocks")


# ------------------------------------------------------------------ growing
def _bag_table() -> np.ndarray:
    """Poisson(1) counts by the rank of 16 random bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _chosen(seed: int, tree: int, level: int, k: int, m: int) -> np.ndarray:
    """The ``m`` of ``k`` features that each node of a level may split by."""
    return np.random.default_rng([seed, 1, tree, level]).random((1 << level, k)).argsort(axis=1)[:, :m]


def _level_counts(blocks: DataFrame, feat: np.ndarray, cut: np.ndarray, is_open: np.ndarray, level: int, k: int, m: int, seed: int) -> DataFrame:
    """Bagged rows of every open node of a level by (feature chosen, bin,
    class), as 32-bit counts of a task and tree."""
    width, nodes, trees = 1 << BITS, 1 << level, len(feat)

    def count(batches):
        table, size = _bag_table(), nodes * m * width * 2
        out = np.zeros((trees, size), np.int32)
        chosen = [_chosen(seed, t, level, k, m) for t in range(trees)]
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(data.as_buffer(), np.uint8)
                y = x[k::k + 1]
                for t in range(trees):
                    if not is_open[t].any():
                        continue
                    bag = table[np.random.default_rng([seed, 2, t, block]).integers(0, 1 << 16, len(y), np.uint16)]
                    rows = np.flatnonzero(bag)
                    at, node = rows * (k + 1), np.zeros(len(rows), np.int64)
                    for up in range(level):
                        heap = node + ((1 << up) - 1)
                        node = 2 * node + (x.take(at + feat[t].take(heap)) > cut[t].take(heap))
                    if not is_open[t].all():
                        inside = np.flatnonzero(is_open[t].take(node))
                        rows, at, node = rows[inside], at[inside], node[inside]
                    weights, base = bag.take(rows).astype(np.float64), node * (m * width * 2) + y.take(rows)
                    for j in range(m):
                        cell = base + (x.take(at + chosen[t][:, j].take(node)) * 2 + np.int64(j * width * 2))
                        out[t] += np.bincount(cell, weights, size).astype(np.int32)
        for t in range(trees):
            if is_open[t].any():
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([out[t].tobytes()], pa.binary())], names=["tree", "counts"])

    return blocks.mapInArrow(count, "tree int, counts binary")


def _gini(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(impurity, weight) of class sums along the last axis."""
    total = stats.sum(axis=-1)
    share = np.divide(stats, total[..., None], out=np.zeros_like(stats), where=total[..., None] > 0)
    return np.where(total > 0, 1 - (share ** 2).sum(axis=-1), 0.0), total


def best_splits(counts: np.ndarray, chosen: np.ndarray, weights: np.ndarray, n_cuts: np.ndarray, min_leaf: int) -> list[tuple]:
    """Per node of ``counts`` (node, feature chosen, bin, class) with rows: its
    place, the best (feature, last bin to the left, gain), gain -1 where there
    is none, and the counts here, left and right of it."""
    width = counts.shape[2]
    left = counts.cumsum(axis=2)
    here = left[:, :1, -1:, :]
    right = here - left
    impurity, total = _gini(here * weights)
    (li, lw), (ri, rw) = _gini(left * weights), _gini(right * weights)
    gain = impurity - (li * lw + ri * rw) / np.where(total > 0, total, 1)
    allowed = ((left.sum(axis=-1) >= min_leaf) & (right.sum(axis=-1) >= min_leaf)
               & (np.arange(width) < n_cuts[chosen][..., None]))
    gain = np.where(allowed, gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    out = []
    for node in np.flatnonzero(here[:, 0, 0].sum(axis=-1) > 0):
        j, b = divmod(int(best[node]), width)
        g = float(gain[node, best[node]])
        out.append((int(node), int(chosen[node, j]), b, g if g > 0 else -1.0,
                    here[node, 0, 0].tolist(), left[node, j, b].tolist(), right[node, j, b].tolist()))
    return out


def _level_splits(counts: DataFrame, n_cuts: np.ndarray, weights: np.ndarray, min_leaf: int, level: int, k: int, m: int, seed: int) -> DataFrame:
    """The best split of every open node of a level, from the counts of all tasks."""
    shape = (1 << level, m, 1 << BITS, 2)

    def split(key, parts):
        import pandas as pd
        tree = int(key[0])
        total = np.zeros(shape, np.float64)
        for c in parts["counts"]:
            total += np.frombuffer(c, np.int32).reshape(shape)
        found = best_splits(total, _chosen(seed, tree, level, k, m), weights, n_cuts, min_leaf)
        return pd.DataFrame([(tree, *r) for r in found], columns=["tree", "node", "feature", "bin", "gain", "here", "left", "right"])

    return counts.groupBy("tree").applyInPandas(split, _SPLITS)


def grow(blocks: DataFrame, cuts: list[list[float]], weights: np.ndarray, trees: int, depth: int, m: int, min_leaf: int, seed: int) -> list[dict[int, Row]]:
    """Per tree its nodes that split, by heap number from 0; a level is one job.
    The root of a tree without a split is kept too, with gain -1."""
    k, n_cuts = len(cuts), np.array([len(c) for c in cuts])
    feat, cut = np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), 255, np.uint8)
    is_open = np.ones((trees, 1), bool)
    out: list[dict[int, Row]] = [{} for _ in range(trees)]
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    kept = blocks.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for level in range(depth):
            counts = _level_counts(kept, feat, cut, is_open, level, k, m, seed)
            rows = _level_splits(counts, n_cuts, weights, min_leaf, level, k, m, seed).collect()  # a row per node
            is_open = np.zeros((trees, 2 << level), bool)
            for r in rows:
                at = r["node"] + (1 << level) - 1
                if r["gain"] > 0:
                    feat[r["tree"], at], cut[r["tree"], at] = r["feature"], r["bin"]
                    for side, stats in enumerate((r["left"], r["right"])):
                        is_open[r["tree"], 2 * r["node"] + side] = min(stats) > 0  # a pure node is a leaf
                if r["gain"] > 0 or level == 0:
                    out[r["tree"]][at] = r
            if not is_open.any():
                break
    finally:
        kept.unpersist()
    return out


# ------------------------------------------------------------------ the model
def _saved_nodes(nodes: dict[int, Row], cuts: list[list[float]], weights: np.ndarray) -> list[dict]:
    """A tree as Spark ML saves it: nodes in preorder, sibling leaves that
    predict the same class merged."""
    def made(at: int, counts: list[float]) -> dict:
        stats = np.array(counts) * weights
        node = {"prediction": float(stats.argmax()), "impurity": float(_gini(stats)[0]), "impurityStats": stats.tolist(), "rawCount": int(sum(counts)),
                "gain": -1.0, "children": (), "split": (-1, [], -1)}
        r = nodes.get(at)
        if r is None or r["gain"] <= 0:
            return node
        left, right = made(2 * at + 1, r["left"]), made(2 * at + 2, r["right"])
        if not left["children"] and not right["children"] and left["prediction"] == right["prediction"]:
            return node
        return {**node, "gain": r["gain"], "children": (left, right), "split": (r["feature"], [cuts[r["feature"]][r["bin"]]], -1)}

    out: list[dict] = []

    def numbered(node: dict) -> int:
        mine = {"id": len(out), **{c: v for c, v in node.items() if c != "children"}, "leftChild": -1, "rightChild": -1}
        out.append(mine)
        if node["children"]:
            mine["leftChild"], mine["rightChild"] = [numbered(c) for c in node["children"]]
        return mine["id"]

    if 0 in nodes:
        numbered(made(0, nodes[0]["here"]))
    return out


def as_model(spark, estimator: RandomForestClassifier, trees: list[list[dict]], k: int) -> RandomForestClassificationModel:
    """The trees as a fitted model of ``estimator``: its saved form, whose
    parameters come from the estimator fitted to one row of each class, with the
    grown nodes for that fit's."""
    two = spark.createDataFrame([(Vectors.dense([v] * k), v, 1.0) for v in (0.0, 1.0)],
                                [estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getWeightCol()])
    path = scratch_path(spark, "forest")
    estimator.fit(two).write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    own = schema["nodeData"].dataType.names if "nodeData" in schema.names else [c for c in schema.names if c != "treeID"]
    rows = [(t, tuple(n[c] for c in own)) if "nodeData" in schema.names else tuple(t if c == "treeID" else n[c] for c in schema.names)
            for t, nodes in enumerate(trees) for n in nodes]
    spark.createDataFrame(rows, schema, verifySchema=False).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit_forest(estimator: RandomForestClassifier, train: DataFrame, features: list[str], key: str, rows: int) -> RandomForestClassificationModel:
    """``estimator`` (with a weight column, its value a function of the class)
    fitted to about ``rows`` rows of ``features``; rows without one are left out."""
    label, weight, seed = estimator.getLabelCol(), estimator.getWeightCol(), estimator.getSeed()
    for f in features:
        train = train.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    cuts, by_class = feature_cuts(train, features, label, weight, min(estimator.getMaxBins(), 1 << BITS))
    weights = np.array([by_class.get(c, 1.0) for c in (0, 1)])
    blocks = packed_blocks(train, features, label, key, cuts, rows)
    m = math.ceil(math.sqrt(len(features)))
    grown = grow(blocks, cuts, weights, estimator.getNumTrees(), estimator.getMaxDepth(), m, estimator.getMinInstancesPerNode(), seed & 0xFFFFFFFF)
    return as_model(train.sparkSession, estimator, [_saved_nodes(t, cuts, weights) for t in grown], len(features))
