"""M11 per key: gradient-boosted regression trees of every SKU at once.

Trees grow level by level from grouped histograms: one aggregate over (key,
node, feature, bin) gives the split of every open node of every key, so the
number of jobs depends on trees and depth and not on the number of keys, and
what moves between executors is histograms. A hot key combines map-side.
A key's ensemble is one row of small arrays (``MODEL``), so scoring is a join
by the key and a fold over its trees.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: per key: bounds of each feature, the mean it starts from, and its trees in
#: heap order: inner nodes' feature and last bin to the left, leaves' values
MODEL = "lo array<double>, hi array<double>, base double, trees array<struct<f: array<int>, b: array<int>, v: array<double>>>"
ALWAYS_LEFT = (1 << 30)


def bins_sql(features: list[str], bins: int, of: str = "") -> str:
    """SQL of each feature's bin: ``bins`` of equal width between the key's own
    bounds ``lo`` and ``hi`` (fields of ``of``); values beyond them fall into
    the outer bins."""
    one = "IF({of}hi[{i}] > {of}lo[{i}], greatest(0, least({last}, CAST(floor((CAST({x} AS double) - {of}lo[{i}]) / ({of}hi[{i}] - {of}lo[{i}]) * {bins}) AS int))), 0)"
    return f"array({', '.join(one.format(of=of, i=i, x=x, last=bins - 1, bins=bins) for i, x in enumerate(features))})"


def _walk(levels: int, x: str = "x", f: str = "f", b: str = "b") -> str:
    """SQL of the heap number that a row reaches after ``levels`` splits."""
    return f"aggregate(sequence(1, {levels}), 1, (n, _) -> 2 * n + IF({x}[{f}[n - 1]] > {b}[n - 1], 1, 0))" if levels else "1"


def boosted_score(x: str, base: str, trees: str, depth: int) -> str:
    """SQL of the prediction from the binned features ``x`` of a row."""
    leaf = _walk(depth, x, "t.f", "t.b")
    return f"{base} + aggregate({trees}, 0D, (s, t) -> s + t.v[{leaf} - {1 << depth}])"


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: training rows that a task holds at most, and histogram rows that one reduces
TASK_ROWS, TASK_SUMS = 500_000, 1_000_000


def _kept(df: DataFrame, tasks: int) -> DataFrame:
    """Written rows kept in executors, each in the task ``_p`` that it was dealt
    to, so that a level's sums within a task need no shuffle. What is lost is
    made again from the rows written."""
    return df.repartitionById(tasks, F.col("_p")).persist(StorageLevel.MEMORY_AND_DISK)


def _grow_level(rows: DataFrame, state: DataFrame, level: int, depth: int, rate: float, min_leaf: int, parts: int) -> DataFrame:
    """``state`` (key, trees, f, b: the trees since the rows were written and
    the splits of the one that grows) with the splits of one more level, or, at
    the last, with the tree finished: sums within each task, then one shuffle
    by the key for all that follows."""
    at = rows.join(state, "_key").select("_p", "_key", F.expr(_walk(level)).alias("node"), F.expr("r - d").alias("r"), "x")
    own = (at.select("_p", "_key", "node", "r", F.posexplode("x").alias("i", "bin")).groupBy("_p", "_key", "node", "i", "bin")
           .agg(F.sum("r").alias("s"), F.count("*").alias("n")))
    hist = (own.repartition(parts, "_key").groupBy("_key", "node", "i", "bin")
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n")))  # at most nodes * features * bins rows a key
    whole = Window.partitionBy("_key", "node", "i")
    upto = whole.orderBy("bin")
    c = hist.select("_key", "node", "i", "bin", F.sum("s").over(upto).alias("sl"), F.sum("n").over(upto).alias("nl"),
                    F.sum("s").over(whole).alias("st"), F.sum("n").over(whole).alias("nt"))
    sr, nr = F.col("st") - F.col("sl"), F.col("nt") - F.col("nl")
    ok = (F.col("nl") >= min_leaf) & (nr >= max(1, min_leaf))
    # gains as float: the last digits of a double depend on the order of sums
    gain = F.when(ok, F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - F.col("st") * F.col("st") / F.col("nt")).cast("float")
    split = F.struct(gain.alias("g"), (-F.col("i")).alias("i"), (-F.col("bin")).alias("b"), (F.col("sl") / F.col("nl")).alias("left"), (sr / nr).alias("right"))
    best = c.groupBy("_key", "node").agg(F.max(F.when(gain > 0, split)).alias("c"), F.max(F.col("st") / F.col("nt")).alias("mean"))
    found = best.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("c", "mean")))).alias("m"))  # at most 2^level entries
    j = found.join(state, "_key")  # every key has rows in each level; the state is the small side, no shuffle
    nodes = F.sequence(F.lit(1 << level), F.lit((2 << level) - 1))
    f = F.concat("f", F.transform(nodes, lambda n: F.coalesce(-F.try_element_at("m", n)["c"]["i"], F.lit(0))))
    b = F.concat("b", F.transform(nodes, lambda n: F.coalesce(-F.try_element_at("m", n)["c"]["b"], F.lit(ALWAYS_LEFT))))
    if level + 1 < depth:
        return j.select("_key", "trees", f.alias("f"), b.alias("b"))
    # a node that has no split sends all its rows to its left leaf
    v = F.flatten(F.transform(nodes, lambda n: F.array(
        F.coalesce(F.try_element_at("m", n)["c"]["left"], F.try_element_at("m", n)["mean"], F.lit(0.0)) * rate,
        F.coalesce(F.try_element_at("m", n)["c"]["right"], F.lit(0.0)) * rate)))
    none = F.array().cast("array<int>")
    return j.select("_key", F.concat("trees", F.array(F.struct(f.alias("f"), b.alias("b"), v.alias("v")))).alias("trees"), none.alias("f"), none.alias("b"))


def train_boosted(rows: DataFrame, key: str, features: list[str], label: str, trees: int = 100, depth: int = 4,
                  rate: float = 0.08, bins: int = 64, min_leaf: int = 1, cut_every: int = 10) -> DataFrame:
    """One model per ``key`` (see MODEL), squared loss, ``rate`` shrinkage, from
    rows without nulls in features and label; rows with a null key train
    nothing. Equal gains go to the first feature and its lowest bin. One query a
    level, whose result (a row per key) is written; its tasks follow the rows
    and keys, not the session's shuffle partitions. Rows lie in ranges of the
    key, a hot key's over several tasks. Their sums move on tree by tree
    (``d``) and residuals are written anew every ``cut_every`` trees, which
    bounds what a lost executor costs."""
    names = [f"_f{i}" for i in range(len(features))]
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_y"), *[F.col(c).alias(n) for c, n in zip(features, names)])
    sized = stash(rows.groupBy("_key").agg(F.array(*[F.min(F.col(c).cast("double")) for c in names]).alias("lo"),
                                           F.array(*[F.max(F.col(c).cast("double")) for c in names]).alias("hi"), F.avg("_y").alias("base"), F.count("*").alias("n")), "boost-bounds")
    bounds, size = sized.drop("n"), sized.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, size["rows"] // TASK_ROWS)
    parts = max(1, min(cores, size["keys"]), min(size["rows"], size["keys"] << (depth - 1)) * len(names) * bins // TASK_SUMS)
    # dealt before the bins are made: a range partitioner reads its input twice
    dealt = rows.repartitionByRange(tasks, "_key", F.rand(42)).withColumn("_p", F.spark_partition_id())
    dealt = dealt.join(bounds, "_key").select("_key", F.expr(bins_sql(names, bins)).alias("x"), (F.col("_y") - F.col("base")).alias("r"), "_p")
    at, last = _kept(stash(dealt, "boost-rows").withColumn("d", F.lit(0.0)), tasks), None
    none = F.array().cast("array<int>")
    start = bounds.select("_key", F.array().cast("array<struct<f: array<int>, b: array<int>, v: array<double>>>").alias("trees"), none.alias("f"), none.alias("b"))
    state, held = start, []
    for k in range(1, trees + 1):
        for level in range(depth):
            state = stash(_grow_level(at, state, level, depth, rate, min_leaf, parts), "boost-state")
            if last is not None:  # the first level has filled the rows that follow it
                last.unpersist()
                last = None
        if k % cut_every == 0 or k == trees:
            held.append(state.select("_key", F.lit(k).alias("k"), "trees"))
        if k < trees:
            leaf = f"element_at(trees, -1).v[{_walk(depth, 'x', 'element_at(trees, -1).f', 'element_at(trees, -1).b')} - {1 << depth}]"
            moved = at.join(state, "_key").select("_key", "x", "r", F.expr(f"d + {leaf}").alias("d"), "_p")
            last = at
            if k % cut_every == 0:
                at = _kept(stash(moved.select("_key", "x", F.expr("r - d").alias("r"), "_p"), "boost-rows").withColumn("d", F.lit(0.0)), tasks)
                state = start
            else:
                at = moved.persist(StorageLevel.MEMORY_AND_DISK)
    at.unpersist()
    alls = held[0]
    for t in held[1:]:
        alls = alls.unionByName(t)
    one = alls.groupBy("_key").agg(F.flatten(F.sort_array(F.collect_list(F.struct("k", "trees")))["trees"]).alias("trees"))  # trees / cut_every entries
    return stash(bounds.join(one, "_key").select(F.col("_key").alias(key), "lo", "hi", "base", "trees"), "boost-model")


def score_boosted(rows: DataFrame, model: DataFrame, key: str, features: list[str], depth: int = 4, bins: int = 64, out: str = "prediction") -> DataFrame:
    """``rows`` of the keys that have a model, with the prediction."""
    packed = model.select(F.col(key).alias("_key"), F.struct("lo", "hi", "base", "trees").alias("_model"))
    j = rows.join(packed, F.col(key) == F.col("_key"))
    # the bins are a lambda's argument, made once a row: as a column they would be written out into the walk and made at every node
    score = f"transform(array({bins_sql(features, bins, '_model.')}), x -> {boosted_score('x', '_model.base', '_model.trees', depth)})[0]"
    return j.withColumn(out, F.expr(score)).drop("_model", "_key")
