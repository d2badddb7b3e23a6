"""Spark ML operators.

* Spoilage: ``Pipeline(StringIndexer x2, VectorAssembler, RandomForest)``
  with balanced class weights and a deterministic stratified hash split.
* Demand: one boosted model per SKU, all grown at once from grouped histograms
  (``boosting``), or one pooled ``GBTRegressor`` over all series (sku and
  warehouse are indexed features); per-SKU MAPE comes from a grouped aggregate
  over the test predictions.
* Recursive forecast: one row of state per series (an array of the last 14
  values); each horizon step derives the lag/rolling features from the array
  with built-in array functions, scores it with the ensemble compiled to SQL
  and appends the prediction: one fold over an array, one job.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import clamp0, r4
from . import boosting as BO
from . import forest as FO
from . import trees as TR
from .features import SERIES, build_lag_features, train_test_split
from .forecast import _ape, forecast_band, heuristic_forecast, series_state

_CACHE: dict = {}


def clear_models(stopped_only: bool = False) -> None:
    """Forget fitted models (all, or only those whose session has stopped)."""
    for k in [k for k, (_, test) in _CACHE.items() if not stopped_only or test.sparkSession.sparkContext._jsc is None]:
        del _CACHE[k]


def _key(df: DataFrame, kind: str, cache_key):
    """Cache key bound to the Spark application (frames die with it)."""
    return None if cache_key is None else (kind, df.sparkSession.sparkContext.applicationId, cache_key)


#: training rows that make a task worth while, and those it holds at most; rows of a
#: frame above which its forest is grown from histograms and not by Spark ML
TASK_ROWS, MAX_TASK_ROWS, FOREST_ROWS = 100_000, 500_000, 1_000_000


def _dealt(train: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """Training rows of a frame of ``rows`` rows over all cores, by the hash of
    their keys and in their order (so bagging does not hang on files and their
    row groups); few rows in fewer tasks, as each level of a tree is a job."""
    n = max(min(rows // TASK_ROWS, train.sparkSession.sparkContext.defaultParallelism), rows // MAX_TASK_ROWS)
    return train.coalesce(1) if n <= 1 else train.repartition(n, *keys).sortWithinPartitions(*keys)


def _fit(pipeline: Pipeline, train: DataFrame, rows: int, keys: list[str]) -> PipelineModel:
    """Fit with the training frame dealt and persisted (indexers, split finding
    and tree-point conversion each read it); released afterwards."""
    from pyspark import StorageLevel
    train = _dealt(train, rows, keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(train)
    finally:
        train.unpersist()


def _fit_large(pipeline: Pipeline, train: DataFrame, rows: int) -> PipelineModel:
    """``_fit`` of the spoilage pipeline for many rows: the same stages, whose
    forest is grown by ``forest``; the training rows are written once."""
    *stages, forest = pipeline.getStages()
    train = BO.stash(train, "spoil-train")  # read by indexers, bins and blocks
    ready = Pipeline(stages=stages).fit(train)
    grown = FO.fit_forest(forest, ready.transform(train), C.SPOILAGE_FEATURES, "lot_id", rows)
    return PipelineModel([*ready.stages, grown])


# ------------------------------------------------------------------ M3, M4
SPLIT_BUCKETS = 4096


def split_bucket(key: str = "lot_id") -> Column:
    """Bucket of a row by the md5 of its key."""
    return F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 3), 16, 10).cast("int")


def with_split(lots: DataFrame, test_fraction: float = C.DEFAULT.spoil_test_fraction, label: str = "did_spoil",
               key: str = "lot_id") -> DataFrame:
    """M3: stratified split. Rows of each label are ordered by the hash bucket
    of their key and cut where the label's own share of training rows is
    reached: counts per (label, bucket), at most SPLIT_BUCKETS rows a label."""
    counts = lots.groupBy(F.col(label).alias("_l"), split_bucket(key).alias("_b")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_l")
    upto, total = F.sum("_n").over(w.orderBy("_b")), F.sum("_n").over(w)
    cut = (counts.withColumn("_in", upto <= F.lit(1 - test_fraction) * total).where("_in")
           .groupBy("_l").agg(F.max("_b").alias("_cut")))
    # null-safe: from a plain equality Catalyst infers "label is not null" and writes the label's whole
    # expression out into that filter; rows without a label train nothing
    inside = F.when(F.col(label).isNotNull(), split_bucket(key) <= F.col("_cut"))
    return (lots.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("_l")), "left")  # a row per label
            .withColumn("is_train", F.coalesce(inside, F.lit(False))).drop("_l", "_cut"))


def balanced_weights(df: DataFrame, label: str = "did_spoil") -> DataFrame:
    """M4: weight = n / (n_classes * n_class), joined from a class-count table
    (bounded by the number of classes)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_nc"))
    tot = counts.select(F.sum("_nc").over(Window.partitionBy()).alias("_n"), F.count("*").over(
        Window.partitionBy()).alias("_k"), label, "_nc")
    w = tot.select(F.col(label).alias("_l"), F.when(F.col(label).isNotNull(), F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("class_weight"))
    j = df.join(F.broadcast(w), F.col(label).eqNullSafe(F.col("_l"))).where("class_weight is not null")  # null-safe as in with_split
    return j.select(label, *[c for c in df.columns if c != label], "class_weight")


# ------------------------------------------------------------------ M1, M2, M5
def label_stages(columns: dict[str, str]) -> list:
    """M1: alphabetical index of each text column as a plain number. The
    arithmetic drops the indexer's nominal metadata, so trees split the number
    (as the source does) and no bin count limits the number of levels."""
    out = [StringIndexer(inputCol=c, outputCol=f"_{e}", stringOrderType="alphabetAsc", handleInvalid="keep") for c, e in columns.items()]
    plain = ", ".join(f"double(_{e}) + 0.0D AS {e}" for e in columns.values())
    return [*out, SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")]


def spoilage_pipeline(p: C.Params = C.DEFAULT) -> Pipeline:
    return Pipeline(stages=[
        *label_stages({"category": "category_enc", "warehouse_id": "warehouse_enc"}),
        VectorAssembler(inputCols=C.SPOILAGE_FEATURES, outputCol="features", handleInvalid="skip"),
        RandomForestClassifier(featuresCol="features", labelCol="did_spoil", weightCol="class_weight",
                               numTrees=p.rf_trees, maxDepth=p.rf_depth, minInstancesPerNode=p.rf_min_leaf,
                               seed=p.seed),
    ])


def _spoil_frame(lots: DataFrame) -> DataFrame:
    return lots.select("lot_id", "category", "warehouse_id", "did_spoil", "age_pct", "temp_deviation_c",
                       "over_order_factor", "quantity_kg", "shelf_life_days", "price_per_kg")


def encoded(df: DataFrame, column: str, out: str) -> DataFrame:
    """M1 as a frame: 0-based alphabetical index of ``column`` (a row number
    over its distinct values, which one task orders, so they are broadcast: a
    shuffle by them would read all rows of a level in one task)."""
    levels = df.select(F.col(column).alias("_v")).distinct()
    levels = levels.select("_v", (F.row_number().over(Window.orderBy("_v")) - 1).cast("double").alias(out))
    return df.join(F.broadcast(levels), F.col(column) == F.col("_v"), "left").drop("_v")


def train_spoilage_model(lots: DataFrame, p: C.Params = C.DEFAULT, cache_key=None):
    """M5: returns (model, scored test frame)."""
    k = _key(lots, "spoil", cache_key)
    if k in _CACHE:
        return _CACHE[k]
    rows = BO.stash(_spoil_frame(lots), "spoil-rows")  # read by split, weights, fit and scoring
    df = with_split(rows, p.spoil_test_fraction)
    train = balanced_weights(df.filter("is_train"))
    n = rows.count()
    model = _fit(spoilage_pipeline(p), train, n, ["lot_id"]) if n <= FOREST_ROWS else _fit_large(spoilage_pipeline(p), train, n)
    test = score_spoilage(model, df.filter(~F.col("is_train")))
    out = (model, test)
    if k is not None:
        _CACHE[k] = out
    return out


def score_spoilage(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M6: predicted class and probability of spoiling."""
    return (model.transform(df)
            .withColumn("spoil_proba", vector_to_array("probability")[1])
            .drop("rawPrediction", "probability", "features"))


# ------------------------------------------------------------------ M7, M8, M9
def classification_metrics(scored: DataFrame, label: str = "did_spoil", pred: str = "prediction") -> DataFrame:
    """M7: accuracy, F1 and per-class precision / recall / support from the
    four confusion cells, in one aggregate."""
    y, yh = F.col(label).cast("int"), F.col(pred).cast("int")
    a = scored.agg(F.count_if((y == 1) & (yh == 1)).alias("tp"), F.count_if((y == 0) & (yh == 1)).alias("fp"),
                   F.count_if((y == 1) & (yh == 0)).alias("fn"), F.count_if((y == 0) & (yh == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ["tp", "fp", "fn", "tn"])
    prec1, rec1 = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    prec0, rec0 = F.try_divide(tn, tn + fn), F.try_divide(tn, tn + fp)
    return a.select(
        r4(F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        r4(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
        r4(prec1).alias("precision_spoil"), r4(rec1).alias("recall_spoil"), (tp + fn).alias("support_spoil"),
        r4(prec0).alias("precision_no_spoil"), r4(rec0).alias("recall_no_spoil"), (tn + fp).alias("support_no_spoil"),
        (tp + tn + fp + fn).alias("n_test"))


def confusion_matrix(scored: DataFrame, label: str = "did_spoil", pred: str = "prediction") -> DataFrame:
    """M8: rows actual, columns predicted, over the fixed 2 x 2 domain (J5):
    four counts in one aggregate, exploded."""
    y, yh = F.col(label).cast("int"), F.col(pred).cast("int")
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    one = scored.agg(*[F.count_if((y == a) & (yh == b)).alias(f"c{a}{b}") for a, b in cells])
    rows = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n")) for a, b in cells])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def feature_importance(model: PipelineModel, spark, features=C.SPOILAGE_FEATURES, k: int | None = None) -> DataFrame:
    """M9 (+ O4 top-k): model metadata as a small frame."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(k) if k else df


# ------------------------------------------------------------------ M11, M12, B22
def available_features(df: DataFrame, features=C.DEMAND_FEATURES) -> list[str]:
    """P10: keep only the feature columns the frame has."""
    return [f for f in features if f in df.columns]


def demand_pipeline(p: C.Params = C.DEFAULT, features=C.DEMAND_FEATURES) -> Pipeline:
    return Pipeline(stages=[
        *label_stages({"sku_id": "sku_idx", "warehouse_id": "wh_idx"}),
        VectorAssembler(inputCols=list(features) + ["sku_idx", "wh_idx"], outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol="actual_demand_kg", maxIter=p.gbt_iters,
                     maxDepth=p.gbt_depth, stepSize=p.gbt_step, seed=p.seed),
    ])


def demand_feature_rows(demand: DataFrame, p: C.Params = C.DEFAULT) -> DataFrame:
    """M10 + W7 + P8: feature rows of series with at least 50 rows."""
    f = train_test_split(build_lag_features(demand), p)
    n = F.count("*").over(Window.partitionBy(*SERIES))
    return f.withColumn("_n", n).filter(F.col("_n") >= p.min_feature_rows).drop("_n")


def train_demand_model(demand: DataFrame, p: C.Params = C.DEFAULT, cache_key=None):
    """Returns (model, test predictions clamped at 0)."""
    k = _key(demand, "demand", cache_key)
    if k in _CACHE:
        return _CACHE[k]
    rows = demand_feature_rows(demand, p)
    feats = available_features(rows)
    rows = BO.stash(rows.select(*SERIES, "date", "row_in_series", "split", "actual_demand_kg", *feats), "feature-rows")  # read by fit and scoring
    model = _fit(demand_pipeline(p, feats), rows.filter(F.col("split") == "train"), rows.count(), [*SERIES, "date"])
    test = (model.transform(rows.filter(F.col("split") == "test"))
            .withColumn("predicted", clamp0("prediction"))
            .select(*SERIES, "date", "row_in_series", F.col("actual_demand_kg").alias("actual"), "predicted"))
    out = (model, test)
    if k is not None:
        _CACHE[k] = out
    return out


def train_sku_models(demand: DataFrame, p: C.Params = C.DEFAULT, trees: int | None = None, depth: int | None = None, bins: int = 64, cache_key=None):
    """One boosted model per SKU over the feature rows of its series;
    returns (models, test predictions clamped at 0)."""
    trees, depth = trees or p.sku_iters, depth or p.gbt_depth
    k = _key(demand, "sku", (cache_key, trees, depth, bins) if cache_key else None)
    if k in _CACHE:
        return _CACHE[k]
    own = [c for c in demand.columns if c in (*SERIES, "date", "actual_demand_kg", *C.DEMAND_FEATURES)]
    rows = demand_feature_rows(demand.select(*own), p).repartition(demand.sparkSession.sparkContext.defaultParallelism, *SERIES, "date")
    rows = BO.stash(rows, "feature-rows")  # read by bounds, bins and scoring, a file a core: fewer would be read by few tasks
    model = BO.train_boosted(rows.filter(F.col("split") == "train"), "sku_id", C.DEMAND_FEATURES, "actual_demand_kg", trees, depth, p.sku_step, bins)
    test = (BO.score_boosted(rows.filter(F.col("split") == "test"), model, "sku_id", C.DEMAND_FEATURES, depth, bins)
            .select(*SERIES, "date", "row_in_series", F.col("actual_demand_kg").alias("actual"), clamp0("prediction").alias("predicted")))
    out = (model, test)
    if k is not None:
        _CACHE[k] = out
    return out


def demand_model_mape(test: DataFrame) -> DataFrame:
    """M12 + B21: MAPE per SKU on the chronological tail, ascending, with the
    mean over SKUs as a reference column."""
    g = test.groupBy("sku_id").agg((F.avg(_ape("actual", "predicted")) * 100).alias("m"),
                                   F.count("*").alias("n_test"))
    return g.select("sku_id", r4("m").alias("mape"), "n_test",
                    r4(F.avg("m").over(Window.partitionBy())).alias("avg_mape"))  # a row per sku


def actual_vs_predicted(test: DataFrame, sku_id: str | None = None) -> DataFrame:
    """The test rows of one SKU (of all when not given), with a step
    index per series."""
    t = test if sku_id is None else test.filter(F.col("sku_id") == sku_id)
    w = Window.partitionBy(*SERIES).orderBy("date")
    return t.select(*SERIES, "date", F.row_number().over(w).alias("step"),
                    r4("actual").alias("actual"), r4("predicted").alias("predicted"))


def metrics_as_lists(test: DataFrame) -> DataFrame:
    """per series, the test actuals and predictions as date-ordered lists
    (bounded by the test days of one series) and as JSON text."""
    g = test.groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("date", "actual", "predicted"))).alias("_r"))
    return g.select(*SERIES, F.col("_r.actual").alias("test_actual"), F.col("_r.predicted").alias("test_predicted"),
                    F.to_json(F.col("_r")).alias("records_json"))


# ------------------------------------------------------------------ B18, B19, J7
def _features_sql(date: str = "date_add(last_date, i)") -> dict[str, str]:
    """SQL of the demand features at step ``i`` from the state ``s.h`` (the
    last 14 values) and the arrays of temperatures and festival multipliers."""
    def mean(a):
        return f"(aggregate({a}, 0e0, (q, v) -> q + v) / size({a}))"

    week = "slice(s.h, -7, 7)"
    std = f"transform(array({mean(week)}), m -> sqrt(aggregate({week}, 0e0, (q, v) -> q + (v - m) * (v - m)) / 6))[0]"
    return {**{f"lag_{n}": f"element_at(s.h, {-n})" for n in C.DEMAND_LAGS},
            "rolling_7_mean": mean(week), "rolling_7_std": std, "rolling_14_mean": mean("slice(s.h, -14, 14)"),
            "day_of_week": f"weekday({date})", "month": f"month({date})", "day_of_year": f"dayofyear({date})",
            "is_weekend": f"IF(weekday({date}) >= 5, 1, 0)", "temp_c": "temps[i - 1]", "festival_multiplier": "fests[i - 1]"}


def forecast_state(demand: DataFrame, horizon: int, known_future: bool = False, festivals: DataFrame | None = None) -> DataFrame:
    """Per series what a recursive forecast starts from: last date, the last 14
    values, and the temperature and festival multiplier of each step."""
    from ..sources.views import festival_dim, seasonal_temp, with_festival, years_of
    w = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    tail = demand.select(*SERIES, "date", "actual_demand_kg", "temp_c", F.row_number().over(w).alias("_rk")).filter(F.col("_rk") <= 14)
    st = (tail.groupBy(*SERIES)
          .agg(F.max("date").alias("last_date"), F.max(F.when(F.col("_rk") == 1, F.col("temp_c"))).alias("_temp"),
               F.sort_array(F.collect_list(F.struct("date", F.col("actual_demand_kg").alias("y")))).alias("_tail"))
          .select(*SERIES, "last_date", "_temp", F.col("_tail.y").alias("hist")))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    if not known_future:
        return st.select(*SERIES, "last_date", "hist", F.array_repeat("_temp", horizon).alias("temps"),
                         F.array_repeat(F.lit(1.0), horizon).alias("fests"))
    if festivals is None:
        last = demand.agg(F.max("date")).first()[0]
        festivals = festival_dim(demand.sparkSession, years_of(last, last + dt.timedelta(days=horizon)) if last else (1970,))
    days = st.select("last_date").distinct().select("last_date", F.explode(steps).alias("i")).withColumn("_d", F.date_add("last_date", F.col("i")))
    days = with_festival(days, festivals, "_d", "_fm")
    fests = days.groupBy("last_date").agg(F.sort_array(F.collect_list(F.struct("i", F.round("_fm", 2).alias("v"))))["v"].alias("fests"))
    temps = F.transform(steps, lambda i: seasonal_temp(F.dayofyear(F.date_add("last_date", i))))
    return st.join(fests, "last_date").select(*SERIES, "last_date", "hist", temps.alias("temps"), "fests")


def fold_forecast(state: DataFrame, horizon: int, row: str, score: str) -> DataFrame:
    """B18 as one projection: a fold over the steps whose state is the history
    and the predictions; each step makes ``row`` from it, scores it (``score``
    over ``x``) and appends the value, clamped at 0. No job per step."""
    step = (f"transform(array({row}), x -> transform(array(greatest({score}, 0e0) + 0e0), y -> "
            "named_struct('h', slice(concat(s.h, array(y)), -14, 14), 'p', concat(s.p, array(y))))[0])[0]")
    fold = f"aggregate(sequence(1, {horizon}), named_struct('h', hist, 'p', CAST(array() AS array<double>)), (s, i) -> {step}, s -> s.p)"
    out = state.select(*SERIES, "last_date", F.posexplode(F.expr(fold)).alias("_pos", "_f"))
    return out.select(*SERIES, (F.col("_pos") + 1).alias("step"), F.date_add("last_date", F.col("_pos") + 1).alias("date"), "_f")


def recursive_forecast(model: PipelineModel, demand: DataFrame, p: C.Params = C.DEFAULT,
                       horizon: int | None = None, known_future: bool = False, festivals: DataFrame | None = None) -> DataFrame:
    """Feed each prediction back as the next step's lags, with the pooled
    model compiled to SQL. By default the temperature is the last one seen and
    the festival multiplier 1.0 (Q7); ``known_future`` takes both from the
    calendar instead (the seasonal temperature cycle and ``festivals``, by
    default the built-in calendar of the years around the last date)."""
    h = horizon or p.horizon
    feats = _features_sql()
    labels, trees = TR.compile_pipeline(model, demand.sparkSession, {n: f"x.{n}" for n in feats})
    row = f"named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {x}' for n, x in feats.items())})"
    state = forecast_state(demand, h, known_future, festivals).selectExpr("*", *[f"{x} AS {n}" for n, x in labels.items()])
    return fold_forecast(state, h, row, TR.sum_sql(trees))


def recursive_forecast_by_sku(model: DataFrame, demand: DataFrame, p: C.Params = C.DEFAULT, depth: int = 4, bins: int = 64,
                              horizon: int | None = None, known_future: bool = False, festivals: DataFrame | None = None) -> DataFrame:
    """B18 with one boosted model per SKU; series of SKUs without one are left out."""
    h = horizon or p.horizon
    feats = _features_sql()
    state = forecast_state(demand, h, known_future, festivals).join(model, "sku_id")
    return fold_forecast(state, h, BO.bins_sql([feats[n] for n in C.DEMAND_FEATURES], bins), BO.boosted_score("x", "base", "trees", depth))


def generate_forecast(model: PipelineModel | None, demand: DataFrame, p: C.Params = C.DEFAULT,
                      horizon: int | None = None, known_future: bool = False) -> DataFrame:
    """B19 + J7: the model's recursive forecast where the series was covered
    by training (>= 50 feature rows), the heuristic elsewhere; both with the
    B17 band and newsvendor order."""
    h = horizon or p.horizon
    heur = heuristic_forecast(demand, p, horizon=h)
    if model is None:
        return heur.withColumn("source", F.lit("heuristic"))
    st = series_state(demand, p).select(*SERIES, "sigma", "n_rows")
    covered = st.filter(F.col("n_rows") - 14 >= p.min_feature_rows).select(*SERIES)
    ml = recursive_forecast(model, demand.join(covered, SERIES, "left_semi"), p, h, known_future=known_future)
    ml = forecast_band(ml.join(st, SERIES), p).withColumn("source", F.lit("model"))
    rest = heur.join(covered, SERIES, "left_anti").withColumn("source", F.lit("heuristic"))
    return ml.unionByName(rest)


# ------------------------------------------------------------------ D24
def score_active_lots(model: PipelineModel, active_full: DataFrame) -> DataFrame:
    """Classifier risk (0-100) for lots in stock; age is the share of the
    effective shelf life used at ``as_of``, as in training."""
    days = F.col("shelf_life_days") - F.col("days_remaining")
    a = active_full.withColumn("age_pct", F.round(F.least(F.lit(1.0), days / F.col("effective_shelf_life")), 2))
    s = score_spoilage(model, a)
    return s.select("lot_id", "sku_id", "warehouse_id", "risk_level", "risk_score",
                    F.round(F.col("spoil_proba") * 100, 1).alias("model_risk_score"),
                    F.col("prediction").cast("int").alias("predicted_spoil"))

