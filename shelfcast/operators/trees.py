"""Fitted tree ensembles as SQL expressions (M6, B18, D24 without a model
object): nested CASE over the features, the same text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame

from ..session import scratch_path


def number(v: float) -> str:
    """A double literal in either dialect."""
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tree_nodes(model, spark) -> dict[int, dict[int, tuple]]:
    """Nodes of a fitted ensemble by tree and id: (feature, threshold, left,
    right) or (value,), from its saved form. Their number is bounded by trees
    and depth, so they come to the driver. A classifier's value is the share of
    class 1 among the node's weights."""
    path = scratch_path(spark, "tree-nodes")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    out: dict[int, dict[int, tuple]] = {}
    classes = hasattr(model, "numClasses")
    for r in rows:
        n = r["nodeData"] if "nodeData" in r.__fields__ else r
        if n["leftChild"] >= 0:
            v = (n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0], n["leftChild"], n["rightChild"])
        elif classes:
            stats = n["impurityStats"]
            v = (stats[1] / sum(stats) if sum(stats) else 0.0,)
        else:
            v = (n["prediction"],)
        out.setdefault(r["treeID"], {})[n["id"]] = v
    return out


def tree_sql(nodes: dict[int, tuple], features: list[str], at: int = 0) -> str:
    """One tree as nested CASE; a value equal to the threshold goes left."""
    n = nodes[at]
    if len(n) == 1:
        return number(n[0])
    f, threshold, left, right = n
    return f"CASE WHEN {features[f]} <= {number(threshold)} THEN {tree_sql(nodes, features, left)} ELSE {tree_sql(nodes, features, right)} END"


def ensemble_sql(model, spark, features: list[str]) -> list[str]:
    """SQL of each tree, times its weight: their sum is the regressor's
    prediction; a forest classifier's is the mean share of class 1."""
    weights = [1.0 / len(model.trees)] * len(model.trees) if hasattr(model, "numClasses") else list(model.treeWeights)
    nodes = tree_nodes(model, spark)
    return [f"{number(w)} * {tree_sql(nodes[i], features)}" for i, w in enumerate(weights)]


def label_sql(stage: StringIndexerModel) -> str:
    """Alphabetical index of a text column; levels not seen in training get
    the number after the last."""
    labels = " ".join(f"WHEN {_quoted(v)} THEN {number(i)}" for i, v in enumerate(stage.labels))
    return f"CASE {stage.getInputCol()} {labels} ELSE {number(len(stage.labels))} END" if labels else number(0)


def compile_pipeline(model: PipelineModel, spark, rename: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """(encoded columns as SQL by name, trees as SQL over the features) of a
    pipeline of label stages, assembler and tree ensemble; ``rename`` maps a
    feature to the SQL that holds it."""
    labels = {s.getOutputCol().removeprefix("_"): label_sql(s) for s in model.stages if isinstance(s, StringIndexerModel)}
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    return labels, ensemble_sql(model.stages[-1], spark, [(rename or {}).get(n, n) for n in names])


def sum_sql(trees: list[str]) -> str:
    return " + ".join(f"({t})" for t in trees)


def score_compiled(df: DataFrame, labels: dict[str, str], trees: list[str], out: str) -> DataFrame:
    """``df`` with the ensemble's value as a column of plain SQL."""
    own = [f"{sql} AS {name}" for name, sql in labels.items()]
    return df.drop(*labels).selectExpr("*", *own).selectExpr("*", f"{sum_sql(trees)} AS {out}").drop(*labels)
