"""Tree ensembles as node tables, and node tables as Spark ML models.

A node table has one row per node: ``tree, node`` (preorder, root 0),
``feature, threshold`` (left: value <= threshold; -1 for a leaf), ``left,
right`` (-1 for a leaf), ``value`` (probability of class 1 or a number),
``rows`` and ``gain``. Tables are read from and written to Spark ML's own model
format as DataFrames, so no node passes through Python, and whatever an
ensemble computes (also the mean of the squared tree values) is computed by
Spark ML's tree walk in the JVM.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.session import checkpoint_dir

NODES = ("tree int, node int, feature int, threshold double, left int, right int, value double, rows double, "
         "gain double")
_COLUMNS = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "leafCol": ""}
_BOTH = {**_COLUMNS, "rawPredictionCol": "rawPrediction", "probabilityCol": "probability"}
# ensemble class, class of its trees, impurity, default columns
_KINDS = {
    "forest": (RandomForestClassificationModel, "classification.RandomForestClassificationModel",
               "classification.DecisionTreeClassificationModel", "gini", _BOTH),
    "mean": (RandomForestRegressionModel, "regression.RandomForestRegressionModel",
             "regression.DecisionTreeRegressionModel", "variance", _COLUMNS),
    "boosting": (GBTClassificationModel, "classification.GBTClassificationModel",
                 "regression.DecisionTreeRegressionModel", "variance", _BOTH),
}


def _model_path(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/models/trees-{uuid.uuid4().hex}"


def node_table(model, spark) -> DataFrame:
    """Nodes of a fitted Spark ML tree ensemble; ``value`` is the probability of class 1 for a
    two-class forest (0 where the model saw only class 0), else the node's prediction."""
    path = _model_path(spark)
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda acc, x: acc + x)
    classes = isinstance(model, RandomForestClassificationModel)
    value = (F.coalesce(F.when(F.size(stats) > 1, F.get(stats, F.lit(1)) / F.nullif(total, F.lit(0.0))), F.lit(0.0))
             if classes else n["prediction"])
    leaf = n["leftChild"] < 0
    inner = F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
        F.when(leaf, F.lit(-1.0)).otherwise(inner).alias("threshold"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), value.alias("value"),
        (total if classes else F.get(stats, F.lit(0))).alias("rows"), n["gain"].alias("gain"))


def ensemble(nodes: DataFrame, kind: str, n_features: int, n_trees: int):
    """A Spark ML model from a node table: ``forest`` (mean of the trees' class-1
    probabilities), ``mean`` (mean of the trees' values) or ``boosting`` (sum of the
    values as half the log odds). Every tree has weight 1."""
    spark = nodes.sparkSession
    cls, name, tree_name, impurity, columns = _KINDS[kind]
    leaf, rows = F.col("left") < 0, F.col("rows")
    stats = (F.array(rows * (1 - F.col("value")), rows * F.col("value")) if kind == "forest"
             else F.array(rows, F.lit(0.0), F.lit(0.0)))
    prediction = F.when(F.col("value") > 0.5, 1.0).otherwise(0.0) if kind == "forest" else F.col("value")
    none = F.array().cast("array<double>")
    data = nodes.select(F.col("tree").alias("treeID"), F.struct(
        F.col("node").alias("id"), prediction.alias("prediction"), F.lit(0.0).alias("impurity"),
        stats.alias("impurityStats"), F.ceil(rows).cast("long").alias("rawCount"),
        F.when(leaf, -1.0).otherwise(F.col("gain")).alias("gain"), F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"), F.struct(
            F.when(leaf, -1).otherwise(F.col("feature")).alias("featureIndex"),
            F.when(leaf, none).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData"))
    meta = {"timestamp": 0, "sparkVersion": spark.version, "uid": f"trees_{uuid.uuid4().hex[:12]}", "paramMap": {},
            "defaultParamMap": {"impurity": impurity, **columns}}
    # a forest's mean divides by the parameter, not by the trees there are
    whole = {**meta, "paramMap": {} if kind == "boosting" else {"numTrees": n_trees}, "class": f"org.apache.spark.ml.{name}", "numFeatures": n_features, "numTrees": n_trees}
    if kind == "forest":
        whole["numClasses"] = 2
    own = {"impurity": impurity, **(_BOTH if "classification" in tree_name else _COLUMNS)}
    tree = json.dumps({**meta, "class": f"org.apache.spark.ml.{tree_name}", "defaultParamMap": own,
                       "numFeatures": n_features, "numClasses": 2})
    path = _model_path(spark)
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.range(0, n_trees, 1, 1).select(F.col("id").cast("int").alias("_1"), F.lit(tree).alias("_2"),
                                F.lit(1.0).alias("_3")).write.parquet(f"{path}/treesMetadata")
    data.write.parquet(f"{path}/data")
    return cls.load(path)


def squared(model, spark) -> RandomForestRegressionModel:
    """The forest's trees with squared leaf values, so that its prediction is the mean of the squared tree
    probabilities; made once per model object."""
    if getattr(model, "_squared", None) is None:
        nodes = node_table(model, spark)
        model._squared = ensemble(nodes.withColumn("value", F.col("value") * F.col("value")), "mean", model.numFeatures,
                                  len(model.treeWeights))
    return model._squared
