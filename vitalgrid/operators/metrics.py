"""Exact evaluation metrics as distributed aggregates.

AUROC and average precision need the rows in score order. The rows are first
reduced to one row per distinct score (positives, negatives; map-side
partials, so a hot score is one row), then running totals come from
``ranking.running_totals`` — no single-partition window. Results match the
usual definitions exactly: AUROC counts ties as one half; average precision is
the step sum ``sum (R_n - R_(n-1)) * P_n`` over distinct thresholds (not the
trapezoid of ``areaUnderPR``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.operators.ranking import running_totals
from vitalgrid.session import materialize

#: Packed scores: of some rows of a model the distinct scores (doubles) of a range, with positives and negatives of each
#: (unsigned, 4 bytes) and in all. Ranges are numbered from low scores to high ones and share no score.
PACKED = "model string, range int, score binary, pos_of binary, neg_of binary, pos long, neg long"


def _by(by) -> list[str]:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def score_counts(df: DataFrame, score: str, label: str, by=None) -> DataFrame:
    """One row per (group, distinct score): positives and negatives. A NULL
    score raises: dropped rows would leave two models measured on different rows."""
    y = F.col(label).cast("long")
    kind = df.schema[score].dataType
    known = F.coalesce(F.col(score), F.raise_error(F.lit(f"NULL in score column {score}")).cast(kind))
    return (df.withColumn(score, known)
              .groupBy(*_by(by), score)
              .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))


def auroc(df: DataFrame, score: str, label: str, by=None, out: str = "auroc") -> DataFrame:
    """Area under the ROC curve = P(score+ > score-) + P(equal) / 2."""
    b = _by(by)
    g = running_totals(score_counts(df, score, label, b), score, ["neg"], by=b)
    contrib = F.col("pos").cast("double") * ((F.col("cum_neg") - F.col("neg")).cast("double")
                                             + F.col("neg").cast("double") / 2)
    return g.groupBy(*b).agg(
        (F.sum(contrib) / F.nullif(F.sum("pos").cast("double") * F.sum("neg").cast("double"), F.lit(0.0)))
        .alias(out))


def average_precision(df: DataFrame, score: str, label: str, by=None, out: str = "average_precision") -> DataFrame:
    """Average precision: thresholds from high to low; at each distinct score
    ``precision = TP / (TP + FP)`` weighted by the recall it adds."""
    b = _by(by)
    g = running_totals(score_counts(df, score, label, b), score, ["pos", "neg"], descending=True, by=b)
    prec = F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg")).cast("double")
    return g.groupBy(*b).agg(
        (F.sum(F.col("pos").cast("double") * prec) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0)))
        .alias(out))


def ranking_metrics(df: DataFrame, score: str, label: str, by=None, auroc: str = "auroc",
                    ap: str = "prauc") -> DataFrame:
    """AUROC and average precision from one pass over the distinct scores, high
    to low: a negative counts the positives above it, and half of those level with it."""
    b = _by(by)
    g = running_totals(score_counts(df, score, label, b), score, ["pos", "neg"], descending=True, by=b)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos", "cum_neg"))
    return g.groupBy(*b).agg(
        (F.sum(neg * (tp - pos + pos / 2)) / F.nullif(F.sum(pos) * F.sum(neg), F.lit(0.0))).alias(auroc),
        (F.sum(pos * tp / (tp + fp)) / F.nullif(F.sum(pos), F.lit(0.0))).alias(ap))


def brier(df: DataFrame, prob: str, label: str, by=None, out: str = "brier") -> DataFrame:
    """Mean squared difference between probability and 0/1 label."""
    d = F.col(prob).cast("double") - F.col(label).cast("double")
    return df.groupBy(*_by(by)).agg(F.avg(d * d).alias(out))


def uncertainty_summary(df: DataFrame, uncertainty: str = "uncertainty") -> DataFrame:
    """One row: mean, min and max of the uncertainty."""
    return df.agg(F.avg(uncertainty).alias("mean_uncertainty"), F.min(uncertainty).alias("min_uncertainty"),
                  F.max(uncertainty).alias("max_uncertainty"))


def accuracy(df: DataFrame, pred: str, label: str, by=None, out: str = "accuracy") -> DataFrame:
    return df.groupBy(*_by(by)).agg(
        F.avg((F.col(pred).cast("long") == F.col(label).cast("long")).cast("double")).alias(out))


def class_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Per class: precision, recall, F1 and support (zero division gives 0),
    then rows 'accuracy', 'macro avg' and 'weighted avg'. Works on the
    confusion table (one row per (label, prediction) pair)."""
    conf = df.groupBy(F.col(label).cast("long").alias("y"), F.col(pred).cast("long").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    per = (conf.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("sup"), F.lit(0).cast("long").alias("npred")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"),
                 F.col("n").alias("npred")))).alias("s")).select("s.*")
        .groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("npred").alias("npred")))

    def ratio(a, b):
        return F.coalesce(F.col(a).cast("double") / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))

    per = (per.withColumn("precision", ratio("tp", "npred")).withColumn("recall", ratio("tp", "support"))
              .withColumn("f1_score", F.coalesce(2 * F.col("precision") * F.col("recall")
                                                 / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)),
                                                 F.lit(0.0))))
    rows = per.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1_score",
                      F.col("support").cast("long").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"))
    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        F.col("n").cast("long").alias("support"))
    none = F.lit(None)
    summary = tot.select(F.inline(F.array(
        row("accuracy", none, none, F.col("tp") / F.col("n")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))))
    return rows.unionByName(summary)


def model_table(long: DataFrame, model: str, score: str, label: str) -> DataFrame:
    """One row per model of a long prediction table: AUROC and average
    precision. Scores may be packed (``PACKED``)."""
    if long.schema[score].dataType == T.BinaryType():
        return _packed_table(long, model)
    return ranking_metrics(long, score, label, by=model)


def _packed_table(packed: DataFrame, model: str) -> DataFrame:
    """``ranking_metrics`` per model of packed scores: totals per range give the
    running totals before it, then every (model, range) is put in order in a
    task of its own, high scores first."""
    packed = materialize(packed, "packed-scores")
    by = [model, "range"]
    totals = packed.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # one row per model and range
    w = Window.partitionBy(model).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select(*by, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"above_{c}") for c in ("pos", "neg")])

    def ordered(key: tuple, rows: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        s, place = np.unique(np.concatenate([np.frombuffer(v) for v in rows["score"]]), return_inverse=True)
        pos, neg = (np.bincount(place, weights=np.concatenate([np.frombuffer(v, np.uint32) for v in rows[c]]),
                                minlength=len(s))[::-1] for c in ("pos_of", "neg_of"))
        tp = pos.cumsum() + float(offset["above_pos"].iloc[0])
        fp = neg.cumsum() + float(offset["above_neg"].iloc[0])
        return pd.DataFrame({model: [key[0]], "pos": [pos.sum()], "neg": [neg.sum()],
                             "won": [(neg * (tp - pos + pos / 2)).sum()], "area": [(pos * tp / (tp + fp)).sum()]})

    parts = packed.drop("pos", "neg").groupBy(*by).cogroup(above.groupBy(*by)).applyInPandas(
        ordered, f"{model} string, pos double, neg double, won double, area double")
    return parts.groupBy(model).agg(
        (F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auroc"),
        (F.sum("area") / F.nullif(F.sum("pos"), F.lit(0.0))).alias("prauc"))


def seed_summary(results: DataFrame, setup: str | Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population std of each metric per setup (over seeds)."""
    by = _by(setup)
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), *aggs)
