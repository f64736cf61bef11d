"""Evaluation of scored claims. Predictions have the columns target, model, clm_id, label (0/1) and p."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.columns import MODELS
from claimlens.functions.expressions import ratio
from claimlens.functions.ordering import running_sums

BY = ["target", "model"]

# The sixteen cut-offs, with the float noise of the grid; and the one used when no cut-off helps.
CUTOFFS = [float(t) for t in np.arange(0.1, 0.9, 0.05)]
DEFAULT_CUTOFF = 0.5


def score_counts(predictions: DataFrame) -> DataFrame:
    """Positives and rows per model, horizon and distinct score.

    All measures below follow from these counts. They take predictions or counts, so whoever needs
    several measures counts once. Rows without score or label are left out.
    """
    if "rows" in predictions.columns:
        return predictions
    known = predictions.filter(F.col("p").isNotNull() & F.col("label").isNotNull())
    return known.groupBy(*BY, "p").agg(F.sum(F.col("label").cast("long")).alias("positives"), F.count("*").alias("rows"))


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def threshold_sweep(predictions: DataFrame, cutoffs: Sequence[float] = tuple(CUTOFFS)) -> DataFrame:
    """Precision, recall and F1 of every model at every cut-off.

    One pass counts, per model, how many cut-offs each score exceeds; the rates at all cut-offs
    follow from these few counts, so the predictions are not multiplied by the cut-offs.
    """
    exceeded = sum(((F.col("p") > F.lit(t)).cast("int") for t in cutoffs), F.lit(0))
    counts = (
        score_counts(predictions)
        .groupBy(*BY, exceeded.alias("exceeded"))
        .agg(F.sum("positives").alias("positives"), F.sum("rows").alias("rows"))
    )
    grid = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("cutoff")) for i, t in enumerate(cutoffs)])
    above = F.col("exceeded") > F.col("step")
    confusion = (
        counts.select("*", F.inline(grid))
        .groupBy(*BY, "step", "cutoff")
        .agg(
            F.sum(F.when(above, F.col("positives")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("rows") - F.col("positives")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("positives"))).alias("fn"),
        )
    )
    return confusion.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Per model the first cut-off with the highest F1; 0.5 with zero rates when every F1 is 0."""
    order = Window.partitionBy(*BY).orderBy(F.desc("f1"), "step")
    useful = F.col("f1") > 0
    return (
        sweep.withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .select(
            *BY,
            F.when(useful, F.col("cutoff")).otherwise(F.lit(DEFAULT_CUTOFF)).alias("cutoff"),
            *[F.when(useful, F.col(m)).otherwise(F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")],
        )
    )


def at_cutoff(predictions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Counts per score with the 0/1 decision of each model's cut-off. ``cutoffs`` has one row per model and horizon."""
    return score_counts(predictions).join(F.broadcast(cutoffs.select(*BY, "cutoff")), BY).withColumn(
        "decision", (F.col("p") > F.col("cutoff")).cast("int")
    )


def classification_metrics(predictions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 at the chosen cut-off."""
    decided, negatives = F.col("decision") == 1, F.col("rows") - F.col("positives")
    confusion = (
        at_cutoff(predictions, cutoffs)
        .groupBy(*BY, "cutoff")
        .agg(
            F.sum("rows").alias("n"),
            F.sum(F.when(decided, F.col("positives")).otherwise(0)).alias("tp"),
            F.sum(F.when(decided, negatives).otherwise(0)).alias("fp"),
            F.sum(F.when(decided, 0).otherwise(F.col("positives"))).alias("fn"),
        )
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return confusion.select(*BY, "cutoff", "n", ratio(n - fp - fn, n).alias("accuracy"), *[
        rate.alias(name) for name, rate in _rates(tp, fp, fn).items()
    ])


def _score_steps(predictions: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with their counts at or above the score and in all."""
    steps = score_counts(predictions).select(*BY, "p", "positives", (F.col("rows") - F.col("positives")).alias("negatives"))
    return running_sums(steps, BY, "p", ["positives", "negatives"])


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve, tied scores counted half; null when only one class occurs."""
    won = (F.col("positives_upto") - F.col("positives")).cast("double") + F.col("positives") / 2.0
    return (
        _score_steps(predictions)
        .groupBy(*BY)
        .agg(
            F.sum(F.col("negatives") * won).alias("_won"),
            (F.sum("positives").cast("double") * F.sum("negatives")).alias("_pairs"),
        )
        .select(*BY, F.when(F.col("_pairs") > 0, F.col("_won") / F.col("_pairs")).alias("auc"))
    )


def roc_curve(predictions: DataFrame) -> DataFrame:
    """ROC points: (0, 0), then one point per distinct score taken as the cut-off."""
    steps = _score_steps(predictions)
    points = steps.select(
        *BY,
        ratio(F.col("negatives_upto"), F.col("negatives_all")).alias("fpr"),
        ratio(F.col("positives_upto"), F.col("positives_all")).alias("tpr"),
        F.col("p").alias("cutoff"),
        (F.col("positives_upto") + F.col("negatives_upto") == F.col("positives") + F.col("negatives")).alias("_first"),
    )
    # the highest score of a model also stands for the origin
    origin = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("cutoff"))
    point = F.struct("fpr", "tpr", "cutoff")
    return points.select(*BY, F.inline(F.when(F.col("_first"), F.array(origin, point)).otherwise(F.array(point))))


def model_metrics(predictions: DataFrame) -> DataFrame:
    """Cut-off, classification metrics and AUC of every model and horizon."""
    predictions = score_counts(predictions)
    cutoffs = best_threshold(threshold_sweep(predictions))
    return classification_metrics(predictions, cutoffs).join(roc_auc(predictions), BY)


def auc_by_model(metrics: DataFrame) -> DataFrame:
    return metrics.select(*BY, "auc")


def best_model(metrics: DataFrame, order: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """The model with the highest AUC per horizon; ties go to the earlier name in ``order``."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = Window.partitionBy("target").orderBy(
        F.desc_nulls_last("auc"), F.when(place > 0, place).otherwise(len(order) + 1), "model"
    )
    return metrics.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def best_predictions(predictions: DataFrame, best: DataFrame) -> DataFrame:
    """Predictions of the best model of each horizon. ``best`` has one row per horizon."""
    return predictions.join(F.broadcast(best.select(*BY)), BY)


def readmission_rates(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Actual and predicted readmissions and their rates in %, by the best model of each horizon."""
    best = best_model(metrics)
    return (
        at_cutoff(predictions, best)
        .groupBy(*BY)
        .agg(
            F.sum("rows").alias("n"),
            F.sum("positives").alias("actual"),
            F.sum(F.col("decision") * F.col("rows")).alias("predicted"),
        )
        .withColumn("actual_rate", F.col("actual") * 100.0 / F.col("n"))
        .withColumn("predicted_rate", F.col("predicted") * 100.0 / F.col("n"))
    )


def performance_summary(metrics: DataFrame) -> DataFrame:
    """Metrics as text with three decimals. Without cross-validation columns the AUC and 0 stand in for them."""
    mean = F.col("cv_mean") if "cv_mean" in metrics.columns else F.col("auc")
    deviation = F.col("cv_std") if "cv_std" in metrics.columns else F.lit(0.0)
    three = {c: F.format_string("%.3f", F.col(c)).alias(c) for c in ("accuracy", "auc", "f1", "recall", "precision")}
    return metrics.select(
        *BY, *three.values(), F.format_string("%.3f ± %.3f", mean, deviation).alias("cv_auc")
    )
