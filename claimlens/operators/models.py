"""Training, cross-validation, scoring and importances.

Logistic regression and forests are MLlib's; boosted trees and the perceptron are fitted by this library, since they
need second-order splits and a weighted loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.columns import MODELS
from claimlens.functions.expressions import risk_tier
from claimlens.operators import boosting, modeltables, perceptron
from claimlens.operators.evaluation import best_model, roc_auc, score_counts
from claimlens.operators.prep import (
    SEED,
    Preparation,
    class_weights,
    feature_names,
    fit_preparation,
    split_cuts,
    stratified_folds,
    stratified_split,
)
from claimlens.operators.trained import BoostedTrees, Perceptron
from claimlens.session import ensure_checkpoint_dir, stored

KEYS = ("desynpuf_id", "clm_id")
ROWS_PER_TASK = 20_000
#: Beyond one task for each core, a task takes so many rows: a forest's tasks all send the sums of all open nodes.
MOST_ROWS_PER_TASK = 200_000
ENSEMBLE = MODELS[:4]


@dataclass(frozen=True)
class Settings:
    """Model settings. The defaults, which a run that compares results has to use."""

    trees: int = 200
    forest_depth: int = 10
    boosting_depth: int = 6
    step: float = 0.05
    inverse_penalty: float = 0.1
    regression_iterations: int = 2000
    hidden: tuple[int, ...] = (256, 128, 64, 32)
    perceptron_iterations: int = 100
    folds: int = 5
    seed: int = SEED


@dataclass(frozen=True)
class Prepared:
    """Train and test part with a features vector, the fitted stages that made it, and the class counts."""

    target: str
    names: list[str]
    stages: list
    train: DataFrame
    tasks: int
    test: DataFrame
    counts: dict[int, int]
    weights: dict[int, float]
    cuts: dict[int, float]
    types: dict[str, str]

    @property
    def trainable(self) -> bool:
        return len(self.counts) > 1


def prepare(
    frame: DataFrame,
    target: str,
    keys: Sequence[str] = KEYS,
    fit_on: str = "all",
    settings: Settings = Settings(),
    materialize: bool = True,
    kept: bool = False,
    fitted: Preparation | None = None,
) -> Prepared:
    """Impute, select, scale and split a training frame.

    ``fit_on='all'`` fits the preparation on every row, ``'train'`` on the training part only.
    ``materialize`` writes the frame and both parts to the shared scratch folder, since every fit
    reads them many times, the training part with a folder for each fold; ``kept`` says that the frame is a stored table already. ``fitted`` is a
    preparation to use as it is, say of another horizon over the same rows.
    """
    keep = stored if materialize else (lambda df: df)
    ensure_checkpoint_dir(frame.sparkSession)
    frame = frame if kept else keep(frame)
    cuts = split_cuts(frame, keys=keys, seed=settings.seed)
    split = stratified_split(frame, keys=keys, seed=settings.seed, cuts=cuts)
    basis = split.filter(~F.col("is_test")) if fit_on == "train" else frame
    fitted = fitted or fit_preparation(basis, feature_names(frame, keys))
    scaled = [f"z{i}" for i in range(len(fitted.features))]
    stages = [
        SQLTransformer(statement=fitted.statement(scaled)),
        VectorAssembler(inputCols=scaled, outputCol="features"),
    ]
    rows = keep(PipelineModel(stages).transform(split).filter(F.col("label").isNotNull()).select(*keys, "label", "is_test", "features"))
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    classes = {r.label: r for r in class_weights(train).collect()}
    counts = {label: r.n for label, r in classes.items()}
    weights = {label: r.weight for label, r in classes.items()}
    weight = F.lit(1.0)
    for label, w in weights.items():
        weight = F.when(F.col("label") == label, w).otherwise(weight)
    train = stratified_folds(train, keys=keys, folds=settings.folds, seed=settings.seed + 1).withColumns(
        {
            "weight": weight,
            "positive_weight": F.when(F.col("label") == 1, weights.get(1, 1.0)).otherwise(1.0),
            "rare_weight": F.when(F.col("label") == 1, counts.get(0, 0) / max(counts.get(1, 1), 1)).otherwise(1.0),
            "row": F.xxhash64(*keys),
        }
    )
    train = stored(train, by="fold") if materialize else train
    tasks = fit_tasks(sum(counts.values()), frame.sparkSession.sparkContext.defaultParallelism)
    types = {c: t for c, t in frame.dtypes if c in set(fitted.features)}
    return Prepared(target, fitted.features, stages, train, tasks, test, counts, weights, cuts, types)


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of an MLlib fit. It runs many short jobs, so a task should hold a good number of rows, and each task sends
    up to 256 MB of sums for every group of tree nodes, so there should be few more tasks than cores."""
    return max(1, min(-(-rows // ROWS_PER_TASK), cores), -(-rows // MOST_ROWS_PER_TASK))


def estimator(name: str, prepared: Prepared, settings: Settings = Settings()):
    """The MLlib estimator of a model name. Penalties, leaf sizes and sampling rates, which a run that
    compares results has to use."""
    common = {"labelCol": "label", "featuresCol": "features"}
    if name == "Logistic Regression":
        # Balanced weights add up to the number of rows, which turns C into this penalty.
        penalty = 1.0 / (settings.inverse_penalty * sum(prepared.counts.values()))
        return LogisticRegression(
            maxIter=settings.regression_iterations,
            tol=1e-9,
            regParam=penalty,
            elasticNetParam=0.0,
            standardization=False,
            weightCol="weight",
            **common,
        )
    if name == "Random Forest":
        return RandomForestClassifier(
            numTrees=settings.trees,
            maxDepth=settings.forest_depth,
            minInstancesPerNode=5,
            featureSubsetStrategy="sqrt",
            cacheNodeIds=True,  # the same trees, whose rows are not led down from the root for every level
            checkpointInterval=-1,
            weightCol="weight",
            seed=settings.seed,
            **common,
        )
    raise ValueError(f"unknown model: {name}")


def booster(name: str, settings: Settings = Settings()) -> boosting.Boosting:
    """How the trees of a boosted model are grown. Fixed values, as in :func:`estimator`."""
    common = {"trees": settings.trees, "depth": settings.boosting_depth, "step": settings.step, "subsample": 0.8, "seed": settings.seed}
    if name == "Gradient Boosting":
        return boosting.Boosting(**common, min_rows=10, min_split=20)
    return boosting.Boosting(**common, columns=0.8, penalty=1.0, min_hessian=5.0, prior=False)


#: Weights of the rows in the loss of each model that this library fits.
WEIGHTS = {"Gradient Boosting": None, "Weighted Gradient Boosting": "positive_weight", "Multilayer Perceptron": "rare_weight"}


def _weighted(name: str, rows: DataFrame) -> DataFrame:
    weight = F.col(WEIGHTS[name]) if WEIGHTS[name] else F.lit(1.0)
    return rows.select("row", "label", "fold", "features", weight.alias("weight"))


def positive_probability(scored: DataFrame):
    return vector_to_array(F.col("probability"))[1]


def score(model: Model, rows: DataFrame, target: str, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Predictions as (target, model, keys…, label, p)."""
    scored = model.transform(rows)
    return scored.select(
        F.lit(target).alias("target"), F.lit(name).alias("model"), *keys, "label", positive_probability(scored).alias("p")
    )


def fit_model(name: str, prepared: Prepared, settings: Settings = Settings()) -> Model:
    return fit_runs(name, prepared, settings, [None])[0]


def fit_runs(name: str, prepared: Prepared, settings: Settings, runs: Sequence[int | None]) -> list[Model]:
    """Fit a model once for each run, the number of a fold to leave out or None.

    Boosted models share the jobs of all runs; the others are fitted one after the other.
    """
    rows = prepared.train
    if name in ("Gradient Boosting", "Weighted Gradient Boosting"):
        fitted = boosting.fit(_weighted(name, rows), booster(name, settings), runs)
        return [BoostedTrees.of(f, len(prepared.names)) for f in fitted]
    out = []
    for left_out in runs:
        part = rows if left_out is None else rows.filter(F.col("fold") != left_out)
        if name == "Multilayer Perceptron":
            network = perceptron.fit(_weighted(name, part), settings.hidden, settings.perceptron_iterations, settings.seed)
            out.append(Perceptron.of(network))
        else:
            out.append(estimator(name, prepared, settings).fit(part.coalesce(prepared.tasks)))
    return out


#: Driver threads that wait for fits; Spark runs the jobs of all of them.
FITS_AT_ONCE = 6


def fit_models(names: Sequence[str], prepared: Prepared, settings: Settings = Settings()) -> dict[str, Model]:
    """Fit several models over one prepared table at the same time."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return dict(zip(names, pool.map(lambda name: fit_model(name, prepared, settings), names), strict=True))


def cross_validate(
    names: str | Sequence[str], prepared: Prepared, settings: Settings = Settings(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """AUC of each held-out fold: one row (target, model, fold, auc, n) per model and fold.

    All models and folds are fitted over one stored training table at the same time, from driver threads. A fold
    is a folder of that table, so scoring reads every row once for each model, and one aggregation rates them all.
    """
    names = [names] if isinstance(names, str) else list(names)
    folds = list(range(settings.folds))
    shared = [(n, folds) for n in names if n in WEIGHTS and n != "Multilayer Perceptron"]
    single = [(n, [fold]) for fold in folds for n in names if n not in [s[0] for s in shared]]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        fits = [(name, runs, pool.submit(fit_runs, name, prepared, settings, runs)) for name, runs in [*shared, *single]]
        fitted = {(name, fold): model for name, runs, future in fits for fold, model in zip(runs, future.result(), strict=True)}
    parts = None
    for (name, fold), model in fitted.items():
        held_out = prepared.train.filter(F.col("fold") == fold)
        part = score(model, held_out, prepared.target, f"{fold}:{name}", keys)
        parts = part if parts is None else parts.unionByName(part)
    counts = score_counts(parts)
    rows = counts.groupBy("target", "model").agg(F.sum("rows").alias("n"))
    place = F.split("model", ":", 2)
    return roc_auc(counts).join(F.broadcast(rows), ["target", "model"]).select(
        "target", place[1].alias("model"), place[0].cast("int").alias("fold"), "auc", "n"
    )


def score_by_table(name: str, model: Model, rows: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys…, p_table): scores from the model's table alone, by plain expressions. ``rows`` have a features vector."""
    spark = rows.sparkSession
    if name == "Logistic Regression":
        return modeltables.score_linear(rows, modeltables.coefficients(model, names, spark)).select(*keys, "p_table")
    if name == "Multilayer Perceptron":
        layers = len(model.network.sizes) - 1
        rows = rows.repartition(spark.sparkContext.defaultParallelism)  # long expressions for each row
        return modeltables.score_layers(rows, modeltables.layer_weights(model, spark), layers).select(*keys, "p_table")
    nodes = modeltables.tree_nodes(model, spark)
    if isinstance(model, BoostedTrees):
        held = model.numbers
        return modeltables.score_trees(rows, nodes, keys, len(held["trees"]), held["depth"], held["base"])
    return modeltables.score_trees(rows, nodes, keys, model.getNumTrees, model.getMaxDepth())


def residual(name: str, model: Model, prepared: Prepared, settings: Settings = Settings()) -> float:
    """The largest error in the equations that a fit has to satisfy on its training rows; 0 up to rounding.

    - Logistic regression: the score equations, the gradient of the penalised mean loss. They have one solution.
    - Boosted trees: the first tree's leaf values against gradient and Hessian of the rows that end in each leaf,
      found by following the table, and the row counts of every split.
    - Forest: rows and positives of every node against those of its children, which are weighted.
    - Perceptron: the weighted loss of its scores against the one its gradient sums report.
    """
    train, spark = prepared.train, prepared.train.sparkSession
    if name == "Logistic Regression":
        scored = modeltables.score_linear(train, modeltables.coefficients(model, prepared.names, spark))
        error = F.col("weight") * (F.col("p_table") - F.col("label"))
        x, width = vector_to_array("features"), len(prepared.names)
        sums = scored.agg(F.sum("weight").alias("w"), F.sum(error).alias("e"), *[F.sum(error * x[i]).alias(f"e{i}") for i in range(width)]).first()
        penalty = estimator(name, prepared, settings).getRegParam()
        slopes = [sums[f"e{i}"] / sums.w + penalty * float(b) for i, b in enumerate(model.coefficients.toArray())]
        return max(abs(v) for v in [sums.e / sums.w, *slopes])
    if name == "Multilayer Perceptron":
        rows = _weighted(name, train)
        scored = model.transform(rows)
        told = perceptron.loss(rows, model.network)
        return abs(told - _log_loss(scored.select("label", "weight", positive_probability(scored).alias("p")), "p")[0])
    nodes = modeltables.tree_nodes(model, spark)
    children = nodes.filter("left >= 0").select("tree", "rows", "value", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"))
    below = nodes.select("tree", "node", F.col("rows").alias("_rows"), F.col("value").alias("_value"))
    sums = children.join(below, ["tree", "node"]).groupBy("tree", "parent", "rows", "value").agg(F.sum("_rows").alias("_rows"), F.sum(F.col("_rows") * F.col("_value")).alias("_held"))
    positives = F.abs(F.col("_held") / F.col("_rows") - F.col("value")) if name == "Random Forest" else F.lit(0.0)
    uneven = sums.agg(F.max(F.greatest(F.abs(F.col("_rows") - F.col("rows")) / F.col("rows"), positives))).first()[0] or 0.0
    if name == "Random Forest":
        return uneven
    how, held = booster(name, settings), model.numbers
    rows = _weighted(name, train).filter(boosting.sampled_in_first_tree(how, "row"))
    p = 1.0 / (1.0 + F.exp(F.lit(-held["base"])))
    ended = modeltables.leaves(rows, nodes, ["row"], 1, held["depth"], ["label", "weight"]).groupBy("node", "value")
    sums = ended.agg(F.sum(F.col("weight") * (p - F.col("label"))).alias("g"), F.sum(F.col("weight") * p * (1 - p)).alias("h"))
    return max(uneven, sums.agg(F.max(F.abs(F.col("value") + how.step * F.col("g") / (F.col("h") + how.penalty)))).first()[0])


def _log_loss(scored: DataFrame, p: str) -> tuple[float, float]:
    """Weighted mean log loss of a column of probabilities, and the least that a constant could have."""
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.col("weight") * F.when(F.col("label") == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    row = scored.agg(F.sum(loss).alias("loss"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("y")).first()
    share = row.y / row.w
    return row.loss / row.w, -(share * math.log(share) + (1 - share) * math.log(1 - share))


def beats_constant(name: str, model: Model, prepared: Prepared) -> bool:
    """Whether the training loss, with the weights of the fit, is below that of every constant."""
    weight = WEIGHTS.get(name, "weight")
    rows = model.transform(prepared.train.withColumn("weight", F.col(weight) if weight else F.lit(1.0)))
    loss, constant = _log_loss(rows.select("label", "weight", positive_probability(rows).alias("p")), "p")
    return loss < constant - 1e-4


def cross_validated(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold AUCs."""
    return folds.groupBy("target", "model").agg(F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"))


def feature_importance(model: Model, names: Sequence[str], spark: SparkSession, top_n: int | None = None) -> DataFrame:
    """(rank, feature, importance), most important first. Features without a name get a number."""
    importances = model.featureImportances.toArray()
    if len(names) != len(importances):
        names = [f"Feature {i + 1}" for i in range(len(importances))]
    ordered = sorted(zip(names, importances.tolist(), strict=True), key=lambda pair: (-pair[1], pair[0]))[:top_n]
    rows = [(rank, name, value) for rank, (name, value) in enumerate(ordered, 1)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def high_risk_factors(models: dict[str, Model], names: Sequence[str], spark: SparkSession, top_n: int = 10) -> DataFrame | None:
    """Importances of the first tree model at hand: forest, then boosting, then weighted boosting."""
    for name in ENSEMBLE[1:]:
        if name in models:
            return feature_importance(models[name], names, spark, top_n).withColumn("model", F.lit(name))
    return None


def best_model_insight(
    metrics: DataFrame, fitted: dict[str, Model], names: Sequence[str], top_n: int = 10
) -> DataFrame:
    """The best model of a horizon with its AUC and, if it ranks features, its top features."""
    best = best_model(metrics).select("target", "model", "auc")
    parts = [
        feature_importance(model, names, metrics.sparkSession, top_n).withColumn("model", F.lit(name))
        for name, model in fitted.items()
        if name in ENSEMBLE[1:]
    ]
    if not parts:
        return best
    ranked = parts[0]
    for part in parts[1:]:
        ranked = ranked.unionByName(part)
    return best.join(F.broadcast(ranked), "model", "left")


def check_features(df: DataFrame, required: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, unused) column names of a frame to score."""
    have = set(df.columns)
    return sorted(set(required) - have), sorted(have - set(required))


def batch_score(pipeline: PipelineModel, rows: DataFrame, required: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Probability and risk tier of new rows. Gaps are filled with the medians of the training data."""
    missing, _ = check_features(rows, required)
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    chosen = rows.select(*dict.fromkeys([*keep, *required]))
    scored = pipeline.transform(chosen)
    return scored.select(*keep, positive_probability(scored).alias("p")).withColumn("tier", risk_tier(F.col("p")))
