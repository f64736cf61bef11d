"""The batch pipeline: load, label, build features, train per horizon, derive insights, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.columns import HORIZONS, horizon_label
from claimlens.operators import claims as claims_ops
from claimlens.operators import evaluation, features, insights, labels, models, prep, progression
from claimlens.session import stored
from claimlens.sources.readers import SourceConfig, load_beneficiaries, load_claims, read_features
from claimlens.sources.registry import Registry
from claimlens.sources.writers import write_predictions, write_summary


@dataclass(frozen=True)
class Trained:
    """Results of one horizon. ``fitted`` is empty when they were loaded."""

    target: str
    metrics: DataFrame
    predictions: DataFrame
    fitted: dict[str, Model]
    names: list[str]


def train_horizon(
    frame: DataFrame,
    target: str,
    registry: Registry,
    names: Sequence[str] = tuple(models.ENSEMBLE),
    settings: models.Settings = models.Settings(),
    force: bool = False,
    fit_on: str = "all",
    cross_validation: bool = True,
    kept: bool = False,
    preparation: prep.Preparation | None = None,
) -> Trained | None:
    """Train, evaluate and store the models of one horizon; None when only one class occurs.

    Unless ``force`` asks for new training, stored results are used again; if they are gone, the saved
    models are loaded and evaluated on the test part. ``kept`` and ``preparation`` as in ``models.prepare``.
    """
    if not force and registry.has_results(target):
        metrics, predictions = registry.load_results(target)
        return Trained(target, metrics, predictions, {}, [])
    if not force and (saved := evaluate_saved(registry, frame, target, settings)) is not None:
        return saved
    prepared = models.prepare(frame, target, fit_on=fit_on, settings=settings, kept=kept, fitted=preparation)
    if not prepared.trainable:
        return None
    fitted = models.fit_models(names, prepared, settings)
    scored = [models.score(model, prepared.test, target, name) for name, model in fitted.items()]
    # all of it becomes visible at once, by the manifest of the version
    version = registry.version(target)
    predictions = version.add_results("predictions", union(scored))
    metrics = evaluation.model_metrics(predictions)
    if cross_validation:
        metrics = metrics.join(models.cross_validated(models.cross_validate(names, prepared, settings)), ["target", "model"], "left")
    else:
        metrics = metrics.withColumns({"cv_mean": F.col("auc"), "cv_std": F.lit(0.0)})
    metrics = version.add_results("metrics", metrics)
    aucs = {r.model: r.auc for r in metrics.select("model", "auc").collect()}
    for name, model in fitted.items():
        version.add_model(PipelineModel([*prepared.stages, model]), name, prepared.names, aucs.get(name), prepared.types)
    version.publish(prepared.cuts)
    stored_metrics, stored_predictions = registry.load_results(target)
    return Trained(target, stored_metrics, stored_predictions, fitted, prepared.names)


def evaluate_saved(registry: Registry, frame: DataFrame, target: str, settings: models.Settings = models.Settings()) -> Trained | None:
    """Load the newest models of a horizon and evaluate them again on rows they have not seen.

    The split is the one each model was trained with, by its stored hash values, also where the frame has grown.
    """
    loaded = registry.load_all(target)
    if not loaded:
        return None
    scored = []
    for name, saved in loaded.items():
        test = prep.stratified_split(frame, seed=settings.seed, cuts=saved.cuts or None).filter("is_test")
        scored.append(models.score(saved.pipeline, test, target, name))
    metrics = evaluation.model_metrics(union(scored)).withColumns({"cv_mean": F.col("auc"), "cv_std": F.lit(0.0)})
    fitted = {name: saved.pipeline.stages[-1] for name, saved in loaded.items()}
    return Trained(target, metrics, union(scored), fitted, next(iter(loaded.values())).features)


def score_file(
    spark: SparkSession, registry: Registry, target: str, model: str, path: str, output: str, keep: Sequence[str] = (), file_format: str = "csv"
) -> tuple[DataFrame, list[str]]:
    """Score a file of feature rows with a saved model and write the result; returns it with the unused columns.

    The file is read once, with the feature types that are stored with the model. Missing features fail before
    anything is scored, a text in a column of numbers fails with its column and value.
    """
    saved = registry.load(target, model)
    rows = read_features(spark, path, saved.types)
    _, unused = models.check_features(rows, saved.features)
    scored = models.batch_score(saved.pipeline, rows, saved.features, keep)
    write_predictions(scored, output, file_format)
    reader = spark.read.schema(scored.schema)
    written = reader.option("header", True).csv(output) if file_format == "csv" else reader.parquet(output)
    return written, [c for c in unused if c not in keep]


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _ranked(registry: Registry, trained: Trained) -> tuple[dict[str, Model], list[str]]:
    """The fitted models of a horizon and its feature names; loaded where results were used again."""
    if trained.fitted:
        return trained.fitted, trained.names
    loaded = registry.load_all(trained.target)
    names = next(iter(loaded.values())).features if loaded else []
    return {name: saved.pipeline.stages[-1] for name, saved in loaded.items()}, names


def run_pipeline(
    spark: SparkSession,
    sources: SourceConfig,
    root: str,
    settings: models.Settings = models.Settings(),
    horizons: Sequence[int] = tuple(HORIZONS),
    perceptron: bool = True,
    force: bool = False,
    cross_validation: bool = True,
    factors_of: int | None = None,
) -> dict[str, DataFrame] | None:
    """Everything from the source files to the report tables; None without inpatient claims.

    ``importances`` has the best model's features of every trained horizon, ``factors`` the risk factors of the
    horizon ``factors_of``, or of the first trained one.
    """
    beneficiaries = load_beneficiaries(spark, sources)
    inpatient, _ = load_claims(spark, sources)
    if inpatient is None or beneficiaries is None:
        return None
    dated = claims_ops.parse_admission_dates(inpatient)
    labelled = labels.readmission_labels(dated)
    matrix = features.feature_matrix(beneficiaries, dated)
    registry = Registry(spark, root)
    targets = [horizon_label(days) for days in horizons]
    # labels and features are derived once, for all horizons
    frames = stored(prep.training_frames(labelled, matrix, targets))
    features_used = [c for c in frames.columns if c not in (*models.KEYS, *targets)]
    # without a selection by label, one preparation serves all horizons
    shared = prep.fit_preparation(frames, features_used) if len(features_used) <= prep.MAX_FEATURES else None
    trained = []
    for target in targets:
        names = [*models.ENSEMBLE, *(["Multilayer Perceptron"] if perceptron and target == targets[0] else [])]
        frame = prep.of_target(frames, targets, target)
        result = train_horizon(
            frame, target, registry, names, settings, force, cross_validation=cross_validation, kept=True, preparation=shared
        )
        if result is not None:
            trained.append(result)
    out = {
        "readmission_totals": labels.readmission_totals(labelled),
        "prevalence": progression.condition_prevalence(beneficiaries),
        "comorbidity": progression.top_pairs(progression.comorbidity_pairs(beneficiaries)),
    }
    if not trained:
        return {**out, "summary": insights.executive_summary(beneficiaries, dated)}
    metrics = union([t.metrics for t in trained])
    predictions = union([t.predictions for t in trained])
    scores = stored(evaluation.score_counts(predictions))
    costs = insights.treatment_costs(insights.risk_tier_counts(scores, metrics))
    ranked = {t.target: _ranked(registry, t) for t in trained}
    wanted = horizon_label(factors_of) if factors_of is not None else trained[0].target
    if wanted not in ranked:
        raise ValueError(f"{wanted} was not trained")
    factors = models.high_risk_factors(*ranked[wanted], spark)
    importances = union([models.best_model_insight(metrics.filter(F.col("target") == t), *found) for t, found in ranked.items()])
    best = evaluation.best_predictions(predictions, evaluation.best_model(metrics))
    summary = insights.executive_summary(beneficiaries, dated, metrics, factors, costs)
    performance = evaluation.performance_summary(metrics)
    write_summary(performance, f"{root}/reports/performance")
    write_predictions(insights.risk_tiers(best), f"{root}/reports/predictions")
    return {
        **out,
        "metrics": metrics,
        "predictions": predictions,
        "performance": performance,
        "roc": evaluation.roc_curve(scores),
        "tiers": insights.risk_tiers(best),
        "treatment_plan": insights.treatment_plan(insights.risk_tiers(best)),
        "costs": costs,
        "factors": factors,
        "importances": importances,
        "summary": summary,
    }
