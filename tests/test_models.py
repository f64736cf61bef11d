"""Training, storing, loading and scoring models."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from claimlens.operators import evaluation, models, modeltables
from claimlens.operators.trained import BoostedTrees
from claimlens.plans.pipeline import evaluate_saved, score_file, train_horizon
from claimlens.sources.readers import read_features
from claimlens.sources.registry import Registry

FEW = models.Settings(trees=5, forest_depth=4, boosting_depth=3, regression_iterations=50, perceptron_iterations=15, folds=3, hidden=(16, 8))
TARGET = "readmit_30"


@pytest.fixture(scope="module")
def frame(spark):
    """Two informative features, one with gaps, one noise feature; a quarter positive."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.25)
        gap = None if rng.random() < 0.1 else float(rng.normal() + 2 * y)
        data.append((f"p{i % 50}", i, y, float(rng.normal() + 2 * y), gap, float(rng.normal())))
    return spark.createDataFrame(data, "desynpuf_id string, clm_id long, label int, a double, b double, noise double").repartition(4)


@pytest.fixture(scope="module")
def prepared(frame):
    return models.prepare(frame, TARGET, settings=FEW)


def test_prepared_parts(frame, prepared):
    assert prepared.train.count() + prepared.test.count() == frame.count()
    assert sum(prepared.counts.values()) == prepared.train.count()
    total = prepared.train.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(prepared.train.count())
    assert {r.fold for r in prepared.train.select("fold").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("name", [*models.ENSEMBLE, "Multilayer Perceptron"])
def test_each_model_learns(prepared, name):
    scored = models.score(models.fit_model(name, prepared, FEW), prepared.test, TARGET, name)
    assert scored.filter(~F.col("p").between(0, 1)).isEmpty()
    assert evaluation.roc_auc(scored).first().auc > 0.8


@pytest.mark.parametrize("name", [*models.ENSEMBLE, "Multilayer Perceptron"])
def test_scores_follow_from_the_table_and_the_equations_hold(prepared, name):
    model = models.fit_model(name, prepared, FEW)
    rows = prepared.test.unionByName(prepared.train.select(prepared.test.columns[0], *prepared.test.columns[1:3], F.lit(False).alias("is_test"), "features"))
    by_table = models.score_by_table(name, model, rows, prepared.names)
    both = models.score(model, rows, TARGET, name).join(by_table, list(models.KEYS))
    assert both.count() == 600 and both.filter(F.abs(F.col("p") - F.col("p_table")) < 1e-9).count() == 600
    assert models.residual(name, model, prepared, FEW) < 1e-6
    assert models.beats_constant(name, model, prepared)


def test_a_constant_model_fails_the_proof(prepared):
    trees = models.fit_model("Gradient Boosting", prepared, FEW)
    held = trees.numbers
    for t in held["trees"]:
        t["value"] = [0.0] * len(t["value"])
    constant = BoostedTrees(state=json.dumps(held))
    assert not models.beats_constant("Gradient Boosting", constant, prepared)
    assert models.residual("Gradient Boosting", constant, prepared, FEW) > 1e-3


def test_importances_follow_from_the_nodes(spark, prepared):
    for name, by_tree in (("Random Forest", True), ("Weighted Gradient Boosting", False)):
        model = models.fit_model(name, prepared, FEW)
        nodes = modeltables.tree_nodes(model, spark)
        assert np.allclose(modeltables.importances(nodes, 3, by_tree), model.featureImportances.toArray())


def test_boosting_is_as_good_as_the_library_of_spark(prepared):
    few = models.Settings(trees=30, boosting_depth=3)
    ours = models.fit_model("Gradient Boosting", prepared, few)
    other = GBTClassifier(maxIter=30, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=10, seed=1).fit(prepared.train)
    aucs = [evaluation.roc_auc(models.score(m, prepared.train, TARGET, "m")).first().auc for m in (ours, other)]
    assert aucs[0] > aucs[1] - 0.01


def test_preparation_on_the_training_part_only(frame):
    all_rows = models.prepare(frame, TARGET, settings=FEW)
    train_rows = models.prepare(frame, TARGET, settings=FEW, fit_on="train", materialize=False)
    assert all_rows.stages[0].getStatement() != train_rows.stages[0].getStatement()


def test_cross_validation(prepared):
    folds = models.cross_validate("Logistic Regression", prepared, FEW)
    aucs = [r.auc for r in folds.collect()]
    assert len(aucs) == 3 and min(aucs) > 0.8
    row = models.cross_validated(folds).first()
    assert row.cv_mean == pytest.approx(np.mean(aucs)) and row.cv_std == pytest.approx(np.std(aucs))


def test_all_models_and_folds_are_validated_together(prepared):
    folds = models.cross_validate([*models.ENSEMBLE, "Multilayer Perceptron"], prepared, FEW).collect()
    assert len(folds) == 15 and {r.fold for r in folds} == {0, 1, 2}
    for name in models.ENSEMBLE:
        assert sum(r.n for r in folds if r.model == name) == sum(prepared.counts.values())
    assert min(r.auc for r in folds) > 0.75


def test_importances_rank_the_informative_features(spark, prepared):
    fitted = {"Random Forest": models.fit_model("Random Forest", prepared, FEW)}
    top = models.high_risk_factors(fitted, prepared.names, spark, 2).collect()
    assert {r.feature for r in top} == {"a", "b"} and top[0].model == "Random Forest"
    unnamed = models.feature_importance(fitted["Random Forest"], [], spark)
    assert {r.feature for r in unnamed.collect()} == {"Feature 1", "Feature 2", "Feature 3"}
    assert models.high_risk_factors({}, [], spark) is None


def test_best_model_insight(spark, prepared):
    names = ["Logistic Regression", "Random Forest"]
    fitted = {n: models.fit_model(n, prepared, FEW) for n in names}
    metrics = spark.createDataFrame([(TARGET, names[0], 0.6), (TARGET, names[1], 0.9)], "target string, model string, auc double")
    rows = models.best_model_insight(metrics, fitted, prepared.names, 2).collect()
    assert len(rows) == 2 and {r.model for r in rows} == {names[1]} and {r.feature for r in rows} == {"a", "b"}
    only = models.best_model_insight(metrics.filter("auc < 0.9"), fitted, prepared.names).collect()
    assert [(r.model, r.feature) for r in only] == [(names[0], None)]


def test_save_load_and_score(spark, prepared, frame, tmp_path):
    registry = Registry(spark, str(tmp_path))
    model = models.fit_model("Logistic Regression", prepared, FEW)
    pipeline = PipelineModel([*prepared.stages, model])
    registry.save(pipeline, TARGET, "Logistic Regression", prepared.names, 0.9, datetime(2020, 1, 1))
    registry.save(pipeline, TARGET, "Logistic Regression", prepared.names, 0.8, datetime(2021, 1, 1))
    assert registry.entries().count() == 2
    assert registry.latest().first().auc == 0.8
    saved = registry.load(TARGET, "Logistic Regression")
    loaded, names = saved.pipeline, saved.features
    assert names == prepared.names
    before = models.batch_score(pipeline, frame, names, keep=["clm_id"]).orderBy("clm_id").collect()
    after = models.batch_score(loaded, frame, names, keep=["clm_id"]).orderBy("clm_id").collect()
    assert before == after and len(before) == 600
    assert {r.tier for r in after} <= {"High", "Medium", "Low"}
    with pytest.raises(LookupError):
        registry.load(TARGET, "Random Forest")


def test_scoring_checks_columns_and_uses_training_medians(spark, prepared, frame):
    pipeline = PipelineModel([*prepared.stages, models.fit_model("Logistic Regression", prepared, FEW)])
    with pytest.raises(ValueError, match="missing features: noise"):
        models.batch_score(pipeline, frame.drop("noise"), prepared.names)
    assert models.check_features(frame.drop("noise"), prepared.names) == (["noise"], ["clm_id", "desynpuf_id", "label"])
    median = frame.selectExpr("median(b)").first()[0]
    rows = spark.createDataFrame([(1.0, None, 0.0), (1.0, median, 0.0)], "a double, b double, noise double")
    first, second = models.batch_score(pipeline, rows, prepared.names).collect()
    assert first.p == pytest.approx(second.p)


def test_horizon_is_trained_stored_and_reused(spark, frame, tmp_path):
    registry = Registry(spark, str(tmp_path))
    names = ["Logistic Regression", "Random Forest"]
    first = train_horizon(frame, TARGET, registry, names, FEW)
    assert {r.model for r in first.metrics.collect()} == set(names)
    assert {"auc", "cv_mean", "cv_std", "accuracy"} <= set(first.metrics.columns)
    assert registry.has_results(TARGET) and not registry.has_results("readmit_60")
    again = train_horizon(frame, TARGET, registry, names, FEW)
    assert again.fitted == {} and registry.entries().count() == 2
    forced = train_horizon(frame, TARGET, registry, names[:1], FEW, force=True, cross_validation=False)
    assert set(forced.fitted) == set(names[:1]) and registry.entries().count() == 3
    reloaded = evaluate_saved(registry, frame, TARGET, FEW)
    stored = {r.model: r.auc for r in forced.metrics.collect()}
    assert {r.model: r.auc for r in reloaded.metrics.collect()}[names[0]] == pytest.approx(stored[names[0]])
    assert evaluate_saved(registry, frame, "readmit_90", FEW) is None


@pytest.mark.parametrize("name", ["Weighted Gradient Boosting", "Multilayer Perceptron"])
def test_own_models_are_saved_and_loaded(spark, prepared, frame, tmp_path, name):
    registry = Registry(spark, str(tmp_path))
    pipeline = PipelineModel([*prepared.stages, models.fit_model(name, prepared, FEW)])
    registry.save(pipeline, TARGET, name, prepared.names, 0.9)
    before, after = (
        sorted(models.batch_score(p, frame, prepared.names, keep=["clm_id"]).collect()) for p in (pipeline, registry.load(TARGET, name).pipeline)
    )
    assert before == after and len(before) == 600


def test_a_save_that_is_stopped_half_way_is_never_seen(spark, prepared, tmp_path):
    registry = Registry(spark, str(tmp_path))
    pipeline = PipelineModel([*prepared.stages, models.fit_model("Logistic Regression", prepared, FEW)])
    old = registry.version(TARGET, datetime(2020, 1, 1))
    old.add_model(pipeline, "Logistic Regression", prepared.names, 0.9)
    metrics = spark.createDataFrame([(TARGET, "Logistic Regression", 0.9)], "target string, model string, auc double")
    old.add_results("metrics", metrics)
    old.add_results("predictions", metrics)
    old.publish(prepared.cuts)
    # the next version dies after its model and predictions, before its manifest
    new = registry.version(TARGET, datetime(2021, 1, 1))
    new.add_model(pipeline, "Logistic Regression", prepared.names, 0.1)
    new.add_results("predictions", metrics.limit(0))
    with pytest.raises(ZeroDivisionError):
        new.add_results("metrics", metrics.withColumn("auc", F.lit(1 / 0)))
    assert [r.version for r in registry.entries().collect()] == [old.name]
    assert registry.load_results(TARGET)[1].count() == 1 and registry.has_results(TARGET)
    # a manifest that was being written is no manifest
    (tmp_path / "manifests" / f"_{TARGET}-{new.name}.json").write_text('{"target": "readm')
    assert registry.latest().first().auc == 0.9


def test_saved_models_meet_rows_they_have_not_seen_in_a_grown_frame(spark, frame, tmp_path):
    registry = Registry(spark, str(tmp_path))
    train_horizon(frame, TARGET, registry, ["Logistic Regression"], FEW, cross_validation=False)
    seen = models.prepare(frame, TARGET, settings=FEW).train.select("clm_id")
    more = frame.withColumn("clm_id", F.col("clm_id") + 1000)
    again = evaluate_saved(registry, frame.unionByName(more), TARGET, FEW)
    assert again.predictions.join(seen, "clm_id").isEmpty()
    assert again.predictions.filter("clm_id < 1000").count() == 600 - seen.count()
    assert again.predictions.filter("clm_id >= 1000").count() > 0


def test_one_class_is_skipped(spark, frame, tmp_path):
    registry = Registry(spark, str(tmp_path))
    assert train_horizon(frame.withColumn("label", F.lit(0)), TARGET, registry, settings=FEW) is None


def test_saved_models_are_evaluated_when_results_are_gone(spark, frame, prepared, tmp_path):
    registry = Registry(spark, str(tmp_path))
    pipeline = PipelineModel([*prepared.stages, models.fit_model("Logistic Regression", prepared, FEW)])
    registry.save(pipeline, TARGET, "Logistic Regression", prepared.names, 0.9, datetime(2020, 1, 1))
    again = train_horizon(frame, TARGET, registry, settings=FEW)
    assert [r.model for r in again.metrics.collect()] == ["Logistic Regression"]
    assert registry.entries().count() == 1


@pytest.mark.parametrize(("file_format", "name"), [("csv", "Logistic Regression"), ("parquet", "Multilayer Perceptron")])
def test_scoring_from_file_to_file(spark, frame, prepared, tmp_path, file_format, name):
    registry = Registry(spark, str(tmp_path / "registry"))
    pipeline = PipelineModel([*prepared.stages, models.fit_model(name, prepared, FEW)])
    registry.save(pipeline, TARGET, name, prepared.names, 0.9, datetime(2020, 1, 1))
    source = str(tmp_path / "rows.csv")
    frame.withColumn("extra", F.lit(1)).write.option("header", True).csv(source)
    out, unused = score_file(spark, registry, TARGET, name, source, str(tmp_path / "out"), ["clm_id"], file_format)
    assert unused == ["desynpuf_id", "extra", "label"]
    plan = models.batch_score(pipeline, read_features(spark, source, prepared.types), prepared.names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    assert out.count() == 600 and {"clm_id", "p", "tier"} == set(out.columns)
    broken = frame.withColumn("a", F.when(F.col("clm_id") == 7, F.lit("much")).otherwise(F.col("a").cast("string")))
    broken.write.option("header", True).csv(str(tmp_path / "broken.csv"))
    with pytest.raises(Exception, match="column a holds no double: much"):
        score_file(spark, registry, TARGET, name, str(tmp_path / "broken.csv"), str(tmp_path / "y"))
    frame.drop("noise").write.option("header", True).csv(str(tmp_path / "short.csv"))
    with pytest.raises(ValueError, match="missing features: noise"):
        score_file(spark, registry, TARGET, name, str(tmp_path / "short.csv"), str(tmp_path / "x"))


def test_tasks_of_a_fit_follow_cores_and_then_rows():
    """Every task of a forest sends its sums of all open nodes, so tasks are not cut at few rows each."""
    assert [models.fit_tasks(n, 8) for n in (0, 100, 80_000, 1_600_000, 4_800_000)] == [1, 1, 4, 8, 24]


def test_model_tables_are_followed_once_for_each_row(prepared):
    """No row is repeated for each tree, and no layer is an interpreted expression."""
    for name, dear in (("Random Forest", "Generate"), ("Gradient Boosting", "Generate"), ("Multilayer Perceptron", "lambdafunction")):
        scored = models.score_by_table(name, models.fit_model(name, prepared, FEW), prepared.train, prepared.names)
        assert dear not in scored._jdf.queryExecution().optimizedPlan().toString(), name


def test_copies_of_a_key_are_scored_together(prepared):
    forest = models.fit_model("Random Forest", prepared, FEW)
    rows = prepared.train.limit(20)
    once, twice = (models.score_by_table("Random Forest", forest, r, prepared.names) for r in (rows, rows.unionAll(rows)))
    assert twice.count() == 20
    assert once.withColumnRenamed("p_table", "p").join(twice, list(models.KEYS)).filter(F.abs(F.col("p") - F.col("p_table")) < 1e-12).count() == 20


def test_a_forest_remembers_nodes_and_gives_the_same_trees(prepared):
    estimator = models.estimator("Random Forest", prepared, FEW)
    assert estimator.getCacheNodeIds()
    plain = estimator.copy({estimator.cacheNodeIds: False})
    assert estimator.fit(prepared.train).toDebugString.split("\n")[1:] == plain.fit(prepared.train).toDebugString.split("\n")[1:]
