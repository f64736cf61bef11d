"""Cut-offs, rates, ROC, tiers and costs against brute force."""

import numpy as np
import pytest

from claimlens.operators import evaluation, insights

SCHEMA = "target string, model string, clm_id long, label int, p double"


def scored(spark, seed=0, n=500, model="Random Forest", target="readmit_30", decimals=2):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    p = np.clip(np.round(rng.random(n) * 0.7 + 0.3 * label * rng.random(n), decimals) + 0.003, 0, 1)
    rows = [(target, model, i, int(y), float(v)) for i, (y, v) in enumerate(zip(label, p))]
    return spark.createDataFrame(rows, SCHEMA), label, p


def pair_auc(label, p):
    yes, no = p[label == 1], p[label == 0]
    diff = yes[:, None] - no[None, :]
    return ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / diff.size


@pytest.mark.parametrize("decimals", [1, 2, 9])
def test_auc(spark, decimals):
    df, label, p = scored(spark, decimals=decimals)
    assert evaluation.roc_auc(df).first().auc == pytest.approx(pair_auc(label, p))
    mirrored = df.selectExpr("target", "model", "clm_id", "label", "1 - p AS p")
    assert evaluation.roc_auc(mirrored).first().auc == pytest.approx(1 - pair_auc(label, p))


def test_auc_of_one_class_is_unknown(spark):
    df = spark.createDataFrame([("t", "m", 1, 0, 0.3), ("t", "m", 2, 0, 0.5)], SCHEMA)
    assert evaluation.roc_auc(df).first().auc is None


def test_roc_curve(spark):
    df, label, p = scored(spark)
    points = {r.cutoff: (r.fpr, r.tpr) for r in evaluation.roc_curve(df).collect()}
    assert points[None] == (0.0, 0.0)
    assert len(points) == len(set(p)) + 1
    for cut in set(p):
        want = ((p >= cut) & (label == 0)).sum() / (label == 0).sum(), ((p >= cut) & (label == 1)).sum() / (label == 1).sum()
        assert points[cut] == pytest.approx(want)


def brute_sweep(label, p):
    out = []
    for t in evaluation.CUTOFFS:
        yes = p > t
        tp, fp, fn = (yes & (label == 1)).sum(), (yes & (label == 0)).sum(), (~yes & (label == 1)).sum()
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        out.append((t, precision, recall, f1))
    return out


def test_sweep_and_metrics(spark):
    df, label, p = scored(spark, seed=3)
    sweep = evaluation.threshold_sweep(df)
    found = sorted((r.cutoff, r.precision, r.recall, r.f1) for r in sweep.collect())
    want = brute_sweep(label, p)
    assert len(found) == 16 and np.allclose(found, want)
    best = max(want, key=lambda r: r[3])
    row = evaluation.model_metrics(df).first()
    assert (row.cutoff, row.precision, row.recall, row.f1) == pytest.approx(best)
    assert row.accuracy == pytest.approx(((p > best[0]) == label).mean())


def test_the_cutoffs_carry_the_noise_of_the_grid():
    assert len(evaluation.CUTOFFS) == 16
    assert evaluation.CUTOFFS[1] == 0.15000000000000002


def test_no_useful_cutoff_gives_one_half(spark):
    df = spark.createDataFrame([("t", "m", 1, 0, 0.9), ("t", "m", 2, 1, 0.05)], SCHEMA)
    row = evaluation.best_threshold(evaluation.threshold_sweep(df)).first()
    assert (row.cutoff, row.f1, row.recall, row.precision) == (0.5, 0.0, 0.0, 0.0)


def test_the_first_best_cutoff_wins(spark):
    df = spark.createDataFrame([("t", "m", 1, 1, 0.99), ("t", "m", 2, 0, 0.01)], SCHEMA)
    assert evaluation.best_threshold(evaluation.threshold_sweep(df)).first().cutoff == 0.1


def test_best_model_ties_follow_the_model_order(spark):
    metrics = spark.createDataFrame(
        [("t", "Gradient Boosting", 0.8), ("t", "Logistic Regression", 0.8), ("t", "Random Forest", 0.7), ("u", "other", 0.1)],
        "target string, model string, auc double",
    )
    assert {r.target: r.model for r in evaluation.best_model(metrics).collect()} == {"t": "Logistic Regression", "u": "other"}


def test_tiers_at_their_limits(spark):
    df = spark.createDataFrame([(0.3,), (0.30001,), (0.7,), (0.70001,), (0.0,), (None,)], "p double")
    assert [r.tier for r in insights.risk_tiers(df).collect()] == ["Low", "Medium", "Medium", "High", "Low", None]


def test_tier_counts_costs_and_rates(spark):
    first, label, p = scored(spark, seed=1)
    second, *_ = scored(spark, seed=1, model="Logistic Regression")
    worse = second.selectExpr("target", "model", "clm_id", "label", "1 - p AS p")
    predictions = first.unionByName(worse)
    metrics = evaluation.model_metrics(predictions)
    row = insights.treatment_costs(insights.risk_tier_counts(predictions, metrics)).first()
    high, medium, low = (p > 0.7).sum(), ((p > 0.3) & (p <= 0.7)).sum(), (p <= 0.3).sum()
    assert (row.model, row.high_risk, row.medium_risk, row.low_risk) == ("Random Forest", high, medium, low)
    without = high * 0.8 * 20000 + medium * 0.4 * 20000 + low * 0.1 * 20000
    treated = high * (2000 + 0.3 * 20000) + medium * (1000 + 0.2 * 20000) + low * 0.05 * 20000
    assert row.potential_savings == pytest.approx(without - treated)
    rates = evaluation.readmission_rates(predictions, metrics).first()
    assert (rates.n, rates.actual) == (500, label.sum())


def test_treatment_plan_and_summary(spark):
    df = spark.createDataFrame([(1, "High"), (2, "Low"), (3, None)], "clm_id int, tier string")
    plans = {r.clm_id: r.interventions for r in insights.treatment_plan(df).collect()}
    assert len(plans[1]) == 4 and len(plans[2]) == 4 and plans[3] is None
    people = spark.createDataFrame([("a",), ("a",), ("b",)], "desynpuf_id string")
    rows = {(r.section, r.item): r.value for r in insights.executive_summary(people, people).collect()}
    assert rows == {("data", "unique_patients"): "2", ("data", "inpatient_admissions"): "3"}


def test_performance_summary_text(spark):
    metrics = spark.createDataFrame(
        [("t", "m", 0.5, 0.9, 0.75, 0.6, 0.4, 0.71, 0.02)],
        "target string, model string, accuracy double, auc double, f1 double, recall double, precision double, cv_mean double, cv_std double",
    )
    row = evaluation.performance_summary(metrics).first()
    assert (row.accuracy, row.auc, row.cv_auc) == ("0.500", "0.900", "0.710 ± 0.020")
