"""Registered queries: each operator over the claims tables derived from the given tables."""

from __future__ import annotations

import functools

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.columns import (
    BENEFICIARY_SHARES,
    CONDITIONS,
    COVERAGE_MONTHS,
    HORIZONS,
    PRIMARY_PAYER,
    REIMBURSEMENTS,
    horizon_label,
)
from claimlens.functions.expressions import lenient_amount, lenient_date, strict_date
from claimlens.operators import claims as claims_ops
from claimlens.operators import dashboard, evaluation, features, insights, labels, models, modeltables, prep, profile, progression
from claimlens.plans import pipeline
from claimlens.plans.tables import Tables
from claimlens.session import scratch_folder, stored
from claimlens.sources import readers, writers
from claimlens.sources.registry import Registry, latest_versions

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

LABELS = [horizon_label(n) for n in HORIZONS]
BOX_COLUMNS = [*COVERAGE_MONTHS, *REIMBURSEMENTS, *BENEFICIARY_SHARES, *PRIMARY_PAYER]
CATEGORIES = ["bene_sex_ident_cd", "bene_race_cd", "bene_esrd_ind", "sp_state_code"]
FEATURES = [
    "clm_pmt_amt",
    "clm_utlztn_day_cnt",
    "age",
    "num_admissions",
    "avg_los",
    "total_ip_cost",
    "sp_chf",
    "has_sp_chf",
    "diag_top_1",
]


def register(query: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of the claims tables under its name."""
    REGISTERED[query.__name__] = lambda spark, folder: query(Tables(spark, folder))
    return query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and decimals as doubles with fixed digits, so two engines can be compared."""
    changes = {n: F.round(F.col(f"`{n}`").cast("double"), digits) for n, t in df.dtypes if t == "double" or t.startswith("decimal")}
    return df.withColumns(changes) if changes else df


# Sources, cleaning, scalar operators


@register
def load_beneficiaries(t: Tables) -> DataFrame:
    people = t.beneficiaries(conditions=False)
    years = [people.filter(F.col("year") == y).drop("year").withColumn("year", F.lit(y)) for y in t.years]
    years[0] = years[0].drop("bene_esrd_ind")
    return readers.union_years(years).select(
        "desynpuf_id", "year", "bene_birth_dt", "bene_sex_ident_cd", "bene_race_cd", "sp_state_code", "bene_esrd_ind"
    )


@register
def load_claims(t: Tables) -> DataFrame:
    names = ["desynpuf_id", "clm_id", "clm_thru_dt", "clm_pmt_amt"]
    inpatient = t.raw_inpatient().select("clm_admsn_dt", *names)
    outpatient = t.raw_outpatient().select("clm_from_dt", *names)
    return inpatient.unionByName(outpatient, allowMissingColumns=True)


@register
def clean_claims(t: Tables) -> DataFrame:
    cleaned = claims_ops.clean_claims(t.raw_inpatient(), t.raw_outpatient())
    return rounded(
        cleaned.select("desynpuf_id", "clm_id", "claim_type", "admit_date", "discharge_date", "clm_pmt_amt", "clm_utlztn_day_cnt"), 2
    )


@register
def parse_dates_strict(t: Tables) -> DataFrame:
    return t.beneficiaries(conditions=False).select("desynpuf_id", "year", strict_date("bene_birth_dt").alias("birth_date"))


@register
def parse_dates_lenient(t: Tables) -> DataFrame:
    return t.raw_inpatient().select(
        "clm_id", lenient_date("clm_admsn_dt").alias("admit_date"), lenient_date("clm_thru_dt").alias("discharge_date")
    )


@register
def parse_amount_lenient(t: Tables) -> DataFrame:
    return rounded(t.raw_inpatient().select("clm_id", lenient_amount("clm_pmt_amt").alias("amount")), 2)


@register
def patient_age(t: Tables) -> DataFrame:
    return claims_ops.with_age(t.beneficiaries(conditions=False)).select("desynpuf_id", "year", "age")


@register
def condition_flags(t: Tables) -> DataFrame:
    return features.condition_flags(t.beneficiaries()).select("desynpuf_id", "year", *[f"has_{c}" for c in CONDITIONS])


# Joins, filters and the claims table

CLAIM_COLUMNS = ["clm_id", "desynpuf_id", "claim_type", "admit_date", "year", "age", "clm_pmt_amt"]


def _joined(t: Tables, by_year: bool = True, codes: bool = False) -> DataFrame:
    return claims_ops.claims_demographics(t.claims(codes=codes), t.beneficiaries(conditions=False), by_year)


@register
def claims_demographics(t: Tables) -> DataFrame:
    return rounded(_joined(t, by_year=False).select(*CLAIM_COLUMNS), 2)


@register
def claims_demographics_by_year(t: Tables) -> DataFrame:
    return rounded(_joined(t).select(*CLAIM_COLUMNS), 2)


@register
def claims_filtered(t: Tables) -> DataFrame:
    years = [1998, 1999]
    joined = claims_ops.claims_demographics(t.inpatient(), t.beneficiaries(conditions=False), years=years)
    out = claims_ops.filter_claims(joined, years=years, claim_types=["Inpatient"])
    return rounded(out.select(*CLAIM_COLUMNS), 2)


@register
def claims_age_range(t: Tables) -> DataFrame:
    return rounded(claims_ops.filter_claims(_joined(t), age_range=(40, 65)).select(*CLAIM_COLUMNS), 2)


@register
def claims_code_search(t: Tables) -> DataFrame:
    out = claims_ops.filter_claims(t.claims(codes=True), code_query="#2")
    return out.select("clm_id", "claim_type", "icd9_dgns_cd_1", "icd9_prcdr_cd_1")


@register
def claims_table(t: Tables) -> DataFrame:
    joined = claims_ops.claims_demographics(t.claims(stay=True), t.beneficiaries(conditions=False), years=t.years)
    chosen = claims_ops.filter_claims(joined, years=t.years)
    return rounded(claims_ops.claims_table(chosen), 2)


# Dashboard aggregates


@register
def kpi_summary(t: Tables) -> DataFrame:
    return rounded(dashboard.kpi_summary(t.claims(), t.beneficiaries(conditions=False)), 2)


@register
def monthly_reimbursement(t: Tables) -> DataFrame:
    return rounded(dashboard.monthly_reimbursement(claims_ops.filter_claims(_joined(t), years=t.years)), 2)


@register
def reimbursement_by_type(t: Tables) -> DataFrame:
    return rounded(dashboard.reimbursement_by_type(claims_ops.filter_claims(_joined(t), years=t.years)), 2)


@register
def count_by_sex(t: Tables) -> DataFrame:
    return dashboard.count_by_sex(t.beneficiaries(conditions=False))


@register
def condition_counts_top10(t: Tables) -> DataFrame:
    return dashboard.condition_counts(t.beneficiaries())


@register
def filter_options(t: Tables) -> DataFrame:
    options = dashboard.filter_options(claims_ops.with_age(t.beneficiaries(conditions=False)))
    return options.withColumn("years", F.array_join("years", ","))


# Labels


@register
def days_to_readmit(t: Tables) -> DataFrame:
    return labels.days_to_readmit(t.inpatient()).select("clm_id", "desynpuf_id", "admit_date", "days_to_readmit")


@register
def readmission_labels(t: Tables) -> DataFrame:
    return t.labelled().select("clm_id", "desynpuf_id", "admit_date", "days_to_readmit", *LABELS)


@register
def readmission_totals(t: Tables) -> DataFrame:
    return labels.readmission_totals(t.labelled())


# Features


@register
def latest_beneficiary(t: Tables) -> DataFrame:
    return features.latest_beneficiary(t.beneficiaries(conditions=False)).select("desynpuf_id", "year", "bene_birth_dt")


@register
def patient_utilization(t: Tables) -> DataFrame:
    return rounded(features.patient_utilization(t.inpatient(stay=True)))


@register
def patient_features(t: Tables) -> DataFrame:
    out = features.patient_features(t.beneficiaries(), t.inpatient(stay=True))
    return rounded(out.select("desynpuf_id", "year", "age", *[f"has_{c}" for c in CONDITIONS], *features.UTILIZATION))


@register
def codes_long(t: Tables) -> DataFrame:
    return features.codes_long(t.inpatient(codes=True))


@register
def top_codes(t: Tables) -> DataFrame:
    return features.top_codes(t.inpatient(codes=True))


def _by_rank(df: DataFrame, codes: list[str]) -> DataFrame:
    """Code columns named by the rank of their code, so that names do not depend on the data."""
    return df.withColumnsRenamed({f"diag_{c}": f"diag_top_{i}" for i, c in enumerate(codes, 1)})


@register
def diagnosis_features(t: Tables) -> DataFrame:
    inpatient = t.inpatient(codes=True, stay=True)
    codes = features.top_code_list(inpatient)
    matrix = features.diagnosis_features(features.patient_features(t.beneficiaries(), inpatient), inpatient, codes)
    wanted = ["desynpuf_id", "age", "num_admissions", *[f"diag_top_{i}" for i in range(1, len(codes) + 1)]]
    return _by_rank(matrix, codes).select(*wanted)


def _frame(t: Tables, target: str = "readmit_30") -> DataFrame:
    inpatient = t.inpatient(codes=True, stay=True)
    codes = features.top_code_list(inpatient)
    matrix = _by_rank(features.feature_matrix(t.beneficiaries(), inpatient, codes), codes)
    return prep.training_frame(labels.readmission_labels(inpatient), matrix, target)


@register
def training_frame(t: Tables) -> DataFrame:
    return rounded(_frame(t))


@register
def patient_lookup(t: Tables) -> DataFrame:
    people = features.patient_features(t.beneficiaries(), t.inpatient(stay=True))
    fixed = people.withColumns(
        {c: F.col(c).cast("decimal(18,2)") for c in ("avg_los", "total_ip_cost")}
    ).select("desynpuf_id", "year", "age", "bene_race_cd", "num_admissions", "avg_los", "total_ip_cost")
    return features.patient_lookup(fixed, "7")


@register
def patient_ids(t: Tables) -> DataFrame:
    return features.patient_ids(features.latest_beneficiary(t.beneficiaries(conditions=False)))


# Progression


@register
def condition_prevalence(t: Tables) -> DataFrame:
    return rounded(progression.condition_prevalence(t.beneficiaries()))


@register
def comorbidity_pairs(t: Tables) -> DataFrame:
    return progression.comorbidity_pairs(t.beneficiaries())


@register
def comorbidity_top10(t: Tables) -> DataFrame:
    return progression.top_pairs(progression.comorbidity_pairs(t.beneficiaries()))


# Column profiles


@register
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.beneficiaries(conditions=False), CATEGORIES)


@register
def value_shares(t: Tables) -> DataFrame:
    return rounded(profile.value_shares(t.person(), ["gender_source_value", "race_source_value"]))


@register
def crosstab_race_gender(t: Tables) -> DataFrame:
    return profile.crosstab(t.person(), "race_source_value", "gender_source_value", ["F", "M"])


@register
def histogram20(t: Tables) -> DataFrame:
    return rounded(profile.histogram(t.claims(), ["clm_pmt_amt"], 20))


@register
def histogram_auto(t: Tables) -> DataFrame:
    return rounded(profile.histogram(claims_ops.with_age(t.beneficiaries(conditions=False)), ["age"], "auto"))


@register
def numeric_summary(t: Tables) -> DataFrame:
    people = claims_ops.with_age(t.beneficiaries(conditions=False, money=True))
    return rounded(profile.numeric_summary(people, ["age", "medreimb_ip", "benres_ip"]))


@register
def kde_age(t: Tables) -> DataFrame:
    return rounded(profile.density(claims_ops.with_age(t.beneficiaries(conditions=False)), "age"))


@register
def box_stats(t: Tables) -> DataFrame:
    return rounded(profile.box_stats(t.beneficiaries(conditions=False, money=True), BOX_COLUMNS))


@register
def condition_sums(t: Tables) -> DataFrame:
    return profile.condition_sums(t.beneficiaries(), CONDITIONS)


@register
def non_null_counts(t: Tables) -> DataFrame:
    return profile.non_null_counts(t.beneficiaries().select("desynpuf_id", "year", "bene_esrd_ind", *CONDITIONS))


@register
def profile_table(t: Tables) -> DataFrame:
    people = claims_ops.with_age(t.beneficiaries(conditions=False)).select(
        "desynpuf_id", "bene_sex_ident_cd", "bene_race_cd", "age", "bene_hi_cvrage_tot_mons"
    )
    return rounded(profile.profile_table(people, skip=["desynpuf_id"], bins=10))


# Model preparation


@register
def impute_median(t: Tables) -> DataFrame:
    frame = stored(_frame(t))
    return rounded(prep.fit_medians(frame, FEATURES).impute(frame).select("clm_id", *FEATURES))


@register
def standard_scale(t: Tables) -> DataFrame:
    frame = stored(_frame(t))
    fitted = prep.fit_scaling(frame, prep.fit_medians(frame, FEATURES))
    return rounded(fitted.scale(fitted.impute(frame)).select("clm_id", *FEATURES), 4)


@register
def anova_f_scores(t: Tables) -> DataFrame:
    frame = stored(_frame(t))
    imputed = prep.fit_medians(frame, prep.feature_names(frame)).impute(frame)
    return rounded(prep.anova_f_scores(imputed, prep.feature_names(frame)), 4)


@register
def select_k_best(t: Tables) -> DataFrame:
    frame = stored(_frame(t))
    imputed = prep.fit_medians(frame, prep.feature_names(frame)).impute(frame)
    return rounded(prep.select_k_best(prep.anova_f_scores(imputed, prep.feature_names(frame)), 10), 4)


def _labels_only(t: Tables) -> DataFrame:
    return t.labelled().select("desynpuf_id", "clm_id", F.col("readmit_30").alias("label"))


@register
def class_weights(t: Tables) -> DataFrame:
    return rounded(prep.class_weights(_labels_only(t)))


@register
def stratified_split(t: Tables) -> DataFrame:
    return prep.stratified_split(stored(_labels_only(t)))


@register
def cv_folds(t: Tables) -> DataFrame:
    return prep.stratified_folds(stored(_labels_only(t)))


# Evaluation of the fixed score


@register
def threshold_sweep(t: Tables) -> DataFrame:
    return rounded(evaluation.threshold_sweep(t.predictions()))


@register
def best_threshold(t: Tables) -> DataFrame:
    return rounded(evaluation.best_threshold(evaluation.threshold_sweep(t.predictions())))


@register
def classification_metrics(t: Tables) -> DataFrame:
    scores = evaluation.score_counts(t.predictions())
    cutoffs = evaluation.best_threshold(evaluation.threshold_sweep(scores))
    return rounded(evaluation.classification_metrics(scores, cutoffs))


@register
def roc_auc(t: Tables) -> DataFrame:
    return rounded(evaluation.roc_auc(t.predictions()))


@register
def roc_curve(t: Tables) -> DataFrame:
    return rounded(evaluation.roc_curve(t.predictions()))


@register
def auc_by_model(t: Tables) -> DataFrame:
    return rounded(evaluation.auc_by_model(evaluation.model_metrics(evaluation.score_counts(t.predictions()))))


@register
def best_model(t: Tables) -> DataFrame:
    return rounded(evaluation.best_model(evaluation.model_metrics(evaluation.score_counts(t.predictions()))))


@register
def performance_summary(t: Tables) -> DataFrame:
    return evaluation.performance_summary(evaluation.model_metrics(evaluation.score_counts(t.predictions())))


@register
def readmission_rates(t: Tables) -> DataFrame:
    scores = evaluation.score_counts(t.predictions())
    return rounded(evaluation.readmission_rates(scores, evaluation.model_metrics(scores)))


# Insights


@register
def risk_tiers(t: Tables) -> DataFrame:
    return rounded(insights.risk_tiers(t.predictions()).select("target", "model", "clm_id", "p", "tier"))


@register
def risk_tier_counts(t: Tables) -> DataFrame:
    scores = evaluation.score_counts(t.predictions())
    return insights.risk_tier_counts(scores, evaluation.roc_auc(scores))


@register
def treatment_costs(t: Tables) -> DataFrame:
    scores = evaluation.score_counts(t.predictions())
    return rounded(insights.treatment_costs(insights.risk_tier_counts(scores, evaluation.roc_auc(scores))), 2)


@register
def treatment_plan(t: Tables) -> DataFrame:
    predictions = t.predictions().filter(F.col("target") == "readmit_30")
    tiered = insights.risk_tiers(evaluation.best_predictions(predictions, evaluation.best_model(evaluation.roc_auc(predictions))))
    return insights.treatment_plan(tiered).select(
        "clm_id", "tier", F.array_join("interventions", "; ").alias("interventions"), "monitoring", "follow_up"
    )


@register
def executive_summary(t: Tables) -> DataFrame:
    scores = evaluation.score_counts(t.predictions())
    metrics = evaluation.roc_auc(scores)
    costs = insights.treatment_costs(insights.risk_tier_counts(scores, metrics))
    # the most frequent codes stand for the factors, which a fixed score does not rank
    order = Window.orderBy(F.desc("n"), "code")
    factors = features.top_codes(t.inpatient(codes=True)).select(F.row_number().over(order).alias("rank"), F.col("code").alias("feature"))
    return insights.executive_summary(t.beneficiaries(conditions=False), t.inpatient(), metrics, factors, costs)


@register
def registry_latest(t: Tables) -> DataFrame:
    entries = t.read("orders").select(
        F.col("o_orderpriority").alias("target"),
        F.col("o_orderstatus").alias("model"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderdate").alias("saved_at"),
    )
    return latest_versions(entries).select("target", "model", "version")


# Sources, sinks and the registry: tables go through files and come back


def _file(t: Tables, name: str) -> str:
    return f"{scratch_folder(t.spark)}/{name}"


@register
def load_missing_years(t: Tables) -> DataFrame:
    """Yearly files under their public names, with one year's file missing and one year unknown."""
    folder, years = scratch_folder(t.spark), t.years[:3]
    sources = readers.default_sources(folder, years)
    for year in (years[0], years[2]):
        t.beneficiaries(conditions=False).filter(F.col("year") == year).drop("year").write.option("header", True).csv(sources.beneficiaries[year])
    out = readers.load_beneficiaries(t.spark, sources, [*years, 1900])
    ids = [F.col("desynpuf_id").cast("long").alias("desynpuf_id"), F.col("bene_birth_dt").cast("int").alias("bene_birth_dt")]
    return out.select(*ids, "year", "bene_race_cd", "sp_state_code")


@register
def predictions_through_files(t: Tables) -> DataFrame:
    """Predictions written as CSV by all tasks and read again with known types."""
    path = _file(t, "predictions")
    scored = insights.risk_tiers(t.predictions()).select("target", "model", "clm_id", "p", "tier")
    writers.write_predictions(scored, path)
    return rounded(t.spark.read.schema(scored.schema).option("header", True).csv(path))


@register
def summary_through_files(t: Tables) -> DataFrame:
    """The performance summary, one folder for each horizon, read again."""
    path = _file(t, "summary")
    writers.write_summary(evaluation.performance_summary(evaluation.model_metrics(evaluation.score_counts(t.predictions()))), path)
    texts = [c for c in ("accuracy", "auc", "f1", "recall", "precision", "cv_auc")]
    return t.spark.read.option("header", True).csv(path).select("target", "model", *texts)


@register
def results_through_registry(t: Tables) -> DataFrame:
    """Metrics and predictions of every horizon published as versions; the newest of each model is read back."""
    registry = Registry(t.spark, scratch_folder(t.spark))
    predictions = stored(t.predictions())
    for days in HORIZONS:
        target = horizon_label(days)
        mine = predictions.filter(F.col("target") == target)
        for part in (mine, mine.filter(F.col("model") == "Random Forest")):
            version = registry.version(target)
            kept = version.add_results("predictions", part)
            version.add_results("metrics", evaluation.model_metrics(kept))
            for name in sorted(r.model for r in kept.select("model").distinct().collect()):
                version.list_model(name, [])
            version.publish()
    usable = [horizon_label(days) for days in HORIZONS if registry.has_results(horizon_label(days))]
    parts = [registry.load_results(target) for target in usable]
    metrics, scores = (pipeline.union([p[k] for p in parts]) for k in (0, 1))
    rows = scores.groupBy("target", "model").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("positives"))
    return rounded(metrics.select("target", "model", "cutoff", "n", "f1", "auc").join(rows, ["target", "model"]))


@register
def features_from_file(t: Tables) -> DataFrame:
    """Feature rows written as CSV and read with the types of the training frame, in one pass."""
    path = _file(t, "rows")
    frame = _frame(t).select("clm_id", *FEATURES)
    frame.write.option("header", True).csv(path)
    types = {c: kind for c, kind in frame.dtypes if c in FEATURES}
    rows = readers.read_features(t.spark, path, types)
    return rounded(rows.select(F.col("clm_id").cast("long").alias("clm_id"), *[F.col(c).cast("double").alias(c) for c in FEATURES]))


@register
def profile_of_file(t: Tables) -> DataFrame:
    """A CSV file of persons, typed by its values, and profiled."""
    path = _file(t, "person")
    t.person().select("person_id", "gender_source_value", "race_source_value").write.option("header", True).csv(path)
    return rounded(profile.profile_table(readers.load_profile_table(t.spark, path), bins=5))


@register
def preview_count(t: Tables) -> DataFrame:
    """A preview has 20 rows of the table, whichever these are."""
    shown = claims_ops.preview(t.inpatient())
    known = shown.join(t.inpatient().select("clm_id"), "clm_id", "left_semi")
    return known.agg(F.count("*").alias("n"), F.count_distinct("clm_id").alias("claims"))


@register
def performance_summary_folds(t: Tables) -> DataFrame:
    """The summary with mean and deviation of the AUC over five folds of the claims, for the fixed score."""
    scores = stored(t.predictions())
    folds = prep.stratified_folds(_labels_only(t)).select("clm_id", "fold")
    by_fold = scores.join(folds, "clm_id").withColumn("model", F.concat_ws(":", F.col("fold").cast("string"), "model"))
    place = F.split("model", ":", 2)
    aucs = evaluation.roc_auc(by_fold).select("target", place[1].alias("model"), place[0].cast("int").alias("fold"), "auc")
    metrics = evaluation.model_metrics(scores).join(models.cross_validated(aucs), ["target", "model"])
    return evaluation.performance_summary(metrics).select("target", "model", "auc", "cv_auc")


@register
def best_model_insight(t: Tables) -> DataFrame:
    """The best model of each horizon and its AUC, where no fitted model ranks features."""
    metrics = evaluation.model_metrics(evaluation.score_counts(t.predictions()))
    return rounded(models.best_model_insight(metrics, {}, []))


# Trained models, all with the library's full settings. Their numbers are not determined in SQL, so the queries
# return what is: the held-out rows, whether the model's table gives the same score by plain expressions, the error
# in the equations that the fit has to satisfy (0), and that its loss is below that of any constant.


def _prepared(t: Tables) -> models.Prepared:
    return models.prepare(_frame(t), "readmit_30")


def _probability(column: str = "p") -> Column:
    return F.coalesce(F.col(column).between(0.0, 1.0), F.lit(False))


def _ranks() -> Column:
    """Whether the scores rank rows at all: a constant has an AUC of exactly one half."""
    return F.abs(F.col("auc") - 0.5) > 1e-9


def _scored(t: Tables, name: str) -> DataFrame:
    prepared = _prepared(t)
    model = models.fit_model(name, prepared)
    by_table = models.score_by_table(name, model, prepared.test, prepared.names)
    scored = models.score(model, prepared.test, "readmit_30", name).join(by_table, list(models.KEYS))
    error = models.residual(name, model, prepared)
    return scored.select(
        "target", "model", "desynpuf_id", "clm_id", "label",
        (_probability() & F.coalesce(F.abs(F.col("p") - F.col("p_table")) < 1e-9, F.lit(False))).alias("p_from_table"),
        F.lit(abs(round(error, 5))).alias("residual"),
        F.lit(models.beats_constant(name, model, prepared)).alias("beats_constant"),
    )


@register
def model_lr(t: Tables) -> DataFrame:
    return _scored(t, "Logistic Regression")


@register
def model_rf(t: Tables) -> DataFrame:
    return _scored(t, "Random Forest")


@register
def model_gbt(t: Tables) -> DataFrame:
    return _scored(t, "Gradient Boosting")


@register
def model_gbt_weighted(t: Tables) -> DataFrame:
    return _scored(t, "Weighted Gradient Boosting")


@register
def model_mlp(t: Tables) -> DataFrame:
    return _scored(t, "Multilayer Perceptron")


@register
def train_horizon(t: Tables) -> DataFrame:
    """All four models of the ensemble, published and read back; their folds are the query cross_validation."""
    registry = Registry(t.spark, scratch_folder(t.spark))
    trained = pipeline.train_horizon(_frame(t), "readmit_30", registry, force=True, cross_validation=False)
    rates = [_probability(c) for c in ("auc", "accuracy", "precision", "recall", "f1")]
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    positives = trained.predictions.groupBy("target", "model").agg(F.sum("label").cast("long").alias("positives"))
    return trained.metrics.join(positives, ["target", "model"]).select(
        "target", "model", "n", "positives",
        (functools.reduce(lambda a, b: a & b, rates) & (F.abs(F.col("f1") - f1) < 1e-9)).alias("rates_agree"),
        _ranks().alias("ranks"),
    )


@register
def cross_validation(t: Tables) -> DataFrame:
    """All models and folds at the full settings, fitted at the same time."""
    prepared = _prepared(t)
    folds = models.cross_validate(models.ENSEMBLE, prepared)
    return folds.select("target", "model", "fold", "n", _probability("auc").alias("auc_in_range"), _ranks().alias("ranks"))


@register
def feature_importance(t: Tables) -> DataFrame:
    """The ten most important features, and whether the importances follow from the table of tree nodes."""
    prepared = _prepared(t)
    model = models.fit_model("Random Forest", prepared)
    factors = models.high_risk_factors({"Random Forest": model}, prepared.names, t.spark)
    falling = F.sort_array(F.collect_list(F.struct("rank", "importance")))
    by_nodes = modeltables.importances(modeltables.tree_nodes(model, t.spark), len(prepared.names), by_tree=True)
    apart = float(abs(by_nodes - model.featureImportances.toArray()).max())
    return factors.groupBy("model").agg(
        F.count("*").cast("int").alias("factors"),
        (F.transform(falling, lambda x: x["importance"]) == F.sort_array(F.collect_list("importance"), asc=False)).alias("ranked"),
        ((F.sum("importance") > 0) & (F.sum("importance") <= 1.000001)).alias("a_share"),
        F.lit(abs(round(apart, 6))).alias("residual"),
    )


@register
def batch_score(t: Tables) -> DataFrame:
    """The preparation and the model are fitted on the training part; rows they have not seen are scored."""
    frame = stored(_frame(t))
    prepared = models.prepare(frame, "readmit_30", fit_on="train")
    model = models.fit_model("Logistic Regression", prepared)
    unseen = prep.stratified_split(frame).filter("is_test").drop("is_test", "label")
    scored = models.batch_score(PipelineModel([*prepared.stages, model]), unseen, prepared.names, keep=["clm_id"])
    features = PipelineModel(prepared.stages).transform(unseen)
    by_table = models.score_by_table("Logistic Regression", model, features, prepared.names, ["clm_id"])
    agrees = F.col("tier") == F.when(F.col("p") > 0.7, "High").when(F.col("p") > 0.3, "Medium").otherwise("Low")
    from_table = F.coalesce(F.abs(F.col("p") - F.col("p_table")) < 1e-9, F.lit(False))
    return scored.join(by_table, "clm_id").select("clm_id", (_probability() & from_table).alias("p_from_table"), agrees.alias("tier_agrees"))


@register
def saved_models(t: Tables) -> DataFrame:
    """A model saved, loaded and evaluated again on a frame that has grown: it meets rows it has not seen only."""
    registry = Registry(t.spark, scratch_folder(t.spark))
    frame = stored(_frame(t))
    old = frame.filter(F.col("clm_id") % 5 > 0)
    first = pipeline.train_horizon(old, "readmit_30", registry, ["Logistic Regression"], force=True, cross_validation=False)
    again = pipeline.evaluate_saved(registry, frame, "readmit_30")
    trained_on = old.join(first.predictions, "clm_id", "left_anti").select("clm_id")
    seen = again.predictions.join(trained_on, "clm_id", "left_semi").count()
    unchanged = first.predictions.select("clm_id", "p").join(again.predictions.select("clm_id", F.col("p").alias("_p")), "clm_id")
    apart = unchanged.agg(F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("_p"))).alias("d")).first()
    return first.metrics.select(
        "target", "model", "n", _ranks().alias("ranks"), F.lit(apart.n).cast("long").alias("scored_again"),
        F.lit(apart.d < 1e-12).alias("same_scores"), F.lit(seen).cast("long").alias("seen_before"),
    )
