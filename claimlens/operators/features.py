"""Patient features: latest record, condition flags, utilization, frequent diagnosis codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.columns import CONDITIONS, diagnosis_columns, present
from claimlens.functions.expressions import has_condition
from claimlens.operators.claims import with_age

UTILIZATION = ["num_admissions", "avg_los", "total_ip_cost"]


def latest_beneficiary(beneficiaries: DataFrame, tie_break: Sequence[str] = ("bene_birth_dt",)) -> DataFrame:
    """The record of the latest year per patient; ties go by ``tie_break``, then by a hash of the whole record.

    Keeping only the first row lets Spark drop the others before the shuffle as well.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in beneficiaries.columns])
    newest = Window.partitionBy("desynpuf_id").orderBy(
        F.desc("year"), *[F.desc(c) for c in present(beneficiaries, tie_break)], whole
    )
    return beneficiaries.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def condition_flags(df: DataFrame, columns: Sequence[str] = tuple(CONDITIONS)) -> DataFrame:
    """HAS_X per condition column that exists: 1 for yes, 0 for no or unknown."""
    return df.withColumns({f"has_{c}": has_condition(c) for c in present(df, columns)})


def utilization_measures() -> list[Column]:
    return [
        F.count("*").alias("num_admissions"),
        F.avg("clm_utlztn_day_cnt").alias("avg_los"),
        F.sum(F.col("clm_pmt_amt").cast("decimal(18,2)")).cast("double").alias("total_ip_cost"),
    ]


def patient_utilization(inpatient: DataFrame) -> DataFrame:
    """Admissions, mean stay and inpatient cost per patient."""
    return inpatient.filter(F.col("desynpuf_id").isNotNull()).groupBy("desynpuf_id").agg(*utilization_measures())


def _demographics(beneficiaries: DataFrame) -> DataFrame:
    return condition_flags(with_age(latest_beneficiary(beneficiaries)))


def patient_features(beneficiaries: DataFrame, inpatient: DataFrame | None) -> DataFrame:
    """One row per patient: latest record, age, condition flags and utilization (0 without admissions)."""
    people = _demographics(beneficiaries)
    if inpatient is None:
        return people.withColumns({"num_admissions": F.lit(0), "avg_los": F.lit(0.0), "total_ip_cost": F.lit(0.0)})
    return people.join(patient_utilization(inpatient), "desynpuf_id", "left").na.fill(0, UTILIZATION)


def codes_long(claims: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ("desynpuf_id", "clm_id")) -> DataFrame:
    """One row per filled diagnosis column."""
    codes = list(columns or diagnosis_columns(claims))
    return claims.select(*keep, F.explode(F.array(*codes)).alias("code")).filter(F.col("code").isNotNull())


def top_codes(claims: DataFrame, n: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """The n most frequent codes over all diagnosis columns; every occurrence counts, ties by code."""
    return (
        codes_long(claims, columns, keep=())
        .groupBy("code")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "code")
        .limit(n)
    )


def top_code_list(claims: DataFrame, n: int = 20) -> list[str]:
    """The top codes as a list. Runs a job, and brings n strings to the driver."""
    return [row.code for row in top_codes(claims, n).collect()]


def diagnosis_flags(claims: DataFrame, codes: Sequence[str]) -> list[Column]:
    """Per code: 1 where any claim of the group has it in any diagnosis column."""
    filled = F.array(*diagnosis_columns(claims))
    return [F.max(F.array_contains(filled, code).cast("int")).alias(f"diag_{code}") for code in codes]


def diagnosis_features(features: DataFrame, inpatient: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Patient features with one 0/1 column per frequent code."""
    codes = top_code_list(inpatient) if codes is None else list(codes)
    flags = (
        inpatient.filter(F.col("desynpuf_id").isNotNull())
        .groupBy("desynpuf_id")
        .agg(*diagnosis_flags(inpatient, codes))
    )
    return features.join(flags, "desynpuf_id", "left").na.fill(0, [f"`diag_{c}`" for c in codes])


def feature_matrix(beneficiaries: DataFrame, inpatient: DataFrame, codes: Sequence[str] | None = None) -> DataFrame:
    """Patient and diagnosis features together: one aggregation over the claims and one join."""
    codes = top_code_list(inpatient) if codes is None else list(codes)
    history = (
        inpatient.filter(F.col("desynpuf_id").isNotNull())
        .groupBy("desynpuf_id")
        .agg(*utilization_measures(), *diagnosis_flags(inpatient, codes))
    )
    return (
        _demographics(beneficiaries)
        .join(history, "desynpuf_id", "left")
        .na.fill(0, [*UTILIZATION, *[f"`diag_{c}`" for c in codes]])
    )


def patient_lookup(features: DataFrame, patient: str) -> DataFrame:
    """One patient's features as (feature, value) rows. The bare key is compared, so the scan can use the filter."""
    key = F.lit(patient).try_cast(features.schema["desynpuf_id"].dataType)
    row = features.filter(F.col("desynpuf_id") == key)
    names = row.columns
    texts = row.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return texts.unpivot([], [f"`{c}`" for c in names], "feature", "value")


def patient_ids(features: DataFrame, n: int = 1000) -> DataFrame:
    """The first n patient ids in order."""
    return features.select(F.col("desynpuf_id").cast("string").alias("desynpuf_id")).orderBy("desynpuf_id").limit(n)
