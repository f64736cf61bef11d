"""Dashboard aggregates. Every one is a single partial aggregation over a pruned scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.columns import CONDITIONS, present
from claimlens.functions.expressions import money_sum, month_start
from claimlens.operators.features import latest_beneficiary


def kpi_summary(claims: DataFrame, beneficiaries: DataFrame) -> DataFrame:
    """Patients, total reimbursed and claim counts, in one row, from the unfiltered tables."""
    patients = beneficiaries.agg(F.countDistinct("desynpuf_id")).scalar()
    return claims.agg(
        money_sum("clm_pmt_amt").alias("total_reimbursed"),
        F.count_if(F.col("claim_type") == "Inpatient").alias("inpatient_claims"),
        F.count_if(F.col("claim_type") == "Outpatient").alias("outpatient_claims"),
        F.count("*").alias("claims"),
    ).withColumn("unique_patients", patients)


def monthly_reimbursement(claims: DataFrame) -> DataFrame:
    return (
        claims.filter(F.col("admit_date").isNotNull())
        .groupBy(month_start(F.col("admit_date")).alias("month"), "claim_type")
        .agg(money_sum("clm_pmt_amt").alias("amount"))
    )


def reimbursement_by_type(claims: DataFrame) -> DataFrame:
    return claims.groupBy("claim_type").agg(money_sum("clm_pmt_amt").alias("amount"))


def count_by_sex(beneficiaries: DataFrame, latest_only: bool = False) -> DataFrame:
    """Patient-years per sex code, or patients with ``latest_only``; an unknown code is left out."""
    if latest_only:
        beneficiaries = latest_beneficiary(beneficiaries)
    return (
        beneficiaries.filter(F.col("bene_sex_ident_cd").isNotNull())
        .groupBy("bene_sex_ident_cd")
        .agg(F.count("*").alias("n"))
    )


def condition_counts(
    beneficiaries: DataFrame, columns: Sequence[str] = tuple(CONDITIONS), n: int | None = 10
) -> DataFrame:
    """Patient-years with each condition; the n most frequent, ties by name."""
    names = present(beneficiaries, columns)
    wide = beneficiaries.agg(*[F.count_if(F.col(c) == 1).alias(c) for c in names])
    long = wide.unpivot([], names, "condition", "n").withColumn(
        "condition", F.regexp_replace("condition", "(?i)^sp_", "")
    )
    return long if n is None else long.orderBy(F.desc("n"), "condition").limit(n)


def filter_options(beneficiaries: DataFrame) -> DataFrame:
    """What the filters can offer: the record years in order, and the age range."""
    return beneficiaries.agg(
        F.sort_array(F.collect_set("year")).alias("years"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
    )
