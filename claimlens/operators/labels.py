"""Readmission labels: days from one admission to the patient's next, and the horizon flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.columns import HORIZONS, horizon_label
from claimlens.functions.expressions import within_days


def days_to_readmit(
    claims: DataFrame,
    patient: str = "desynpuf_id",
    admit: str = "admit_date",
    order: Sequence[str] = ("clm_id",),
    gap: str = "days_to_readmit",
) -> DataFrame:
    """Days from each admission to the same patient's next admission; null for the last one.

    Admissions of one day are ordered by ``order``: all but the last of them are followed on the
    same day (gap 0), the last one by the patient's next admission day. So the look-ahead runs over
    patient *days*, at most one row per calendar day however many claims a patient has, and the
    claims themselves are spread by claim rather than by patient.
    """
    known = F.col(patient).isNotNull() & F.col(admit).isNotNull()
    keyed = claims.withColumn("_claim", F.struct(*order))
    ahead = Window.partitionBy(patient).orderBy(admit)
    # One order column aggregates by hash; a struct of several has to be sorted.
    last = F.struct(F.max(order[0]).alias(order[0])) if len(order) == 1 else F.max("_claim")
    last_of_day = (
        keyed.filter(known)
        .groupBy(patient, admit)
        .agg(last.alias("_claim"))
        .select(patient, admit, "_claim", F.lead(admit).over(ahead).alias("_next"), F.lit(True).alias("_last"))
    )
    copies = Window.partitionBy(patient, admit, "_claim").orderBy(patient)
    days = F.when(
        known,
        F.when(
            F.col("_last") & (F.col("_copy") == 1),
            F.datediff(F.col("_next"), F.col(admit)),
        ).otherwise(0),
    )
    return (
        keyed.withColumn("_copy", F.row_number().over(copies))
        .join(last_of_day, [patient, admit, "_claim"], "left")
        .withColumn(gap, days)
        .select(*claims.columns, gap)
    )


def readmission_flags(df: DataFrame, horizons: Sequence[int] = tuple(HORIZONS), gap: str = "days_to_readmit") -> DataFrame:
    """READMIT_N = 1 where the next admission follows within N days."""
    return df.withColumns({horizon_label(n): within_days(F.col(gap), n) for n in horizons})


def readmission_labels(claims: DataFrame, horizons: Sequence[int] = tuple(HORIZONS), **names) -> DataFrame:
    return readmission_flags(days_to_readmit(claims, **names), horizons, names.get("gap", "days_to_readmit"))


def readmission_totals(labelled: DataFrame, horizons: Sequence[int] = tuple(HORIZONS)) -> DataFrame:
    """Number of admissions and of positive labels per horizon, in one row."""
    return labelled.agg(
        F.count("*").alias("admissions"),
        *[F.coalesce(F.sum(horizon_label(n)), F.lit(0)).alias(horizon_label(n)) for n in horizons],
    )
