"""Risk tiers, cost estimates, treatment plans and the executive summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.expressions import risk_tier
from claimlens.operators.evaluation import BY, best_model, best_predictions, score_counts

# Cost of a readmission and of preventive care per patient, in dollars.
READMISSION_COST = 20000.0
PREVENTIVE_COST = 2000.0

# Readmission probability per tier without and with intervention, and share of the preventive cost.
WITHOUT = {"high": 0.8, "medium": 0.4, "low": 0.1}
WITH = {"high": 0.3, "medium": 0.2, "low": 0.05}
CARE = {"high": 1.0, "medium": 0.5, "low": 0.0}

# The plan of each tier.
PLANS = [
    (
        "High",
        [
            "Intensive case management",
            "Daily medication adherence monitoring",
            "Weekly follow-up appointments",
            "Home health visits 2x per week",
        ],
        "Daily vital signs monitoring via telehealth",
        "48-hour post-discharge appointment",
    ),
    (
        "Medium",
        [
            "Standard case management",
            "Medication reconciliation",
            "Bi-weekly follow-up appointments",
            "Disease-specific education program",
        ],
        "Weekly telehealth check-ins",
        "7-day post-discharge appointment",
    ),
    (
        "Low",
        [
            "Standard discharge planning",
            "Medication education",
            "Access to nurse hotline",
            "Preventive care reminders",
        ],
        "Monthly wellness checks",
        "14-day post-discharge appointment",
    ),
]


def risk_tiers(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("tier", risk_tier(F.col("p")))


def risk_tier_counts(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Claims per tier by the best model of each horizon, from predictions or counts per score."""
    tier = risk_tier(F.col("p"))
    return (
        best_predictions(score_counts(predictions), best_model(metrics))
        .groupBy(*BY)
        .agg(*[F.sum(F.when(tier == name.title(), F.col("rows")).otherwise(0)).alias(f"{name}_risk") for name in WITHOUT])
    )


def treatment_costs(tier_counts: DataFrame) -> DataFrame:
    """Expected cost per horizon without and with intervention, and the difference."""
    without = sum((F.col(f"{t}_risk") * (WITHOUT[t] * READMISSION_COST) for t in WITHOUT), F.lit(0.0))
    treated = sum(
        (F.col(f"{t}_risk") * (CARE[t] * PREVENTIVE_COST + WITH[t] * READMISSION_COST) for t in WITH), F.lit(0.0)
    )
    return tier_counts.withColumns({"cost_without": without, "cost_with": treated}).withColumn(
        "potential_savings", F.col("cost_without") - F.col("cost_with")
    )


def plan_table(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(
            F.lit(tier).alias("tier"),
            F.array(*[F.lit(i) for i in interventions]).alias("interventions"),
            F.lit(monitoring).alias("monitoring"),
            F.lit(follow_up).alias("follow_up"),
        )
        for tier, interventions, monitoring, follow_up in PLANS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def treatment_plan(tiered: DataFrame) -> DataFrame:
    """Each tiered row with the plan of its tier; the plan table has three rows."""
    return tiered.join(F.broadcast(plan_table(tiered.sparkSession)), "tier", "left")


def executive_summary(
    beneficiaries: DataFrame,
    inpatient: DataFrame,
    metrics: DataFrame | None = None,
    factors: DataFrame | None = None,
    costs: DataFrame | None = None,
    savings_target: str = "readmit_30",
    top_factors: int = 5,
) -> DataFrame:
    """The report as (section, item, value) rows. Parts without input are left out."""

    def rows(df: DataFrame, section: str, item, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("string").alias("value"))

    parts = [
        rows(beneficiaries.agg(F.countDistinct("desynpuf_id").alias("v")), "data", F.lit("unique_patients"), F.col("v")),
        rows(inpatient.agg(F.count("*").alias("v")), "data", F.lit("inpatient_admissions"), F.col("v")),
    ]
    if metrics is not None:
        text = F.format_string("%s (AUC: %.3f)", F.col("model"), F.col("auc"))
        parts.append(rows(best_model(metrics), "best_model", F.col("target"), text))
    if factors is not None:
        top = factors.orderBy("rank").limit(top_factors)
        parts.append(rows(top, "risk_factor", F.col("rank").cast("string"), F.col("feature")))
    if costs is not None:
        chosen = costs.filter(F.col("target") == savings_target)
        parts.append(rows(chosen, "savings", F.col("target"), F.format_string("%.2f", F.col("potential_savings"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
