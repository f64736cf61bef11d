"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimlens.plans.queries import REGISTERED
from claimlens.session import clear_scratch, local_session

HEADLINE = [
    "readmission_totals",
    "readmission_labels",
    "clean_claims",
    "claims_filtered",
    "claims_code_search",
    "claims_table",
    "kpi_summary",
    "monthly_reimbursement",
    "patient_features",
    "top_codes",
    "condition_prevalence",
    "comorbidity_top10",
    "value_shares",
    "histogram20",
    "numeric_summary",
    "box_stats",
    "stratified_split",
    "threshold_sweep",
    "roc_auc",
    "roc_curve",
    "treatment_costs",
    "diagnosis_features",
    "impute_median",
    "anova_f_scores",
    "kde_age",
    "model_lr",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cores, shuffle_partitions=8)

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(3)), 3)
        clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cores": cores,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
