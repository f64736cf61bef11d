"""Physical plans: what must hold for the queries to work at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimlens.operators import evaluation, features
from claimlens.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "clean_claims",
    "claims_demographics",
    "claims_table",
    "kpi_summary",
    "monthly_reimbursement",
    "reimbursement_by_type",
    "readmission_totals",
    "latest_beneficiary",
    "patient_features",
    "patient_ids",
    "top_codes",
    "comorbidity_top10",
    "box_stats",
    "kde_age",
    "threshold_sweep",
    "roc_auc",
]


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(entry.queries()[name](spark, FOLDER)) for name in LAZY}


def test_no_cartesian_product_and_no_python(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text, name


def test_latest_record_is_cut_before_the_shuffle(plans):
    text = plans["latest_beneficiary"]
    exchange = text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text[exchange:]


def test_top_lists_need_no_global_sort(plans):
    for name in ("claims_table", "top_codes", "comorbidity_top10", "patient_ids"):
        assert "TakeOrderedAndProject" in plans[name], name
        assert "rangepartitioning" not in plans[name], name


def test_scans_read_only_what_is_used(plans):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plans["reimbursement_by_type"])
    read = {column.split("#")[0] for scan in scans for column in scan.split(",")}
    assert read == {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "c_custkey"}


def test_filters_reach_the_scan(spark):
    text = plan(Tables(spark, FOLDER).inpatient())
    assert re.search(r"PushedFilters: \[[^\]]*(In|Or|EqualTo)\(", text)


def test_the_gap_window_runs_over_patient_days(plans):
    """The look-ahead sorts aggregated patient days; only copies of one claim share a window group."""
    text = plans["readmission_totals"]
    windows = re.findall(r"Window \[(\w+)\(.*?\], \[([^\]]*)\]", text)
    keys = {function: len(by.split(", ")) for function, by in windows}
    assert keys["lead"] == 1 and keys["row_number"] == 3
    assert "partial_max(clm_id" in text and "SortAggregate" not in text


def test_split_does_not_sort_the_frame(spark, tmp_path):
    from claimlens.operators.prep import stratified_split

    df = spark.createDataFrame([("p", i, i % 2) for i in range(50)], "desynpuf_id string, clm_id long, label int")
    df.write.parquet(str(tmp_path / "f"))
    text = plan(stratified_split(spark.read.parquet(str(tmp_path / "f"))))
    assert text.count("SortMergeJoin") == 0 and "BroadcastHashJoin" in text


def test_sweep_shuffles_counts_only(spark, tmp_path):
    df = spark.createDataFrame([("t", "m", 1, 1, 0.4)], "target string, model string, clm_id long, label int, p double")
    text = plan(evaluation.threshold_sweep(df))
    assert "partial_sum" in text.split("Generate")[1]


def test_history_is_one_aggregation(spark):
    t = Tables(spark, FOLDER)
    matrix = features.feature_matrix(t.beneficiaries(conditions=False), t.inpatient(codes=True, stay=True), ["Brand#1"])
    assert plan(matrix).count("partial_avg(clm_utlztn_day_cnt") == 1


def test_patient_lookup_pushes_the_key(spark):
    text = plan(entry.queries()["patient_lookup"](spark, FOLDER))
    assert "EqualTo(c_custkey,7)" in text and "EqualTo(o_custkey,7)" in text


def test_claim_type_reaches_the_scan_of_filtered_claims(spark):
    text = plan(entry.queries()["claims_filtered"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*o_orderstatus", text)


def test_no_task_orders_a_whole_column(spark):
    """Values are ordered inside their range of the column, and only counts are ordered across ranges."""
    text = plan(entry.queries()["numeric_summary"](spark, FOLDER))
    for by in re.findall(r"Window \[sum\(rows[^\]]*?\], \[([^\]]*)\], \[value", text):
        assert "range" in by


def test_shuffle_files_end_with_a_stored_frame(spark):
    """The table stands for the shuffle, so its files go at once, and the session keeps its own setting."""
    import time

    from claimlens.session import SHUFFLES_END, stored

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    setting, before = spark.conf.get(SHUFFLES_END), files()
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(SHUFFLES_END) == setting
    assert kept.count() == 7


def test_scratch_is_cleared(spark):
    import os

    from claimlens.session import clear_scratch, scratch_folder, stored

    stored(spark.range(5)).count()
    top = os.path.dirname(scratch_folder(spark)).removeprefix("file:")
    assert os.listdir(top)
    clear_scratch(spark)
    assert not os.path.exists(top)
