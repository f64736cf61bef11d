"""Reading and writing files, and the whole pipeline over CSV files."""

import numpy as np
import pytest

from claimlens.columns import CONDITIONS
from claimlens.operators import models
from claimlens.plans.pipeline import run_pipeline
from claimlens.operators import claims, profile
from claimlens.sources import readers, writers

FEW = models.Settings(trees=3, forest_depth=3, boosting_depth=2, regression_iterations=20, perceptron_iterations=5, folds=2, hidden=(8,))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A small sample in the public file layout. The 2009 file lacks a column; there is no 2010 file."""
    path = tmp_path_factory.mktemp("csv")
    rng = np.random.default_rng(9)
    for year in (2008, 2009):
        names = ["DESYNPUF_ID", "BENE_BIRTH_DT", "BENE_SEX_IDENT_CD", "SP_STATE_CODE", *[c.upper() for c in CONDITIONS]]
        names += ["MEDREIMB_IP"] if year == 2008 else []
        lines = [",".join(names)]
        for i in range(60):
            cells = [f"P{i}", f"{1930 + i % 40}0501", str(1 + i % 2), str(1 + i % 5), *[str(rng.integers(1, 3)) for _ in CONDITIONS]]
            lines.append(",".join(cells + (["120.50"] if year == 2008 else [])))
        (path / f"DE1_0_{year}_Beneficiary_Summary_File_Sample_1.csv").write_text("\n".join(lines) + "\n")
    lines = ["DESYNPUF_ID,CLM_ID,CLM_FROM_DT,CLM_THRU_DT,CLM_PMT_AMT,CLM_ADMSN_DT,CLM_UTLZTN_DAY_CNT,ICD9_DGNS_CD_1,ICD9_DGNS_CD_2"]
    for i in range(300):
        day = f"2008{1 + i % 12:02d}{1 + (i * 7) % 28:02d}"
        lines.append(f"P{rng.integers(0, 60)},{i},{day},{day},{1000 + i}.00,{day},{i % 9},0{i % 7}9,")
    (path / "DE1_0_2008_to_2010_Inpatient_Claims_Sample_1.csv").write_text("\n".join(lines) + "\n")
    return str(path)


def test_beneficiaries(spark, folder):
    sources = readers.default_sources(folder)
    df = readers.load_beneficiaries(spark, sources)
    assert df.count() == 120
    types = dict(df.dtypes)
    assert types["desynpuf_id"] == "string" and types["sp_chf"] == "int" and types["medreimb_ip"] == "decimal(18,2)"
    assert df.filter("year = 2009 AND medreimb_ip IS NOT NULL").isEmpty()
    assert readers.load_beneficiaries(spark, sources, years=[2008, 1999]).count() == 60
    assert readers.load_beneficiaries(spark, sources, years=[2010]) is None


def test_claims_with_a_missing_side(spark, folder):
    inpatient, outpatient = readers.load_claims(spark, readers.default_sources(folder))
    assert outpatient is None and inpatient.count() == 300
    assert inpatient.filter("icd9_dgns_cd_1 = '009'").count() > 0
    assert dict(inpatient.dtypes)["icd9_dgns_cd_1"] == "string"


def test_paths_can_be_replaced(spark, folder):
    sources = readers.default_sources(folder).replace(inpatient=None, outpatient=readers.default_sources(folder).inpatient)
    inpatient, outpatient = readers.load_claims(spark, sources)
    assert inpatient is None and outpatient.count() == 300


def test_a_wrong_header_fails(spark, folder):
    path = readers.default_sources(folder).inpatient
    with pytest.raises(Exception):
        readers.read_table(spark, path, "a string, b string").collect()


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_predictions_round_trip(spark, tmp_path, file_format):
    df = spark.createDataFrame([(1, 0.25, "Low"), (2, 0.9, "High")], "clm_id int, p double, tier string")
    path = str(tmp_path / f"out.{file_format}")
    writers.write_predictions(df, path, file_format)
    back = readers.read_features(spark, path).select("clm_id", "p", "tier")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_summary_has_a_folder_per_horizon(spark, tmp_path):
    df = spark.createDataFrame([("readmit_30", "m", "0.500"), ("readmit_60", "m", "0.600")], "target string, model string, auc string")
    writers.write_summary(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"target=readmit_30", "target=readmit_60"}
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError):
        writers.write_summary(df, str(tmp_path / "x"), "xlsx")


def test_results_of_other_horizons_and_models_stay(spark, tmp_path):
    path = str(tmp_path / "r")
    schema = "target string, model string, auc double"
    writers.write_results(spark.createDataFrame([("readmit_30", "a", 0.1), ("readmit_60", "a", 0.2)], schema), path)
    writers.write_results(spark.createDataFrame([("readmit_30", "b", 0.3)], schema), path)
    assert sorted((r.target, r.model) for r in spark.read.parquet(path).collect()) == [
        ("readmit_30", "a"),
        ("readmit_30", "b"),
        ("readmit_60", "a"),
    ]


def test_pipeline(spark, folder, tmp_path):
    out = run_pipeline(spark, readers.default_sources(folder), str(tmp_path), FEW, horizons=[30, 90], cross_validation=False)
    assert {r.target for r in out["metrics"].select("target").distinct().collect()} == {"readmit_30", "readmit_90"}
    assert out["metrics"].filter("target = 'readmit_30'").count() == 5
    sections = {r.section for r in out["summary"].collect()}
    assert sections == {"data", "best_model", "risk_factor", "savings"}
    assert out["costs"].count() == 2 and out["performance"].count() == 9
    assert out["roc"].count() > 9 and out["treatment_plan"].count() == out["tiers"].count() > 0
    assert out["factors"].count() > 0
    assert {r.target for r in out["importances"].select("target").distinct().collect()} == {"readmit_30", "readmit_90"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/reports/performance").count() == 9
    assert spark.read.option("header", True).csv(f"{tmp_path}/reports/predictions").count() == out["tiers"].count()
    again = run_pipeline(spark, readers.default_sources(folder), str(tmp_path), FEW, horizons=[30, 90], cross_validation=False, factors_of=90)
    assert {r.section for r in again["summary"].collect()} == sections and again["factors"].count() > 0
    with pytest.raises(ValueError, match="readmit_60 was not trained"):
        run_pipeline(spark, readers.default_sources(folder), str(tmp_path), FEW, horizons=[30], cross_validation=False, factors_of=60)


def test_pipeline_without_claims(spark, tmp_path):
    assert run_pipeline(spark, readers.default_sources(str(tmp_path)), str(tmp_path), FEW) is None


def test_lenient_integers(spark):
    df = spark.createDataFrame([("1e30", "x"), ("7", "y"), ("n/a", "z")], "SP_CHF string, other string")
    assert [r.sp_chf for r in readers.typed(df).collect()] == [None, 7, None]


def test_profiles_of_csv_files_are_typed(spark, tmp_path):
    rows = [(i, "ab"[i % 2], 1.5 * i) for i in range(30)]
    spark.createDataFrame(rows, "Age int, Sex string, Amount double").coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    table = readers.load_profile_table(spark, str(tmp_path / "t"))
    out = profile.profile_table(table, bins=5, curve=True)
    assert {(r.variable, r.statistic) for r in out.collect()} == {
        ("sex", "count"),
        *[(v, s) for v in ("age", "amount") for s in ("histogram", "mean", "median", "density")],
    }
    assert readers.load_profile_table(spark, str(tmp_path / "t"), "Age string, Sex string, Amount string").dtypes[0] == ("age", "string")


def test_preview(spark):
    assert claims.preview(spark.range(100)).count() == 20
