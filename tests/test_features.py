"""Patient features, codes and name-based column selection."""

import datetime as dt

from claimlens import columns
from claimlens.operators import features


def people(spark):
    return spark.createDataFrame(
        [("a", 2008, 19300101, 1, 2), ("a", 2010, 19300101, 2, 1), ("b", 2008, 19500630, None, 1), ("c", 2009, 19700101, 2, 2)],
        "desynpuf_id string, year int, bene_birth_dt int, sp_chf int, sp_copd int",
    )


def stays(spark):
    return spark.createDataFrame(
        [
            ("a", 1, 4, 100.0, "4019", "4019", None),
            ("a", 2, None, None, None, "25000", None),
            ("b", 3, None, None, "4019", None, None),
            (None, 4, 3, 5.0, "V01", None, None),
        ],
        "desynpuf_id string, clm_id int, clm_utlztn_day_cnt int, clm_pmt_amt double,"
        "icd9_dgns_cd_1 string, icd9_dgns_cd_2 string, icd9_prcdr_cd_1 string",
    )


def test_latest_record_flags_and_age(spark):
    out = {r.desynpuf_id: r for r in features.patient_features(people(spark), stays(spark)).collect()}
    assert len(out) == 3
    assert (out["a"].year, out["a"].age, out["a"].has_sp_chf, out["a"].has_sp_copd) == (2010, 80, 0, 1)
    assert (out["b"].age, out["b"].has_sp_chf, out["b"].has_sp_copd) == (58, 0, 1)


def test_utilization_skips_gaps_and_fills_zero(spark):
    out = {r.desynpuf_id: r for r in features.patient_features(people(spark), stays(spark)).collect()}
    assert (out["a"].num_admissions, out["a"].avg_los, out["a"].total_ip_cost) == (2, 4.0, 100.0)
    assert (out["b"].num_admissions, out["b"].avg_los, out["b"].total_ip_cost) == (1, 0.0, 0.0)
    assert (out["c"].num_admissions, out["c"].avg_los, out["c"].total_ip_cost) == (0, 0.0, 0.0)


def test_without_inpatient_claims_utilization_is_zero(spark):
    row = features.patient_features(people(spark), None).filter("desynpuf_id = 'a'").first()
    assert (row.num_admissions, row.avg_los, row.total_ip_cost) == (0, 0.0, 0.0)


def test_codes_count_every_occurrence(spark):
    found = [(r.code, r.n) for r in features.top_codes(stays(spark)).collect()]
    assert found == [("4019", 3), ("25000", 1), ("V01", 1)]
    assert features.top_code_list(stays(spark), 2) == ["4019", "25000"]


def test_ties_at_the_limit_go_by_code(spark):
    df = spark.createDataFrame([(c,) for c in ["b", "c", "a", "d", "d"]], "icd9_dgns_cd_1 string")
    assert features.top_code_list(df, 3) == ["d", "a", "b"]


def test_diagnosis_features_match_the_combined_matrix(spark):
    base = features.patient_features(people(spark), stays(spark))
    out = features.diagnosis_features(base, stays(spark))
    matrix = features.feature_matrix(people(spark), stays(spark))
    assert out.columns == matrix.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, matrix.collect()))
    flags = {r.desynpuf_id: (r.diag_4019, r.diag_25000, r.diag_V01) for r in out.collect()}
    assert flags == {"a": (1, 1, 0), "b": (1, 0, 0), "c": (0, 0, 0)}


def test_lookup_and_ids(spark):
    base = features.patient_features(people(spark), stays(spark))
    found = {r.feature: r.value for r in features.patient_lookup(base, "b").collect()}
    assert found["desynpuf_id"] == "b" and found["age"] == "58" and found["sp_chf"] is None
    assert features.patient_lookup(base, "nobody").isEmpty()
    assert [r[0] for r in features.patient_ids(base, 2).collect()] == ["a", "b"]


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3, "x", dt.date(2008, 1, 1))], "ICD9_DGNS_CD_1 int, ICD9_PRCDR_CD_1 int, SP_CHF int, t string, d date")
    assert columns.diagnosis_columns(df) == ["ICD9_DGNS_CD_1"]
    assert columns.code_columns(df) == ["ICD9_DGNS_CD_1", "ICD9_PRCDR_CD_1"]
    assert columns.starting(df, "sp_") == ["SP_CHF"]
    assert columns.present(df, ["sp_chf", "missing"]) == ["sp_chf"]
    assert columns.numeric_columns(df) == ["ICD9_DGNS_CD_1", "ICD9_PRCDR_CD_1", "SP_CHF"]


def test_latest_record_is_a_total_order(spark):
    rows = [("p", 2001, 19300101, x) for x in range(20)]
    schema = "desynpuf_id string, year int, bene_birth_dt int, x int"
    chosen = {features.latest_beneficiary(spark.createDataFrame(rows[::step], schema).repartition(parts)).first().x for step in (1, -1) for parts in (1, 5)}
    assert len(chosen) == 1


def test_latest_only(spark):
    from claimlens.operators import dashboard, progression

    schema = "desynpuf_id string, year int, bene_birth_dt int, bene_sex_ident_cd string, sp_chf int, sp_copd int"
    rows = [("a", 2000, 1, "1", 1, 1), ("a", 2001, 1, "1", 1, 2), ("b", 2000, 1, "2", 1, 1)]
    people = spark.createDataFrame(rows, schema)
    pair = ["sp_chf", "sp_copd"]
    assert [tuple(r) for r in progression.comorbidity_pairs(people, pair).collect()] == [("chf & copd", 2)]
    assert [tuple(r) for r in progression.comorbidity_pairs(people, pair, latest_only=True).collect()] == [("chf & copd", 1)]
    assert {tuple(r) for r in dashboard.count_by_sex(people, latest_only=True).collect()} == {("1", 1), ("2", 1)}
