"""Cleaning, joining, filtering and listing claims."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlens.functions.expressions import lenient_amount, lenient_date, strict_date
from claimlens.operators import claims, dashboard, progression

D = dt.date


def test_lenient_dates_and_amounts(spark):
    df = spark.createDataFrame([("20080229", "12.50"), ("20090229", "n/a"), ("0", None), (None, "-3")], "d string, a string")
    out = df.select(lenient_date("d"), lenient_amount("a").cast("double")).collect()
    assert [tuple(r) for r in out] == [(D(2008, 2, 29), 12.5), (None, None), (None, None), (None, -3.0)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_dates_fail(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        good = spark.createDataFrame([(20080101,), (None,)], "d int")
        assert [r[0] for r in good.select(strict_date("d")).collect()] == [D(2008, 1, 1), None]
        bad = spark.createDataFrame([(20080132,)], "d int")
        with pytest.raises(Exception, match="not a yyyymmdd date"):
            bad.select(strict_date("d")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.fixture(scope="module")
def sides(spark):
    inpatient = spark.createDataFrame(
        [("p1", 1, 20080105, 20080107, "100.00", 2), ("p2", 2, 0, 0, "n/a", None)],
        "desynpuf_id string, clm_id int, clm_admsn_dt int, clm_thru_dt int, clm_pmt_amt string, clm_utlztn_day_cnt int",
    )
    outpatient = spark.createDataFrame(
        [("p1", 3, 20090105, 20090105, "5")],
        "desynpuf_id string, clm_id int, clm_from_dt int, clm_thru_dt int, clm_pmt_amt string",
    )
    return inpatient, outpatient


def test_clean_claims(sides):
    out = claims.clean_claims(*sides)
    found = {r.clm_id: (r.claim_type, r.admit_date, r.discharge_date, r.clm_pmt_amt) for r in out.collect()}
    assert found[1][:3] == ("Inpatient", D(2008, 1, 5), D(2008, 1, 7))
    assert found[2] == ("Inpatient", None, None, None)
    assert found[3][:3] == ("Outpatient", D(2009, 1, 5), D(2009, 1, 5))


def test_clean_claims_with_missing_sides(sides):
    assert claims.clean_claims(sides[0], None).count() == 2
    assert claims.clean_claims(None, sides[1]).count() == 1
    assert claims.clean_claims(None, None) is None


def test_demographics(spark, sides):
    people = spark.createDataFrame(
        [("p1", 2008, 19300101), ("p1", 2009, 19300101)], "desynpuf_id string, year int, bene_birth_dt int"
    )
    cleaned = claims.clean_claims(*sides)
    once = {r.clm_id: (r.year, r.age) for r in claims.claims_demographics(cleaned, people).collect()}
    assert once == {1: (2008, 78), 2: (None, None), 3: (2009, 79)}
    assert claims.claims_demographics(cleaned, people, by_year=False).count() == 5


def test_empty_filters_keep_everything(spark):
    df = spark.createDataFrame([("Inpatient", 2008, 70), ("Outpatient", None, None)], "claim_type string, year int, age int")
    assert claims.filter_claims(df).count() == 2
    assert claims.filter_claims(df, years=[], claim_types=[], code_query="").count() == 2
    assert claims.filter_claims(df, age_range=(70, 70)).count() == 1
    assert claims.filter_claims(df, claim_types=["Outpatient"]).count() == 1


def test_code_search_is_a_case_sensitive_part_match(spark):
    df = spark.createDataFrame(
        [(1, "4019", None), (2, "V401", None), (3, None, "x40"), (4, None, None)],
        "clm_id int, icd9_dgns_cd_1 string, icd9_prcdr_cd_1 string",
    )
    def found(q):
        return sorted(r.clm_id for r in claims.search_codes(df, q).collect())
    assert found("40") == [1, 2, 3]
    assert found("v4") == []
    assert found("nan") == []
    assert found("None") == []


def test_claims_table_is_cut_and_ordered(spark):
    df = spark.createDataFrame(
        [(i, "p", D(2008, 1, 1 + i % 3) if i else None) for i in range(6)], "clm_id int, desynpuf_id string, admit_date date"
    )
    out = [(r.admit_date, r.clm_id) for r in claims.claims_table(df, 5).collect()]
    assert out == [(D(2008, 1, 1), 3), (D(2008, 1, 2), 1), (D(2008, 1, 2), 4), (D(2008, 1, 3), 2), (D(2008, 1, 3), 5)]


def test_conditions_and_pairs(spark):
    df = spark.createDataFrame(
        [(2008, 1, 1, 2), (2008, 1, None, 2), (2009, 2, 2, 2)], "year int, sp_chf int, sp_diabetes int, sp_copd int"
    )
    counts = {r.condition: r.n for r in dashboard.condition_counts(df).collect()}
    assert counts == {"chf": 2, "diabetes": 1, "copd": 0}
    prevalence = {r.year: (r.sp_chf, r.sp_diabetes) for r in progression.condition_prevalence(df).collect()}
    assert prevalence == {2008: (100.0, 50.0), 2009: (0.0, 0.0)}
    assert [tuple(r) for r in progression.comorbidity_pairs(df).collect()] == [("chf & diabetes", 1)]


def test_a_wider_column_list_is_allowed(spark):
    df = spark.createDataFrame([(1, 1)], "sp_chf int, sp_state_code int")
    wide = dashboard.condition_counts(df, ["sp_chf", "sp_state_code"])
    assert {r.condition for r in wide.collect()} == {"chf", "state_code"}


def test_monthly_sums_skip_unknown_dates(spark):
    df = spark.createDataFrame(
        [(D(2008, 1, 3), "Inpatient", 1.5), (D(2008, 1, 30), "Inpatient", 2.0), (None, "Inpatient", 9.0), (D(2008, 2, 1), "Inpatient", None)],
        "admit_date date, claim_type string, clm_pmt_amt double",
    )
    found = sorted(tuple(r) for r in dashboard.monthly_reimbursement(df).collect())
    assert found == [(D(2008, 1, 1), "Inpatient", 3.5), (D(2008, 2, 1), "Inpatient", 0.0)]
    assert dashboard.reimbursement_by_type(df).select(F.col("amount")).first()[0] == 12.5
