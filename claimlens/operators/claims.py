"""Claims: cleaning, union of inpatient and outpatient, demographics, filters and the claims table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.columns import CLAIM_DISPLAY, code_columns, has, present
from claimlens.functions.expressions import age, any_contains, lenient_amount, lenient_date, strict_date


def parse_admission_dates(inpatient: DataFrame) -> DataFrame:
    """Admit and discharge dates of inpatient claims; a malformed date fails the query."""
    return inpatient.withColumns(
        {"admit_date": strict_date("clm_admsn_dt"), "discharge_date": strict_date("clm_thru_dt")}
    )


def clean_side(claims: DataFrame, admit_source: str, claim_type: str) -> DataFrame:
    """One side of the claims with lenient dates and amount, tagged by type. Absent columns are skipped."""
    changes = {}
    if has(claims, admit_source):
        changes["admit_date"] = lenient_date(admit_source)
    if has(claims, "clm_thru_dt"):
        changes["discharge_date"] = lenient_date("clm_thru_dt")
    if has(claims, "clm_pmt_amt"):
        changes["clm_pmt_amt"] = lenient_amount("clm_pmt_amt")
    return claims.withColumns({**changes, "claim_type": F.lit(claim_type)})


def clean_claims(inpatient: DataFrame | None, outpatient: DataFrame | None) -> DataFrame | None:
    """Inpatient and outpatient claims as one table; one missing side is left out, both missing give None."""
    sides = []
    if inpatient is not None:
        sides.append(clean_side(inpatient, "clm_admsn_dt", "Inpatient"))
    if outpatient is not None:
        sides.append(clean_side(outpatient, "clm_from_dt", "Outpatient"))
    if not sides:
        return None
    if len(sides) == 1:
        return sides[0]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def with_age(beneficiaries: DataFrame) -> DataFrame:
    """AGE = record year − birth year, from a yyyymmdd birth date."""
    return beneficiaries.withColumn("age", age(F.col("year"), lenient_date("bene_birth_dt")))


def claims_demographics(claims: DataFrame, beneficiaries: DataFrame, by_year: bool = True, years: Sequence[int] = ()) -> DataFrame:
    """Claims with the patient's age and record year, every claim kept.

    ``by_year`` matches the record of the admission year, so a claim stays one row. Without it a
    claim meets every yearly record of its patient, and sums over the result count it once per year.
    ``years`` says that only these record years are wanted: other claims and records are left out
    before the join (claims only with ``by_year``, where the admission tells the year).
    """
    if years:
        beneficiaries = beneficiaries.filter(F.col("year").isin(list(years)))
        if by_year:
            first, last = F.make_date(F.lit(min(years)), F.lit(1), F.lit(1)), F.make_date(F.lit(max(years)), F.lit(12), F.lit(31))
            claims = claims.filter(F.col("admit_date").between(first, last))
    if not has(beneficiaries, "age") and has(beneficiaries, "bene_birth_dt"):
        beneficiaries = with_age(beneficiaries)
    people = beneficiaries.select(*present(beneficiaries, ["desynpuf_id", "age", "year"]))
    if not by_year:
        return claims.join(people, "desynpuf_id", "left")
    people = people.withColumnRenamed("desynpuf_id", "_patient")
    same_patient_year = (F.col("desynpuf_id") == F.col("_patient")) & (F.year("admit_date") == F.col("year"))
    return claims.join(people, same_patient_year, "left").drop("_patient")


def filter_claims(
    claims: DataFrame,
    years: Sequence[int] = (),
    claim_types: Sequence[str] = (),
    age_range: tuple[int, int] | None = None,
    code_query: str = "",
) -> DataFrame:
    """Dashboard filters. An empty list or text means no filter; the age range includes both ends."""
    out = claims
    if years and has(out, "year"):
        out = out.filter(F.col("year").isin(list(years)))
    if claim_types:
        out = out.filter(F.col("claim_type").isin(list(claim_types)))
    if age_range is not None and has(out, "age"):
        out = out.filter(F.col("age").between(*age_range))
    if code_query:
        out = search_codes(out, code_query)
    return out


def search_codes(claims: DataFrame, query: str) -> DataFrame:
    """Claims with the text anywhere in any diagnosis or procedure code."""
    codes = code_columns(claims)
    return claims.filter(any_contains(codes, query)) if codes else claims


def claims_table(claims: DataFrame, n: int = 1000) -> DataFrame:
    """The first n claims by admit date with the display columns that exist. Ties go by claim id, then year."""
    tie_break = present(claims, ["clm_id", "year"])
    return (
        claims.orderBy(F.col("admit_date").asc_nulls_last(), *tie_break)
        .limit(n)
        .select(*present(claims, CLAIM_DISPLAY), *present(claims, ["clm_id"]))
    )


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """Any n rows, read from as few files as needed."""
    return df.limit(n)
