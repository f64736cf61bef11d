"""Column names and fixed values of the claims data model, and selection of columns by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The eleven chronic-condition indicators, in file order (1 = yes, 2 = no).
CONDITIONS = [
    "sp_alzhdmta",
    "sp_chf",
    "sp_chrnkidn",
    "sp_cncr",
    "sp_copd",
    "sp_depressn",
    "sp_diabetes",
    "sp_ischmcht",
    "sp_osteoprs",
    "sp_ra_oa",
    "sp_strketia",
]

# Readmission horizons in days.
HORIZONS = [30, 60, 90]

# Model names in the order that decides ties.
MODELS = [
    "Logistic Regression",
    "Random Forest",
    "Gradient Boosting",
    "Weighted Gradient Boosting",
    "Multilayer Perceptron",
]

COVERAGE_MONTHS = [
    "bene_hi_cvrage_tot_mons",
    "bene_smi_cvrage_tot_mons",
    "bene_hmo_cvrage_tot_mons",
    "plan_cvrg_mos_num",
]
REIMBURSEMENTS = ["medreimb_ip", "medreimb_op", "medreimb_car"]
BENEFICIARY_SHARES = ["benres_ip", "benres_op", "benres_car"]
PRIMARY_PAYER = ["pppymt_ip", "pppymt_op", "pppymt_car"]

DIAGNOSIS = "icd9_dgns_cd"
PROCEDURE = "icd9_prcdr_cd"

CLAIM_DISPLAY = [
    "desynpuf_id",
    "claim_type",
    "admit_date",
    "discharge_date",
    "clm_pmt_amt",
    "clm_utlztn_day_cnt",
]

# Columns that are never model inputs, and name parts that exclude a column.
NON_FEATURES = [
    "desynpuf_id",
    "bene_birth_dt",
    "clm_id",
    "clm_from_dt",
    "clm_thru_dt",
    "admit_date",
    "discharge_date",
    "clm_admsn_dt",
    "days_to_readmit",
    "readmit_30",
    "readmit_60",
    "readmit_90",
]
NON_FEATURE_PARTS = ["icd9", "hcpcs", "_cd", "prvdr"]


def containing(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose name contains any of the parts, in frame order, ignoring case."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The listed names that exist in the frame, in the order of the list."""
    have = {c.lower() for c in df.columns}
    return [n for n in names if n.lower() in have]


def has(df: DataFrame, name: str) -> bool:
    return bool(present(df, [name]))


def diagnosis_columns(df: DataFrame) -> list[str]:
    return containing(df, DIAGNOSIS)


def code_columns(df: DataFrame) -> list[str]:
    return containing(df, DIAGNOSIS, PROCEDURE)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def horizon_label(days: int) -> str:
    return f"readmit_{days}"
