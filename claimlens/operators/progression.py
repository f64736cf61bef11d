"""Condition prevalence over the years and comorbidity pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.columns import CONDITIONS, present
from claimlens.operators.features import latest_beneficiary


def _masks(beneficiaries: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Records per set of present conditions, a bit each; so few rows that all else follows from them."""
    bits = sum((F.when(F.col(c) == 1, 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    return beneficiaries.groupBy(*by, bits.alias("_mask")).agg(F.count("*").alias("_rows"))


def _with_all(*bits: int) -> Column:
    wanted = sum(1 << b for b in bits)
    return F.sum(F.when(F.col("_mask").bitwiseAND(wanted) == wanted, F.col("_rows")).otherwise(0))


def condition_prevalence(beneficiaries: DataFrame, columns: Sequence[str] = tuple(CONDITIONS)) -> DataFrame:
    """Per year, the share in % of records with each condition; an unknown indicator counts as no."""
    names = present(beneficiaries, columns)
    share = [(_with_all(i) * 100.0 / F.sum("_rows")).alias(c) for i, c in enumerate(names)]
    return _masks(beneficiaries, names, ["year"]).groupBy("year").agg(F.sum("_rows").alias("n"), *share)


def comorbidity_pairs(beneficiaries: DataFrame, columns: Sequence[str] = tuple(CONDITIONS), latest_only: bool = False) -> DataFrame:
    """Records in which both conditions of a pair are present, for the pairs that occur.

    ``latest_only`` counts each patient's latest record instead of all yearly ones. The pairs come from the
    fixed column list and are sums over the sets of conditions that occur.
    """
    if latest_only:
        beneficiaries = latest_beneficiary(beneficiaries)
    names = present(beneficiaries, columns)
    label = {c: c[3:] if c.lower().startswith("sp_") else c for c in names}
    pairs = {f"{label[names[i]]} & {label[names[j]]}": _with_all(i, j) for i, j in combinations(range(len(names)), 2)}
    wide = _masks(beneficiaries, names).agg(*[count.alias(pair) for pair, count in pairs.items()])
    return wide.unpivot([], [f"`{p}`" for p in pairs], "pair", "n").filter("n > 0")


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("n"), "pair").limit(n)
