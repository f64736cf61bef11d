"""Scalar column expressions. All of them are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: dates arrive as yyyymmdd.
DATE_FORMAT = "yyyyMMdd"


def lenient_date(column: Column | str) -> Column:
    """yyyymmdd as a date; a value that is not a date becomes null."""
    text = F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, DATE_FORMAT))


def strict_date(column: Column | str) -> Column:
    """yyyymmdd as a date; a value that is not a date fails the query, whatever the ANSI setting."""
    raw = F.col(column) if isinstance(column, str) else column
    failure = F.raise_error(F.concat(F.lit("not a yyyymmdd date: "), raw.cast("string")))
    return F.when(raw.isNotNull(), F.coalesce(lenient_date(raw), failure.cast("date")))


def lenient_amount(column: Column | str) -> Column:
    """Text as money; text that is not a number becomes null."""
    raw = F.col(column) if isinstance(column, str) else column
    return raw.try_cast("decimal(18,2)")


def age(year: Column, birth_date: Column) -> Column:
    return year - F.year(birth_date)


def has_condition(column: str) -> Column:
    """1 where the indicator says yes; no and unknown are 0."""
    return F.when(F.col(column) == 1, 1).otherwise(0)


def within_days(gap: Column, days: int) -> Column:
    """1 where the next admission follows within the horizon, limits included; unknown gap is 0."""
    return F.coalesce((gap <= days).cast("int"), F.lit(0))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def any_contains(columns: list[str], query: str) -> Column:
    """True where any of the columns contains the text, case-sensitive; nulls never match."""
    hits = [F.coalesce(F.col(c).contains(query), F.lit(False)) for c in columns]
    return reduce(lambda left, right: left | right, hits)


def risk_tier(probability: Column) -> Column:
    """High above 0.7, Medium above 0.3, else Low; null stays null."""
    return (
        F.when(probability > 0.7, "High").when(probability > 0.3, "Medium").when(probability.isNotNull(), "Low")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, and 0 where the denominator is 0."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def money_sum(column: str) -> Column:
    """Exact sum of a money column, returned as a double."""
    return F.coalesce(F.sum(F.col(column).cast("decimal(18,2)")), F.lit(0)).cast("double")


def stable_hash(*columns: str, seed: int = 0) -> Column:
    """A 52-bit hash of the key columns as a whole double, the same in every engine that has md5."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
