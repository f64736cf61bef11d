"""Column profiles: the numbers behind each exploratory chart."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.ordering import long_form, order_statistics, quantile
from claimlens.session import stored

QUARTILES = {"q1": quantile(0.25), "median": quantile(0.5), "q3": quantile(0.75)}


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of each column occurs. All columns share one scan and one aggregation."""
    return long_form(df, columns, data_type="string").groupBy("variable", "value").agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share in % of each value among the filled cells of its column."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("variable").agg(F.sum("n").alias("_total"))
    return (
        counts.join(F.broadcast(totals), "variable")
        .withColumn("share", F.col("n") * 100.0 / F.col("_total"))
        .drop("_total")
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by column value. ``values`` lists the column values, so no job runs to find them."""
    known = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return known.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def _narrow(df: DataFrame, columns: Sequence[str], kept: bool) -> DataFrame:
    """The columns as a stored table, since they are read in several passes."""
    return df if kept else stored(df.select(*[F.col(f"`{c}`") for c in columns]))


def _ranges(df: DataFrame, columns: Sequence[str], bins: int | str, kept: bool = False) -> DataFrame:
    """(variable, low, high, bins): the histogram range of each column; one row per column."""
    if bins == "auto":
        stats = order_statistics(
            df, columns, {"least": quantile(0.0), "most": quantile(1.0), "q1": QUARTILES["q1"], "q3": QUARTILES["q3"]}, kept=kept
        )
        spread = F.col("most") - F.col("least")
        rows = F.col("n").cast("double")
        by_count = spread / (F.log2(rows) + 1)
        by_quartiles = 2 * (F.col("q3") - F.col("q1")) / F.cbrt(rows)
        width = F.when(by_quartiles > 0, F.least(by_quartiles, by_count)).otherwise(by_count)
        number = F.when(spread > 0, F.ceil(spread / width)).otherwise(1).cast("int")
    else:
        stats = _extremes(df, columns)
        number = F.lit(int(bins))
    half = F.when(F.col("least") == F.col("most"), 0.5).otherwise(0.0)
    return stats.select(
        "variable", (F.col("least") - half).alias("low"), (F.col("most") + half).alias("high"), number.alias("bins")
    )


def _extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, least, most) from one wide aggregation; a column without a value has no row."""
    cell = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    rows = [F.struct(F.lit(c).alias("variable"), F.min(cell(c)).alias("least"), F.max(cell(c)).alias("most")) for c in columns]
    return df.agg(F.array(*rows).alias("_columns")).select(F.inline("_columns")).filter("least is not null")


def histogram(df: DataFrame, columns: Sequence[str], bins: int | str = 20) -> DataFrame:
    """Equal-width bins over each column's range, the last one closed; empty bins are listed with 0.

    ``bins='auto'`` takes the finer of the count rule and the quartile rule.
    """
    ranges = _ranges(df, columns, bins)
    counts = (
        long_form(df, columns)
        .join(F.broadcast(ranges), "variable")
        .groupBy("variable", _bin().alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    return _all_bins(ranges, counts)


def _bin() -> Column:
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins"))
    return F.least(place, F.col("bins") - 1).cast("int")


def _all_bins(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """Every bin of every column with its edges and its count, 0 where none was counted."""
    width = (F.col("high") - F.col("low")) / F.col("bins")
    frame = ranges.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")).select(
        "variable",
        "bin",
        (F.col("low") + width * F.col("bin")).alias("bin_start"),
        (F.col("low") + width * (F.col("bin") + 1)).alias("bin_end"),
    )
    return frame.join(counts, ["variable", "bin"], "left").na.fill(0, ["n"])


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and exact median per numeric column."""
    return order_statistics(df, columns, {"median": quantile(0.5)}, mean="mean")


#: A grid point sums the kernels of so many distinct values at a time.
KERNEL_VALUES = 4096


def density(df: DataFrame, columns: str | Sequence[str], points: int = 200) -> DataFrame:
    """Gaussian density estimate on an even grid over each column's range, bandwidth by Scott's rule.

    (point, x, density), with the column's name first if several are given. Null and NaN are left out, and a
    column without spread has no density. Equal values are counted first, and a kernel is evaluated once for
    each distinct value and grid point, in blocks of values.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    out = _density(stored(long_form(df, names).groupBy("variable", "value").agg(F.count("*").alias("rows"))), points)
    return out.drop("variable") if isinstance(columns, str) else out


def _density(counts: DataFrame, points: int) -> DataFrame:
    """The density from a stored table (variable, value, rows) of distinct values."""
    rows, value = F.col("rows").cast("double"), F.col("value")
    first = counts.groupBy("variable").agg(
        F.sum("rows").alias("n"), (F.sum(rows * value) / F.sum(rows)).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    spread = F.sqrt(F.sum(rows * F.pow(value - F.col("mean"), 2)) / (F.first("n") - 1))
    stats = counts.join(F.broadcast(first), "variable").groupBy("variable", "n", "low", "high").agg(spread.alias("sd"))
    bandwidth = (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth")
    usable = stats.filter("sd > 0").select("variable", "n", "low", "high", bandwidth)
    block = F.pmod(F.xxhash64("value"), F.greatest(F.ceil(F.col("_values") / KERNEL_VALUES), F.lit(1)))
    sizes = counts.groupBy("variable").agg(F.count("*").alias("_values"))
    blocks = (
        counts.join(F.broadcast(sizes), "variable")
        .groupBy("variable", block.alias("_block"))
        .agg(F.collect_list(F.struct("value", "rows")).alias("_held"))
    )
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1)
    grid = usable.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).withColumn("x", x)
    kernel = lambda total, held: total + held["rows"] * F.exp(-0.5 * F.pow((F.col("x") - held["value"]) / F.col("bandwidth"), 2))
    sums = (
        blocks.join(F.broadcast(grid), "variable")
        .select("variable", "point", "x", "n", "bandwidth", F.aggregate("_held", F.lit(0.0), kernel).alias("_sum"))
        .groupBy("variable", "point", "x", "n", "bandwidth")
        .agg(F.sum("_sum").alias("_sum"))
    )
    return sums.select(
        "variable", "point", "x", (F.col("_sum") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density")
    )


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and the number of values beyond them.

    The columns are stored once; the quartiles come from counts of ranges, the rest from one wide aggregation.
    """
    narrow = _narrow(df, columns, False)
    quartiles = order_statistics(narrow, columns, QUARTILES, kept=True)
    found = {r.variable: r for r in quartiles.collect()}
    measures = []
    for k, (name, r) in enumerate(found.items()):
        value, reach = F.col(f"`{name}`").cast("double"), 1.5 * (r.q3 - r.q1)
        above, below = value >= r.q1 - reach, value <= r.q3 + reach
        valid = value.isNotNull() & ~F.isnan(value)
        measures.append(
            F.struct(
                F.lit(name).alias("variable"),
                F.least(F.min(F.when(valid & above, value)), F.lit(r.q1)).alias("whisker_low"),
                F.greatest(F.max(F.when(valid & below, value)), F.lit(r.q3)).alias("whisker_high"),
                F.count_if(valid & ~(above & below)).alias("outliers"),
            )
        )
    if not measures:
        return quartiles.selectExpr("variable", "n", "q1 AS whisker_low", "q1", "median", "q3", "q3 AS whisker_high", "n AS outliers")
    rest = narrow.agg(F.array(*measures).alias("_columns")).select(F.inline("_columns"))
    return quartiles.join(F.broadcast(rest), "variable").select(
        "variable", "n", "whisker_low", "q1", "median", "q3", "whisker_high", "outliers"
    )


def condition_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plain sum of each indicator column."""
    wide = df.agg(*[F.sum(c).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "condition", "total")


def non_null_counts(df: DataFrame) -> DataFrame:
    """Type, row count and filled cells per column."""
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in names])
    types = F.create_map(*[F.lit(v) for pair in df.dtypes for v in pair])
    return (
        wide.unpivot(["_rows"], [f"`{c}`" for c in names], "variable", "non_null")
        .select("variable", types[F.col("variable")].alias("data_type"), F.col("_rows").alias("n"), "non_null")
    )


def profile_table(df: DataFrame, skip: Sequence[str] = (), bins: int | str = "auto", curve: bool = False) -> DataFrame:
    """Profile of every column by its type, as (variable, statistic, item, value) rows.

    Text columns give value counts; numeric columns give a histogram, the mean, the median and, with
    ``curve``, the density. The source is scanned once: its columns are stored, and after the pass that finds the
    ranges one aggregation of that table counts the texts and the bins and sums the numbers.
    """
    fields = [f for f in df.schema.fields if f.name not in skip]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    if not texts and not numbers:
        raise ValueError("no text or numeric column to profile")
    narrow = _narrow(df, [*texts, *numbers], False)
    ranges = _ranges(narrow, numbers, bins, kept=True) if numbers else None
    cell = lambda name, text, number: F.struct(F.lit(name).alias("variable"), text.cast("string").alias("item"), number.cast("double").alias("value"))
    none = F.lit(None)
    cells = [cell(c, F.col(f"`{c}`"), none) for c in texts] + [cell(c, none, F.col(f"`{c}`")) for c in numbers]
    long = narrow.select(F.inline(F.array(*cells))).filter(F.col("item").isNotNull() | (F.col("value").isNotNull() & ~F.isnan("value")))
    if ranges is not None:
        long = long.join(F.broadcast(ranges), "variable", "left")
    long = long.withColumn("bin", _bin() if ranges is not None else F.lit(None).cast("int"))
    counts = stored(long.groupBy("variable", "item", "bin").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    parts = []
    if texts:
        parts.append(counts.filter("bin is null").select("variable", F.lit("count").alias("statistic"), "item", F.col("n").cast("double").alias("value")))
    if numbers:
        binned = counts.filter("bin is not null")
        parts.append(
            _all_bins(ranges, binned.select("variable", "bin", "n")).select(
                "variable", F.lit("histogram").alias("statistic"), F.col("bin").cast("string").alias("item"), F.col("n").cast("double").alias("value")
            )
        )
        blank = F.lit("").alias("item")
        parts.append(binned.groupBy("variable").agg((F.sum("total") / F.sum("n")).alias("value")).select("variable", F.lit("mean").alias("statistic"), blank, "value"))
        medians = order_statistics(narrow, numbers, {"value": quantile(0.5)}, kept=True)
        parts.append(medians.select("variable", F.lit("median").alias("statistic"), blank, "value"))
    if numbers and curve:
        parts.append(
            density(narrow, numbers).select("variable", F.lit("density").alias("statistic"), F.col("x").cast("string").alias("item"), F.col("density").alias("value"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
