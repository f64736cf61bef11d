"""Exact order statistics and running sums that never bring a whole column into one task.

A plain ``percentile`` keeps every distinct value of a column in one reducer, and a plain window over a few large
groups sorts each group in one task. Here both are answered from counts of ranges: a range that holds a wanted
place is split again until it is one value, and running sums go from range to range by a carry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import stored


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), data_type: str = "double") -> DataFrame:
    """(by…, variable, value) rows of the filled cells, all columns cast to one type."""
    cells = df.select(*by, *[F.col(f"`{c}`").cast(data_type).alias(c) for c in columns])
    long = cells.unpivot(list(by), [f"`{c}`" for c in columns], "variable", "value")
    filled = F.col("value").isNotNull()
    return long.filter(filled & ~F.isnan("value") if data_type == "double" else filled)


@dataclass(frozen=True)
class Position:
    """A 0-based place in the sorted values: ``at`` maps their number to it, ``share`` is its share of all rows."""

    share: float
    at: Callable[[Column], Column]


def quantile(p: float) -> Position:
    """The p-quantile with linear interpolation."""
    return Position(p, lambda n: (n - 1) * F.lit(float(p)))


def last_of_first(share: float) -> Position:
    """The last row of the first ``share`` of the rows, rounded to whole rows."""
    return Position(share, lambda n: F.greatest(F.round(n * F.lit(float(share))) - 1, F.lit(0.0)))


#: A range is split into so many parts, and a window over parts never has more rows than this.
SPLITS = 1 << 16
#: Parts of each doubling of the value in the first split. Doubles span 2**-1074 to 2**1024.
PER_DOUBLING = 16
#: So many ranges, some 10 MB, are sent to all tasks at most; more are joined.
BROADCAST_RANGES = 100_000


def _doubling(value: Column) -> Column:
    """The first split, for any range of doubles: sixteenths of powers of two, by sign. Infinities stand alone."""
    size = F.floor(PER_DOUBLING * (F.least(F.log2(F.abs(value)), F.lit(1030.0)) + 1075)) + 1
    return F.when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("int")


def _part(value: Column, low: Column, high: Column, rows: Column) -> Column:
    """Which part of [low, high] a value lies in; every value is a part of its own where the rows are few."""
    even = F.least(F.floor((value - low) / (high - low) * F.lit(float(SPLITS))), F.lit(float(SPLITS - 1))).cast("double")
    return F.when(rows <= SPLITS, value).otherwise(even)


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    positions: dict[str, Position],
    by: Sequence[str] = (),
    mean: str | None = None,
    rows: str | None = None,
    kept: bool = False,
) -> DataFrame:
    """Exact order statistics per column: (by…, variable, n, one column per position).

    ``mean`` names a further column with the mean. ``rows`` names a column of counts, so that a row stands for
    so many equal ones. ``kept`` says that the frame is a stored table; otherwise its columns are stored once.
    Rows whose ``by`` is null form no group. The same steps serve every size:

    1. The cells are counted by sixteenths of powers of two, with the least and greatest value of each part.
       Running counts tell in which parts the wanted places lie.
    2. A part that holds a wanted place and more than one value is split again: into ``SPLITS`` even ranges, or
       into its values where it has no more than so many rows. This is repeated until every place has its value,
       after 5 rounds at the latest, since each splits the 52 binary digits below the first 4 by 16.

    Each round is one aggregation with partial sums before the shuffle, and a window over at most ``SPLITS``
    counts for each column, group and place, however many rows there are. ``by`` must be a class-like key: the
    driver holds a few numbers for each group, column and place.
    """
    by, names = list(by), list(positions)
    plain = {f"_c{i}": c for i, c in enumerate(columns)}
    spark = df.sparkSession
    cells = df.select(*by, *([F.col(rows).alias("_n")] if rows else []), *[F.col(f"`{c}`").cast("double").alias(p) for p, c in plain.items()])
    if not kept:
        cells = stored(cells)
    for key in by:
        cells = cells.filter(F.col(key).isNotNull())
    if not plain:
        return spark.createDataFrame([], _schema(df, by, names, mean))

    def long_cells(numbers: Sequence[int]) -> DataFrame:
        """The filled cells of some columns, by number, as (by…, _i, _v); the other columns are not read."""
        cell = [F.struct(F.lit(i).alias("_i"), F.col(f"_c{i}").alias("_v")) for i in numbers]
        out = cells.select(*by, *(["_n"] if rows else []), F.inline(F.array(*cell)))
        return out.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))

    long = long_cells(range(len(plain)))
    group = [*by, "_i"]
    number = F.sum("_n") if rows else F.count("*")
    total = F.sum(F.col("_n") * F.col("_v")) if rows else F.sum("_v")

    # round 1
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    counts = long.groupBy(*group, _doubling(F.col("_v")).alias("_part")).agg(
        number.alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), total.alias("_sum")
    )
    counts = counts.withColumns({"_upto": F.sum("_rows").over(upto), "n": F.sum("_rows").over(whole), "_total": F.sum("_sum").over(whole)})
    places = F.array(*[f(positions[p].at(F.col("n"))).cast("long") for p in names for f in (F.floor, F.ceil)])
    exact = F.array(*[positions[p].at(F.col("n")).cast("double") for p in names])
    first = counts.withColumns({"_places": places, "_exact": exact})
    found: dict[tuple, dict] = {}
    wanted = []
    for r in _holding(first, F.col("_places")).collect():
        key = tuple(r[c] for c in group)
        mine = found.setdefault(key, {"n": r.n, "exact": r["_exact"], "total": r["_total"], "values": {}})
        _settle(mine, wanted, key, r, sorted(set(r["_places"])))

    # the rounds that follow look at the columns with wanted ranges, and at the cells of these ranges only
    fields = [*[df.schema[c] for c in by], *T._parse_datatype_string("_i int, _low double, _high double, _before long, _all long, _places array<long>").fields]
    inside = Window.partitionBy(*group, "_low", "_high").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    while wanted:
        ranges = spark.createDataFrame(wanted, T.StructType(fields))
        ranges = F.broadcast(ranges) if len(wanted) <= BROADCAST_RANGES else ranges
        long = long_cells(sorted({w[len(by)] for w in wanted}))
        wanted = []
        # not null-safe: groups with a null key were left out above
        met = long.join(ranges, group).filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
        split = met.withColumn("_part", _part(F.col("_v"), F.col("_low"), F.col("_high"), F.col("_all")))
        counts = split.groupBy(*group, "_low", "_high", "_before", "_part").agg(
            number.alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_places").alias("_places")
        )
        counts = counts.withColumn("_upto", F.col("_before") + F.sum("_rows").over(inside))
        for r in _holding(counts, F.col("_places")).drop("_low", "_high").withColumnsRenamed({"_least": "_low", "_most": "_high"}).collect():
            key = tuple(r[c] for c in group)
            _settle(found[key], wanted, key, r, r["_places"])

    out = []
    for key, mine in found.items():
        values = []
        for place in mine["exact"]:
            low, high = mine["values"][int(place // 1)], mine["values"][int(-(-place // 1))]
            values.append(low if low == high else low + (high - low) * (place - place // 1))
        out.append((*key[:-1], columns[key[-1]], mine["n"], *values, *([mine["total"] / mine["n"]] if mean else [])))
    return spark.createDataFrame(out, _schema(df, by, names, mean))


def _schema(df: DataFrame, by: Sequence[str], names: Sequence[str], mean: str | None) -> T.StructType:
    numbers = [T.StructField(n, T.DoubleType()) for n in [*names, *([mean] if mean else [])]]
    return T.StructType([*[df.schema[c] for c in by], T.StructField("variable", T.StringType()), T.StructField("n", T.LongType()), *numbers])


def _holding(counts: DataFrame, places: Column) -> DataFrame:
    """The parts in which one of the places lies; ``_upto`` counts the rows to the end of a part."""
    return counts.filter(F.exists(places, lambda p: (F.col("_upto") - F.col("_rows") <= p) & (p < F.col("_upto"))))


def _settle(mine: dict, wanted: list[tuple], key: tuple, r, places: Sequence[int]) -> None:
    """Note the value of the places in a part with one value, or ask for the part to be split."""
    before = r["_upto"] - r["_rows"]
    held = [p for p in places if before <= p < r["_upto"]]
    if r["_low"] == r["_high"]:
        mine["values"].update(dict.fromkeys(held, r["_low"]))
    else:
        wanted.append((*key, r["_low"], r["_high"], before, r["_rows"], held))


#: Rows that one task puts in order for running sums.
RANGE_ROWS = 250_000


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``<sum>_upto``, the sum over the rows of the group whose order value is at least this row's, and
    ``<sum>_all``, the sum of the group. Within a group the order values differ from each other.

    Rows are dealt into ranges of (group, value) of about ``range_rows`` each, so their number follows the input.
    Every range is put in order by itself; only one row for each range and group goes on to the carry,
    the sum of all ranges above. The rows are computed once and stored.
    """
    by = list(by)
    plain = stored(df)
    parts = max(1, -(-plain.count() // range_rows))
    if parts > 1:
        dealt = plain.repartitionByRange(parts, *by, F.desc(order)).withColumn("_range", F.spark_partition_id())
        rows = stored(dealt)
    else:
        rows = plain.withColumn("_range", F.lit(0))
    above = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carry = (
        rows.groupBy(*by, "_range")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by,
            "_range",
            *[F.coalesce(F.sum(s).over(above), F.lit(0)).alias(f"{s}_start") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums],
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumns({f"{s}_upto": F.sum(s).over(inside) for s in sums})
        .join(carry, [*by, "_range"])
        .withColumns({f"{s}_upto": F.col(f"{s}_start") + F.col(f"{s}_upto") for s in sums})
        .drop("_range", *[f"{s}_start" for s in sums])
    )
