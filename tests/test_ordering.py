"""Order statistics and running sums against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.functions import ordering
from claimlens.functions.ordering import last_of_first, order_statistics, quantile, running_sums

PLACES = {"q0": quantile(0.0), "q1": quantile(0.25), "q2": quantile(0.5), "q3": quantile(0.75), "q4": quantile(1.0)}


def samples(kind, n=20_000):
    rng = np.random.default_rng(5)
    if kind == "normal":
        return rng.normal(size=n)
    if kind == "heavy tail":
        return np.exp(rng.normal(size=n) * 4)
    if kind == "few values":
        return rng.integers(0, 13, size=n).astype(float)
    if kind == "one hot value":
        return np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))
    return np.full(n, 3.0)


@pytest.mark.parametrize("kind", ["normal", "heavy tail", "few values", "one hot value", "constant"])
def test_quantiles_are_exact(spark, kind):
    values = samples(kind)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    row = order_statistics(df, ["v"], PLACES).first()
    expected = np.quantile(values, [0, 0.25, 0.5, 0.75, 1])
    assert np.allclose([row[p] for p in PLACES], expected, rtol=1e-12)
    assert row.n == len(values)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_few_rows_with_gaps_and_groups(spark, n):
    data = [(g, float(i * i), None if i % 2 else 1.0) for g in "ab" for i in range(n)] + [("a", None, None), ("b", float("nan"), None)]
    df = spark.createDataFrame(data, "g string, v double, w double")
    out = {(r.g, r.variable): r for r in order_statistics(df, ["v", "w"], PLACES, by=["g"]).collect()}
    expected = np.quantile([i * i for i in range(n)], [0, 0.25, 0.5, 0.75, 1])
    for g in "ab":
        assert np.allclose([out[g, "v"][p] for p in PLACES], expected)
        assert out[g, "w"].n == (n + 1) // 2


def test_last_of_first(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)], "v double")
    row = order_statistics(df, ["v"], {"cut": last_of_first(0.2)}).first()
    assert row["cut"] == 199.0


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v), int(c)) for g in "ab" for v, c in zip(rng.permutation(500) / 500, rng.integers(0, 9, 500))]
    df = spark.createDataFrame(data, "g string, v double, c long")
    out = running_sums(df, ["g"], "v", ["c"])
    for r in out.collect():
        assert r.c_upto == sum(c for g, v, c in data if g == r.g and v >= r.v)
        assert r.c_all == sum(c for g, v, c in data if g == r.g)


@pytest.fixture
def compiled(spark):
    """Whole-stage code for the large cases; the other tests do without."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture
def windows(monkeypatch):
    """Rows of the largest window of each round."""
    seen = []
    holding = ordering._holding

    def watched(counts, places):
        keys = [c for c in ("_i", "_low", "_high") if c in counts.columns and "_least" in counts.columns or c == "_i"]
        seen.append(counts.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return holding(counts, places)

    monkeypatch.setattr(ordering, "_holding", watched)
    return seen


@pytest.mark.parametrize("rows", [1_000_000, 10_000_000])
def test_windows_do_not_grow_with_the_rows(spark, compiled, windows, rows):
    df = spark.range(rows).select(F.xxhash64("id").cast("double").alias("v"))
    row = order_statistics(df, ["v"], {"median": quantile(0.5)}).first()
    assert df.filter(F.col("v") <= row["median"]).count() == rows // 2 and row.n == rows
    assert 2 <= len(windows) <= 5 and max(windows) <= 70_000


@pytest.mark.parametrize("kind", ["geometric", "close", "subnormal", "mixed signs"])
def test_hard_ranges_are_split_to_the_last_digit(spark, windows, monkeypatch, kind):
    monkeypatch.setattr(ordering, "SPLITS", 4)  # many rounds on few rows
    rng = np.random.default_rng(3)
    n = 500
    values = {
        "geometric": 2.0 ** rng.uniform(-1000, 1000, n),
        "close": 1.0 + rng.integers(0, 400, n) * 2.0**-52,
        "subnormal": rng.integers(0, 300, n) * 5e-324,
        "mixed signs": np.append(rng.normal(size=n) * 1e-3, [0.0, -0.0, np.inf, -np.inf]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    row = order_statistics(df, ["v"], {"q1": quantile(0.25), "q2": quantile(0.5), "q3": quantile(0.75)}).first()
    ordered = np.sort(values)
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        place = (len(values) - 1) * p
        low, high = ordered[int(place)], ordered[int(np.ceil(place))]
        assert row[name] == (low if low == high else low + (high - low) * (place - int(place)))
    assert max(windows[1:], default=0) <= 4 + 1


def test_counted_rows_and_means(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2), (None, 5)], "v double, c long")
    row = order_statistics(df, ["v"], {"m": quantile(0.5)}, mean="mean", rows="c").first()
    assert (row.n, row.m, row["mean"]) == (6, 1.5, 23 / 6)


def test_running_sums_of_ten_million_distinct_scores(spark, compiled):
    n = 10_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.xxhash64("id") / 1e19).alias("v"), F.lit(1).cast("long").alias("c"))
    out = running_sums(df, ["g"], "v", ["c"])
    row = out.agg(F.min("c_upto"), F.max("c_upto"), F.sum("c_upto"), F.count_distinct("c_all")).first()
    assert tuple(row) == (1, n, n * (n + 1) // 2, 1)


def test_ranges_of_running_sums_are_bounded(spark, rows):
    rng = np.random.default_rng(1)
    data = [(g, float(v), int(c)) for g in "abc" for v, c in zip(rng.permutation(500) / 5e7, rng.integers(0, 9, 500))]
    df = spark.createDataFrame(data, "g string, v double, c long").repartition(5)
    assert rows(running_sums(df, ["g"], "v", ["c"], range_rows=40)) == rows(running_sums(df, ["g"], "v", ["c"]))


def test_null_groups_and_infinite_values(spark):
    rows = [("a", 1.0), ("a", float("inf")), ("a", float("-inf")), (None, 5.0), ("b", None)]
    out = order_statistics(spark.createDataFrame(rows, "g string, v double"), ["v"], {"m": quantile(0.5)}, by=["g"]).collect()
    assert [(r.g, r.n, r.m) for r in out] == [("a", 3, 1.0)]


def test_later_rounds_read_only_columns_that_are_not_settled(spark, monkeypatch):
    seen, holding = [], ordering._holding
    monkeypatch.setattr(ordering, "_holding", lambda counts, places: (seen.append(counts), holding(counts, places))[1])
    df = spark.createDataFrame([(1.0, 16 + i / 1000, None) for i in range(101)], "flag double, x double, none double")
    found = ordering.order_statistics(df, ["flag", "x", "none"], {"m": ordering.quantile(0.5)})
    assert {r.variable: r.m for r in found.collect()} == {"flag": 1.0, "x": 16.05}
    plans = [c._jdf.queryExecution().executedPlan().toString() for c in seen]
    assert len(plans) > 1 and all("_c1" in p for p in plans) and "_c0" in plans[0]
    assert not any("_c0" in p or "_c2" in p for p in plans[1:])
