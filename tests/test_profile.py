"""Column profiles against numpy."""

import numpy as np
import pytest

from claimlens.operators import profile


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x = np.append(rng.normal(50, 9, 400), [200.0, -90.0])
    df = spark.createDataFrame([(float(v), "ab"[i % 2], i) for i, v in enumerate(x)] + [(None, None, None)], "x double, c string, i int")
    return df, x


def test_histogram(sample):
    df, x = sample
    rows = sorted(profile.histogram(df, ["x"], 20).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram(x, 20)
    assert [r.n for r in rows] == counts.tolist()
    assert np.allclose([r.bin_start for r in rows] + [rows[-1].bin_end], edges)


def test_automatic_bins(sample):
    df, x = sample
    q1, q3 = np.quantile(x, [0.25, 0.75])
    width = min(2 * (q3 - q1) / len(x) ** (1 / 3), np.ptp(x) / (np.log2(len(x)) + 1))
    assert profile.histogram(df, ["x"], "auto").count() == np.ceil(np.ptp(x) / width)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    rows = sorted(profile.histogram(df, ["x"], 4).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram([3.0] * 5, 4)
    assert [r.n for r in rows] == counts.tolist() and rows[0].bin_start == edges[0]


def test_box_stats(sample):
    df, x = sample
    row = profile.box_stats(df, ["x"]).first()
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert (row.q1, row.median, row.q3) == pytest.approx((q1, q2, q3))
    assert (row.whisker_low, row.whisker_high) == pytest.approx((x[x >= low].min(), x[x <= high].max()))
    assert row.outliers == ((x < low) | (x > high)).sum()


def test_summary_and_density(sample):
    df, x = sample
    row = profile.numeric_summary(df, ["x"]).first()
    assert (row.n, row["mean"], row["median"]) == (len(x), pytest.approx(x.mean()), pytest.approx(np.median(x)))
    points = sorted(profile.density(df, "x", 50).collect(), key=lambda r: r.point)
    grid = np.linspace(x.min(), x.max(), 50)
    width = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(1) / (len(x) * width * np.sqrt(2 * np.pi))
    assert np.allclose([r.x for r in points], grid) and np.allclose([r.density for r in points], want)


def test_counts_shares_and_crosstab(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", None), (None, "x")], "r string, c string")
    counts = {(r.variable, r.value): r.n for r in profile.value_counts(df, ["r", "c"]).collect()}
    assert counts == {("r", "a"): 3, ("r", "b"): 1, ("c", "x"): 3, ("c", "y"): 1}
    shares = {r.value: r.share for r in profile.value_shares(df, ["r"]).collect()}
    assert shares == {"a": 75.0, "b": 25.0}
    assert [tuple(r) for r in profile.crosstab(df, "r", "c", ["x", "y"]).collect()] == [("a", 2, 1)]


def test_non_null_counts_and_sums(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "sp_chf int, t string")
    found = {r.variable: (r.data_type, r.n, r.non_null) for r in profile.non_null_counts(df).collect()}
    assert found == {"sp_chf": ("int", 3, 2), "t": ("string", 3, 1)}
    assert profile.condition_sums(df, ["sp_chf"]).first().total == 3


def test_profile_table_dispatches_by_type(sample):
    df, _ = sample
    rows = profile.profile_table(df, skip=["i"], bins=5).collect()
    kinds = {(r.variable, r.statistic) for r in rows}
    assert kinds == {("c", "count"), ("x", "histogram"), ("x", "mean"), ("x", "median")}
    assert sum(r.value for r in rows if r.statistic == "histogram") == 402
    with pytest.raises(ValueError):
        profile.profile_table(df, skip=["x", "c", "i"])


def test_density_without_spread_or_with_nan(spark):
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert profile.density(constant, "x").count() == 0
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "x double")
    clean = profile.density(df.filter("x < 100"), "x", 20).collect()
    assert sorted(profile.density(df, "x", 20).collect()) == sorted(clean) and len(clean) == 20
    assert profile.density(df.limit(0), "x").count() == 0


def test_density_of_several_columns(spark):
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(50)], "a double, `b.c` double")
    both = profile.density(df, ["a", "b.c"], 10)
    assert {r.variable: r["count"] for r in both.groupBy("variable").count().collect()} == {"a": 10, "b.c": 10}


def test_profile_table_scans_its_source_once(spark, tmp_path):
    rows = [("ab"[i % 2], float(i % 7), i) for i in range(200)]
    spark.createDataFrame(rows, "t string, x double, y int").write.parquet(str(tmp_path / "source"))
    counted = spark.sparkContext.accumulator(0)
    source = spark.read.parquet(str(tmp_path / "source"))

    def seen(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    out = profile.profile_table(source.mapInArrow(seen, source.schema), bins="auto", curve=True)
    assert out.filter("statistic = 'mean'").count() == 2
    assert counted.value == 200
