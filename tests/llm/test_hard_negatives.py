import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import hard_negatives
from claimlens.llm.hard_negatives import Best, Shard, mined, search


def brute(rows, positives=5, negatives=3, least=50, most=95, every=50):
    """Score every pair; rows equal in id, label and vector count once."""
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        usable[i, label, q] = None
    usable = list(usable)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, q in usable:
        if i % every:
            continue
        others = sorted((-score(q, w), j, m) for j, m, w in usable if j != i)
        near = [(-s, j) for s, j, m in others if m == label][:positives]
        for ps, p in near:
            far = [(-s, j) for s, j, m in others if m != label and least * ps <= -100 * s <= most * ps][:negatives]
            out += [(i, p, rank, j, ps, s) for rank, (s, j) in enumerate(far, 1)]
    return sorted(out)


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, 7, "x") for i, label, v in rows], "vec_id long, embedding array<float>, label int, shard int, block string").repartition(parts)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def random_rows(n, dims, labels, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(labels)), [float(np.float32(x)) for x in rng.normal(size=dims) * 0.3]) for i in range(n)]


def test_all_rows_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "STRIPE_SHARDS", 2)
    rows = random_rows(600, 12, 4)
    assert result(mined(vectors(spark, rows), F.col("vec_id") % 20 == 0)) == brute(rows, every=20)


def test_nulls_ties_repeats_and_ragged_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.0, 0.5]) for _ in range(4)]) for i in range(200)]
    rows += rows[:20]  # repeated rows
    rows += [(50, 1, [0.5, 0.5, 0.0, 0.0]), (50, 2, [0.0, 0.0, 0.0, 0.0]), (250, 0, [0.0] * 4)]
    rows += [(None, 1, [0.5] * 4), (400, None, [0.5] * 4), (450, 1, None), (500, 1, [0.5, None, 0.5, 0.5]), (550, 2, [0.5, float("nan"), 0.1, 0.1])]
    rows += [(600, 2, [float("inf"), 0.0, 0.0, 0.0]), (650, 0, [0.5, 0.5]), (700, 1, [0.5, 0.5, 0.5, 0.5, 0.25]), (750, 2, [])]
    assert result(mined(vectors(spark, rows), F.col("vec_id") % 50 == 0)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.4, 0.5]), (2, 2, [0.4, 0.3])]
    assert result(mined(vectors(spark, rows, 1), F.col("vec_id") % 50 == 0)) == brute(rows) != []
    assert mined(vectors(spark, rows, 1).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert mined(vectors(spark, rows[1:], 1), F.col("vec_id") % 50 == 0).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        mined(vectors(spark, [(0, 1, [1e6, 0.0])], 1), F.col("vec_id") == 0).collect()


def test_the_search_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    n, dims = 4000, 6
    v = rng.integers(-100, 100, (n, dims)).astype("<i2")
    v[:50] += 300  # a far cluster, so the threshold falls soon
    shard = Shard(np.arange(n), np.zeros(n, "<i4"), v)
    anchor = np.array([3, -1, 2, 0, 5, 1])
    best = Best(5)
    met = search(shard.lists(0, True), anchor, -1, [best])
    scores = v.astype(np.int64) @ anchor
    want = sorted(zip(-scores, range(n)))[:5]
    assert [(-s, i) for s, i in zip(best.scores, best.ids)] == want
    assert met < n
