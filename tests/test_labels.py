"""Readmission gaps and flags on hand-made and random rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from claimlens.operators import labels

D = dt.date
SCHEMA = "desynpuf_id string, clm_id long, admit_date date"


def brute_force(claims):
    """Gap per row: rows of a patient in order of date (unknown last) and claim; unknown patient gives None."""
    gaps = []
    by_patient = {}
    for patient, claim, day in claims:
        by_patient.setdefault(patient, []).append((day is None, day or D.max, claim))
    for patient, stays in by_patient.items():
        stays.sort()
        for i, (unknown, day, claim) in enumerate(stays):
            following = stays[i + 1] if i + 1 < len(stays) else None
            known = patient is not None and not unknown and following is not None and not following[0]
            gaps.append((patient, claim, None if unknown else day, (following[1] - day).days if known else None))
    return sorted(gaps, key=repr)


def gaps(spark, claims):
    out = labels.days_to_readmit(spark.createDataFrame(claims, SCHEMA))
    return sorted((tuple(r) for r in out.select("desynpuf_id", "clm_id", "admit_date", "days_to_readmit").collect()), key=repr)


def test_hand_made_rows(spark):
    claims = [
        ("single", 1, D(2008, 1, 1)),
        ("same_day", 2, D(2008, 1, 1)),
        ("same_day", 3, D(2008, 1, 1)),
        ("same_day", 4, D(2008, 2, 5)),
        ("unknown_date", 5, D(2008, 1, 1)),
        ("unknown_date", 6, None),
        ("unknown_date", 7, None),
        (None, 8, D(2008, 1, 1)),
        (None, 9, D(2008, 1, 2)),
    ]
    assert gaps(spark, claims) == brute_force(claims)


def test_copies_of_one_claim_follow_each_other(spark):
    claims = [("a", 1, D(2008, 1, 1))] * 3 + [("a", 2, D(2008, 1, 11))]
    found = gaps(spark, claims)
    assert sorted(g for *_, g in found if g is not None) == [0, 0, 10]
    assert len(found) == 4


def test_random_rows_in_any_order(spark):
    rng = random.Random(3)
    claims = [
        (
            rng.choice([None, *"abcdefgh"]),
            i,
            rng.choice([None, *[D(2008, 1, 1) + dt.timedelta(days=rng.randrange(120)) for _ in range(9)]]),
        )
        for i in range(400)
    ]
    expected = brute_force(claims)
    assert gaps(spark, claims) == expected
    rng.shuffle(claims)
    assert gaps(spark, claims) == expected


def test_hot_patient(spark):
    claims = [("hot", i, D(2008, 1, 1) + dt.timedelta(days=i // 50)) for i in range(2000)]
    claims += [(f"p{i}", 10_000 + i, D(2008, 1, 1)) for i in range(50)]
    assert gaps(spark, claims) == brute_force(claims)


def test_horizons_include_their_limit_and_grow(spark):
    days = [None, 0, 30, 31, 60, 61, 90, 91]
    df = spark.createDataFrame([(d,) for d in days], "days_to_readmit int")
    out = labels.readmission_flags(df)
    found = {r.days_to_readmit: (r.readmit_30, r.readmit_60, r.readmit_90) for r in out.collect()}
    assert found == {
        None: (0, 0, 0),
        0: (1, 1, 1),
        30: (1, 1, 1),
        31: (0, 1, 1),
        60: (0, 1, 1),
        61: (0, 0, 1),
        90: (0, 0, 1),
        91: (0, 0, 0),
    }
    assert out.filter((F.col("readmit_30") > F.col("readmit_60")) | (F.col("readmit_60") > F.col("readmit_90"))).isEmpty()


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("a", 1, D(2008, 1, 1), "x")], SCHEMA + ", extra string")
    assert labels.readmission_labels(df).columns == [*df.columns, "days_to_readmit", "readmit_30", "readmit_60", "readmit_90"]
