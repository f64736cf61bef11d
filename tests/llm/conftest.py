import random

import pytest

from claimlens.llm.queries import reachable


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    reachable(spark)


def invented(rng, n, size=200):
    return " ".join(rng.choice("aeioubdklmnrst") + rng.choice("aeiou") * rng.randint(1, 2) + str(rng.randint(0, size)) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Texts with copies, near copies, shared passages, repeats, nulls, empty and long texts; some ids repeat."""
    rng = random.Random(5)
    base = [invented(rng, rng.randint(30, 150)) for _ in range(30)]
    rows = list(enumerate(base))
    passage = invented(rng, 90)
    for k in range(12):
        w = base[k].split()
        w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((100 + k, " ".join(w)))
        rows.append((200 + k, invented(rng, 5) + " " + passage + " " + invented(rng, 5 + k)))
    rows += [(300, base[3]), (301, base[3].replace(" ", "  \n")), (302, base[3].upper())]
    rows += [(310, None), (311, ""), (312, " \t\n"), (313, "one two"), (314, "One two"), (315, "é" * 300 + " " + "ab " * 400)]
    rows += [(316, "ab " * 400), (317, invented(rng, 20_000)), (318, passage), (319, passage), (320, "x")]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows, tmp_path_factory):
    """The hard rows as a table, with more columns whose names clash with internal ones."""
    folder = str(tmp_path_factory.mktemp("hard") / "documents")
    df = spark.createDataFrame(hard_rows, "doc_id long, text string")
    clashing = ("block", "score", "set", "bucket", "task", "digest", "component", "n_points", "_keep")
    from pyspark.sql import functions as F

    df.select("*", *[F.lit(7).alias(c) for c in clashing]).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
