import random
import zlib

import pytest

from claimlens.llm import quality, toxicity

from .conftest import invented


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        words, toxic = invented(rng, rng.randint(20, 60)).split(), rng.random() < 0.3
        good = rng.random() < 0.7
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "1diot", "scum", "ScUm", "ѕcum"]))
        text = " ".join(words) if good else " ".join(w + rng.choice(["%%%", "###"]) for w in words)
        rows.append((i, text, "extra"))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "extra"), (1001, "", "extra"), (1001, "", "extra"), (None, "idiot scum", "extra"), (1002, "word " * 50_000, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def held_accuracy(df, labels, column, modulus, held):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    rows = [r for r in df.collect() if r.doc_id is not None and r.doc_id < 700]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out]
    return sum(p == t for p, t in judged) / len(judged)


def test_quality_of_held_out_rows(labelled):
    docs, labels = labelled
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    assert held_accuracy(out, labels, "quality", 5, 0) > 0.97
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count()
    assert held_accuracy(out, labels, "toxic", 4, 2) > 0.95


def test_toxic_rows_go_and_columns_stay(labelled):
    docs, labels = labelled
    out = toxicity.accepted(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.filter("doc_id >= 1000").collect()} == {1000, 1001, 1002}
    assert out.filter("doc_id is null").count() == 0


def test_without_labels_or_documents(spark, labelled, empty):
    docs, labels = labelled
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.0}
    assert quality.classify(empty, labels).count() == 0
    assert toxicity.classify(empty, labels).count() == 0


def test_folding():
    assert toxicity.folded("  Ｉdi0t—ＳCUM! ") == " idiot scum "
    assert toxicity.folded("ѕсum é1") == " scum ei "
    assert toxicity.folded(None) == " "


def test_exceptions_cancel_entries():
    model = toxicity.ToxicityModel({"trash ": 5.0}, [" trash can "], (-3.0, 4.0, 0.0))
    assert model.measures("a trash can")[0] == 0
    assert model.measures("you trash")[0] == 5
    assert model.score("you trash") > 0.5 > model.score("a trash can here")


def test_cosine_blocks_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = (rng.random(300) > 0.4).astype(np.float32)
    rows = rng.random((20, 12)).astype(np.float32)
    make = lambda block: quality.QualityModel(np.ones(12, np.float32), rng2, vectors, labels, 10, 0.5, block)
    rng2 = rng.normal(size=(12, 8)).astype(np.float32)
    assert np.allclose(make(7).scores(rows), make(1000).scores(rows))
