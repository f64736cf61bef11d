"""The pipeline on a small table with planted cases, and the registered queries against their SQL."""

import os
import random

import compare
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from claimlens.llm import queries

from .conftest import invented

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    top = str(tmp_path_factory.mktemp("corpus"))
    texts = {i: invented(rng, rng.randint(40, 90)) for i in range(120)}
    labels = []
    for i in range(60):
        if i % 3 == 0:
            texts[i] += " idiot scum " + invented(rng, 3)
        labels.append((i, 1, int(i % 3 == 0)))
    texts[200] = invented(rng, 60) + " scum idiot"
    texts[201] = texts[100].replace(" ", "\n")
    words = texts[101].split()
    words[50 % len(words)] = "changed"
    texts[202] = " ".join([*words, *invented(rng, 1).split()])
    item = invented(rng, 30)
    texts[203] = texts[102] + " " + item
    texts[204] = invented(rng, 20) + " " + " ".join(item.split()[15:] + ["x"] + item.split()[:15])
    rows = [(i, t, "en", "src", len(t)) for i, t in texts.items()] + [(300, None, "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(0, item), (1, invented(rng, 30))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_planted_cases_go_and_clean_documents_stay(spark, folder):
    left = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    gone = {i for i in range(60) if i % 3 == 0} | {200, 201, 202, 203, 204}
    # the copy with more code points stays; both have as many here, so the smaller id does
    assert left == (set(range(120)) | {300}) - gone


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = queries.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_on_empty_tables(spark, folder):
    docs = queries.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, name):
    duck = compare.connect(FOLDER)
    assert compare.difference(queries.QUERIES[name](spark, FOLDER), duck, queries.ORACLE_SQL[name]) is None


def test_everything_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert os.path.exists(corpus_pipeline.__file__)
