"""Every registered query against its oracle SQL, on the smallest given tables."""

import os
import subprocess
import sys

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


# Minutes each at their full settings; tests/test_models.py covers the operators with small ones, and
# tests/compare.py runs them in full.
LONG = {"model_gbt", "model_gbt_weighted", "model_mlp", "train_horizon", "cross_validation", "saved_models"}
LLM = {n for n in SQL if n.startswith("op")}


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG - LLM))
def test_matches_oracle(spark, duck, name):
    assert compare.difference(entry.queries()[name](spark, FOLDER), duck, SQL[name]) is None


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_known_totals(spark):
    """Totals of the mapping at sf0.01, computed once in two engines."""
    queries = entry.queries()
    folder = "/root/testdata/sf0.01"
    totals = queries["readmission_totals"](spark, folder).first()
    assert tuple(totals) == (10021, 798, 1535, 2223)
    kpi = queries["kpi_summary"](spark, folder).first()
    assert (kpi.inpatient_claims, kpi.unique_patients) == (10021, 1500)
    years = {r.year: r.n for r in queries["latest_beneficiary"](spark, folder).groupBy("year").count().withColumnRenamed("count", "n").collect()}
    assert years == {2001: 1500}


def test_other_queries_work_without_a_package_of_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['regex'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == len([n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
