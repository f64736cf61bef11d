import re

import pytest
from pyspark.sql import functions as F

from claimlens.llm import pii

TEXT = (
    "call +1 (319) 555-5132 or 4436 3873 4676 4662 / 4436387346764662, eop.13@mail5.example.com from 16.141.162.38 on 2020-02-29, "
    "31.12.1999 12/31/2001; ssn 123-45-6789; DE89 3704 0044 0532 0130 00."
)
WRONG = "4436387346764663 999.1.1.1 2021-02-30 000-12-3456 DE88370400440532013000 version 1.2.3 +12 34"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, 5), (2, WRONG, 5), (3, None, 5), (4, "", 5), (5, "no numbers", 5), (6, "again eop.13@mail5.example.com", 5), (6, "again eop.13@mail5.example.com", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_replaced int")


@pytest.fixture(scope="module")
def out(docs):
    return {r.doc_id: r for r in pii.pseudonymised(docs, "secret").collect()}


def test_values_change_within_their_format(out):
    new = out[1].text
    assert re.sub("[0-9]", "0", re.sub(r"\d+\.\d+\.\d+\.\d+", "IP", re.sub("[a-z]", "a", new))) == re.sub(
        "[0-9]", "0", re.sub(r"\d+\.\d+\.\d+\.\d+", "IP", re.sub("[a-z]", "a", TEXT))
    )
    for old in ("555-5132", "3873 4676", "4436387346764662", "eop.13", "16.141.162.38", "2020-02-29", "31.12.1999", "12/31/2001", "123-45-6789", "3704 0044"):
        assert old not in new
    assert out[1].n_replaced == 10


def test_results_stay_valid(out):
    new = out[1].text
    spaced, plain = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0], re.search(r"\d{16}", new)[0]
    assert luhn(spaced) and spaced.replace(" ", "") == plain
    assert all(int(x) < 256 for x in re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", new).groups())
    iban = re.search(r"DE[\d ]+\d", new)[0].replace(" ", "")
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1


def test_invalid_and_missing_values_stay(out):
    assert out[2].text == WRONG and out[2].n_replaced == 0
    assert out[3].text is None and out[3].n_replaced == 0
    assert out[4].text == "" and out[5].text == "no numbers"


def test_equal_values_stay_linked(out):
    assert re.search(r"\S+@\S+com", out[1].text)[0] == re.search(r"\S+@\S+", out[6].text)[0]


def test_key_restores(docs):
    there = pii.pseudonymised(docs, "secret")
    back = {r.doc_id: r.text for r in pii.pseudonymised(there, "secret", back=True).collect()}
    assert back[1] == TEXT and back[2] == WRONG
    other = pii.pseudonymised(docs, "another").filter("doc_id = 1").first().text
    assert other not in (TEXT, there.filter("doc_id = 1").first().text)


def test_numbers_are_permuted_one_to_one(spark):
    rows = spark.range(276 * 397).select(pii.permuted_number(F.col("id"), 276, 397, "k", "date").alias("x"))
    assert rows.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first() == (276 * 397, 0, 276 * 397 - 1)
    short = spark.range(1000).select(pii.permuted_string(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "card").alias("x"))
    assert short.distinct().count() == 1000


def test_runs_without_python(spark, docs, empty):
    plan = pii.pseudonymised(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert pii.pseudonymised(empty, "k").count() == 0


BESIDE = {
    "4111 1111 1111 1111 123": "4111 1111 1111 1111", "paid 4111 1111 1111 1111 12/27": "4111 1111 1111 1111",
    "5 4111 1111 1111 1111": "4111 1111 1111 1111", "12 34 56 4111 1111 1111 1111 99 77": "4111 1111 1111 1111",
    "4111111111111111 2020-02-29": "2020-02-29", "4111 1111 1111 1111 5th": "4111 1111 1111 1111",
    "4111 1111 1111 1111 5500 0000 0000 0004": "5500 0000 0000 0004", "7 3782 822463 10005 12": "822463",
    "AT61 1904 3002 3457 3201 BIC X": "1904 3002", "AT61 1904 3002 3457 3201 4111 1111 1111 1111": "4111 1111",
    "IBAN ES91 2100 0418 4502 0005 1332 IM": "0418 4502", "AB12 SE45 5000 0000 0583 9825 7466 A": "0583 9825",
    "XX12 PL61 1090 1014 0000 0712 1981 2874 ABC": "0712 1981",
}


def test_values_beside_short_numbers_and_capital_words(spark):
    texts = [*BESIDE, *[t.replace("4111 1111 1111 1111", f"{n} 4111 1111 1111 1111") for n in range(8) for t in [*BESIDE][:2]]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")
    there = pii.pseudonymised(docs, "secret")
    out = {r.doc_id: r for r in there.collect()}
    for i, t in enumerate(texts):
        old = BESIDE.get(t, "4111 1111 1111 1111")
        assert old not in out[i].text and out[i].n_replaced >= 1, (t, out[i].text)
        assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", out[i].text)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", t))
    assert out[texts.index("4111 1111 1111 1111 5500 0000 0000 0004")].n_replaced == 2
    back = {r.doc_id: r.text for r in pii.pseudonymised(there, "secret", back=True).collect()}
    assert back == dict(enumerate(texts))


def test_clashing_columns_survive(spark):
    docs = spark.createDataFrame([(1, "a@b.example and 4111 1111 1111 1111", "mine", 3)], "doc_id int, text string, __candidates__ string, __Candidates___ int")
    out = pii.pseudonymised(docs, "secret")
    assert out.columns == [*docs.columns, "n_replaced"]
    row = out.first()
    assert (row["__candidates__"], row["__Candidates___"]) == ("mine", 3) and "4111 1111" not in row.text
