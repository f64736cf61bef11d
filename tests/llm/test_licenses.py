import random
import re

import pytest

from claimlens.llm import licenses
from claimlens.llm.licenses import PHRASES, STRETCH, TEMPLATES, compiled, scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(rows, containment=0.8, templates=TEMPLATES):
    """Every phrase at every place, every template in every block."""
    chosen = compiled(templates, containment)
    out = []
    for doc_id, text in rows:
        words = words_of(text)
        places, labels = [], set()
        for phrase, label in PHRASES:
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        base, score = sorted(labels), 1.0 if labels else 0.0
        for x in chosen:
            for begin in range(0, len(words), x.block):
                share = len(set(x.tokens) & set(words[begin : begin + 2 * x.block])) / len(x.tokens)
                if share * len(x.tokens) >= x.needed:
                    labels.add(x.label)
                    score = max(score, share)
        out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def documents(seed=3):
    rng = random.Random(seed)
    vocabulary = sorted({t for x in compiled(TEMPLATES, 0.8) for t in x.tokens}) + [f"w{i}" for i in range(60)]
    invented = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, invented(rng.randint(0, 300))) for i in range(60)]
    for i in range(120):
        words = words_of(rng.choice(TEMPLATES)[0])
        for _ in range(rng.randint(0, len(words) // 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + i, f"{' '.join(f'v{rng.randint(0, 9)}' for _ in range(rng.randint(0, 200)))} {rng.choice([' ', '-', chr(10)]).join(words)}. {' '.join('tail' for _ in range(rng.randint(0, 40)))}"))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "MIT LICENSE mit license,mit\nlicense"), (304, "mit licenſe"), (305, "MIT Lİcense apache LICENSE")]
    rows += [(306, "worK is licensed under the gnu general public license version 3"), (307, "licenKe"), (None, "Released under the MIT License."), (308, "cc by"), (308, "cc by"), (309, "x cc"), (310, "é日本 gnu general public license")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, block int, token string, words string").repartition(parts)


def result(df):
    return sorted(((*r[:-1], round(r[-1], 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("containment", [0.8, 0.5, 1.0])
def test_every_row_against_every_template(spark, containment):
    rows = documents()
    assert result(scan(frame(spark, rows), containment=containment)) == brute(rows, containment)


def test_very_long_texts_are_searched_whole(spark):
    notice = words_of(TEMPLATES[1][0])
    rows = []
    for k, shift in enumerate((-40, -3, 0, 1, 70)):
        filler = ["filler"] * (2 * STRETCH + shift)
        rows.append((k, " ".join([*filler, *notice, "end", "apache", "license", *["more"] * 9000])))
    rows.append((9, "the software " * 30_000))
    assert result(scan(frame(spark, rows))) == brute(rows)
    assert [r.labels for r in scan(frame(spark, rows)).orderBy("doc_id").collect()] == ["apache,mit"] * 5 + [""]


def test_empty_table(spark):
    assert scan(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_templates_are_checked():
    with pytest.raises(ValueError, match="words"):
        compiled([("", "none")], 0.8)
    with pytest.raises(ValueError, match="words"):
        compiled([("word " * 65, "long")], 0.8)


def test_no_python_in_the_plan(spark, rows):
    plan = scan(frame(spark, documents()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)
    assert licenses.MOST_WORDS <= STRETCH
