import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimlens.llm import divergence
from claimlens.llm.divergence import Postings, accumulated, audit


def brute(rows, min_docs=30, top=50):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g for g, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in counts if g == lang)
        count = {s: counts[lang, s] for s in sources}
        count[None] = sum(count.values(), Counter())
        p = {}
        for s, c in count.items():
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def texts(n, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in ("", "n", "É", "ß", "日本")]
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "Z", "é", None])
        pool = words if source != "b" else words[: len(words) // 2]
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(pool, k=rng.randint(0, 60))) + rng.choice([" END-42 x_y", "", "\tÄ K"])))
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("xx", "s", "only here"), ("xx", "t", None), ("yy", "alone", None), ("en", "a", "word " * 3000)]
    return rows + rows[:40]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, place int, shard int").repartition(parts)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_every_pair_and_term(spark):
    rows = texts(300)
    assert result(audit(frame(spark, rows))) == brute(rows)


def test_many_shards_blocks_and_parts_agree(spark, monkeypatch):
    for name, value in (("SHARD_POSTINGS", 10), ("MOST_POSTINGS", 100), ("BLOCK_ROWS", 2), ("HELD_TERMS", 20), ("PART_BYTES", 64), ("SALTS", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = texts(120)
    assert result(audit(frame(spark, rows), min_docs=4, top=3)) == brute(rows, 4, 3)


def test_empty_table_and_no_kept_terms(spark):
    rows = [("en", "a", "x"), ("en", "b", None), ("de", "a", "y")]
    assert audit(frame(spark, rows).limit(0)).count() == 0
    assert result(audit(frame(spark, rows))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_rows_accumulate_to_the_dense_distances(seed):
    rng = np.random.default_rng(seed)
    groups, terms = 7, 40
    z = rng.integers(1, 50, groups)
    dense = np.where(rng.random((groups, terms)) < 0.3, rng.integers(1, 200, (groups, terms)), z[:, None])
    held = rng.random((groups, terms)) < 0.4
    held[rng.integers(groups, size=terms), np.arange(terms)] = True
    dense = np.where(held, dense, z[:, None])
    g, t = np.nonzero(held)
    rows = np.array([0, 3, 6])
    got = accumulated(Postings(t, g, dense[g, t], groups), z, rows)
    assert (got == np.abs(dense[rows, None] - dense[None]).sum(axis=2)).all()
