import random

from claimlens.llm import tiling

from .conftest import invented


def naive(a, b, least):
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k >= least and (not best or k >= best[0][0]):
                    best = [*(best if best and best[0][0] == k else []), (k, i, j)]
        if not best:
            return out
        for k, i, j in sorted(best, key=lambda m: m[1:]):
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                used_a[i : i + k] = used_b[j : j + k] = [True] * k
                out.append((k, i, j))


def test_tiles_match_the_naive_algorithm():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        assert tiling.tiles(a, b, least=2) == naive(a, b, 2)


def covered(item, text):
    """Share of the item's words that lie in its greedy tiles in the whole text."""
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    a, b = plain(item), plain(text)
    return sum(k for k, _, _ in naive(a, b, tiling.LEAST)) / max(len(a), 1)


def leaky_by(item, text, share=0.5):
    """Whether the item leaks: by the share that its tiles cover, or by one long tile."""
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    longest = max((k for k, _, _ in naive(plain(item), plain(text), tiling.LEAST)), default=0)
    return covered(item, text) >= share or longest >= tiling.LONG_TILE


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    items = [invented(rng, rng.randint(8, 40)) for _ in range(8)] + ["too short", None, ""]
    rows = []
    for i in range(60):
        words = invented(rng, 60).split()
        if i % 3 == 0:
            part = items[i % 8].split()
            cut = rng.randint(0, len(part))
            moved = part[cut:] + ["between"] + part[:cut]
            words[10:10] = moved if i % 2 else [w.upper() + "," for w in part[: rng.randint(3, len(part))]]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (None, items[0]), (5, items[1]), (5, items[1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(
        ((i, k, round(covered(item, t), 9)) for i, t in rows if t for k, item in enumerate(items) if item and len(item.split()) >= 5 and leaky_by(item, t)),
        key=repr,
    )
    for block_bytes in (1 << 20, 300):
        got = tiling.contaminated(docs, benchmark, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.coverage, 9)) for r in got), key=repr) == want
    clean = tiling.decontaminated(docs, benchmark, block_bytes=300)
    assert clean.columns == docs.columns
    leaky = lambda t: any(item and len(item.split()) >= 5 and leaky_by(item, t) for item in items)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, t in rows if not t or not leaky(t)), key=repr)


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert tiling.contaminated(empty, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert tiling.contaminated(docs, items.limit(0)).count() == 0
    assert tiling.decontaminated(docs, items.limit(0)).count() == 1


def test_a_long_passage_of_a_long_item_leaks(spark):
    rng = random.Random(8)
    item = invented(rng, 120, 10**6)
    words = item.split()
    texts = [" ".join(words[30:85]), " ".join(words[:13]), " ".join(words[:12]), " ".join([*words[:8], "x", *words[20:32]])]
    texts = [f"{invented(rng, 20, 10**6)} {t} {invented(rng, 20, 10**6)}" for t in texts] + [" ".join([*["filler"] * 60_000, *words[50:63], *["more"] * 60_000])]
    docs = spark.createDataFrame([(i, t, 5, 0.1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int, coverage double")
    benchmark = spark.createDataFrame([(1, item, "x", 3)], "item_id long, text string, doc_id string, n_tiles int")
    found = {r.doc_id: (r.covered_words, r.longest_tile) for r in tiling.contaminated(docs, benchmark).collect()}
    assert found == {0: (55, 55), 1: (13, 13), 4: (13, 13)}
    assert sorted(r.doc_id for r in tiling.decontaminated(docs, benchmark).collect()) == [2, 3]
