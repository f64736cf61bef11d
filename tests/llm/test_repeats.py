import random
import re

import numpy as np
import pytest

from claimlens.llm import repeats, substring, suffixes


def earlier_words(rows, window):
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


def repeated_bytes(rows, window):
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + window] for _, b in texts for k in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if n[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = len(substring.spans_of(gone)[0])
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def small(rows):
    return [(i, t) for i, t in rows if len(t or "") < 20_000]


@pytest.mark.parametrize("most", [4096, 1])
def test_words_in_earlier_documents(spark, hard, hard_rows, most, monkeypatch):
    monkeypatch.setattr(repeats.Windows, "__init__", limited(most))
    out = substring.without_earlier(hard).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == earlier_words(hard_rows, 13)
    assert all(sum(s["end"] - s["first"] for s in r.spans) == r.n_removed for r in out)


@pytest.mark.parametrize("most", [4096, 1])
def test_bytes_found_anywhere_else(spark, hard, hard_rows, most, monkeypatch):
    monkeypatch.setattr(repeats.Windows, "__init__", limited(most))
    out = suffixes.without_repeats(hard.filter("length(coalesce(text, '')) < 20000")).collect()
    want = repeated_bytes(small(hard_rows), 400)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out) == want


def limited(most, init=repeats.Windows.__init__):
    """Few different pieces of an anchor are enough for the way of very many."""

    def make(self, *args, **named):
        init(self, *args, **{**named, "most": most})

    return make


def test_repeated_rows_null_ids_and_empty_tables(spark, empty):
    text = " ".join(f"w{k}" for k in range(150))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (9, text + " tail"), (8, "short")], "doc_id long, text string")
    words = sorted(((r.doc_id, r.n_removed) for r in substring.without_earlier(docs).collect()), key=repr)
    assert words == [(7, 0), (7, 0), (8, 0), (9, 150), (None, 150)]
    whole = sorted(((r.doc_id, r.n_bytes - r.n_removed) for r in suffixes.without_repeats(docs).collect()), key=repr)
    assert whole == [(7, 0), (7, 0), (8, 5), (9, 5), (None, 0)]
    assert substring.without_earlier(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == 0


def test_reference_blocks(spark):
    words = [f"w{k}" for k in range(60)]
    reference = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[30:50])), (3, None)], "doc_id long, text string")
    docs = spark.createDataFrame([(5, " ".join(words)), (6, "other"), (7, None)], "doc_id long, text string")
    for size in (1 << 20, 60):
        out = {r.doc_id: r for r in substring.without_reference(docs, reference, block_bytes=size).collect()}
        assert out[5].kept == " ".join(words[20:30] + words[50:])
        assert [tuple(s) for s in out[5].spans] == [(0, 20), (30, 50)]
        assert out[6].n_removed == 0 and out[7].n_words == 0


def test_automaton_statistics():
    rng = random.Random(6)
    for _ in range(100):
        pieces = [([rng.randint(0, 2) for _ in range(rng.randint(1, 14))], k) for k in range(4)]
        automaton = substring.SuffixAutomaton()
        for units, owner in pieces:
            automaton.add(units, owner)
        text = [rng.randint(0, 2) for _ in range(30)]
        for end, (size, first) in enumerate(automaton.statistics(text, 4), 1):
            known = lambda s: [o for u, o in pieces if any(u[i : i + len(s)] == s for i in range(len(u)))]  # noqa: E731,B023
            assert size == max(k for k in range(5) if k <= end and (k == 0 or known(text[end - k : end])))
            assert first == (min(known(text[end - 4 : end])) if size == 4 else None)


def naive_repeats(texts, least):
    """All maximal repeats with all occurrences, by trying every substring."""
    where = {}
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + least, len(text) + 1):
                where.setdefault(text[i:j], []).append((t, i))
    out = []
    for s, places in where.items():
        if len(places) < 2:
            continue
        left = {texts[t][i - 1 : i] if i else (t, i) for t, i in places}
        right = {texts[t][i + len(s) : i + len(s) + 1] or (t, i) for t, i in places}
        if len(left) > 1 and len(right) > 1:
            out.append((len(s), sorted(places)))
    return sorted(out)


def test_maximal_repeats():
    rng = random.Random(7)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(3)]
        assert sorted(suffixes.maximal_repeats(texts, 2)) == naive_repeats(texts, 2)
    assert suffixes.maximal_repeats([b"", b""], 2) == []


def test_anchors_depend_on_the_window_alone():
    """Equal windows get equal anchors wherever they stand."""
    rng = np.random.default_rng(3)
    units = rng.integers(1, 1 << 60, 400, dtype=np.uint64)
    spec = repeats.Windows(words=True, window=13, gram=7, anywhere=True)
    text = np.concatenate([units[:100], units[50:90], units[:10], units[45:100]])
    u = repeats.Units(text, np.array([0, 150, len(text)]), repeats.prefix_sums(text))
    x = repeats.pieces_of(u, spec)
    by_window = {}
    for begin, count, anchor in zip(x.begin, x.count, x.anchor, strict=True):
        for p in range(begin, begin + count):
            by_window.setdefault(text[p : p + 13].tobytes(), set()).add(int(anchor))
    assert all(len(a) == 1 for a in by_window.values())
    assert sum(x.count) == (150 - 12) + (len(text) - 150 - 12)
    parted = repeats.pieces_of(u, spec, span=16)
    assert sum(parted.count) == sum(x.count) and set(parted.anchor) == set(x.anchor)


