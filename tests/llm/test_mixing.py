import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from claimlens.llm import mixing
from claimlens.llm.texts import Slice
from .conftest import invented


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def test_base_score_and_model(spark, hard, hard_rows, empty):
    out = {r.doc_id: r for r in mixing.scored(hard).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in hard_rows}
    counts = Counter(w for i, t in hard_rows if not held[i] for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in hard_rows:
        w = tokens(t)
        want = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        assert (out[i].held_out, out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (held[i], len(w), sum(x in counts for x in w), total)
        assert abs(out[i].base_score - want) < 1e-6 * max(1, abs(want))
        assert out[i].score <= 0
    bits = -sum(out[i].score for i in held if not held[i]) / math.log10(2)
    size = sum(len((t or "").encode()) for i, t in hard_rows if not held[i])
    assert bits / size < 4.5  # eight without learning
    assert mixing.scored(empty).count() == 0


def test_bits_are_a_distribution():
    """Over all next bytes, the probabilities of any context add up to one."""
    rng = np.random.default_rng(1)
    tables = rng.integers(-6000, 6000, (mixing.ORDERS, 1 << mixing.SLOT_BITS)).astype(np.int16)
    model = mixing.Mixer.fresh(tables)
    model.refined[:] = rng.integers(0, 50, model.refined.shape)
    context = np.uint64(0x0102030405) << np.uint64(8)
    bits = model.bits(context | np.arange(256, dtype=np.uint64))
    assert abs(np.exp2(-bits).sum() - 1) < 1e-6


def test_grams_stay_in_their_text():
    data = b"abc" + b"" + b"xyzxyzxyz"
    s = Slice(np.array([1, 2, 3]), np.frombuffer(data, np.uint8), np.array([0, 3, 3, 12]))
    gram, at = mixing.byte_grams(s)
    assert at.tolist() == [0, 4, 5, 15]
    assert gram[3] == int.from_bytes(b"abc\0", "big") and gram[4] == 0
    assert gram[5] == ord("x") and gram[14] == int.from_bytes(b"zxyz\0", "big") | (ord("y") << 40)


def test_null_id_is_never_held_out(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, "a a"), (1, "a a")], "doc_id long, text string")
    rows = mixing.scored(docs).collect()
    assert len(rows) == 4 and not any(r.held_out for r in rows if r.doc_id is None)


def test_every_context_has_its_own_counts():
    """More different contexts than any fixed table: odds are those of the counts, and a context never met says so."""
    rng = np.random.default_rng(2)
    gram = np.unique(rng.integers(0, 1 << 48, 900_000, dtype=np.uint64))
    n = rng.integers(1, 5, len(gram))
    counts = mixing.Counts(gram, n)
    strangers = rng.integers(0, 1 << 48, 1000, dtype=np.uint64)
    strangers = strangers[~np.isin(strangers >> np.uint64(8), gram >> np.uint64(8))]
    met = counts.odds(strangers)[:, -1] != 0
    assert not met.any()
    some = gram[:: len(gram) // 200]
    odds = counts.odds(some)
    for k in range(mixing.LOW, mixing.ORDERS):
        mask = np.uint64((1 << (8 * k + 8)) - 1)
        for i, g in enumerate(some):
            alike = ((gram ^ g) & mask) >> np.uint64(8) == 0
            byte, m = gram[alike] & np.uint64(255), n[alike]
            for place in range(8):
                same = byte >> np.uint64(8 - place) == (g & np.uint64(255)) >> np.uint64(8 - place)
                one = (byte >> np.uint64(7 - place)) & np.uint64(1)
                want = math.log((m[same & (one == 1)].sum() + 0.4) / (m[same & (one == 0)].sum() + 0.4)) * mixing.SCALE
                assert odds[place, k - mixing.LOW, i] == (round(want) or 1)


def test_bits_with_counts_are_a_distribution():
    rng = np.random.default_rng(3)
    context = np.uint64(0x0102030405) << np.uint64(8)
    counts = mixing.Counts(context | np.arange(0, 256, 3, dtype=np.uint64), rng.integers(1, 50, 86))
    model = mixing.Mixer.fresh([rng.integers(-6000, 6000, 1 << b).astype(np.int16) for b in (8, 16, 24)])
    assert abs(np.exp2(-model.bits(context | np.arange(256, dtype=np.uint64), counts)).sum() - 1) < 1e-6


def test_scores_by_bucket_are_those_of_all_counts(spark, hard, hard_rows):
    """Texts scored by joining their strings with buckets of counts score as with the whole counts in one place."""
    from pyspark.sql import functions as F

    out = {r.doc_id: r.score for r in mixing.scored(hard).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    role = F.when(held, 0).when(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0, 2).otherwise(1).cast("long")
    model, grams = mixing.learned(hard.withColumn("role", role), "role", 8)
    blobs = [(np.frombuffer(r.grams, "<u8"), np.frombuffer(r.counted, "<i8") + np.frombuffer(r.mixed, "<i8")) for r in grams.collect()]
    gram, n = (np.concatenate(x) for x in zip(*blobs, strict=True))
    assert len(np.unique(gram)) == len(gram)
    counts = mixing.Counts(gram, n)
    for i, t in hard_rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        want = -model.bits(mixing.byte_grams(Slice(np.array([i]), data, np.array([0, len(data)])))[0], counts).sum() * math.log10(2)
        assert abs(out[i] - want) < 1e-3 * max(1, abs(want))


def test_texts_of_the_mix_are_known(spark):
    """A passage that stands only in documents of the mixing eighth costs few bits afterwards."""
    from pyspark.sql import functions as F

    ids = spark.range(2000).withColumn("mix", F.pmod(F.xxhash64("id"), F.lit(8)) == 0)
    ids = [(r.id, r.mix) for r in ids.collect() if zlib.crc32(str(r.id).encode()) % 7 != 2]
    mix, others = [i for i, m in ids if m][:60], [i for i, m in ids if not m][:300]
    rng = random.Random(4)
    passage = "QUX ZYV JWK XQ ZZY VKJ WQX " + "".join(rng.choice("QRSTUVWXYZ") for _ in range(200))
    rows = [(i, invented(rng, 150, 20)) for i in (*others, *mix)]
    rows = [(i, f"{t} {passage} {t}" if i in mix[:5] else t) for i, t in rows]
    rows.append((next(i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2), passage))
    out = mixing.scored(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.filter("held_out").first().bits_per_byte < 3


def test_places_of_strings_in_any_order():
    """A table finds every string's place, also of those that lost theirs in the table to another."""
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 1 << 48, 60_000, dtype=np.uint64))
    rng.shuffle(values)
    places = mixing.Places(values)
    assert len(places.lost) > 0
    asked = rng.integers(0, len(values), 300_000)
    assert (places.of(values[asked]) == asked).all()
    assert mixing.Places(values[:0]).of(values[:0]).size == 0


def test_strings_return_with_their_bits():
    """The blocks need not find their different strings again: each comes back beside what it costs."""
    import pyarrow as pa

    own = [np.unique(np.random.default_rng(k).integers(0, 1 << 48, 50, dtype=np.uint64)) for k in range(3)]
    wanted = pa.table({"bucket": [4, 4, 4], "block": [9, 2, 9], "wanted": pa.array([x.tobytes() for x in own], pa.binary())})
    known = pa.table({c: pa.array([], pa.binary()) for c in ("grams", "counted", "mixed")})
    model = mixing.Mixer.fresh([np.zeros(1 << b, np.int16) for b in (8, 16, 24)])
    out = {r["block"]: r for r in mixing.block_bits(known, wanted, model).to_pylist()}
    for block, want in ((2, own[1]), (9, np.union1d(own[0], own[2]))):
        assert (np.frombuffer(out[block]["grams"], "<u8") == want).all()
        assert np.allclose(np.frombuffer(out[block]["bits"], "<f4"), model.bits(want))
