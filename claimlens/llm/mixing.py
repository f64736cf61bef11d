"""Language-model scores: a unigram base, and a logistic mix of bit predictors of 0 to 5 bytes of context.

A text is a string of bytes with a closing zero byte; each byte is eight bits, first the highest. For every
bit, one predictor per order (the last 0 to 5 bytes together with the bits already known) gives its log
odds. A gate, the longest context met before and the place of the bit, picks the weights by which the odds
are added, and an adaptive map refines the mixed probability by what came true at such probabilities.

Every context has counts of its own. Orders 0 to 2 have a table with a place for each of their 65,536
contexts at most, which is broadcast. The counts of orders 3 to 5 are the six-byte strings of the training texts
themselves: they grow with the corpus, lie in buckets by the three bytes before the last, and the different
strings of each block of texts come to them and return with their bits.

Learning is online over the training documents. One part of them fills the predictors' counts; the other
part then passes by in small steps, each predicting first and then moving the weights of its gate, in
every partition on its own, and the weights are averaged. Then that part joins the counts. Scoring uses the
learned state as it is, so a score depends on nothing but the text. As contexts end with the last six bytes, equal six-byte strings are
counted once for each slice of texts and scored once for each bucket.

Word and byte counts cover all training texts. Words return to the texts block by block, so a frequent
word is one record of each block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.exchange import buckets_for, pack, shuffled, text_bytes
from claimlens.llm.repeats import in_blocks
from claimlens.llm.texts import Slice, mixed, slices, trimmed, words
from claimlens.session import stored

ORDERS = 6
# Bytes of text in a block of neighbouring rows of mean length, and its rows at most: longer blocks send fewer strings.
BLOCK_BYTES, BLOCK_ROWS = 24 << 20, 1 << 14
# Orders with a broadcast table, the bits of its widest place (two bytes of context, a node), its parts, bytes
# of text for each bucket of strings, and strings scored at once.
LOW = 3
SLOT_BITS = 24
RANGES = 8
GRAM_BYTES = 16 << 20
PART = 1 << 18
SCALE = 2000.0
STEPS = 33
SLICE = 2 << 20
WORD = np.dtype([("word", "<u8"), ("block", "<i8"), ("n", "<u4")])
GRAM = np.dtype([("gram", "<u8"), ("counted", "<u4"), ("mixed", "<u4")])
AFTER = np.dtype([("after", "<u4"), ("n", "<u8")])


# Words


def block_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different words of each block, with their number in its training texts."""
    for batch in batches:
        block, train = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found, at = [], a
            for s in slices(iter([batch.slice(a, b - a)])):
                w = words(s, lower=True)
                uses = np.repeat(train[at : at + len(s)], np.diff(w.offsets)).astype(np.int64)
                word, inverse = np.unique(w.hashes, return_inverse=True)
                found.append((word, np.bincount(inverse, uses, len(word))))
                at += len(s)
            if found:
                word, inverse = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([x[1] for x in found]), len(word))
                out = np.empty(len(word), WORD)
                out["word"], out["block"], out["n"] = word, block[a], n
                yield out, (word % np.uint64(buckets)).astype(np.int64)


COUNTS = "block long, bucket long, counts binary, total long, distinct long"


def word_counts(records: np.ndarray, buckets: int) -> pa.Table:
    """For each block, the corpus counts of its words of this bucket in the order of the words; and a row of sums."""
    word, inverse = np.unique(records["word"], return_inverse=True)
    c = np.bincount(inverse, records["n"], len(word)).astype(np.int64)
    order = np.lexsort((records["word"], records["block"]))
    block, at = records["block"][order], inverse[order]
    new = np.append(True, (block[1:] != block[:-1]) | (at[1:] != at[:-1]))  # a block may come in two parts
    block, at = block[new], at[new]
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    blobs = [x.astype("<u4").tobytes() for x in np.split(np.minimum(c[at], 0xFFFFFFFF), starts[1:])]
    bucket = int(records["word"][0] % np.uint64(buckets))
    n = len(blobs)
    columns = [[*block[starts].tolist(), None], [bucket] * (n + 1), [*blobs, None], [None] * n + [int(c.sum())], [None] * n + [int((c > 0).sum())]]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in COUNTS.split(", ")])


# Bit predictors


def byte_grams(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of a slice's texts and their closing zeros, with the five bytes before it, as one number;
    and where each text begins."""
    n = len(s)
    at = s.offsets + np.arange(n + 1)
    data = np.zeros(at[-1], np.uint64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    data[inside] = s.data
    place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    gram = data.copy()
    for k in range(1, 6):
        before = np.zeros_like(data)
        before[k:] = data[:-k]
        before[place < k] = 0
        gram |= before << np.uint64(8 * k)
    return gram, at


def table_slots(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of 64-bit numbers in a table of 2**bits."""
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Places:
    """Where numbers stand in an array of different ones that has them all."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, max(10, (3 * len(values)).bit_length())
        slot, every = table_slots(values, self.bits), np.arange(len(values), dtype=np.int32)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[slot] = every
        self.lost_at = np.flatnonzero(self.table[slot] != every)
        self.lost_at = self.lost_at[np.argsort(values[self.lost_at])]
        self.lost = values[self.lost_at]

    def of(self, x: np.ndarray) -> np.ndarray:
        at = self.table[table_slots(x, self.bits)]
        wrong = np.flatnonzero(self.values[at] != x)
        if len(wrong):
            at[wrong] = self.lost_at[np.searchsorted(self.lost, x[wrong])]
        return at


def gram_buckets(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in which strings with the same three bytes before the last meet."""
    return (mixed((gram >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def last_bytes(gram: np.ndarray, n: int) -> np.ndarray:
    return gram & np.uint64((1 << (8 * n)) - 1)


def slots_of(gram: np.ndarray, order: int, node: np.ndarray) -> np.ndarray:
    """Table places of contexts with the bits known so far (``node``: a one, then these bits)."""
    return (last_bytes(gram >> np.uint64(8), order) << np.uint64(8)) | node


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Scaled log odds; 0 says that the context has not been met, so even odds of a met one are a step above."""
    odds = np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * SCALE), -32000, 32000)
    odds[(odds == 0) & (zeros + ones > 0)] = 1
    return odds.astype(np.int16)


def node_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of all 256 nodes from the counts of the 256 bytes, for each row."""
    out = np.zeros(counts.shape, np.int16)
    for place in range(8):
        zeros, ones = np.moveaxis(counts.reshape(len(counts), 1 << place, 2, 128 >> place).sum(-1), -1, 0)
        out[:, 1 << place : 2 << place] = log_odds(zeros, ones)
    return out


class Counts:
    """What came after each context of ``LOW`` to 5 bytes, from all the strings of a bucket and their numbers."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.orders = []
        for order in range(LOW, ORDERS):
            key, inverse = np.unique(last_bytes(gram, order + 1), return_inverse=True)
            self.orders.append((key, np.append(0, np.cumsum(np.bincount(inverse, n, len(key)).astype(np.int64)))))

    def odds(self, gram: np.ndarray) -> np.ndarray:
        """Scaled log odds by place of the bit and order, for the byte of each string."""
        out = np.zeros((8, ORDERS - LOW, len(gram)), np.int16)
        for k, (key, sums) in enumerate(self.orders):
            want, inverse = np.unique(last_bytes(gram, LOW + k + 1), return_inverse=True)
            base = want & ~np.uint64(255)
            # the keys that agree with context and bits so far lie side by side, zeros before ones
            first, last = np.searchsorted(key, base), np.searchsorted(key, base + np.uint64(256))
            for place in range(8):
                half = np.uint64(128 >> place)
                middle = np.searchsorted(key, base + half)
                out[place, k] = log_odds(sums[middle] - sums[first], sums[last] - sums[middle])[inverse]
                one = (want & half) > 0
                base = np.where(one, base + half, base)
                first, last = np.where(one, middle, first), np.where(one, last, middle)
        return out


def node_and_bit(gram: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    byte = gram & np.uint64(255)
    node = (np.uint64(1) << np.uint64(place)) | (byte >> np.uint64(8 - place))
    return node, ((byte >> np.uint64(7 - place)) & np.uint64(1)).astype(np.float32)


@dataclass
class Mixer:
    """Log odds by low order and slot, weights by gate, and counts of the refining map by gate and step of log odds.

    Without ``counts`` no context of a higher order has been met.
    """

    tables: Sequence[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def fresh(tables: Sequence[np.ndarray]) -> Mixer:
        return Mixer(tables, np.full((8 * ORDERS, ORDERS), 0.35, np.float32), np.zeros((8 * ORDERS, STEPS, 2)))

    def inputs(self, gram: np.ndarray, counts: Counts | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: log odds of all predictors, the gate (bit place and longest context met before), and the bit."""
        high = counts.odds(gram) if counts else None
        for place in range(8):
            node, bit = node_and_bit(gram, place)
            odds = np.zeros((ORDERS, len(gram)), np.float32)
            longest = np.zeros(len(gram), np.int64)
            for k in range(ORDERS):
                if k < LOW:
                    odds[k] = self.tables[k][slots_of(gram, k, node)]
                elif high is not None:
                    odds[k] = high[place, k - LOW]
                longest[odds[k] != 0] = k
            yield odds / np.float32(SCALE), place * ORDERS + longest, bit

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("kn,nk->n", odds, self.weights[gate]), -15, 15)

    @staticmethod
    def step(total: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(total * 2), -16, 16).astype(np.int64) + 16

    def probability(self, total: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mixed and the refined one."""
        plain = 1 / (1 + np.exp(-total.astype(np.float64)))
        zeros, ones = np.moveaxis(self.refined[gate, self.step(total)], -1, 0)
        refined = (ones + 8 * plain) / (zeros + ones + 8)
        return np.clip((plain + refined) / 2, 1e-7, 1 - 1e-7)

    def bits(self, gram: np.ndarray, counts: Counts | None = None) -> np.ndarray:
        """Bits that each byte costs after the five before it."""
        total = np.zeros(len(gram))
        for odds, gate, bit in self.inputs(gram, counts):
            p = self.probability(self.mixed(odds, gate), gate)
            total -= np.log2(np.where(bit > 0, p, 1 - p))
        return total

    def learn(self, gram: np.ndarray, n: np.ndarray, counts: Counts | None = None, rate: float = 0.02) -> None:
        """Predict, then move the weights of each gate by the error, weighted by the square root of n."""
        weight = np.sqrt(n)
        for odds, gate, bit in self.inputs(gram, counts):
            error = (bit - 1 / (1 + np.exp(-self.mixed(odds, gate)))) * weight
            held = np.maximum(np.bincount(gate, weight, 8 * ORDERS), 1)
            for k in range(ORDERS):
                self.weights[:, k] += (rate * 16 * np.bincount(gate, error * odds[k], 8 * ORDERS) / held).astype(np.float32)

    def outcomes(self, gram: np.ndarray, n: np.ndarray, counts: Counts | None = None) -> np.ndarray:
        """How often zeros and ones came at each gate and step of mixed log odds."""
        out = np.zeros((8 * ORDERS * STEPS, 2))
        for odds, gate, bit in self.inputs(gram, counts):
            at = gate * STEPS + self.step(self.mixed(odds, gate))
            for value in (0, 1):
                out[:, value] += np.bincount(at, n * (bit == value), len(out))
        return out.reshape(8 * ORDERS, STEPS, 2)


def gram_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Six-byte strings of training texts and their numbers, for the counts and for the mix."""
    waiting, size = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        gram, inverse = np.unique(np.concatenate([x[0] for x in waiting]), return_inverse=True)
        out = np.empty(len(gram), GRAM)
        out["gram"] = gram
        out["counted"], out["mixed"] = (np.bincount(inverse, np.concatenate([x[k] for x in waiting]), len(gram)) for k in (1, 2))
        return out, gram_buckets(gram, buckets)

    for batch in batches:
        use = batch.column(2).to_numpy()
        at = 0
        for s in slices(iter([batch]), SLICE):
            role = use[at : at + len(s)]
            at += len(s)
            gram, starts = byte_grams(s)
            role = np.repeat(role, np.diff(starts))
            both = [np.unique(gram[role == r], return_counts=True) for r in (1, 2)]
            for k, (found, n) in enumerate(both):
                zero = np.zeros(len(n), np.int64)
                waiting.append((found, n, zero) if k == 0 else (found, zero, n))
                size += len(n)
            if size > 1_500_000:
                yield flush()
                waiting, size = [], 0
    if size:
        yield flush()
    waiting = []
    trimmed()


GRAMS = "bucket long, grams binary, counted binary, mixed binary"


def summed_grams(records: np.ndarray, buckets: int) -> pa.Table:
    gram, inverse = np.unique(records["gram"], return_inverse=True)
    counts = [np.bincount(inverse, records[c], len(gram)).astype("<i8") for c in ("counted", "mixed")]
    bucket = pa.array(gram_buckets(gram[:1], buckets))
    return pa.table([bucket, *[pa.array([x.tobytes()], pa.binary()) for x in (gram, *counts)]], names=["bucket", "grams", "counted", "mixed"])


def _blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for g, a, b in zip(*[batch.column(k) for k in ("grams", "counted", "mixed")], strict=True):
            yield np.frombuffer(g.as_py(), "<u8"), np.frombuffer(a.as_py(), "<i8"), np.frombuffer(b.as_py(), "<i8")


def after_two(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """How often each byte came after the two before it; ``whole``: also in the texts of the mix."""
    for gram, counted, mix in _blobs(batches):
        n = counted + mix if whole else counted
        after, inverse = np.unique(last_bytes(gram[n > 0], 3), return_inverse=True)
        out = np.empty(len(after), AFTER)
        out["after"], out["n"] = after, np.bincount(inverse, n[n > 0], len(after))
        yield out, (((after >> np.uint64(8)) & np.uint64(255)) // np.uint64(256 // RANGES)).astype(np.int64)


def low_odds(records: np.ndarray) -> pa.Table:
    """Counts of the bytes, and scaled log odds of orders 1 and 2, for one range of the byte before."""
    width = 256 // RANGES
    after = records["after"].astype(np.int64)
    first = int(after[0] >> 8 & 255) // width
    at = ((after >> 16) * width + (after >> 8 & 255) - first * width) * 256 + (after & 255)
    two = np.bincount(at, records["n"], 256 * width * 256).astype(np.int64).reshape(-1, 256)
    one = two.reshape(256, width, 256).sum(0)
    blobs = [x.tobytes() for x in (one.sum(0).astype("<i8"), node_odds(one).astype("<i2"), node_odds(two).astype("<i2"))]
    return pa.table([pa.array([first]), *[pa.array([x], pa.binary()) for x in blobs]], names=["first", "bytes", "one", "two"])


def low_tables(grams: DataFrame, whole: bool) -> list[np.ndarray]:
    """Scaled log odds of orders 0 to 2 at the places of :func:`slots_of`."""
    width, total = 256 // RANGES, np.zeros((1, 256), np.int64)
    one, two = np.zeros((256, 256), np.int16), np.zeros((256, 256, 256), np.int16)
    for r in shuffled(grams, lambda b: after_two(b, whole), AFTER, low_odds, "first long, bytes binary, one binary, two binary").toLocalIterator():
        part = slice(r["first"] * width, (r["first"] + 1) * width)
        total += np.frombuffer(r.bytes, "<i8")
        one[part] = np.frombuffer(r.one, "<i2").reshape(width, 256)
        two[:, part] = np.frombuffer(r.two, "<i2").reshape(256, width, 256)
    return [node_odds(total).ravel(), one.ravel(), two.ravel()]


def block_grams(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Different six-byte strings of each block, by bucket."""
    for batch in batches:
        block = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = [np.unique(byte_grams(s)[0]) for s in slices(iter([batch.slice(a, b - a)]), SLICE)]
            if found:
                gram = np.unique(np.concatenate(found))
                numbers, blobs = pack(gram, gram_buckets(gram, buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.array([block[a]] * len(numbers), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["bucket", "block", "wanted"],
                )
    trimmed()


BITS = "block long, bucket long, grams binary, bits binary"


def block_bits(known: pa.Table, wanted: pa.Table, mixer: Mixer) -> pa.Table:
    """For each block, its different strings of one bucket and their bits."""
    counts = None
    for gram, counted, mix in _blobs(known.to_batches()):
        counts = Counts(gram, counted + mix)
    block = wanted.column("block").to_numpy()
    found = [np.frombuffer(x, "<u8") for x in wanted.column("wanted").to_pylist()]
    gram = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    bits = np.concatenate([np.zeros(0), *[mixer.bits(gram[a : a + PART], counts) for a in range(0, len(gram), PART)]])
    blocks, bucket, blobs, strings = np.unique(block), wanted.column("bucket").to_pylist(), [], []
    order = np.argsort(block, kind="stable")
    starts = np.append(np.searchsorted(block[order], blocks), len(block))
    for a, b in zip(starts, starts[1:], strict=False):
        # a block may come in two parts
        own = found[order[a]] if b - a == 1 else np.unique(np.concatenate([found[i] for i in order[a:b]]))
        strings.append(own.tobytes())
        blobs.append(bits[np.searchsorted(gram, own)].astype("<f4").tobytes())
    trimmed()
    return pa.table([pa.array(blocks, pa.int64()), pa.array(bucket[: len(blocks)], pa.int64()), pa.array(strings, pa.binary()), pa.array(blobs, pa.binary())], names=["block", "bucket", "grams", "bits"])


def learned(docs: DataFrame, role: str, buckets: int, epochs: int = 2, batch: int = 4096) -> tuple[Mixer, DataFrame]:
    """The mixer learned from (text, ``role``), and the strings with their numbers that its counts come from.

    Role 1 fills the counts, 2 moves weights and map and joins the counts afterwards, 0 teaches nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.col(role)).filter(F.col(role) > 0)
    grams = stored(shuffled(texts, lambda b: gram_counts(b, buckets), GRAM, lambda r: summed_grams(r, buckets), GRAMS))
    shared_tables = spark.sparkContext.broadcast(low_tables(grams, whole=False))
    model = Mixer.fresh(shared_tables.value)
    for _ in range(epochs):
        begin = model.weights

        def walk(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            own, total = Mixer.fresh(shared_tables.value), 0.0
            own.weights = begin.copy()
            for gram, counted, n in _blobs(batches):
                counts = Counts(gram[counted > 0], counted[counted > 0])
                gram, n = gram[n > 0], n[n > 0]
                order = np.argsort(mixed(gram))
                for a in range(0, len(order), batch):
                    part = order[a : a + batch]
                    own.learn(gram[part], n[part], counts)
                total += float(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([own.weights.astype("<f4").tobytes()], pa.binary()), pa.array([total])], names=["weights", "total"])

        found = grams.mapInArrow(walk, "weights binary, total double").collect()
        total = sum(r.total for r in found)
        if total:
            parts = sorted((r.total, bytes(r.weights)) for r in found)
            model.weights = (sum(np.frombuffer(w, "<f4").astype(np.float64) * t for t, w in parts) / total).astype(np.float32).reshape(-1, ORDERS)
    weights = model.weights

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer.fresh(shared_tables.value)
        own.weights = weights
        out = np.zeros_like(own.refined)
        for gram, counted, n in _blobs(batches):
            counts = Counts(gram[counted > 0], counted[counted > 0])
            for a in range(0, len(gram), PART):
                part, m = gram[a : a + PART], n[a : a + PART]
                out += own.outcomes(part[m > 0], m[m > 0], counts)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["outcomes"])

    for r in grams.mapInArrow(check, "outcomes binary").collect():
        model.refined += np.frombuffer(r.outcomes, "<f8").reshape(model.refined.shape)
    model.tables = low_tables(grams, whole=True)
    return model, grams


SCHEMA = "doc_id long, n_tokens long, n_known long, log_sum double, n_bytes long, bits double"


def scored(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Base and model scores of every document.

    Learns from documents whose crc32(doc_id as text) modulo ``modulus`` is not ``held``; an eighth of them, by
    hash, moves the mix before it joins the counts of the others. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the text's bytes and its end) and bits_per_byte. Null and empty
    texts have one token, the end. Repeated rows count and are scored each time; a null id is never held
    out. Other columns are not read. Without training texts every bit costs one bit.
    """
    spark = docs.sparkSession
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))
    size, rows = text_bytes(docs), docs.count()
    texts = in_blocks(docs, max(1, min(BLOCK_ROWS, BLOCK_BYTES * rows // max(1, size)))).withColumn("held_out", remainder)
    role = F.when(F.col("held_out"), 0).when(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0, 2).otherwise(1)
    buckets, many = buckets_for(size), buckets_for(size, GRAM_BYTES)
    model, grams = learned(texts.withColumn("role", role.cast("long")), "role", many)
    shared_tables = spark.sparkContext.broadcast(model.tables)
    weights, refined = model.weights, model.refined
    wanted = texts.select("doc_id", "text", "block").mapInArrow(lambda b: block_grams(b, many), "bucket long, block long, wanted binary")

    def price(known: pa.Table, wanted: pa.Table) -> pa.Table:
        return block_bits(known, wanted, Mixer(shared_tables.value, weights, refined))

    priced = grams.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(price, BITS)
    sent = texts.select("doc_id", "text", "block", (~F.col("held_out")).alias("train"))
    counts = shuffled(sent, lambda b: block_words(b, buckets), WORD, lambda r: word_counts(r, buckets), COUNTS)
    train_docs = texts.agg(F.count_if(~F.col("held_out")).alias("n")).first().n
    sums = counts.filter("block is null").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, distinct = (sums.total or 0) + train_docs, (sums.distinct or 0) + (train_docs > 0)

    def score(d: pa.Table, c: pa.Table) -> pa.Table:
        batches = d.to_batches()
        vocabulary = [np.zeros(0, np.uint64)]
        for s in slices(iter(batches)):
            vocabulary.append(np.unique(words(s, lower=True).hashes))
        known = np.unique(np.concatenate(vocabulary))
        number = (known % np.uint64(buckets)).astype(np.int64)
        corpus = np.zeros(len(known), np.int64)
        strings, cost = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for bucket, blob, own, bits in zip(*[c.column(x).to_pylist() for x in ("bucket", "counts", "grams", "bits")], strict=True):
            if blob is not None:
                corpus[number == bucket] = np.frombuffer(blob, "<u4")
            if bits is not None:
                strings.append(np.frombuffer(own, "<u8"))
                cost.append(np.frombuffer(bits, "<f4").astype(np.float64))
        logs = np.log10(corpus + 1.0)
        places, costs = Places(np.concatenate(strings)), np.concatenate(cost)
        columns: list[list] = [[] for _ in range(6)]
        for s in slices(iter(batches), SLICE):
            w = words(s, lower=True)
            at = np.searchsorted(known, w.hashes)
            doc, n = w.document(), len(s)
            gram, starts = byte_grams(s)
            bits = costs[places.of(gram)]
            values = (
                s.ids,
                np.diff(w.offsets) + 1,
                np.bincount(doc, corpus[at] > 0, n) + (train_docs > 0),
                np.bincount(doc, logs[at], n) + np.log10(train_docs + 1.0),
                np.diff(s.offsets),
                np.add.reduceat(bits, starts[:-1]),
            )
            for column, value in zip(columns, values, strict=True):
                column.extend(value.tolist())
        trimmed()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        made = [pa.array(column, pa.float64() if t == pa.float64() else None, from_pandas=True).cast(t) for column, t in zip(columns, types, strict=True)]
        return pa.table(made, names=[f.split()[0] for f in SCHEMA.split(", ")])

    beside = counts.filter("block is not null").select("block", "bucket", "counts").unionByName(priced, allowMissingColumns=True)
    found = texts.select("doc_id", "text", "block").groupBy("block").cogroup(beside.groupBy("block")).applyInArrow(score, SCHEMA)
    width = float(np.log10(total + (distinct + 1.0)))
    return found.select(
        "doc_id",
        remainder.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.lit(width)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"),
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
