"""Divergence of sources within a language, from smoothed integer term frequencies.

The distance of two groups is the sum over all kept terms of |p − q|, and most terms are missing from most
groups. Gustavson's row accumulation gives it without a row for each pair of postings: a group scatters its
terms through the term-major index into one dense accumulator over its peers. A term that a group lacks has that
group's baseline there (not 0), so the accumulator starts from the baselines and each scattered posting adds the
correction.

Postings are dealt into shards by term and rows of a language into blocks, so a task holds one bounded shard, one
accumulator and one block; totals of shards are added by Spark. The result itself has a row for each pair of
sources of a language.

Rows: null text, lang and source count as empty strings. Repeated rows count each time. A group without terms has
the baseline everywhere; a language without kept terms has distance 0 between all its sources and no term rows.
All numbers are integers, sums stay below 2**53 within a task and 2**63 in all. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.texts import trimmed
from claimlens.session import stored

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 1_000_000_000
#: A task's counters are sent on when they hold so many terms; longer texts are cut into parts of so many bytes.
HELD_TERMS = 300_000
PART_BYTES = 4 << 20
#: A shard has about so many postings, and more where a language has many sources: at least a quarter of its pairs
#: of sources, so that sums of shards stay few beside the postings, but no more than the second number.
SHARD_POSTINGS, MOST_POSTINGS = 40_000, 500_000
BLOCK_ROWS = 1024
ACCUMULATED = 1 << 22
SALTS = 16

GROUP = ["lang", "source"]
# The characters besides A-Z and a-z that words may have all lie outside ASCII: bytes from 0x80.
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at a break between words."""
    start = 0
    while len(text) - start > PART_BYTES:
        found = _BREAK.search(text, start + PART_BYTES)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task's rows; a row without term for each group."""
    total: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    groups: set[tuple[str, str]] = set()

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in total.items():
            terms = list(counts)
            columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
            held = docs[lang, source]
            columns += [pa.array(list(counts.values()), pa.int64()), pa.array([held[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        total.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            group = (lang, source)
            if group not in groups:
                groups.add(group)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((lang, source, None, 0, 0), _COUNTS, strict=True)], schema=_COUNTS)
                if len(groups) > HELD_TERMS:
                    groups.clear()
            if not text:
                continue
            counts = total.setdefault(group, Counter())
            seen: set[bytes] = set()
            for part in _parts(text.encode()):
                words = _WORD.findall(part.lower())  # of bytes: lower-cases A-Z only
                counts.update(words)
                seen.update(words)
            docs.setdefault(group, Counter()).update(seen)
            if sum(map(len, total.values())) > HELD_TERMS:
                yield from sent()
    yield from sent()
    trimmed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of every group; term is null in one row of each group."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    counts = filled.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (total + 5 terms)) in whole numbers; null without terms."""
    dividend = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    divisor = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", dividend, divisor))


class Postings:
    """Postings of one shard, by term and by row: the term-major index and the rows to scatter."""

    def __init__(self, term: np.ndarray, group: np.ndarray, p: np.ndarray, groups: int):
        order = np.argsort(term, kind="stable")
        self.group, self.p = group[order], p[order]
        self.terms = int(term.max(initial=-1)) + 1
        self.first = np.searchsorted(term[order], np.arange(self.terms + 1))
        rows = np.lexsort((p, group))
        self.row_term, self.row_p = term[rows], p[rows]  # by group, then ascending p
        self.row_first = np.searchsorted(group[rows], np.arange(groups + 1))
        self.row_sums = np.concatenate([[0], np.cumsum(self.row_p)])

    def beyond(self, g: int, baselines: np.ndarray) -> np.ndarray:
        """For each baseline the sum of |p − baseline| over the terms of group g."""
        a, b = self.row_first[g], self.row_first[g + 1]
        below = a + np.searchsorted(self.row_p[a:b], baselines)
        sums, low = self.row_sums, self.row_sums[a]
        return baselines * (below - a) - (sums[below] - low) + (sums[b] - sums[below]) - baselines * (b - below)


def accumulated(postings: Postings, z: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances, over the terms of one shard, of some groups to all groups; z: the baseline of each group."""
    sizes = np.diff(postings.row_first)
    others = np.zeros((len(z), len(rows)), np.int64)
    for h in np.flatnonzero(sizes):
        others[h] = postings.beyond(h, z[rows])
    out = np.empty((len(rows), len(z)), np.int64)
    for k, g in enumerate(rows):
        apart = np.abs(z[g] - z)
        # every term at both baselines, then the terms of the row, then those of each peer
        row = postings.terms * apart + postings.beyond(g, z) - sizes[g] * apart + others[:, k] - sizes * apart
        a, b = postings.row_first[g], postings.row_first[g + 1]
        term, mine = postings.row_term[a:b], postings.row_p[a:b]
        lengths = postings.first[term + 1] - postings.first[term]
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(postings.first[term], lengths) + step
        peer, theirs, mine = postings.group[at], postings.p[at], np.repeat(mine, lengths)
        # a term that both have was counted once from either side, against a baseline
        correction = np.abs(mine - theirs) - np.abs(mine - z[peer]) - np.abs(z[g] - theirs) + apart[peer]
        # below 2**53 in a shard, so the sums of doubles are exact
        out[k] = row + np.bincount(peer, correction, len(z)).astype(np.int64)
    return out


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _distances(postings: pa.Table, groups: pa.Table) -> pa.Table:
    """Distances over one shard of the groups of one block (``mine``) to all groups of the language."""
    order = np.argsort(groups.column("place").to_numpy(), kind="stable")
    names = groups.column("source").combine_chunks().take(pa.array(order))
    z, mine = groups.column("baseline").to_numpy()[order], groups.column("mine").to_numpy(zero_copy_only=False)[order]
    rows = np.flatnonzero(mine)
    term = postings.column("term").combine_chunks().dictionary_encode()
    found = Postings(term.indices.to_numpy().astype(np.int64), postings.column("place").to_numpy() - 1, postings.column("p").to_numpy(), len(z))
    sums = accumulated(found, z, rows)
    mine_at, peer_at = np.nonzero(rows[:, None] != np.arange(len(z)))
    lang = groups.column("lang")[0].as_py()
    out = pa.table(
        [pa.repeat(lang, len(mine_at)), names.take(pa.array(rows[mine_at])), names.take(pa.array(peer_at)), pa.array(sums[mine_at, peer_at])],
        schema=_PAIRS,
    )
    trimmed()
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Distance of each source to the others of its language, and the terms that stand out in it.

    ``docs`` has lang, source and text. Each lang keeps the terms in at least ``min_docs`` of its documents.
    (lang, source, part, item, value, rank): part 'pair' has every other source of the lang with the distance,
    part 'term' the first ``top`` terms of the source whose share is above the share in the lang, with the
    difference; higher values first, then items in the order of their bytes.
    """
    counts = stored(term_counts(docs))
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("n_lang"))
    kept = kept.filter(F.col("in_docs") >= min_docs).select("lang", "term", "n_lang")
    postings = stored(counts.join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "n_lang"))

    # one row for each group: occurrences, and those of its language, over kept terms
    totals = postings.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = postings.groupBy("lang", "term").agg(F.max("n_lang").alias("n"), F.count("*").alias("groups"))
    langs = langs.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"), F.sum("groups").alias("postings"))
    every = counts.filter("term is null").select(*GROUP)
    known = every.join(totals, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total", "postings"])
    of_lang = Window.partitionBy("lang")
    known = known.withColumns(
        {
            "place": F.row_number().over(of_lang.orderBy("source")),
            "peers": F.count("*").over(of_lang),
            "baseline": F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0).cast("long")),
        }
    )
    shard = F.least(F.lit(MOST_POSTINGS), F.greatest(F.lit(SHARD_POSTINGS), F.col("peers") * F.col("peers") / 4))
    known = known.withColumn("shards", F.greatest(F.ceil(F.col("postings") / shard), F.lit(1)).cast("long"))
    rows = F.greatest(F.least(F.lit(BLOCK_ROWS), F.expr(f"{ACCUMULATED} div peers")), F.lit(1)).cast("long")
    groups = stored(known.withColumn("rows", rows).withColumn("blocks", F.ceil(F.col("peers") / F.col("rows")).cast("long")))
    valued = stored(
        postings.join(groups, GROUP).select(
            *GROUP, "term", "place", "shards", "blocks",
            share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            share(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
    )
    ranked = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return _pairs(valued, groups).withColumn("rank", F.row_number().over(ranked)).select(*GROUP, F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        _terms(valued, top).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")
    )


def _terms(valued: DataFrame, top: int) -> DataFrame:
    """Terms above the share of the language: the first ``top`` of each salted part of a group, so no task ranks a
    whole vocabulary."""
    above = valued.filter("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    salted = above.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    place = Window.partitionBy(*GROUP, "_salt").orderBy(F.desc("value"), "item")
    return salted.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= top).drop("_salt", "_place")


def _pairs(valued: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every pair of sources, from shards of terms and blocks of rows."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # all groups of the language meet every (shard, block)
    right = groups.select("lang", "source", "place", "baseline", "rows", "shards", numbers("blocks").alias("block")).select(
        "lang", "source", "place", "baseline", (F.floor((F.col("place") - 1) / F.col("rows")) == F.col("block")).alias("mine"), "block", numbers("shards").alias("shard")
    )
    left = valued.select("lang", "term", "place", "p", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), numbers("blocks").alias("block"))
    key = ["lang", "shard", "block"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_distances, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
