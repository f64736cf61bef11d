"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are compared as words in lower case without ASCII punctuation. Documents that
share a seed, a run of ``LEAST`` words, with an item are tiled: the longest common run of words not yet
used is marked in both, again and again, so passages are found in any order. An item leaks into a document
if the marked words make up a given share of the item.

The benchmark is the stated query set: it is cut into blocks of bounded size, each block is broadcast, and
all documents stream past it. No document is moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.texts import grams, slices, words

LEAST = 5
#: One tile of so many words is a leak by itself.
LONG_TILE = 13
BLOCK_BYTES = 8 << 20
_MODULUS = (1 << 61) - 1
_BASE = 1_000_003


def rolling(units: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin (start, hash) of every window of ``size`` units."""
    if len(units) < size:
        return
    top, value = pow(_BASE, size - 1, _MODULUS), 0
    for k, unit in enumerate(units):
        if k >= size:
            value -= units[k - size] * top
        value = (value * _BASE + unit) % _MODULUS
        if k >= size - 1:
            yield k - size + 1, value


def _free(used: list[bool], breaks: list[bool], start: int, size: int) -> bool:
    return not any(used[start : start + size]) and not any(breaks[start + 1 : start + size])


def longest_matches(a: list[int], b: list[int], used_a: list[bool], used_b: list[bool], breaks: list[bool], size: int) -> list[tuple[int, int, int]]:
    """All (length, start in a, start in b) of the longest common free runs of at least ``size`` units."""
    at: dict[int, list[int]] = {}
    whole = [False] * len(a)
    for i, h in rolling(a, size):
        if _free(used_a, whole, i, size):
            at.setdefault(h, []).append(i)
    best: list[tuple[int, int, int]] = []
    for j, h in rolling(b, size):
        if h not in at or not _free(used_b, breaks, j, size):
            continue
        for i in at[h]:
            if a[i : i + size] != b[j : j + size]:
                continue
            if i and j and a[i - 1] == b[j - 1] and not (used_a[i - 1] or used_b[j - 1] or breaks[j]):
                continue  # part of a run that begins earlier
            k = size
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not (used_a[i + k] or used_b[j + k] or breaks[j + k]):
                k += 1
            if best and k < best[0][0]:
                continue
            if best and k > best[0][0]:
                best = []
            best.append((k, i, j))
    return sorted(best, key=lambda m: m[1:])


def tiles(a: list[int], b: list[int], breaks: list[bool] | None = None, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, start in a, start in b), longest first, then leftmost in a and b.

    ``breaks`` marks units of b that do not follow the unit before them. Common runs are looked for with
    a window that shrinks by halves from the length of the shorter sequence down to ``least``.
    """
    used_a, used_b = [False] * len(a), [False] * len(b)
    breaks = breaks or [False] * len(b)
    size, out = max(min(len(a), len(b)), least), []
    while True:
        found = longest_matches(a, b, used_a, used_b, breaks, size)
        for k, i, j in found:
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                used_a[i : i + k] = [True] * k
                used_b[j : j + k] = [True] * k
                out.append((k, i, j))
        if not found:
            if size == least:
                return out
            size = max(size // 2, least)


@dataclass
class Block:
    """Some benchmark items: their words, and all their seeds sorted, with the item and first word of each."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray
    items: np.ndarray
    spots: np.ndarray


def block_of(table: pa.Table) -> Block:
    ids, held, seeds, items, spots = [], [], [], [], []
    for s in slices(iter(table.to_batches()), key="item_id"):
        w = words(s, plain=True)
        h, whole = grams(w, LEAST)
        doc = w.document()
        for k in range(len(s)):
            held.append(w.hashes[w.offsets[k] : w.offsets[k + 1]])
        seeds.append(h[whole])
        items.append(doc[: len(h)][whole] + len(ids))
        spots.append(np.flatnonzero(whole) - w.offsets[doc[: len(h)][whole]])
        ids.extend(s.ids)
    columns = ((seeds, np.uint64), (items, np.int64), (spots, np.int64))
    seeds, items, spots = (np.concatenate(x) if x else np.zeros(0, t) for x, t in columns)
    order = np.lexsort((spots, items, seeds))
    return Block(np.array(ids), held, seeds[order], items[order], spots[order])


def _longest_run(places: np.ndarray) -> int:
    """Most consecutive numbers in an ascending array."""
    cuts = np.flatnonzero(np.diff(places, prepend=-9, append=-9) != 1)
    return int(np.diff(cuts).max(initial=0))


def leaks(block: Block, hashes: np.ndarray, seeds: np.ndarray, places: np.ndarray, share: float, long_tile: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item index, words of the item, covered words, tiles, words of the longest tile) for one document.

    ``seeds`` and ``places`` are the document's seeds that occur in the block, and their first words.
    """
    own = np.unique(seeds)
    low, high = np.searchsorted(block.seeds, own, "left"), np.searchsorted(block.seeds, own, "right")
    entries = np.concatenate([np.arange(i, j) for i, j in zip(low, high, strict=True)])
    items, spots = block.items[entries], block.spots[entries]
    covered = np.unique((places[:, None] + np.arange(LEAST)).ravel())
    breaks = [True, *(np.diff(covered) > 1).tolist()]
    text = None
    for item in np.unique(items).tolist():
        units = block.words[item]
        # tiles lie inside the words that shared seeds cover
        within = np.unique((spots[items == item][:, None] + np.arange(LEAST)).ravel())
        if len(within) < share * len(units) and _longest_run(within) < long_tile:
            continue
        text = text if text is not None else hashes[covered].tolist()
        found = tiles(units.tolist(), text, breaks)
        total, longest = sum(k for k, _, _ in found), max((k for k, _, _ in found), default=0)
        if found and (total >= share * len(units) or longest >= long_tile):
            yield item, len(units), total, len(found), longest


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The benchmark cut by hash of its ids into blocks of about ``block_bytes``, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = items.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-size // block_bytes))
    for number in range(n):
        yield block_of(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == number).toArrow())


def judged(block: Block, batch: pa.RecordBatch, share: float, long_tile: int, text: str = "text") -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item index, words of the item, covered words, tiles, longest tile) of all leaks into the rows of a batch."""
    if not len(block.seeds):
        return
    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(batch.schema.get_field_index(text))], names=["row", "text"])
    for s in slices(iter([numbered]), key="row"):
        w = words(s, plain=True)
        h, whole = grams(w, LEAST)
        at = np.minimum(np.searchsorted(block.seeds, h), len(block.seeds) - 1)
        places = np.flatnonzero(whole & (block.seeds[at] == h))
        doc = np.searchsorted(w.offsets, places, "right") - 1
        for k in np.unique(doc):
            first, own = w.offsets[k], places[doc == k]
            for found in leaks(block, w.hashes[first : w.offsets[k + 1]], h[own], own - first, share, long_tile):
                yield int(s.ids[k]), *found


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("item_words", pa.int32()),
        ("covered_words", pa.int32()),
        ("n_tiles", pa.int32()),
        ("longest_tile", pa.int32()),
        ("coverage", pa.float64()),
    ]
)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, block_bytes: int = BLOCK_BYTES, long_tile: int = LONG_TILE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, longest_tile, coverage) of every leak.

    An item leaks where its tiles cover ``share`` of its words, or where one tile alone has ``long_tile`` words,
    however long the item is. Whole texts; null and empty texts and items leak nothing, nor do items of fewer than ``LEAST`` words.
    Repeated rows are judged one by one and repeat their result; a null id stays null. Other columns are not read.
    """
    out = None
    for block in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                found = list(judged(items, batch, share, long_tile))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                columns = [[items.ids[f[1]] for f in found], *[[f[k] for f in found] for k in (2, 3, 4, 5)], [f[3] / f[2] for f in found]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, RESULT.types[1:], strict=True)]], schema=RESULT)

        schema = "doc_id long, item_id long, item_words int, covered_words int, n_tiles int, longest_tile int, coverage double"
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, block_bytes: int = BLOCK_BYTES, long_tile: int = LONG_TILE) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns; rows are judged in place."""
    for block in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[f[0] for f in judged(shared.value, batch, share, long_tile)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
