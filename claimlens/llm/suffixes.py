"""Suffix-array deduplication: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

A shard of texts is sorted by its suffixes; a stack over the lengths of common prefixes of neighbours walks
the tree of intervals. An interval whose suffixes are preceded by different bytes is a maximal repeat: the
group of all its occurrences, not only neighbours, is put out. Bytes inside repeats of at least the
threshold are removed from the documents. Passages meet in shards by anchor (see ``repeats``), so equal
strings always stand in one shard, and only passages met again are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimlens.llm.repeats import Found, Windows, each_block
from claimlens.llm.substring import spans_of
from claimlens.llm.texts import trimmed

WINDOW = 400
_FIRST = 7


class SuffixArray:
    """Suffix order and common prefixes of several byte strings, by doubling of ranks.

    ``chosen`` are the places whose suffixes are sorted (all, if None). Common prefixes end with a string.
    """

    def __init__(self, texts: list[bytes], chosen: np.ndarray | None = None):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.repeat(np.cumsum(lengths), lengths)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        symbols = np.concatenate([self.data.astype(np.uint64) + np.uint64(1), np.zeros(_FIRST, np.uint64)])
        at = np.arange(n)
        key = np.zeros(n, np.uint64)
        for k in range(_FIRST):
            key = (key << np.uint64(9)) | np.where(at + k < self.ends, symbols[k : n + k], np.uint64(0))
        self.levels: list[tuple[int, np.ndarray]] = []
        depth, longest = _FIRST, int(lengths.max(initial=0))
        while True:
            _, rank = np.unique(key, return_inverse=True)
            rank = (rank + 1).astype(np.int64)
            self.levels.append((depth, rank.astype(np.int32)))
            if depth >= longest or (n and rank.max() == n):
                break
            after = at + depth
            key = rank.astype(np.uint64) * np.uint64(n + 1) + np.where(after < self.ends, rank[np.minimum(after, n - 1)], 0).astype(np.uint64)
            depth *= 2
        places = at if chosen is None else chosen
        self.order = places[np.argsort(self.levels[-1][1][places], kind="stable")]
        self.common = self._common(self.order[:-1], self.order[1:])

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at i and j."""
        i, j, n = i.copy(), j.copy(), len(self.data)
        end_i, end_j = self.ends[i], self.ends[j]
        limit, total = np.minimum(end_i - i, end_j - j), np.zeros(len(i), np.int64)
        for depth, rank in reversed(self.levels):
            same = (i < end_i) & (j < end_j)
            same &= rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]
            i, j, total = i + same * depth, j + same * depth, total + same * depth
        going = np.ones(len(i), bool)
        for _ in range(_FIRST - 1):
            going &= (i < end_i) & (j < end_j) & (self.data[np.minimum(i, n - 1)] == self.data[np.minimum(j, n - 1)])
            i, j, total = i + going, j + going, total + going
        return np.minimum(total, limit)

    def intervals(self, least: int, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Maximal repeats (length, first, last place in ``order``) of at least ``least`` bytes.

        ``before`` names what precedes each sorted suffix; a negative number differs from all others.
        An interval counts if its suffixes are preceded by different things. Shorter ones come later.
        """
        common, before = self.common.tolist(), before.tolist()
        stack: list[list[int]] = []  # [length, first, what precedes all suffixes or None]
        for k in range(len(before)):
            shared = common[k] if k < len(common) else 0
            first, left = k, before[k]
            while stack and stack[-1][0] > shared:
                length, begin, what = stack.pop()
                left = self._joined(what, left)
                if left is None:
                    yield length, begin, k
                first = begin
            if shared < least:
                stack.clear()
                continue
            if stack and stack[-1][0] == shared:
                stack[-1][2] = self._joined(stack[-1][2], left)
            else:
                stack.append([shared, first, left])

    @staticmethod
    def _joined(a: int | None, b: int | None) -> int | None:
        return a if a is not None and a == b and a >= 0 else None


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of at least ``least`` bytes: (length, all occurrences as (text, place))."""
    if not any(texts):
        return []
    array = SuffixArray(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text = np.searchsorted(starts, array.order, "right") - 1
    head = array.order == starts[text]
    before = np.where(head, -1 - array.order, array.data[np.maximum(array.order - 1, 0)].astype(np.int64))
    out = []
    for length, a, b in array.intervals(least, before):
        out.append((length, sorted((int(t), int(p - starts[t])) for t, p in zip(text[a : b + 1], array.order[a : b + 1], strict=True))))
    return out


def resolve(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """For every window of every piece of a shard, whether it occurs at another place too (one byte each)."""
    texts = table.column("content").to_pylist()
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    windows = lengths - window + 1
    first = np.cumsum(windows) - windows
    piece = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(windows.sum()) - first[piece]
    array = SuffixArray(texts, starts[piece] + inside)
    text = np.searchsorted(starts, array.order, "right") - 1
    head = array.order == starts[text]
    before = np.where(head, -1 - array.order, array.data[np.maximum(array.order - 1, 0)].astype(np.int64))
    best = np.zeros(len(array.order), np.int64)
    for length, a, b in array.intervals(window, before):
        np.maximum(best[a : b + 1], length, out=best[a : b + 1])
    # the windows that a repeat holds from its occurrence on
    at = np.flatnonzero(best)
    own = text[at]
    place = first[own] + array.order[at] - starts[own]
    edge = np.zeros(len(piece) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, np.minimum(place + best[at] - window + 1, first[own] + windows[own]), -1)
    marked = np.cumsum(edge[:-1]) > 0
    marked |= np.repeat(table.column("many").to_numpy(zero_copy_only=False), windows)
    answers = [x.astype(np.uint8).tobytes() for x in np.split(marked, first[1:])]
    del array, best, edge
    trimmed()
    return pa.table([table.column("anchor"), table.column("piece"), pa.array(answers, pa.binary())], names=["anchor", "piece", "answer"])


SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:int,end:int>>, kept binary"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        ("kept", pa.binary()),
    ]
)


def _written(found: Found) -> pa.RecordBatch:
    s = found.slice
    size, removed, spans, kept = [], [], [], []
    for k in range(len(s)):
        a, b = s.offsets[k], s.offsets[k + 1]
        mine = found.covered[a:b]
        begin, end = spans_of(mine)
        size.append(int(b - a))
        removed.append(int(mine.sum()))
        spans.append([{"first": i, "end": j} for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
        kept.append(s.data[a:b][~mine].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip([s.ids, size, removed, spans, kept], _ARROW.types, strict=True)], schema=_ARROW)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = 128) -> DataFrame:
    """Remove every byte covered by ``window`` bytes that also start at any other place of the corpus.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs, in bytes of the UTF-8 text) and kept
    (the remaining bytes; a cut may fall inside a character). Matches lie in one document; strings are judged
    on the input. Null and empty texts have no bytes; shorter texts lose nothing; rows repeated, also under
    one id or a null id, are repeats of each other. Every row gives a row; other columns are not read.
    """
    spec = Windows(words=False, window=window, gram=gram, anywhere=True, shard=2048)
    return each_block(docs, spec, lambda table: resolve(table, window), _written, SCHEMA)
