"""Substring deduplication of words with suffix automata of reference shards.

A shard of reference texts becomes one suffix automaton whose states know the smallest document that has
their strings. Texts are streamed through it: the matching statistics tell, word by word, how long the
longest reference string ending there is; maximal spans of at least the threshold are removed.

:func:`without_reference` broadcasts the automata of a given reference set, block after block.
:func:`without_earlier` takes the whole corpus as reference. Broadcasting it would be quadratic, so shards
and the passages to stream meet by anchor (see ``repeats``), and only passages met again take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.repeats import Found, Windows, each_block
from claimlens.llm.texts import slices, trimmed, words

WINDOW = 13


class SuffixAutomaton:
    """Suffix automaton of many sequences, added by rising owner; each state keeps its first owner."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, follow: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, state: int, unit: int, target: int) -> int:
        """The state of the strings that ``state`` + ``unit`` really ends, taken out of ``target``."""
        clone = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1, self.first[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(unit) == target:
            self.next[state][unit] = clone
            state = self.link[state]
        return clone

    def add(self, units: list[int], owner: int) -> None:
        last = 0
        for unit in units:
            target = self.next[last].get(unit)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, unit, target)
                continue
            state = self._state({}, 0, self.length[last] + 1, owner)
            at = last
            while at >= 0 and unit not in self.next[at]:
                self.next[at][unit] = state
                at = self.link[at]
            if at >= 0:
                target = self.next[at][unit]
                self.link[state] = target if self.length[target] == self.length[at] + 1 else self._split(at, unit, target)
            last = state

    def statistics(self, units: list[int], most: int) -> Iterator[tuple[int, int | None]]:
        """For each unit: length of the longest known string ending there, up to ``most``, and the first
        owner of the string of that length when it is ``most``."""
        state = size = 0
        for unit in units:
            while state and unit not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if unit in self.next[state]:
                state = self.next[state][unit]
                size += 1
            while state and self.length[self.link[state]] >= most:
                state = self.link[state]
            if size >= most:
                size = most
            yield size, self.first[state] if size == most else None


def resolve(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """For every window of every piece of a shard, the smallest document among the shard's pieces that has it."""
    table = table.sort_by([("first", "ascending"), ("piece", "ascending")])
    blobs = [np.frombuffer(b, "<u8") for b in table.column("content").to_pylist()]
    _, inverse = np.unique(np.concatenate(blobs), return_inverse=True)
    cuts = np.cumsum([len(b) for b in blobs])[:-1]
    pieces = [x.tolist() for x in np.split(inverse, cuts)]
    automaton = SuffixAutomaton()
    for units, first in zip(pieces, table.column("first").to_pylist(), strict=True):
        automaton.add(units, first)
    answers = [np.array([f for size, f in automaton.statistics(u, window) if size == window], "<i8").tobytes() for u in pieces]
    del automaton, pieces
    trimmed()
    return pa.table([table.column("anchor"), table.column("piece"), pa.array(answers, pa.binary())], names=["anchor", "piece", "answer"])


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,end:int>>, kept string"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        ("kept", pa.string()),
    ]
)


def _write(ids, raw: bytes, offsets, w, covered: np.ndarray) -> pa.RecordBatch:
    number, removed, spans, kept = [], [], [], []
    for k in range(len(ids)):
        a, b = w.offsets[k], w.offsets[k + 1]
        mine = covered[a:b]
        n = int(mine.sum())
        if n:
            begin, end = spans_of(mine)
            spans.append([{"first": i, "end": j} for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
            stay = np.flatnonzero(~mine) + a
            parts = [raw[i:j] for i, j in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]
        else:
            spans.append([])
            parts = raw[offsets[k] : offsets[k + 1]].split()
        number.append(int(b - a))
        removed.append(n)
        kept.append(b" ".join(parts).decode())
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip([ids, number, removed, spans, kept], _ARROW.types, strict=True)], schema=_ARROW)


def _written(found: Found) -> pa.RecordBatch:
    return _write(found.slice.ids, found.slice.data.tobytes(), found.slice.offsets, found.words, found.covered)


def without_earlier(docs: DataFrame, window: int = WINDOW, gram: int = 7) -> DataFrame:
    """Remove every word covered by ``window`` words that also stand in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, spans (words removed, maximal runs) and kept (the other words, joined
    by one blank). Windows are judged on the input. Null and empty texts have no words; texts shorter than
    a window lose nothing; rows repeated under one id lose nothing to each other; a null id counts as larger
    than all others. Every row gives a row; other columns are not read. ``gram`` only sets how passages are found.
    """
    spec = Windows(words=True, window=window, gram=gram, anywhere=False)
    return each_block(docs, spec, lambda table: resolve(table, window), _written, SCHEMA)


def without_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """Remove every word covered by ``window`` words that also stand in a text of ``reference`` (doc_id, text).

    The reference is cut into blocks of about ``block_bytes``; the automaton of each is built once and
    broadcast, and all documents are streamed past it. Output and special cases as in :func:`without_earlier`;
    a document may stand in the reference itself and is then removed.
    """
    spark = docs.sparkSession
    texts = reference.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = texts.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-size // block_bytes))
    automata = []
    for number in range(n):
        block = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == number).toArrow()
        automaton = SuffixAutomaton()
        for s in slices(iter(block.to_batches())):
            w = words(s)
            for k in range(len(s)):
                automaton.add(w.hashes[w.offsets[k] : w.offsets[k + 1]].tolist(), 0)
        automata.append(spark.sparkContext.broadcast(automaton))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            w = words(s)
            covered = np.zeros(len(w.hashes), bool)
            for k in range(len(s)):
                a, units = int(w.offsets[k]), w.hashes[w.offsets[k] : w.offsets[k + 1]].tolist()
                for automaton in automata:
                    for i, (length, _) in enumerate(automaton.value.statistics(units, window)):
                        if length == window:
                            covered[a + i + 1 - window : a + i + 1] = True
            yield _write(s.ids, s.data.tobytes(), s.offsets, w, covered)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)
