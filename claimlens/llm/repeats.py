"""Repeated windows of a corpus, found without comparing all documents and without any hot group.

A window is a run of ``window`` units (words or bytes) of one document. Its anchor is the smallest hash of
its grams of ``gram`` units, so equal windows have equal anchors, and neighbouring windows mostly share
theirs: a document falls into pieces, runs of windows with one anchor. Only pieces are exchanged.

1. Documents lie in blocks of neighbouring rows. Each block sends every different piece once (anchor, hash of
   the content, smallest document), so a passage that a third of all rows share is one record of each block.
2. Records meet by anchor. An anchor met once is unique. If all its pieces are equal, every window of
   theirs is repeated, and the blocks are told. Otherwise the contents have to be compared.
3. One block sends each different piece of such an anchor; they meet in shards by anchor, where the
   operator's own index (suffix automaton or suffix array) answers for every window. An anchor with more
   than ``most`` different pieces is answered by counting window hashes instead, which splits it over tasks.
4. Answers return to the blocks, which find their pieces anew and mark the repeated windows.

An answer is a number for each window: the smallest document that has it; a window counts in the documents
with larger numbers. Operators that ask for any other place (``anywhere``) answer yes or no, one byte each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.exchange import buckets_for, shuffled, text_bytes
from claimlens.llm.texts import Slice, byte_units, mixed, powers, prefix_sums, run_hash, slices, trimmed, words
from claimlens.session import stored

NEVER = np.iinfo(np.int64).max
ALWAYS = np.iinfo(np.int64).min
BLOCK_ROWS = 256
FLUSH = 1 << 19
RECORD = np.dtype([("anchor", "<u8"), ("piece", "<u8"), ("block", "<i8"), ("first", "<i8"), ("many", "u1")])


@dataclass(frozen=True)
class Windows:
    """What is looked for: the unit, units of a window, units of a gram, and whether any other place counts
    (``anywhere``) or only one in a document with a smaller id."""

    words: bool
    window: int
    gram: int
    anywhere: bool
    most: int = 4096
    shard: int = 4096


@dataclass
class Units:
    """Units of a slice as 64-bit numbers, and where each document's units begin."""

    values: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray


@dataclass
class Pieces:
    """Runs of windows with one anchor: document index, first window, number of windows, anchor, content."""

    doc: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    piece: np.ndarray


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def units_of(s: Slice, spec: Windows) -> tuple[Units, object]:
    if spec.words:
        w = words(s)
        return Units(w.hashes, w.offsets, prefix_sums(w.hashes)), w
    values = byte_units(s.data)
    return Units(values, s.offsets, prefix_sums(values)), None


def pieces_of(u: Units, spec: Windows, span: int = 1 << 23) -> Pieces:
    """The pieces of a slice; a slice beyond ``span`` units is worked off in overlapping parts."""
    n, width = len(u.values), spec.window - spec.gram + 1
    parts: list[list[np.ndarray]] = []
    for first in range(0, max(n - spec.window + 1, 0), span):
        last = min(n, first + span + spec.window - 1)
        m = last - first - spec.gram + 1
        sums = u.sums[first : last + 1]
        grams = mixed((sums[spec.gram :] - sums[:m]) * powers(last + 1, inverse=True)[first : first + m] + np.uint64(spec.gram))
        # equal hashes: the leftmost; 40 bits of hash over 24 bits of place
        low = np.uint64((1 << 24) - 1)
        place = (sliding_minimum((grams & ~low) | np.arange(m, dtype=np.uint64), width) & low).astype(np.int64)
        doc = np.searchsorted(u.offsets, np.arange(first, first + len(place)), "right") - 1
        p = np.flatnonzero(np.arange(first, first + len(place)) + spec.window <= u.offsets[doc + 1])
        if not len(p):
            continue
        new = np.ones(len(p), bool)
        new[1:] = (place[p[1:]] != place[p[:-1]]) | (doc[p[1:]] != doc[p[:-1]]) | (p[1:] != p[:-1] + 1)
        at = np.flatnonzero(new)
        begin, count = p[at] + first, np.diff(np.append(at, len(p)))
        anchor = grams[place[p[at]]]
        content = run_hash(u.sums, begin, begin + count - 1 + spec.window)
        parts.append([doc[p[at]], begin, count, anchor, mixed(anchor + content * np.uint64(0x9E3779B97F4A7C15))])
    if not parts:
        none = np.zeros(0, np.int64)
        return Pieces(none, none, none, none.view(np.uint64), none.view(np.uint64))
    return Pieces(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def numbers(ids: np.ndarray) -> np.ndarray:
    """Document ids as integers; a missing id comes after all others."""
    if ids.dtype == np.int64:
        return ids
    return np.array([NEVER if x is None or x != x else int(x) for x in ids], np.int64)


def in_blocks(docs: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text, block): blocks of ``size`` neighbouring rows of the files that ``docs`` reads.

    A frame that is not a plain read of files is written to the shared scratch folder first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = ("_metadata.file_path", "_metadata.row_index")
    try:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(c.split(".")[1]) for c in place])
        rows.schema  # noqa: B018  fails here if there is no such column
    except AnalysisException:
        rows = stored(rows).select("doc_id", "text", *[F.col(c).alias(c.split(".")[1]) for c in place])
    block = F.xxhash64("file_path", F.floor(F.col("row_index") / size))
    return rows.select("doc_id", "text", block.alias("block"))


def _records(batches: Iterator[pa.RecordBatch], spec: Windows, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each block's different pieces, with their smallest document and whether they occur again in the block."""
    waiting, size = [], 0
    for batch in batches:
        block = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = []
            for s in slices(iter([batch.slice(a, b - a)])):
                x = pieces_of(units_of(s, spec)[0], spec)
                found.append((x.anchor, x.piece, numbers(s.ids)[x.doc]))
            if not found:
                continue
            anchor, piece, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(piece):
                continue
            order = np.lexsort((doc, piece))
            anchor, piece, doc = anchor[order], piece[order], doc[order]
            at = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            last = np.append(at[1:], len(piece)) - 1
            out = np.empty(len(at), RECORD)
            out["anchor"], out["piece"], out["block"], out["first"] = anchor[at], piece[at], block[a], doc[at]
            out["many"] = last > at if spec.anywhere else doc[last] > doc[at]
            waiting.append(out)
            size += len(out)
            if size >= FLUSH:
                records = np.concatenate(waiting)
                yield records, (records["anchor"] % np.uint64(buckets)).astype(np.int64)
                waiting, size = [], 0
    if waiting:
        records = np.concatenate(waiting)
        waiting = []
        yield records, (records["anchor"] % np.uint64(buckets)).astype(np.int64)
    trimmed()


LINKS = "block long, anchor long, piece long, first long, many boolean, kind int, owner boolean"
EQUAL, FEW, LARGE = 1, 2, 3


def _links(records: np.ndarray, spec: Windows) -> pa.Table:
    """Records of anchors met again: kind EQUAL if all pieces are one, FEW or LARGE if contents must be compared.

    ``owner`` marks one record of each different piece, the one with the smallest document.
    """
    order = np.lexsort((records["first"], records["piece"], records["anchor"]))
    r = records[order]
    n = len(r)
    new_piece = np.append(True, r["piece"][1:] != r["piece"][:-1])[:n]
    new_anchor = np.append(True, r["anchor"][1:] != r["anchor"][:-1])[:n]
    new_piece |= new_anchor
    at = np.flatnonzero(new_anchor)
    group = np.cumsum(new_anchor) - 1
    size = np.diff(np.append(at, n))
    pieces = np.add.reduceat(new_piece, at) if n else size
    at_piece = np.flatnonzero(new_piece)
    piece_of = np.cumsum(new_piece) - 1
    first = r["first"][at_piece][piece_of]
    again = np.add.reduceat(r["many"].astype(np.int64), at_piece) if n else size
    rows = np.diff(np.append(at_piece, n))
    many = ((again > 0) | (rows > 1))[piece_of]
    if not spec.anywhere and n:  # the same document in two parts of a block is no other document
        highest = np.maximum.reduceat(r["first"], at_piece)
        many = ((again > 0) | (highest > r["first"][at_piece]))[piece_of]
    kind = np.where(pieces == 1, EQUAL, np.where(pieces <= spec.most, FEW, LARGE))[group]
    keep = (kind > EQUAL) | many
    if not spec.anywhere:  # a block that holds nothing but the first document loses nothing
        keep &= (kind > EQUAL) | (r["first"] > first) | (r["many"] > 0)
    else:
        first = np.where(many, ALWAYS, NEVER)
    r, columns = r[keep], (first, many, kind, new_piece)
    first, many, kind, owner = (c[keep] for c in columns)
    arrays = [r["block"], r["anchor"].view(np.int64), r["piece"].view(np.int64), first, many, kind.astype(np.int32), owner]
    return pa.table([pa.array(np.ascontiguousarray(x)) for x in arrays], names=[c.split()[0] for c in LINKS.split(", ")])


CONTENT = "anchor long, piece long, first long, many boolean, kind int, content binary"


def _content(docs: pa.Table, wanted: pa.Table, spec: Windows) -> pa.Table:
    """The units of the wanted pieces of one block: 8 bytes of each word, or the bytes themselves."""
    names = [c.split()[0] for c in CONTENT.split(", ")]
    keys = wanted.column("piece").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, found = keys[order], [[] for _ in names]
    meta = [wanted.column(c).to_numpy()[order] for c in names[:5]]
    done = np.zeros(len(keys), bool)
    for s in slices(iter(docs.to_batches())) if len(keys) else ():
        u, _ = units_of(s, spec)
        x = pieces_of(u, spec)
        at = np.minimum(np.searchsorted(keys, x.piece), len(keys) - 1)
        for k in np.flatnonzero(keys[at] == x.piece):
            if not done[at[k]]:
                done[at[k]] = True
                end = x.begin[k] + x.count[k] - 1 + spec.window
                raw = u.values[x.begin[k] : end] if spec.words else s.data[x.begin[k] : end]
                for column, value in zip(found, [*(m[at[k]] for m in meta), raw.tobytes()], strict=True):
                    column.append(value)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    trimmed()
    return pa.table([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=names)


ANSWERS = "anchor long, piece long, answer binary"


def _by_counting(contents: DataFrame, spec: Windows) -> DataFrame:
    """Answers for anchors with very many different pieces: equal windows meet by two hashes of theirs."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, piece, first, many, raw in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                values = np.frombuffer(raw, "<u8") if spec.words else byte_units(np.frombuffer(raw, np.uint8))
                start = np.arange(len(values) - spec.window + 1)
                both = [run_hash(prefix_sums(v), start, start + spec.window).view(np.int64) for v in (values, mixed(values))]
                columns = [np.full(len(start), anchor), np.full(len(start), piece), start, *both, np.full(len(start), first)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([many] * len(start))], names=names)

    schema = "anchor long, piece long, place long, h1 long, h2 long, first long, many boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = contents.select("anchor", "piece", "first", "many", "content").mapInArrow(hashes, schema)
    # the place inside the piece does not matter, and a window occurs once in a piece unless the piece repeats itself
    again = F.when((F.count("*") > 1) | F.max("many"), F.lit(ALWAYS)).otherwise(F.lit(NEVER))
    met = rows.groupBy("h1", "h2").agg((again if spec.anywhere else F.min("first")).alias("answer"))
    pairs = F.sort_array(F.collect_list(F.struct("place", "answer")))
    lists = rows.join(met, ["h1", "h2"]).groupBy("anchor", "piece").agg(F.transform(pairs, lambda x: x["answer"]).alias("answers"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (lambda x: (x == ALWAYS).astype(np.uint8)) if spec.anywhere else (lambda x: x)
            blobs = [kind(np.array(x, "<i8")).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["anchor", "piece", "answer"])

    return lists.mapInArrow(packed, ANSWERS)


@dataclass
class Found:
    """One slice with its marked windows: which units are covered by one."""

    slice: Slice
    words: object
    units: Units
    covered: np.ndarray


def _marked(docs: pa.Table, answers: pa.Table, spec: Windows) -> Iterator[Found]:
    keys = answers.column("piece").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, whole = keys[order], answers.column("first").to_numpy()[order]
    blobs = answers.column("answer").take(pa.array(order)).to_pylist()
    length = np.array([len(b or b"") for b in blobs], np.int64)
    flat = np.frombuffer(b"".join(b for b in blobs if b is not None), np.uint8)
    if spec.anywhere:
        flat = np.where(flat > 0, ALWAYS, NEVER)
    else:
        length, flat = length // 8, flat.view("<i8")
    start = np.concatenate([[0], np.cumsum(length)])
    for s in slices(iter(docs.to_batches())):
        u, w = units_of(s, spec)
        edge = np.zeros(len(u.values) + 1, np.int32)
        if len(keys):
            x = pieces_of(u, spec)
            at = np.minimum(np.searchsorted(keys, x.piece), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == x.piece)
            count, row = x.count[hit], at[hit]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row, place = np.repeat(row, count), np.repeat(x.begin[hit], count) + inside
            value = whole[row].copy()
            listed = length[row] > 0
            value[listed] = flat[start[row[listed]] + inside[listed]]
            place = place[value < np.repeat(numbers(s.ids)[x.doc[hit]], count)]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + spec.window, -1)
        yield Found(s, w, u, np.cumsum(edge[:-1]) > 0)


def each_block(docs: DataFrame, spec: Windows, resolve: Callable[[pa.Table], pa.Table], write: Callable[[Found], pa.RecordBatch], schema: str) -> DataFrame:
    """``write`` each slice of ``docs`` with its repeated windows marked.

    ``resolve`` gets the contents of one shard (schema CONTENT) and gives ANSWERS for all of them.
    """
    rows = in_blocks(docs)
    size = text_bytes(docs)
    buckets = buckets_for(size)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return _records(batches, spec, buckets)

    links = stored(shuffled(rows, records, RECORD, lambda r: _links(r, spec), LINKS))
    kinds = {r.kind: r.n for r in links.filter("owner").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    answered = links.filter(F.col("kind") == EQUAL).select("block", "piece", "first", F.lit(None).cast("binary").alias("answer"))
    if kinds.get(FEW) or kinds.get(LARGE):
        owners = links.filter((F.col("kind") > EQUAL) & F.col("owner")).select("block", "anchor", "piece", "first", "many", "kind")
        contents = (
            rows.groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(lambda d, w: _content(d, w, spec), CONTENT)
        )
        answers = None
        if kinds.get(LARGE):
            answers = _by_counting(contents.filter(F.col("kind") == LARGE), spec)
        if kinds.get(FEW):
            shards = max(8, -(-kinds[FEW] // spec.shard))
            few = contents.filter(F.col("kind") == FEW).groupBy(F.pmod("anchor", F.lit(shards)).alias("shard"))
            by_index = few.applyInArrow(resolve, ANSWERS)
            answers = by_index if answers is None else answers.unionByName(by_index)
        others = links.filter(F.col("kind") > EQUAL).select("block", "anchor", "piece")
        told = others.join(answers, ["anchor", "piece"]).select("block", "piece", F.lit(0).cast("long").alias("first"), "answer")
        answered = answered.unionByName(told)

    def finish(d: pa.Table, a: pa.Table) -> pa.Table:
        out = [write(found) for found in _marked(d, a, spec)]
        trimmed()
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([], schema=empty)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema))
    return rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, schema)
