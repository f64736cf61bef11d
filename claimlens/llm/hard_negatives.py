"""Hard negatives of anchor vectors by Fagin's threshold algorithm over sorted lists for each dimension.

Candidates are packed into shards of some thousand rows. For every label a search needs, a shard gives, for
each dimension, its rows in the order of that component. A search walks these lists from the end that the sign
of the anchor's component asks for, scores each row it meets for the first time exactly, and stops when no row
that it has not met can reach a place: the threshold, the score of a row made of the components at the present
depth, has fallen strictly below the last place of every window (strictly, since a tie goes to the smaller id).

Spark brings blocks of anchors and stripes (a bounded number of shards) together: each task searches one stripe
for one block, so neither side is ever whole in a task, and what it found is ranked by anchor afterwards.
Shards and blocks are dealt by hash, so a label that holds a third of the rows makes none of them larger.

Rows: a null id, label or vector, or a null or non-finite component, takes no part. A shorter vector counts as
followed by zeros. Rows equal in id, label and vector count once; rows that share an id only are rows of
their own, but none of them is a partner of an anchor with that id. Components beyond 2**20 in size after
scaling raise an error, so that scores of up to 8,192 dimensions are exact. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.texts import trimmed
from claimlens.session import stored

SCALE = 256
SHARD_ROWS = 4096
BLOCK_ROWS = 128
STRIPE_SHARDS = 16
LARGEST = 1 << 20
#: Lists are walked to this depth, then on in steps that double.
FIRST_DEPTH = 16

_PACKED = "shard long, width int, dims int, ids binary, labels binary, vectors binary"


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector): floor(256 x) of each component, x as double, as 32-bit integers in one binary."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()  # of the lists that are not null
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        gaps = flat.is_null().to_numpy(zero_copy_only=False)
        values = np.floor(SCALE * pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64))
        bad = gaps | ~np.isfinite(values)
        if (np.abs(values[~bad]) > LARGEST).any():
            raise ValueError("a vector component is too large for exact scores")
        badly = np.concatenate([[0], np.cumsum(bad)])
        whole = np.where(bad, 0, values).astype("<i4")
        ok = (badly[ends] == badly[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
        for k in (0, 1):
            ok &= batch.column(k).is_valid().to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(ok)
        blobs = [whole[ends[i] - sizes[i] : ends[i]].tobytes() for i in keep]
        chosen = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(blobs, pa.binary())],
            names=["vec_id", "label", "vector"],
        )


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones are followed by zeros."""
    dims = max((len(b) for b in blobs), default=0) // 4
    return np.frombuffer(b"".join(b.ljust(4 * dims, b"\0") for b in blobs), "<i4").reshape(len(blobs), dims)


def _pack(table: pa.Table) -> pa.Table:
    """One row for a shard; components take two bytes where all of them fit."""
    vectors = _matrix(table.column("vector").to_pylist())
    width = 2 if np.abs(vectors).max(initial=0) < 1 << 15 else 4
    parts = [table.column("vec_id").to_numpy().astype("<i8"), table.column("label").to_numpy().astype("<i4"), vectors.astype(f"<i{width}")]
    values = [table.column("shard")[0].as_py(), width, vectors.shape[1], *[p.tobytes() for p in parts]]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["shard", "width", "dims", "ids", "labels", "vectors"]
    return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)


@dataclass
class Lists:
    """Candidates with a sorted list for each dimension: row numbers in descending order of the component."""

    ids: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    values: np.ndarray


@dataclass
class Shard:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: np.ndarray = field(init=False)
    _lists: dict = field(default_factory=dict)

    def __post_init__(self):
        # small integers are sorted by radix; the complement turns ascending into descending
        self.order = np.argsort(~self.vectors, axis=0, kind="stable")

    def lists(self, label: int, same: bool) -> Lists:
        """The lists of the rows with this label, or of all others."""
        if (label, same) not in self._lists:
            chosen = (self.labels == label) == same
            place = np.cumsum(chosen) - 1
            n, dims = int(chosen.sum()), self.vectors.shape[1]
            by_dim = self.order.T
            order = place[by_dim[chosen[by_dim]]].reshape(dims, n).T
            # float64 holds these integers, their products and sums exactly: see LARGEST
            vectors = self.vectors[chosen].astype(np.float64)
            self._lists[label, same] = Lists(self.ids[chosen], vectors, order, np.take_along_axis(vectors, order, axis=0))
        return self._lists[label, same]


def _shards(table: pa.Table) -> Iterator[Shard]:
    for row in table.to_pylist():
        ids = np.frombuffer(row["ids"], "<i8")
        vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(len(ids), row["dims"])
        yield Shard(ids, np.frombuffer(row["labels"], "<i4"), vectors)


class Best:
    """The first ``k`` rows met so far with a score in [low, high]; higher scores first, then smaller ids."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bound(self) -> float:
        """A row whose score is below this cannot get in."""
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.bound) & (scores <= self.high)
        if inside.any():
            scores = np.concatenate([self.scores, scores[inside].astype(np.int64)])
            ids = np.concatenate([self.ids, ids[inside]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def search(lists: Lists, anchor: np.ndarray, anchor_id: int, windows: list[Best]) -> int:
    """Bring the windows up to date with some candidates by the threshold algorithm; returns how many it scored."""
    n, dims = lists.vectors.shape
    a = np.zeros(dims)
    a[: min(dims, len(anchor))] = anchor[:dims]  # components that one side lacks are zeros
    up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
    met = np.zeros(n, bool)
    depth, step = 0, FIRST_DEPTH
    while depth < n and any(w.bound < np.inf for w in windows):
        upto = min(n, depth + step)
        fresh = np.zeros(n, bool)
        if len(up) or len(down):
            fresh[lists.order[depth:upto][:, up]] = True
            fresh[lists.order[n - upto : n - depth][:, down]] = True
            fresh &= ~met
        else:  # all scores are 0 and no list says more than another
            fresh[depth:upto] = True
        met |= fresh
        new = np.flatnonzero(fresh)
        ids, scores = lists.ids[new], lists.vectors[new] @ a
        other = ids != anchor_id
        for w in windows:
            w.add(scores[other], ids[other])
        depth, step = upto, 2 * step
        threshold = lists.values[depth - 1, up] @ a[up] + lists.values[n - depth, down] @ a[down]
        if all(threshold < w.bound for w in windows):
            break
    return int(met.sum())


@dataclass(frozen=True)
class Packed:
    """Shards of candidates, and their number."""

    shards: DataFrame
    number: int

    @property
    def stripes(self) -> int:
        return max(1, -(-self.number // STRIPE_SHARDS))


def packed(rows: DataFrame, n: int) -> Packed:
    """Rows (vec_id, label, vector) in shards of about ``SHARD_ROWS``, dealt by hash."""
    number = max(1, -(-n // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(number)).cast("long"))
    return Packed(stored(dealt.groupBy("shard").applyInArrow(_pack, _PACKED)), number)


def _searched(anchors: DataFrame, blocks: int, candidates: Packed, searcher, schema: str) -> DataFrame:
    """Call ``searcher`` for every block of anchors and stripe of shards."""
    block = F.pmod("anchor_key", F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = candidates.shards.select(every(blocks).alias("block"), F.expr(f"shard div {STRIPE_SHARDS}").alias("stripe"), "*")
    right = anchors.select(block.alias("block"), every(candidates.stripes).alias("stripe"), "*")
    key = ["block", "stripe"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(searcher, schema)


def _rows(found: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*found, strict=True) if found else [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_POSITIVE = pa.schema([("anchor_key", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_key", pa.int64()), ("slot", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _positives(k: int):
    def run(shards: pa.Table, anchors: pa.Table) -> pa.Table:
        todo = anchors.to_pylist()
        best = [Best(k) for _ in todo]
        for shard in _shards(shards):
            for a, window in zip(todo, best, strict=True):
                search(shard.lists(a["label"], True), np.frombuffer(a["vector"], "<i4"), a["anchor_id"], [window])
        trimmed()
        return _rows([(a["anchor_key"], i, s) for a, w in zip(todo, best, strict=True) for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)], _POSITIVE)

    return run


def _negatives(k: int, least: int, most: int):
    def run(shards: pa.Table, anchors: pa.Table) -> pa.Table:
        todo = anchors.to_pylist()
        # least * positive <= 100 * negative <= most * positive, in whole numbers
        best = [[Best(k, -((-least * s) // 100), (most * s) // 100) for s in a["scores"]] for a in todo]
        useful = [[w for w in windows if w.low <= w.high] for windows in best]
        for shard in _shards(shards):
            for a, windows in zip(todo, useful, strict=True):
                if windows:
                    search(shard.lists(a["label"], False), np.frombuffer(a["vector"], "<i4"), a["anchor_id"], windows)
        trimmed()
        return _rows([(a["anchor_key"], slot, i, s) for a, windows in zip(todo, best, strict=True) for slot, w in enumerate(windows) for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)], _NEGATIVE)

    return run


def _first(df: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id or label. An anchor's
    positives are its first ``positives`` rows of the same label by score, its negatives for a positive the first
    ``negatives`` rows of another label whose score is at least ``least`` and at most ``most`` percent of the
    positive's. (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); a positive
    without a negative, and so any with a score below zero, gives no row.
    """
    cells = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    rows = stored(cells.mapInArrow(quantised, "vec_id long, label int, vector binary").distinct())
    marked = rows.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    n, of_them = marked.agg(F.count("*"), F.count_if("_anchor")).first()
    blocks = max(1, -(-of_them // BLOCK_ROWS))
    candidates = packed(rows, n)
    anchors = marked.filter("_anchor").select(F.xxhash64("vec_id", "label", "vector").alias("anchor_key"), F.col("vec_id").alias("anchor_id"), "label", "vector")
    near = _first(_searched(anchors, blocks, candidates, _positives(positives), _POSITIVE_SQL), ["anchor_key"], "positive_score", "positive_id", positives)
    known = stored(
        anchors.join(near.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")), "anchor_key")
    )
    asked = known.select("anchor_key", "anchor_id", "label", "vector", F.col("positives.positive_score").alias("scores"))
    far = _first(_searched(asked, blocks, candidates, _negatives(negatives, least, most), _NEGATIVE_SQL), ["anchor_key", "slot"], "negative_score", "negative_id", negatives)
    return far.join(known.select("anchor_key", "anchor_id", "positives"), "anchor_key").select(
        "anchor_id",
        F.get("positives", F.col("slot"))["positive_id"].alias("positive_id"),
        "rank",
        "negative_id",
        F.get("positives", F.col("slot"))["positive_score"].alias("positive_score"),
        "negative_score",
    )


_POSITIVE_SQL = "anchor_key long, positive_id long, positive_score long"
_NEGATIVE_SQL = "anchor_key long, slot int, negative_id long, negative_score long"
