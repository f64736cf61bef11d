"""Quality classifier: nearest labelled neighbours in a latent semantic space vote on every document.

A document becomes frequencies of byte-class trigrams, of hashed words and of word repetitions. A truncated
singular value decomposition of a bounded labelled sample gives the latent space. The labelled vectors,
``2 * per_class`` at most, are broadcast; every document's cosine with all of them is computed exactly, in
blocks, and the labels of the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.labelled import remainder, training_rows
from claimlens.llm.texts import Slice, slices, words

CLASSES = 14
WORD_SLOTS = 256
REPEATS = 4
WIDTH = CLASSES**3 + WORD_SLOTS + REPEATS
MOST_ROWS = 256


def _byte_classes() -> np.ndarray:
    """Letters, digits, spaces, line ends, non-ASCII, and groups of punctuation."""
    c = np.full(256, 6, np.int64)
    c[97:123], c[65:91], c[48:58], c[128:] = 0, 1, 2, 3
    c[[32, 9, 11, 12]], c[[10, 13]] = 4, 5
    for k, marks in enumerate((b".,", b"!?", b"|", b"#", b"%&$", b"*~^", b"<>{}[]()"), 7):
        c[list(marks)] = k
    return c


BYTE_CLASS = _byte_classes()


def features(s: Slice) -> np.ndarray:
    """One row of square-rooted frequencies per document; an empty text is all zeros."""
    n = len(s)
    out = np.zeros((n, WIDTH), np.float32)
    tri = CLASSES**3
    length = np.diff(s.offsets)
    if len(s.data) >= 3:
        c = BYTE_CLASS[s.data]
        doc = np.repeat(np.arange(n), length)
        whole = doc[:-2] == doc[2:]
        code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        counts = np.bincount((doc[:-2] * tri + code)[whole], minlength=n * tri).reshape(n, tri)
        out[:, :tri] = np.sqrt(counts / np.maximum(length - 2, 1)[:, None])
    w = words(s, lower=True)
    if len(w.hashes):
        doc, number = w.document(), np.maximum(np.diff(w.offsets), 1)
        slot = (w.hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
        counts = np.bincount(doc * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
        out[:, tri : tri + WORD_SLOTS] = 0.3 * np.sqrt(counts / number[:, None])
        for k in range(1, 3):
            same = (w.hashes[k:] == w.hashes[:-k]) & (doc[k:] == doc[:-k])
            out[:, tri + WORD_SLOTS + k - 1] = 2 * np.bincount(doc[k:][same], minlength=n) / number
        order = np.lexsort((w.hashes, doc))
        h, d = w.hashes[order], doc[order]
        again = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        share = np.bincount(d[1:][again], minlength=n) / number
        out[:, tri + WORD_SLOTS + 2] = 0.5 * share
        out[:, tri + WORD_SLOTS + 3] = 0.5 * np.maximum(share - 0.5, 0)
    return out


@dataclass
class QualityModel:
    """Column weights, latent directions, and the labelled vectors with their labels."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float
    block: int = 2048

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = (rows * self.weights) @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Share of similarity weight on label 1 among the nearest labelled vectors; the prior without any."""
        z = self.latent(rows)
        best = np.full((len(z), 0), -2, np.float32)
        found = np.zeros((len(z), 0), np.float32)
        for a in range(0, len(self.vectors), self.block):
            best = np.concatenate([best, z @ self.vectors[a : a + self.block].T], 1)
            found = np.concatenate([found, np.broadcast_to(self.labels[a : a + self.block], (len(z), best.shape[1] - found.shape[1]))], 1)
            if best.shape[1] > self.neighbours:
                at = np.argpartition(-best, self.neighbours - 1, 1)[:, : self.neighbours]
                best, found = np.take_along_axis(best, at, 1), np.take_along_axis(found, at, 1)
        weight = np.maximum(best, 0).astype(np.float64) ** 4
        total = weight.sum(1)
        vote = (weight * found).sum(1) + 1e-6 * self.prior
        return np.clip(vote / (total + 1e-6), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 2500, latent: int = 32, neighbours: int = 25) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each class outside ``held_out`` (a bounded, documented sample).

    The neighbours of a class are weighted alike; without rows of both classes every score is the only
    label seen, or 0.5.
    """
    sample = training_rows(docs, labels, "quality", held_out, per_class)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at = batch.column(2).to_numpy(zero_copy_only=False), 0
            for s in slices(iter([batch]), most=MOST_ROWS):
                x = features(s).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.ids), pa.array(label[at : at + len(s)].astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["doc_id", "label", "row"],
                )
                at += len(s)

    found = sample.select("doc_id", "text", "label").mapInArrow(rows, "doc_id long, label int, row binary").toArrow().sort_by("doc_id")
    y = found.column("label").to_numpy().astype(np.float32)
    if not len(y):
        nothing = np.zeros((0, latent), np.float32)
        return QualityModel(np.ones(WIDTH, np.float32), np.zeros((WIDTH, latent), np.float32), nothing, y, neighbours, 0.5)
    x = np.stack([np.frombuffer(r, np.float16) for r in found.column("row").to_pylist()]).astype(np.float32)
    seen = (x > 0).sum(0)
    weights = (np.log((len(x) + 1) / (seen + 1)) + 1).astype(np.float32)
    x *= weights
    _, directions = np.linalg.eigh((x.T @ x).astype(np.float64))
    directions = np.ascontiguousarray(directions[:, ::-1][:, :latent]).astype(np.float32)
    model = QualityModel(weights, directions, np.zeros((0, latent), np.float32), y, neighbours, float(y.mean()))
    model.vectors = model.latent(x / weights)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; null and empty texts get a score too, rows are never merged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, most=MOST_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(s.ids, pa.int64(), from_pandas=True), pa.array(shared.value.scores(features(s)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Fit outside the held-out rows and score every document: doc_id, held_out, score, predicted."""
    held_out = remainder("doc_id", modulus) == held
    model = fit(docs, labels, held_out, per_class=2500)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
