"""Labelled training rows and the held-out rule shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled rows of each class, outside ``held_out``.

    The sample is the rows with the smallest hashes of their ids, so it depends on neither order nor
    partitioning. Only these bounded ids are broadcast. Null labels and ids train nothing.
    """
    usable = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out)
        .dropDuplicates(["doc_id"])
    )
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
