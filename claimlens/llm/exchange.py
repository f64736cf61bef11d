"""Shuffle of numpy records: rows are packed by bucket before Spark shuffles and groups them.

A row of Spark's own costs far more than the 8 to 20 bytes of a hashed token. The mapper returns numpy
arrays and their buckets; each (slice, bucket) travels as one binary row, Spark groups by bucket, and the
reducer gets one bucket's arrays. Buckets follow the size of the input, so each stays a few MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.texts import trimmed

BUCKET_BYTES = 8 << 20


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0)


def buckets_for(nbytes: int, per_bucket: int = BUCKET_BYTES) -> int:
    return max(8, -(-nbytes // per_bucket))


def pack(records: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Bucket numbers and, for each, its records as bytes."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    ends = np.flatnonzero(np.diff(bucket, append=-1))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return bucket[ends], [records[a : b + 1].tobytes() for a, b in zip(starts, ends, strict=True)]


def shuffled(
    df: DataFrame,
    mapper: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[np.ndarray, np.ndarray]]],
    dtype: np.dtype,
    reducer: Callable[[np.ndarray], pa.Table],
    schema: str,
) -> DataFrame:
    """Send the mapper's (records, buckets) to one reducer call for each bucket."""
    dtype = np.dtype(dtype)
    packed = pa.schema([("bucket", pa.int64()), ("records", pa.binary())])

    def send(batches):
        for records, bucket in mapper(batches):
            if len(records):
                numbers, blobs = pack(records, bucket)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], schema=packed)

    def receive(table: pa.Table) -> pa.Table:
        blobs = table.column("records").to_pylist()
        records = np.frombuffer(b"".join(blobs), dtype)
        del blobs
        out = reducer(records)
        trimmed()
        return out

    return df.mapInArrow(send, "bucket long, records binary").groupBy("bucket").applyInArrow(receive, schema)
