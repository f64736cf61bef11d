"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a table of one row per distinct text: SHA-256 of the text without white space, and the row
that stands for it. New data is reduced to one row per digest, anti-joined with the index by sort and
merge (the index is already bucketed and sorted, so only the new digests are shuffled), and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import scratch_folder, stored

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


class DigestIndex:
    """Digests seen so far, kept as a bucketed table under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64):
        """Open the index in ``folder``, or start an empty one; the default folder is a new shared scratch folder."""
        self.spark, self.buckets = spark, buckets
        self.folder = folder or scratch_folder(spark)
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex
        if not spark.catalog.tableExists(self.table):
            columns = "digest BINARY, keep_id BIGINT, n_points INT"
            spark.sql(
                f"CREATE TABLE {self.table} ({columns}) USING parquet OPTIONS (path '{self.folder}') "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
            )

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, docs: DataFrame) -> DataFrame:
        """Judge a batch of documents, append its new digests, and return one row per document.

        Columns: doc_id, keep_id, group_size, kept, text_sha256, n_points. Of equal texts the row with the most
        code points, then the smallest doc_id, stays; if an earlier batch has the text, its row stays.
        group_size counts the batch's documents. Null texts are empty texts, and empty texts are equal.
        Rows repeated with id and text are one document; a null id loses ties. Other columns are ignored.
        An empty batch gives no rows.
        """
        judged = stored(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.unhex(F.sha2(normalised(), 256)).alias("digest"),
                F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
            ).distinct()
        )
        best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus")))
        groups = judged.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
        groups = groups.select(
            "digest", (-F.col("best.minus")).alias("keep_id"), F.col("best.n_points").alias("keep_points"), "group_size"
        )
        earlier = self.entries().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        standing = stored(groups.join(earlier, "digest", "left"))
        fresh = groups.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", F.col("keep_points").alias("n_points"))
            # dealt by the number of the bucket, whatever the number of tasks: one file for each bucket, not one for
            # each task and bucket; with as many tasks as buckets, some would get several
            .repartition(4 * self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
            .write.format("parquet")
            .mode("append")
            .option("path", self.folder)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )
        mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
        return judged.join(standing, "digest").select(
            "doc_id",
            F.when(F.col("old"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            "group_size",
            (F.col("old").isNull() & mine).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "n_points",
        )


def deduplicated(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns; of rows repeated with id and text, one."""
    keep = decisions.filter("kept").select("doc_id", F.unhex("text_sha256").alias("digest"), "n_points")
    own, points = F.unhex(F.sha2(normalised(docs["text"]), 256)), F.length(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(keep["doc_id"]) & (own == keep["digest"]) & (points == keep["n_points"])
    return docs.join(keep, same, "left_semi").dropDuplicates(["doc_id", "text"])
