"""Sinks for predictions, performance summaries and training results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_predictions(scored: DataFrame, path: str, file_format: str = "csv") -> None:
    """Predictions as a folder of files, written by all tasks."""
    _write(scored, path, file_format)


def write_summary(summary: DataFrame, path: str, file_format: str = "csv") -> None:
    """Performance summary, one folder per horizon."""
    _write(summary, path, file_format, partition="target")


def write_results(df: DataFrame, path: str) -> None:
    """Metrics or predictions as parquet, replacing only the horizons and models that are in the frame."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("target", "model")
        .parquet(path)
    )


def _write(df: DataFrame, path: str, file_format: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    if file_format == "csv":
        writer.option("header", True).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format: {file_format}")
