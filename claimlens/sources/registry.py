"""Saved models and training results, as Spark-written files under one root folder.

Everything of a version is written first; a manifest, one JSON document that is written under another name and then
renamed, makes it visible last. What a run that was stopped has written is never listed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlens.sources.readers import exists

MANIFEST = (
    "target string, version string, saved_at timestamp, results string, cuts array<struct<label int, cut double>>, "
    "models array<struct<model string, path string, auc double, features array<struct<name string, type string>>>>"
)
ENTRY = (
    "target string, model string, version string, path string, features array<string>, types array<string>, auc double, "
    "results string, cuts array<struct<label int, cut double>>, saved_at timestamp"
)


@dataclass(frozen=True)
class Saved:
    """A loaded model: its pipeline, the names and types of its features, and the split it was trained with."""

    pipeline: PipelineModel
    features: list[str]
    types: dict[str, str]
    cuts: dict[int, float]


class Version:
    """A version in the making. Nothing of it is visible until :meth:`publish`."""

    def __init__(self, registry: Registry, target: str, at: datetime | None = None):
        self.registry, self.target = registry, target
        self.at = at or datetime.now(timezone.utc)
        self.name = self.at.strftime("%Y%m%d_%H%M%S_%f")
        self.models: list[dict] = []
        self.results: str | None = None

    def add_model(self, pipeline: PipelineModel, model: str, features: Sequence[str], auc: float | None = None, types: Mapping[str, str] | None = None) -> str:
        """Write a fitted pipeline. Returns its path."""
        path = f"{self.registry.root}/models/{self.target}/{model.replace(' ', '_')}/{self.name}"
        pipeline.write().overwrite().save(path)
        self.list_model(model, features, auc, types, path)
        return path

    def list_model(self, model: str, features: Sequence[str], auc: float | None = None, types: Mapping[str, str] | None = None, path: str | None = None) -> None:
        """Name a model in the manifest; without a path only its results can be loaded."""
        listed = [{"name": f, "type": (types or {}).get(f, "double")} for f in features]
        self.models.append({"model": model, "path": path, "auc": auc, "features": listed})

    def add_results(self, kind: str, df: DataFrame) -> DataFrame:
        """Write metrics or predictions and return them as stored, so they are computed once."""
        self.results = f"{self.registry.root}/results/{self.target}/{self.name}"
        df.write.mode("overwrite").parquet(f"{self.results}/{kind}")
        return self.registry.spark.read.schema(df.schema).parquet(f"{self.results}/{kind}")

    def publish(self, cuts: Mapping[int, float] | None = None) -> None:
        """Make the version visible. ``cuts`` are the hash values that split each class into test and training part."""
        document = {
            "target": self.target,
            "version": self.name,
            "saved_at": self.at.replace(tzinfo=None).isoformat(),
            "results": self.results,
            "cuts": [{"label": int(k), "cut": float(v)} for k, v in (cuts or {}).items()],
            "models": self.models,
        }
        self.registry._write(f"{self.target}-{self.name}.json", json.dumps(document))


@dataclass(frozen=True)
class Registry:
    """Root folder with ``models/``, ``results/`` and ``manifests/`` (one for each version)."""

    spark: SparkSession
    root: str

    def _write(self, name: str, text: str) -> None:
        """A file that appears whole or not at all."""
        jvm = self.spark.sparkContext._jvm
        folder = f"{self.root}/manifests"
        there, hidden = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}")
        files = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(hidden, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files.delete(there, False)
        if not files.rename(hidden, there):
            raise OSError(f"could not publish {name}")

    def version(self, target: str, at: datetime | None = None) -> Version:
        return Version(self, target, at)

    def save(
        self,
        pipeline: PipelineModel,
        target: str,
        model: str,
        features: Sequence[str],
        auc: float | None = None,
        at: datetime | None = None,
        types: Mapping[str, str] | None = None,
        cuts: Mapping[int, float] | None = None,
    ) -> str:
        """Save one fitted pipeline as a version of its own. Returns its path."""
        version = self.version(f"{target}", at)
        path = version.add_model(pipeline, model, features, auc, types)
        version.publish(cuts)
        return path

    def entries(self) -> DataFrame:
        """All published models in order of target, model and version."""
        folder = f"{self.root}/manifests"
        if not exists(self.spark, f"{folder}/*.json"):
            return self.spark.createDataFrame([], ENTRY)
        listed = self.spark.read.schema(MANIFEST).json(folder).select("*", F.explode("models").alias("m"))
        return listed.select(
            "target", "m.model", "version", "m.path", F.col("m.features.name").alias("features"), F.col("m.features.type").alias("types"),
            "m.auc", "results", "cuts", "saved_at",
        ).orderBy("target", "model", "version")

    def latest(self) -> DataFrame:
        return latest_versions(self.entries())

    def _load(self, row) -> Saved:
        return Saved(PipelineModel.load(row.path), list(row.features), dict(zip(row.features, row.types, strict=True)), {c.label: c.cut for c in row.cuts or []})

    def _loadable(self, target: str) -> DataFrame:
        return latest_versions(self.entries().filter((F.col("target") == target) & F.col("path").isNotNull()))

    def load(self, target: str, model: str) -> Saved:
        """The newest pipeline of a model and horizon."""
        row = self._loadable(target).filter(F.col("model") == model).first()
        if row is None:
            raise LookupError(f"no saved model {model} for {target}")
        return self._load(row)

    def load_all(self, target: str) -> dict[str, Saved]:
        rows = self._loadable(target).collect()
        return {r.model: self._load(r) for r in rows}

    def load_results(self, target: str) -> tuple[DataFrame, DataFrame] | None:
        """(metrics, predictions) of a horizon, each model's from its newest version with results; or None."""
        found = latest_versions(self.entries().filter(F.col("results").isNotNull() & (F.col("target") == target)))
        folders: dict[str, list[str]] = {}
        for r in found.collect():
            folders.setdefault(r.results, []).append(r.model)
        if not folders:
            return None
        out = []
        for kind in ("metrics", "predictions"):
            parts = None
            for folder, names in folders.items():
                part = self.spark.read.parquet(f"{folder}/{kind}").filter(F.col("model").isin(names))
                parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
            out.append(parts)
        return tuple(out)

    def has_results(self, target: str) -> bool:
        """Whether at least one model of the horizon was stored with an AUC."""
        stored = self.load_results(target)
        return stored is not None and not stored[0].filter(F.col("auc").isNotNull()).isEmpty()


def latest_versions(entries: DataFrame, order: str = "saved_at") -> DataFrame:
    """The newest entry per horizon and model."""
    newest = Window.partitionBy("target", "model").orderBy(F.desc(order), F.desc("version"))
    return entries.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
