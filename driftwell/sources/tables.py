"""Snapshots, exports, requests and fitted models on a file system that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.sources.event_log import EventLog

SAVES = "seq long, name string, version int, path string, saved_at timestamp"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Snapshots:
    """Named Parquet snapshots under ``root``: each save has a folder of its own that never changes, and is committed by an event in a log.

    Readers of a snapshot are not disturbed by later saves, earlier versions can be loaded by number or by time, and a save that
    failed midway is never seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = EventLog(spark, f"{self.root}/_saves", SAVES)

    def save(self, name: str, df: DataFrame) -> str:
        """Write a new version of a snapshot and return its folder."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)

        def commit(seq: int, before: DataFrame) -> dict:
            last = before.where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
            return {"name": name, "version": last + 1, "path": path, "saved_at": datetime.now(UTC).isoformat()}

        self.log.append(commit)
        return path

    def versions(self, name: str | None = None) -> DataFrame:
        """Every save, or those of one name."""
        saves = self.log.events()
        return saves if name is None else saves.where(F.col("name") == name)

    def list(self) -> DataFrame:
        """The latest save of each name."""
        last = self.versions().groupBy("name").agg(F.max_by(F.struct("version", "path", "saved_at"), "seq").alias("s"))
        return last.select("name", "s.*").orderBy("name")

    def load(self, name: str, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
        """A snapshot: the latest, that of a number, or the latest saved at a time or before; KeyError if there is none."""
        saves = self.versions(name)
        if version is not None:
            saves = saves.where(F.col("version") == version)
        if as_of is not None:
            saves = saves.where(F.col("saved_at") <= F.lit(as_of))
        row = saves.orderBy(F.desc("seq")).head(1)
        if not row:
            raise KeyError(name)
        return self.spark.read.parquet(row[0]["path"])


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder with a header for each table; columns must be flat."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A batch of JSON observations with a fixed schema."""
    return spark.read.schema(schema).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str | None) -> PipelineModel | None:
    return PipelineModel.load(path) if path else None


MODELS = "seq long, artifact_id string, artifact_type string, version int, created_at timestamp, event string, metadata map<string,double>"


class ModelStore:
    """Fitted models under ``root``, each with an event of metadata in a log that several writers may append to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = EventLog(spark, f"{self.root}/_events", MODELS)

    def events(self) -> DataFrame:
        return self.log.events()

    def _append(self, artifact_id: str, event: str, told: Callable[[DataFrame], tuple[int, dict[str, float]]]) -> int:
        def make(seq: int, before: DataFrame) -> dict:
            version, metadata = told(before)
            return {"artifact_id": artifact_id, "artifact_type": "model", "version": version, "created_at": datetime.now(UTC).isoformat(), "event": event, "metadata": {k: float(v) for k, v in metadata.items()}}

        return self.log.append(make)["version"]

    def save(self, model: PipelineModel, artifact_id: str, metadata: dict[str, float]) -> int:
        """The version of the model, one more than the models saved before."""
        save_model(model, f"{self.root}/{artifact_id}")
        return self._append(artifact_id, "save", lambda before: (before.where("event = 'save'").select("artifact_id").distinct().count() + 1, metadata))

    def _saved(self, artifact_id: str, events: DataFrame):
        row = events.where((F.col("event") == "save") & (F.col("artifact_id") == artifact_id)).orderBy(F.desc("seq")).head(1)
        if not row:
            raise KeyError(artifact_id)
        return row[0]

    def promote(self, artifact_id: str) -> None:
        """Make a saved model the champion. KeyError if there is none of that id."""

        def told(before: DataFrame) -> tuple[int, dict[str, float]]:
            saved = self._saved(artifact_id, before)
            return saved["version"], saved["metadata"]

        self._append(artifact_id, "promote", told)

    def load(self, artifact_id: str) -> PipelineModel:
        """A model by id. KeyError if there is none of that id."""
        self._saved(artifact_id, self.events())
        return PipelineModel.load(f"{self.root}/{artifact_id}")

    def champion(self) -> tuple[PipelineModel, str, dict[str, float]] | None:
        """The model promoted last, its id and its metadata, from one reading of the log; or None."""
        row = self.events().where("event = 'promote'").orderBy(F.desc("seq")).head(1)
        return (PipelineModel.load(f"{self.root}/{row[0]['artifact_id']}"), row[0]["artifact_id"], row[0]["metadata"]) if row else None

    def load_champion(self) -> PipelineModel | None:
        """The model promoted last, or None."""
        found = self.champion()
        return found[0] if found else None
