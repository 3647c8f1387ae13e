"""Models and artifacts as append-only event tables; the present state is a view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("staging", "production", "archived")
EVENTS = "seq long, model_id string, model_name string, version string, registered_at timestamp, status string, model_path string, card_path string, tags map<string,string>"
ARTIFACTS = "seq long, artifact_id string, artifact_type string, version int, created_at timestamp, event string, metadata map<string,double>"


def current(events: DataFrame, status: str | None = None) -> DataFrame:
    """The latest event of each model, newest registration first; of one status if given."""
    last = events.withColumn("_n", F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    return (last if status is None else last.where(F.col("status") == status)).orderBy(F.desc("registered_at"), "model_id")


def status_event(events: DataFrame, model_id: str, status: str) -> DataFrame:
    """The event that gives a model a new status. Unknown statuses and models raise."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    last = current(events.where(F.col("model_id") == model_id))
    if last.isEmpty():
        raise KeyError(model_id)
    seq = events.agg(F.max("seq").alias("top"))
    return last.crossJoin(seq).withColumns({"seq": F.col("top") + 1, "status": F.lit(status)}).select(events.columns)


def champions(artifacts: DataFrame) -> DataFrame:
    """The latest event of each artifact with ``is_champion``: true for the one promoted last."""
    per = artifacts.groupBy("artifact_id").agg(F.max_by(F.struct("artifact_type", "version", "metadata"), "seq").alias("a"), F.max(F.when(F.col("event") == "promote", F.col("seq"))).alias("promoted"))
    top = artifacts.where("event = 'promote'").agg(F.max("seq").alias("top"))
    return per.crossJoin(top).select("artifact_id", "a.*", F.coalesce(F.col("promoted") == F.col("top"), F.lit(False)).alias("is_champion"))


def next_version(artifacts: DataFrame, kind: str = "model") -> DataFrame:
    """One row: the number of artifacts of a kind, plus one."""
    return artifacts.where((F.col("event") == "save") & (F.col("artifact_type") == kind)).agg((F.count_distinct("artifact_id") + 1).alias("version"))


def unknown_statuses(events: DataFrame) -> DataFrame:
    """Events whose status is none of ``STATUSES``, NULL among them."""
    return events.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def champion_metric(artifacts: DataFrame, metric: str = "mae") -> float | None:
    row = champions(artifacts).where("is_champion").select(F.col("metadata")[metric].alias("m")).head(1)
    return row[0]["m"] if row else None


def tags_to_map(df: DataFrame, column: str = "tags") -> DataFrame:
    return df.withColumn(column, F.from_json(column, "map<string,string>"))


def tags_to_json(df: DataFrame, column: str = "tags") -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def stable_id(*columns: str):
    """An id that a retried task makes again: a digest of the natural key."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)
