"""Drift of a stream of observations against a stored reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.functions.columns import long_values
from driftwell.operators import drift
from driftwell.operators.summaries import ReferenceSummary
from driftwell.sources.shared import materialise


def observations(spark: SparkSession, folder: str, schema: str, max_files: int | None = 100) -> DataFrame:
    """A stream of JSON files with a fixed schema; ``max_files`` of None reads all that are there in one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).json(folder)


def window_counts(stream: DataFrame, edges: DataFrame, columns: list[str], ts: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, feature, bin, n_cur): counts in tumbling windows over the reference's frozen edges.

    ``edges`` has a row for each feature. Rows later than the watermark are dropped by Spark, which counts them in the query's progress.
    """
    values = long_values(stream.withWatermark(ts, late), columns, ts=F.col(ts))
    binned = values.join(F.broadcast(edges), "feature").withColumn("bin", drift.bin_of(F.col("value"), F.col("edges")))
    return binned.groupBy(F.window("ts", window).alias("w"), "feature", "bin").agg(F.count("*").alias("n_cur")).select(F.col("w.start").alias("window_start"), "feature", "bin", "n_cur")


def reference_counts(reference: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): frozen equal-frequency edges and the reference's counts in them."""
    values = long_values(reference, columns)
    edges = drift.quantile_edges(values).where(F.size("edges") >= 2)
    counts = values.join(F.broadcast(edges), "feature").groupBy("feature", drift.bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n_ref"))
    return edges, counts


def window_psi(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """(window_start, feature, psi, severity) from a batch table of window counts and the reference's."""
    windows = counts.select("window_start", "feature").distinct()
    full = windows.join(reference, "feature").join(counts, ["window_start", "feature", "bin"], "left").na.fill(0, ["n_cur"])
    keyed = full.select(F.struct("window_start", "feature").alias("feature"), "bin", "n_ref", "n_cur")
    return drift.psi_from_counts(keyed).select("feature.window_start", "feature.feature", F.round("psi", 6).alias("psi"), drift.psi_severity(F.col("psi")).alias("severity"))


def start_reports(stream: DataFrame, summary: ReferenceSummary, out: str, checkpoint: str, **tags: Column) -> StreamingQuery:
    """Drift rows and the report of each micro-batch against a stored summary, under ``out``/rows and ``out``/reports.

    Both lie under the batch's id, so that a batch that is repeated after a failure replaces itself. ``tags`` are
    aggregates of the batch that go with its rows. The reference's rows aren't read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            told = batch.agg(*(c.alias(n) for n, c in tags.items())) if tags else None
            tagged = lambda df: df if told is None else df.crossJoin(told)  # one row on the right
            rows = materialise(summary.drift_rows(batch))
            tagged(rows).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
            tagged(summary.report(batch, rows)).write.mode("overwrite").parquet(f"{out}/reports/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_windows(stream: DataFrame, edges: DataFrame, columns: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Finished windows' counts appended as Parquet."""
    return window_counts(stream, edges, columns).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_all_windows(stream: DataFrame, edges: DataFrame, columns: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """All windows' counts, the last ones too, as Parquet that each batch replaces.

    For a finished table: counts of all windows are kept, so that no row is too late, in whatever order the files come.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return window_counts(stream, edges, columns).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
