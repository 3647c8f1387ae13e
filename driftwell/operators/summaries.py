"""A stored summary of a reference, against which batches are compared without reading the reference's rows.

The summary holds, for each feature, its distinct values with their counts, cut into ranges of bounded size; a row for
each range with its borders and count; and a row of facts: the number of values, their sum, frozen equal-frequency edges
and the counts between them. PSI and means of a batch need the facts only. KS needs the reference's distribution at the
batch's values: ranges that hold such values are read, and every other range counts as one step at its upper border,
which is exact, as the batch's distribution is flat there. Summaries of parts of a reference merge into that of the whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions.columns import long_values, numeric_columns, quantiles, running_sums
from driftwell.operators import drift
from driftwell.sources.shared import materialise

#: Distinct values of a range.
RANGE_VALUES = 1 << 16
BINS = 10


@dataclass(frozen=True)
class ReferenceSummary:
    """A summary in a folder: ``values`` (feature, bucket, value, k), ``ranges`` and ``facts``, which are written last."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, reference: DataFrame, columns: list[str] | None, path: str, range_values: int = RANGE_VALUES) -> ReferenceSummary:
        """Summarise the present values of numeric columns; a column without any has no row."""
        ties = long_values(reference, columns or numeric_columns(reference)).groupBy("feature", "value").agg(F.count("*").alias("k"))
        rows = reference.agg(F.count("*").alias("rows"))
        return cls._write(ties, rows, path, range_values)

    @classmethod
    def merged(cls, parts: list[ReferenceSummary], path: str, range_values: int = RANGE_VALUES) -> ReferenceSummary:
        """The summary of all parts' rows together."""
        ties = reduce(DataFrame.unionByName, [p.values().select("feature", "value", "k") for p in parts])
        rows = reduce(DataFrame.unionByName, [p.row_count() for p in parts]).agg(F.sum("rows").alias("rows"))
        return cls._write(ties.groupBy("feature", "value").agg(F.sum("k").alias("k")), rows, path, range_values)

    @classmethod
    def _write(cls, ties: DataFrame, rows: DataFrame, path: str, range_values: int) -> ReferenceSummary:
        spark = ties.sparkSession
        summed = running_sums(ties.withColumn("one", F.lit(1)), ["feature"], "value", ["k", "one"])
        bucketed = summed.withColumn("bucket", F.expr(f"(cum_one - 1) div {range_values}"))
        bucketed.repartition("feature", "bucket").select("feature", "bucket", "value", "k").write.mode("overwrite").partitionBy("feature", "bucket").parquet(f"{path}/values")
        bucketed.groupBy("feature", "bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("k").alias("k")).write.mode("overwrite").parquet(f"{path}/ranges")
        edges = materialise(drift.edges_of(quantiles(summed, ["feature"], "value", "k", [i / BINS for i in range(BINS + 1)])))
        counts = drift.bin_counts(summed.select("feature", "value", F.col("k").alias("r"), F.lit(0).cast("long").alias("c")), edges, BINS)
        counts = counts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "n_ref"))).alias("bins"))
        totals = summed.groupBy("feature").agg(F.sum("k").alias("n"), F.sum(F.col("value") * F.col("k")).alias("total"))
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        totals.join(edges, "feature").join(counts, "feature", "left").write.mode("overwrite").parquet(f"{path}/facts")
        return cls(spark, path)

    def values(self) -> DataFrame:
        return self.spark.read.schema("value double, k long, feature string, bucket long").parquet(f"{self.path}/values")

    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def facts(self) -> DataFrame:
        """A row for each feature."""
        return self.spark.read.parquet(f"{self.path}/facts")

    def row_count(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def ties(self, batch: DataFrame) -> DataFrame:
        """(feature, value, r, c, cum_r, cum_c) of batch ties (feature, value, c): what ``drift.ks_of_ties`` takes."""
        ranges = self.ranges()
        if ranges.count() == self.facts().count():
            # One range for each feature.
            placed = batch.withColumn("bucket", F.lit(0).cast("long"))
        else:
            marks = ranges.select("feature", F.col("lo").alias("value"), F.lit(0).cast("long").alias("c"), F.lit(1).alias("mark"))
            points = batch.withColumn("mark", F.lit(0)).unionByName(marks).groupBy("feature", "value").agg(F.sum("c").alias("c"), F.sum("mark").alias("mark"))
            found = running_sums(points, ["feature"], "value", ["mark"]).where("c > 0")
            placed = found.select("feature", "value", "c", (F.greatest("cum_mark", F.lit(1)) - 1).alias("bucket"))
        touched = materialise(placed.select("feature", "bucket").distinct())
        # The ranges' rows are found by their partitions; those that aren't touched are one step each.
        inside = self.values().join(touched, ["feature", "bucket"]).select("feature", "value", F.col("k").alias("r"), F.lit(0).cast("long").alias("c"))
        steps = ranges.join(touched, ["feature", "bucket"], "left_anti").join(touched.select("feature").distinct(), "feature", "left_semi")
        steps = steps.select("feature", F.col("hi").alias("value"), F.col("k").alias("r"), F.lit(0).cast("long").alias("c"))
        own = placed.join(self.facts().select("feature"), "feature", "left_semi").select("feature", "value", F.lit(0).cast("long").alias("r"), "c")
        together = inside.unionByName(steps).unionByName(own).groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
        return running_sums(together, ["feature"], "value", ["r", "c"])

    def drift_rows(self, batch: DataFrame) -> DataFrame:
        """The rows of ``drift.feature_drift`` for a batch: features with values in the reference and in the batch."""
        facts = self.facts()
        have = [r["feature"] for r in facts.select("feature").collect() if r["feature"] in numeric_columns(batch)]
        if not have:
            return drift.drift_rows(*self._nothing())
        ties = materialise(long_values(batch, have).groupBy("feature", "value").agg(F.count("*").alias("c")))
        sums = ties.groupBy("feature").agg(F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum("c")).alias("current_mean"))
        means = drift.shifts(facts.join(sums, "feature").select("feature", (F.col("total") / F.col("n")).alias("reference_mean"), "current_mean"))
        known = facts.join(sums.select("feature"), "feature", "left_semi").select("feature", "edges", "bins")
        counted = drift.bin_counts(ties.withColumn("r", F.lit(0).cast("long")), known.select("feature", "edges"), BINS).select("feature", "bin", "n_cur")
        counts = known.select("feature", F.inline("bins")).join(counted, ["feature", "bin"], "left").na.fill(0, ["n_cur"])
        return drift.drift_rows(drift.psi_from_edges(known, counts), drift.ks_of_ties(self.ties(ties)), means)

    def _nothing(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        empty = self.spark.createDataFrame
        return empty([], "feature string, psi double"), empty([], "feature string, n_ref long, n_cur long, ks double, p double"), empty([], "feature string, reference_mean double, current_mean double, mean_shift_pct double")

    def report(self, batch: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """The report of ``drift.report`` for a batch, without a label."""
        counts = self.row_count().select(F.col("rows").alias("n_reference_samples")).crossJoin(batch.agg(F.count("*").alias("n_current_samples")))  # one row each
        return drift.rolled_up((self.drift_rows(batch) if rows is None else rows).withColumn("is_label", F.lit(False)), counts)
