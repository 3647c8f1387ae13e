"""Population drift: statistics, PSI, two-sample KS, histograms and the report.

All functions treat every feature in one job over a long table. Values that
are NULL or NaN are dropped; a feature without values on either side is
skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.columns import kolmogorov_p, long_values, numeric_columns, quantiles, quantiles_of, running_sums, shared_numeric_columns
from driftwell.sources.shared import materialise

PSI_WARNING, PSI_CRITICAL, KS_ALPHA, EMPTY_SHARE = 0.10, 0.20, 0.05, 1e-6
REF, CUR = "reference", "current"


def sides(reference: DataFrame, current: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(side, feature, value) of the numeric columns that both share."""
    columns = shared_numeric_columns(reference, current, features)
    return long_values(reference, columns, side=F.lit(REF)).unionByName(long_values(current, columns, side=F.lit(CUR)))


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation and quartiles of each numeric column."""
    values = long_values(df, columns or numeric_columns(df))
    sums = values.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    quartiles = quantiles_of(values, ["feature"], "value", [0.25, 0.5, 0.75])
    return sums.join(quartiles, "feature").select("feature", "n", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def tie_table(values: DataFrame) -> DataFrame:
    """(feature, value, r, c, cum_r, cum_c): each value once with its counts on both sides and their running sums, written once.

    PSI, KS and means all follow from it, so that both sides are read a single time.
    """
    ties = values.groupBy("feature", "value").agg(F.count_if(F.col("side") == REF).alias("r"), F.count_if(F.col("side") == CUR).alias("c"))
    return running_sums(ties, ["feature"], "value", ["r", "c"])


def edges_of(found: DataFrame) -> DataFrame:
    """(feature, edges): distinct edges from quantiles."""
    return found.select("feature", F.array_distinct(F.array_sort("q")).alias("edges"))


def quantile_edges(values: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges): distinct equal-frequency edges."""
    return edges_of(quantiles_of(values, ["feature"], "value", [k / bins for k in range(bins + 1)]))


def bin_of(value: Column, edges: Column) -> Column:
    """Index of the bin, from 0; the last is closed on the right. Values outside are clipped first."""
    return F.least(F.size(F.filter(edges, lambda e: e <= F.greatest(value, edges[0]))), F.size(edges) - 1) - 1


def psi_from_counts(counts: DataFrame) -> DataFrame:
    """(feature, psi) from (feature, bin, n_ref, n_cur); an empty share counts as 1e-6."""
    # A feature has a row for each bin.
    own = Window.partitionBy("feature")
    share = lambda n: F.when(F.col(n) > 0, F.col(n) / F.sum(n).over(own)).otherwise(F.lit(EMPTY_SHARE))
    shares = counts.select("feature", share("n_ref").alias("x"), share("n_cur").alias("a"))
    # Empty on both sides adds nothing, so that such bins need no row.
    return shares.groupBy("feature").agg(F.sum((F.col("a") - F.col("x")) * F.log(F.col("a") / F.col("x"))).alias("psi"))


def psi(values: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, psi) of (side, feature, value): edges from the reference; 0 with fewer than two edges."""
    return psi_of_ties(tie_table(values), bins)


def psi_of_ties(ties: DataFrame, bins: int = 10) -> DataFrame:
    # A row for each feature, written as it is used twice.
    edges = materialise(edges_of(quantiles(ties, ["feature"], "value", "r", [k / bins for k in range(bins + 1)])))
    return psi_from_edges(edges, bin_counts(ties, edges, bins))


def psi_from_edges(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(feature, psi) from ``bin_counts``; 0 with fewer than two edges."""
    return psi_from_counts(counts).unionByName(edges.where(F.size("edges") < 2).select("feature", F.lit(0.0).alias("psi")))


def bin_counts(ties: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, bin, n_ref, n_cur) for each bin of features with two edges or more, from values with their counts ``r`` and ``c``.

    One aggregation sums what lies below each edge; values outside are clipped, and the last bin is closed.
    """
    inner = range(1, bins)
    edge = lambda i: F.get("edges", F.lit(i))
    below = [F.sum(F.when(F.col("value") < edge(i), F.col(side)).otherwise(0)).alias(f"{side}{i}") for side in "rc" for i in inner]
    joined = ties.join(F.broadcast(edges.where(F.size("edges") >= 2)), "feature")  # one row for each feature
    sums = joined.groupBy("feature").agg(F.size(F.first("edges")).alias("n"), F.sum("r").alias("r"), F.sum("c").alias("c"), *below)
    upto = lambda side, i: F.lit(0) if i == 0 else F.when(F.col("n") - 1 > i, F.col(f"{side}{i}")).otherwise(F.col(side)) if i < bins else F.col(side)
    counts = [F.struct(F.lit(i).alias("bin"), (upto("r", i + 1) - upto("r", i)).alias("n_ref"), (upto("c", i + 1) - upto("c", i)).alias("n_cur")) for i in range(bins)]
    return sums.select("feature", "n", F.inline(F.array(*counts))).where("bin < n - 1").drop("n")


def ks(values: DataFrame) -> DataFrame:
    """(feature, n_ref, n_cur, ks, p): largest gap between the two empirical distributions."""
    return ks_of_ties(tie_table(values))


def ks_of_ties(ties: DataFrame) -> DataFrame:
    totals = ties.groupBy("feature").agg(F.max("cum_r").alias("n_ref"), F.max("cum_c").alias("n_cur")).where("n_ref > 0 and n_cur > 0")
    gaps = ties.join(F.broadcast(totals), "feature")  # one row for each feature
    found = gaps.groupBy("feature").agg(F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max(F.abs(F.col("cum_r") / F.col("n_ref") - F.col("cum_c") / F.col("n_cur"))).alias("ks"))
    return found.withColumn("p", kolmogorov_p(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def means(values: DataFrame) -> DataFrame:
    """(feature, reference_mean, current_mean, mean_shift_pct); the shift is against 1 where the reference mean is about 0."""
    return means_of_ties(tie_table(values))


def means_of_ties(ties: DataFrame) -> DataFrame:
    counted = ties.groupBy("feature").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.try_divide(F.sum(F.col("value") * F.col("r")), F.sum("r")).alias("reference_mean"), F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum("c")).alias("current_mean"))
    return shifts(counted.where("r > 0 and c > 0").select("feature", "reference_mean", "current_mean"))


def shifts(both: DataFrame) -> DataFrame:
    """``mean_shift_pct`` beside both means."""
    size = F.abs("reference_mean")
    return both.withColumn("mean_shift_pct", (F.col("current_mean") - F.col("reference_mean")) / F.when(size > 1e-9, size).otherwise(1.0) * 100)


def psi_severity(value: Column) -> Column:
    return F.when(value >= PSI_CRITICAL, "critical").when(value >= PSI_WARNING, "warning").otherwise("none")


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Two rows for each feature, by PSI and by KS, with severity and means."""
    return _drift_rows(tie_table(sides(reference, current, features)))


def _drift_rows(ties: DataFrame) -> DataFrame:
    return drift_rows(psi_of_ties(ties), ks_of_ties(ties), means_of_ties(ties))


def drift_rows(by_feature: DataFrame, ks_found: DataFrame, stat: DataFrame) -> DataFrame:
    """A row by PSI and one by KS for each feature, from (feature, psi), ``ks_of_ties`` and ``means_of_ties``."""
    by_psi = by_feature.join(stat, "feature").select(
        "feature", F.lit("PSI").alias("method"), F.round("psi", 6).alias("statistic"), F.lit(None).cast("double").alias("p_value"),
        (F.col("psi") >= PSI_WARNING).alias("is_drift"), psi_severity(F.col("psi")).alias("severity"), *_rounded())
    return by_psi.unionByName(_ks_rows(ks_found, stat))


def _rounded() -> list[Column]:
    return [F.round("reference_mean", 4).alias("reference_mean"), F.round("current_mean", 4).alias("current_mean"), F.round("mean_shift_pct", 2).alias("mean_shift_pct")]


def _ks_rows(found: DataFrame, stat: DataFrame) -> DataFrame:
    drift = F.col("p") < KS_ALPHA
    return found.join(stat, "feature").select(
        "feature", F.lit("KS").alias("method"), F.round("ks", 6).alias("statistic"), F.round("p", 6).alias("p_value"),
        drift.alias("is_drift"), F.when(drift, "critical").otherwise("none").alias("severity"), *_rounded())


def label_drift(reference: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """The KS row of one label column."""
    ties = tie_table(sides(reference, current, [label]))
    return _ks_rows(ks_of_ties(ties), means_of_ties(ties))


def report(reference: DataFrame, current: DataFrame, features: list[str] | None = None, label: str | None = None) -> DataFrame:
    """One row: counts, all drift rows, whether anything drifted, whether to retrain, and a summary."""
    own = shared_numeric_columns(reference, current, features)
    ties = tie_table(sides(reference, current, [*own, *([label] if label and label not in own else [])]))
    rows = _drift_rows(ties.where(F.col("feature").isin(own))).withColumn("is_label", F.lit(False))
    if label:
        of_label = ties.where(F.col("feature") == label)
        rows = rows.unionByName(_ks_rows(ks_of_ties(of_label), means_of_ties(of_label)).withColumn("is_label", F.lit(True)))
    counts = reference.agg(F.count("*").alias("n_reference_samples")).crossJoin(current.agg(F.count("*").alias("n_current_samples")))  # one row each
    return rolled_up(rows, counts)


def rolled_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The report from drift rows with ``is_label`` and one row of both sides' row counts."""
    named = lambda severity: F.array_sort(F.collect_list(F.when((F.col("method") == "PSI") & ~F.col("is_label") & (F.col("severity") == severity), F.col("feature"))))
    columns = ["feature", "method", "statistic", "p_value", "is_drift", "severity", "reference_mean", "current_mean", "mean_shift_pct"]
    rolled = rows.agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_label"), F.struct(*columns)))).alias("feature_drift"),
        F.max(F.when(F.col("is_label"), F.struct(*columns))).alias("label_drift"),
        F.coalesce(F.bool_or("is_drift"), F.lit(False)).alias("overall_drift_detected"),
        F.coalesce(F.bool_or(F.when(F.col("is_label"), F.col("is_drift")).otherwise((F.col("method") == "PSI") & (F.col("severity") == "critical"))), F.lit(False)).alias("retraining_recommended"),
        named("critical").alias("critical"), named("warning").alias("warning"),
    )
    # The texts of the summary.
    label_text = F.format_string("Label drift detected (KS p=%.4f); mean shifted %+.1f%%.", F.col("label_drift.p_value"), F.col("label_drift.mean_shift_pct"))
    summary = F.when(~F.col("overall_drift_detected"), F.lit("No significant drift detected. Model distributions appear stable.")).otherwise(F.concat_ws(
        " ",
        F.when(F.size("critical") > 0, F.concat(F.lit("CRITICAL drift (PSI >= 0.20) in: "), F.array_join("critical", ", "), F.lit("."))),
        F.when(F.size("warning") > 0, F.concat(F.lit("WARNING drift (0.10 <= PSI < 0.20) in: "), F.array_join("warning", ", "), F.lit("."))),
        F.when(F.col("label_drift.is_drift"), label_text),
        F.when(F.col("retraining_recommended"), F.lit("Retraining is recommended.")),
    ))
    # Both sides of the cross join are one row.
    return counts.crossJoin(rolled).select("n_reference_samples", "n_current_samples", "feature_drift", "label_drift", "overall_drift_detected", "retraining_recommended", summary.alias("summary"))


def paired_histogram(values: DataFrame, bins: int = 30) -> DataFrame:
    """(feature, side, bin, n, density): both sides over the same equal bins between the least and the greatest value."""
    span = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    totals = values.groupBy("feature", "side").agg(F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = values.join(F.broadcast(span), "feature").groupBy("feature", "side", place.alias("bin")).agg(F.count("*").alias("n"), F.max(width).alias("width"))
    return counts.join(F.broadcast(totals), ["feature", "side"]).select("feature", "side", "bin", "n", ratio_density().alias("density"))


def ratio_density() -> Column:
    return F.when(F.col("width") > 0, F.col("n") / (F.col("total") * F.col("width"))).otherwise(F.lit(1.0))


def top_drift(rows: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` features of highest PSI among drift rows, ties by name."""
    return rows.where(F.col("method") == "PSI").orderBy(F.desc("statistic"), "feature").limit(n)


def score_histogram(flags: DataFrame, bins: int = 50, group: str = "side", score: str = "score") -> DataFrame:
    """(group, bin, n, density): scores over equal bins from 0 to 1.05 times the greatest score."""
    top = flags.agg((F.max(score) * 1.05).alias("hi"))
    totals = flags.groupBy(group).agg(F.count("*").alias("total"))
    width = F.col("hi") / bins
    place = F.when(width > 0, F.least(F.floor(F.col(score) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = flags.crossJoin(F.broadcast(top)).groupBy(group, place.alias("bin")).agg(F.count("*").alias("n"), F.max(width).alias("width"))  # one row on the right
    return counts.join(totals, group).select(group, "bin", "n", ratio_density().alias("density"))


def what_if(df: DataFrame, date: str, start: str, price: str | None = None, demand: str | None = None) -> DataFrame:
    """A scenario for back-testing monitors: from ``start`` on, price * 1.30 + 2.0 and demand * 0.60."""
    after = F.col(date) >= F.to_timestamp(F.lit(start))
    if price:
        df = df.withColumn(price, F.when(after, F.col(price) * 1.30 + 2.0).otherwise(F.col(price)))
    if demand:
        df = df.withColumn(demand, F.when(after, F.col(demand) * 0.60).otherwise(F.col(demand)))
    return df
