"""Classifier and regression metrics, gain table and fairness slices over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.columns import present, ratio, running_sums

MIN_SLICE = 30


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: accuracy, precision, recall, f1 (0 on zero division)."""
    t, p = F.col(y_true), F.col(y_pred)
    c = df.agg(
        F.count("*").alias("n"), F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if(t == p).alias("same"),
    )
    c = c.select(ratio(F.col("same"), F.col("n")).alias("accuracy"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranking(df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob") -> DataFrame:
    """One row: roc_auc with half credit for ties, gini, and the largest gap between the classes' score distributions."""
    ties = df.where(present(y_prob)).groupBy(F.lit(0).alias("g"), F.col(y_prob).cast("double").alias("s")).agg(F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) == 0).alias("neg"))
    summed = running_sums(ties, ["g"], "s", ["pos", "neg"])
    totals = ties.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    # One row on the right.
    return summed.crossJoin(totals).agg(
        ratio(F.sum(F.col("pos") * below), F.max("P") * F.max("N")).alias("roc_auc"),
        F.coalesce(F.max(F.abs(ratio(F.col("cum_pos"), F.col("P")) - ratio(F.col("cum_neg"), F.col("N")))), F.lit(0.0)).alias("ks_statistic"),
    ).select("roc_auc", (2 * F.col("roc_auc") - 1).alias("gini"), "ks_statistic")


def performance(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", y_prob: str = "y_prob") -> DataFrame:
    """All seven metrics in one row."""
    return confusion(df, y_true, y_pred).crossJoin(ranking(df, y_true, y_prob))


def gain_table(df: DataFrame, id_col: str = "id", y_true: str = "y_true", y_prob: str = "y_prob") -> DataFrame:
    """(threshold, cumulative_bad, cumulative_good, ks): shares of both classes in the first tenths by score, ties by id."""
    rows = df.select(F.lit(0).alias("g"), F.struct((-F.col(y_prob)).alias("s"), F.col(id_col).alias("i")).alias("o"), F.lit(1).alias("one"), (F.col(y_true) == 1).cast("int").alias("bad"))
    summed = running_sums(rows, ["g"], "o", ["one", "bad"])
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("P"))
    cuts = totals.select("n", "P", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("d")).withColumn("cut", F.floor(F.col("n") * F.col("d") / 10))
    hit = summed.join(F.broadcast(cuts), F.col("cut") == F.col("cum_one")).select("d", "cum_bad")  # ten rows
    at = cuts.join(hit, "d", "left").withColumn("b", F.coalesce("cum_bad", F.lit(0)))
    bad, good = ratio(F.col("b"), F.col("P")), ratio(F.col("cut") - F.col("b"), F.col("n") - F.col("P"))
    return at.select((F.col("d") * 10).alias("threshold"), F.round(bad, 4).alias("cumulative_bad"), F.round(good, 4).alias("cumulative_good"), F.round(F.abs(bad - good), 4).alias("ks"))


def fairness_slices(df: DataFrame, features: list[str], y_true: str = "y_true", y_pred: str = "y_pred", min_samples: int = MIN_SLICE) -> DataFrame:
    """Approval (y_pred 0), error rates and disparate impact of each slice of at least ``min_samples`` rows.

    The overall approval rate is over all rows; names of columns that don't exist are skipped, and so are NULL values.
    """
    have = [f for f in features if f in df.columns]
    t, p = F.col("t"), F.col("p")
    long = df.select(F.col(y_true).alias("t"), F.col(y_pred).alias("p"), *(F.col(f).cast("string").alias(f) for f in have)).unpivot(["t", "p"], have, "feature", "value").where("value is not null")
    slices = long.groupBy("feature", "value").agg(
        F.count("*").alias("n_samples"), ratio(F.count_if(p == 0), F.count("*")).alias("approval_rate"),
        ratio(F.count_if((t == 0) & (p == 1)), F.count_if(t == 0)).alias("fpr"), ratio(F.count_if((t == 1) & (p == 0)), F.count_if(t == 1)).alias("fnr"),
    ).where(F.col("n_samples") >= min_samples)
    overall = df.agg(ratio(F.count_if(F.col(y_pred) == 0), F.count("*")).alias("overall"))
    return slices.crossJoin(F.broadcast(overall)).select(
        F.concat_ws("=", "feature", "value").alias("slice_name"), "feature", "value", "n_samples", "approval_rate", "fpr", "fnr", ratio(F.col("approval_rate"), F.col("overall")).alias("disparate_impact")
    )


def slice_report(slices: DataFrame) -> DataFrame:
    """Slices with a flag where the four-fifths rule is broken."""
    return slices.withColumn("violates", F.col("disparate_impact") < 0.8)


def regression(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row: mae, rmse, r2."""
    t, e = F.col(y_true).cast("double"), (F.col(y_true) - F.col(y_pred)).cast("double")
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(t) * F.count(t)).alias("sst")).select("mae", "rmse", (1 - ratio(F.col("sse"), F.col("sst"))).alias("r2"))


def before_after(df: DataFrame, date: str, start: str, columns: list[str]) -> DataFrame:
    """One row: least, greatest, and mean before and from ``start`` on, of each column."""
    after = F.col(date) >= F.to_timestamp(F.lit(start))
    aggs: list[Column] = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(F.when(~after, F.col(c))).alias(f"{c}_before"), F.avg(F.when(after, F.col(c))).alias(f"{c}_after")]
    return df.agg(*aggs)


def ranked_importances(attributions: DataFrame) -> DataFrame:
    """(feature, mean_abs, rank) from (feature, phi), the largest first, ties by name."""
    means = attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    # One row for each feature.
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))


def top_importances(attributions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` features of greatest importance, in order."""
    return ranked_importances(attributions).where(F.col("rank") <= n).orderBy("rank")
