"""Risk of a model, 0 to 100, from its card; model cards as nested columns; comparison of two cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "gini", "ks_statistic")
CARD_SCHEMA = (
    "model_id string, model_name string, version string, description string, model_type string, training_date string, training_dataset_size long, "
    "feature_names array<string>, performance struct<accuracy:double,precision:double,recall:double,f1:double,roc_auc:double,gini:double,ks_statistic:double>, "
    "fairness_slices array<struct<slice_name:string,feature:string,value:string,n_samples:long,approval_rate:double,fpr:double,fnr:double,disparate_impact:double>>, "
    "feature_importances array<struct<feature_name:string,shap_mean_abs:double,rank:int>>, risk_score double, "
    "risk_factors struct<performance:double,fairness:double,data:double,stability:double,details:struct<performance:string,fairness:string,data:string,stability:string>>, "
    "intended_use string, limitations string, created_at timestamp"
)
#: Where each risk is full and where it ends.
GINI, KS, ROWS, FOUR_FIFTHS = (0.3, 0.5), (0.2, 0.4), (1_000, 10_000), 0.8


def falling(x: Column, ends: tuple[float, float], full: float) -> Column:
    """``full`` up to the first end, 0 from the second on, linear between."""
    lo, hi = ends
    return F.when(x <= lo, F.lit(float(full))).when(x >= hi, 0.0).otherwise(full * (1.0 - (x - lo) / (hi - lo)))


def violations(slices: Column) -> Column:
    return F.filter(slices, lambda s: s["disparate_impact"] < FOUR_FIFTHS)


def violation_share(slices: Column) -> Column:
    return F.when(F.size(slices) > 0, F.size(violations(slices)) / F.size(slices)).otherwise(0.0)


def with_risk(cards: DataFrame) -> DataFrame:
    """Cards with ``risk_score``, ``risk_factors`` and ``risk_label``, from gini, f1, slices, training size and KS."""
    p, slices, n = F.col("performance"), F.coalesce("fairness_slices", F.expr("array()").cast(dict(cards.dtypes)["fairness_slices"])), F.col("training_dataset_size")
    perf = F.least(F.lit(25.0), falling(p["gini"], GINI, 20) + F.when(p["f1"] < 0.5, 5.0).otherwise(0.0))
    fair, data, stab = F.round(25.0 * violation_share(slices), 2), F.round(falling(n, ROWS, 25), 2), F.round(falling(p["ks_statistic"], KS, 25), 2)
    names = F.array_join(F.transform(violations(slices), lambda s: s["slice_name"]), ", ")
    # The texts of the details.
    details = F.struct(
        F.format_string("Gini = %.3f (threshold 0.3); F1 = %.3f; score = %.1f/25", p["gini"], p["f1"], perf).alias("performance"),
        F.when(F.size(slices) == 0, F.lit("No fairness slices available; risk assumed 0.")).otherwise(
            F.concat(F.format_string("%d/%d slices violate disparate impact < 0.8; ", F.size(violations(slices)), F.size(slices)), F.when(names == "", F.lit("none")).otherwise(F.concat(F.lit("violations: "), names)))).alias("fairness"),
        F.concat(F.lit("Training size = "), F.format_number(n, 0), F.lit(" (min=1,000, target=10,000); score="), F.format_string("%.1f/25", data)).alias("data"),
        F.format_string("KS=%.3f (threshold 0.2); score = %.1f/25", p["ks_statistic"], stab).alias("stability"),
    )
    total = F.round(perf + fair + data + stab, 2)
    factors = F.struct(F.round(perf, 2).alias("performance"), fair.alias("fairness"), data.alias("data"), stab.alias("stability"), details.alias("details"))
    return cards.withColumns({"risk_score": total, "risk_factors": factors, "risk_label": label(total)})


def label(score: Column) -> Column:
    return F.when(score <= 25, "Low").when(score <= 50, "Medium").when(score <= 75, "High").otherwise("Critical")


def to_json(cards: DataFrame) -> DataFrame:
    """(model_id, card): each card as a JSON text."""
    return cards.select("model_id", F.to_json(F.struct("*")).alias("card"))


def from_json(texts: DataFrame, column: str = "card") -> DataFrame:
    """Cards from JSON texts; missing lists become empty."""
    c = texts.select(F.from_json(column, CARD_SCHEMA).alias("c")).select("c.*")
    lists = {k: F.coalesce(k, F.expr("array()").cast(kind)) for k, kind in c.dtypes if kind.startswith("array")}
    return c.withColumns(lists)


def compare(cards: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, a, b, delta): both cards' metrics side by side; the delta is NULL if either is."""
    one = cards.where(F.col("model_id").isin(a, b)).select("model_id", *(F.col(f"performance.{m}").alias(m) for m in METRICS), "risk_score")
    long = one.unpivot(["model_id"], [*METRICS, "risk_score"], "metric", "value")
    sides = long.groupBy("metric").agg(F.max(F.when(F.col("model_id") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("model_id") == b, F.col("value"))).alias("b"))
    return sides.withColumn("delta", F.col("b") - F.col("a"))


def promotion(cards: DataFrame) -> DataFrame:
    """(model_id, status): the lowest risk wins, then the highest gini, then the smaller id; all others are archived."""
    first = cards.agg(F.min(F.struct("risk_score", -F.col("performance.gini"), "model_id")).alias("_first"))
    return cards.crossJoin(F.broadcast(first)).select("model_id", F.when(F.col("model_id") == F.col("_first.model_id"), "production").otherwise("archived").alias("status"))  # one row on the right
