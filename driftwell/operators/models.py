"""Training, promotion gate, batch prediction, attribution, and the training and monitoring workflows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, ProbabilisticClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.columns import running_sums
from driftwell.operators import drift, features, metrics
from driftwell.sources.shared import materialise
from driftwell.sources.tables import Snapshots, save_model


@dataclass(frozen=True)
class Gate:
    """Limits that a model must meet before it is promoted."""

    max_mae: float = 50.0
    max_rmse: float = 75.0
    min_r2: float = 0.65
    min_improvement: float = 0.02


def gate(result: DataFrame, limits: Gate = Gate()) -> DataFrame:
    """``result`` (mae, rmse, r2, champion_mae) with passed and reason; checks in order, the first failure decides.

    A NULL champion_mae skips the last check.
    """
    mae, rmse, r2, champion = (F.col(c) for c in ("mae", "rmse", "r2", "champion_mae"))
    required = champion * (1 - limits.min_improvement)
    # The reasons' texts.
    reason = (
        F.when(mae > limits.max_mae, F.format_string(f"FAILED: MAE %.4f exceeds threshold {limits.max_mae}", mae))
        .when(rmse > limits.max_rmse, F.format_string(f"FAILED: RMSE %.4f exceeds threshold {limits.max_rmse}", rmse))
        .when(r2 < limits.min_r2, F.format_string(f"FAILED: R2 %.4f below minimum {limits.min_r2}", r2))
        .when(mae >= required, F.format_string(f"FAILED: MAE %.4f does not improve champion %.4f by {limits.min_improvement * 100:.0f}%% (required < %.4f)", mae, champion, required))
        .otherwise(F.concat(
            F.format_string("PASSED: MAE=%.4f, RMSE=%.4f, R2=%.4f", mae, rmse, r2),
            F.when(champion.isNotNull(), F.format_string(", improved champion by %.1f%%", (champion - mae) / champion * 100)).otherwise(""),
        ))
    )
    return result.withColumn("reason", reason).withColumn("passed", F.startswith("reason", F.lit("PASSED")))


#: Rows of a task that trains: Spark's trees hold a task's rows in memory, about 220 bytes each.
TASK_ROWS = 500_000

#: Rows that are worth a core of their own, as each tree passes several times over them.
CORE_ROWS = 25_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew where a task would hold over ``TASK_ROWS`` rows, or twice its share of them while cores idle: files are cut by bytes, and narrow columns make many rows of few.

    Rows are in order within a task, so that one that runs again draws the same of them.
    """
    held = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    most, n = held["most"] or 0, held["n"] or 0
    tasks = max(-(-n // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, n // CORE_ROWS), 1)
    return df.repartition(tasks).sortWithinPartitions(*df.columns) if most > min(TASK_ROWS, 2 * -(-n // tasks)) else df


def train_regressor(df: DataFrame, columns: list[str], label: str, trees: int = 200, seed: int = 55) -> PipelineModel:
    boosted = GBTRegressor(featuresCol="x", labelCol=label, maxIter=trees, stepSize=0.05, maxDepth=4, minInstancesPerNode=10, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="skip"), boosted]).fit(spread(df.select(*columns, label)))


def train_classifiers(df: DataFrame, columns: list[str], label: str, c: float = 0.1, trees: int = 150, seed: int = 55) -> dict[str, PipelineModel]:
    """A logistic model of inverse regularisation ``c`` and a boosted one."""
    df = spread(df.select(*columns, label))
    n = max(1, df.count())
    assemble = VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="skip")
    logistic = LogisticRegression(featuresCol="x", labelCol=label, regParam=1 / (c * n), standardization=False, maxIter=500)
    boosted = GBTClassifier(featuresCol="x", labelCol=label, maxIter=trees, stepSize=0.05, maxDepth=4, seed=seed)
    return {"logistic": Pipeline(stages=[assemble, logistic]).fit(df), "boosted": Pipeline(stages=[assemble, boosted]).fit(df)}


def stratified_split(df: DataFrame, label: str, id_col: str, share: float = 0.25, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test``: of each class exactly the floor of its share, those with the smallest hashes of their ids.

    Ranks within a class are running sums over ranges of hashes, so that no task holds a class. Ids must be unique.
    """
    hashed = df.withColumns({"_o": F.struct(F.xxhash64(id_col, F.lit(seed)).alias("h"), F.col(id_col).alias("i")), "_one": F.lit(1)})
    sizes = df.groupBy(label).agg(F.floor(F.count("*") * share).alias("_take"))  # one row for each class
    ranked = running_sums(hashed, [label], "_o", ["_one"]).join(F.broadcast(sizes), label)
    return ranked.select(*df.columns, (F.col("cum__one") <= F.col("_take")).alias("is_test"))


def serving_model(model: PipelineModel) -> PipelineModel:
    """A fitted model that takes raw prediction requests: it holds the serving features too, and is saved and loaded with them."""
    return model if isinstance(model.stages[0], features.ServingFeatures) else PipelineModel([features.ServingFeatures(), *model.stages])


def predictions(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """Batch prediction of requests by a ``serving_model``, or by a model of serving features, clamped at 0."""
    return serving_model(model).transform(requests).select("store_id", "product_id", "date", features.clamped(F.col("prediction")).alias("predicted_demand"))


def linear_attributions(rows: DataFrame, background: DataFrame, coefficients: dict[str, float], id_col: str = "id") -> DataFrame:
    """(id, feature, phi): exact values of a linear model, coefficient * (x - mean of the background)."""
    means = background.agg(*(F.avg(c).alias(f"_m_{c}") for c in coefficients))
    wide = rows.crossJoin(means).select(id_col, *((F.lit(float(b)) * (F.col(c) - F.col(f"_m_{c}"))).alias(c) for c, b in coefficients.items()))  # one row of means
    return wide.unpivot([id_col], list(coefficients), "feature", "phi")


def model_output(model: PipelineModel) -> Column:
    """What is explained: the probability of class 1 of a classifier, the prediction of any other model."""
    last = model.stages[-1]
    return vector_to_array(F.col("probability"))[1] if isinstance(last, ProbabilisticClassificationModel) else F.col("prediction")


def drawn_background(background: DataFrame, columns: list[str], background_rows: int = 100, seed: int = 0) -> DataFrame:
    """(_b, columns): at most ``background_rows`` rows, those with the smallest hashes, numbered."""
    drawn = background.select(*columns).orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(background_rows)
    return materialise(drawn.withColumn("_b", F.monotonically_increasing_id()))


def sampled_attributions(model: PipelineModel, rows: DataFrame, background: DataFrame, columns: list[str], id_col: str = "id", error: float = 0.01, max_rounds: int = 16, background_rows: int = 100, seed: int = 0) -> DataFrame:
    """(id, feature, phi, standard_error, rounds): sampled Shapley values of any model (Strumbelj and Kononenko 2014).

    In each round a row meets every background row, with a hashed order of its features and with the reverse of that order; features
    take the row's values one after another, and each is credited with the change of the model's output. So a row's values sum to its output less the
    mean output of the background, whatever was drawn. The standard error is that of the rounds' means; rows whose features all have
    at most ``error`` after two rounds or more are drawn no further, and ``max_rounds`` ends the others.

    Values depend on a row's features alone: each distinct row of features is drawn once, spread over all tasks, and its values are joined
    to its ids. Outputs of whole rows and of the background are found once. Up to two features, an order and its reverse are all
    orders there are: a second round would repeat the first, which counts for both. Rows that the model skips have no values.
    """
    told = drawn_background(background, columns, background_rows, seed)
    others = materialise(model.transform(told).select("_b", model_output(model).alias("_base"), *(F.col(c).alias(f"_b_{c}") for c in columns)))
    n_background = others.count()
    asked = materialise(rows.select(id_col, *columns))
    # A fixed number of partitions, so that they are not merged to a few: what a row costs is in no relation to its bytes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each, own_columns = range(len(columns)), [f"_x_{c}" for c in columns]
    sums, squares = [f"_s_{i}" for i in each], [f"_q_{i}" for i in each]
    distinct = model.transform(asked.select(*columns).distinct().repartition(tasks))
    own = distinct.select(*(F.col(c).alias(x) for c, x in zip(columns, own_columns, strict=True)), model_output(model).alias("_full"), *(F.lit(0.0).alias(s) for s in sums + squares))
    places, last = F.array(*map(F.lit, each)), len(columns) - 1
    repeats = 2 if len(columns) <= 2 else 1
    settled = None
    for k in range(1, max_rounds + 1):
        # A broadcast of at most background_rows rows, all of which every row meets.
        met = (own if k == 1 else own.repartition(tasks)).crossJoin(F.broadcast(others))
        hashed = F.transform(F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(i, *own_columns, F.col("_b"), F.lit(k), F.lit(seed)).alias("h"), i.alias("i")))), lambda x: x["i"])  # noqa: B023
        order = places if repeats == 2 else hashed
        steps = met.withColumn("_o", F.explode(F.array(order, F.reverse(order)))).withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(max(last, 1)))))
        taken: dict[str, Column] = {c: F.when(F.array_position("_o", F.lit(i)) <= F.col("_s"), F.col(f"_x_{c}")).otherwise(F.col(f"_b_{c}")) for i, c in enumerate(columns)}
        scored = model.transform(steps.withColumns(taken)).select(*own_columns, "_full", *sums, *squares, "_s", "_base", F.get("_o", F.col("_s") - 1).alias("_in"), F.get("_o", F.col("_s")).alias("_next"), model_output(model).alias("_y"))
        # A step's output counts for the feature that it added, and against the one that comes next; before the first is the background, after the last the row.
        gain = F.col("_y") - F.when(F.col("_s") == 1, F.col("_base")).otherwise(0.0)
        rest = F.when(F.col("_s") == last, F.col("_full")).otherwise(0.0) - F.col("_y")
        means = scored.groupBy(*own_columns).agg(
            *(F.any_value(c).alias(c) for c in ["_full", *sums, *squares]),
            *((F.sum(F.when(F.col("_in") == i, gain).when(F.col("_next") == i, rest)) / (2 * n_background)).alias(f"_m_{i}") for i in each),
        )
        n = repeats * k
        state = materialise(means.select(*own_columns, "_full", *((F.col(s) + repeats * F.col(f"_m_{i}")).alias(s) for i, s in enumerate(sums)), *((F.col(q) + repeats * F.col(f"_m_{i}") * F.col(f"_m_{i}")).alias(q) for i, q in enumerate(squares))))
        own = state
        if n == 1:
            continue
        errors = [F.sqrt(F.greatest(F.col(q) - F.col(s) * F.col(s) / n, F.lit(0.0)) / (n - 1) / n) for s, q in zip(sums, squares, strict=True)]
        wide = F.array_max(F.array(*errors)) > error
        found = (state if k == max_rounds else state.where(~wide)).select(*own_columns, *((F.col(s) / n).alias(f"_phi_{i}") for i, s in enumerate(sums)), *(e.alias(f"_e_{i}") for i, e in enumerate(errors)), F.lit(n).alias("rounds"))
        settled = found if settled is None else settled.unionByName(found)
        own = state.where(wide)
        if k == max_rounds or not own.head(1):
            break
    same = [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(columns, own_columns, strict=True)]
    values = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"_phi_{i}").alias("phi"), F.col(f"_e_{i}").alias("standard_error")) for i, c in enumerate(columns)))
    return asked.join(settled, same).select(id_col, F.inline(values), "rounds")


def train_line(df: DataFrame, columns: list[str], label: str) -> PipelineModel:
    """Least squares."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="skip"), LinearRegression(featuresCol="x", labelCol=label, solver="normal")]).fit(df)


def training_workflow(table: DataFrame, keys: list[str], train: tuple[str, str], validation: tuple[str, str], store: Snapshots, model_path: str, champion_mae: float | None = None, limits: Gate = Gate(), trees: int = 200, train_model: Callable[[DataFrame, list[str], str], PipelineModel] | None = None) -> DataFrame:
    """One row of metrics and the gate's decision. A model that passes is saved, and its training features become the snapshot ``reference``.

    ``train_model`` takes rows, features and label, in place of the boosted regressor of ``trees``.
    """
    ready = materialise(features.prepare(table, keys))
    a, b = features.date_range(ready, "date", *train), features.date_range(ready, "date", *validation)
    columns = [c for c in features.FEATURES if c in ready.columns]
    model = train_model(a, columns, "demand") if train_model else train_regressor(a, columns, "demand", trees)
    result = metrics.regression(model.transform(b), "demand", "prediction").withColumns({"champion_mae": F.lit(champion_mae).cast("double"), "n_train_samples": F.lit(a.count())})
    decided = materialise(gate(result, limits))
    if decided.first()["passed"]:
        save_model(model, model_path)
        store.save("reference", features.feature_columns(a, "demand"))
    return decided


def monitoring_workflow(table: DataFrame, keys: list[str], window: tuple[str, str], store: Snapshots) -> DataFrame:
    """The drift report of a date range against the snapshot ``reference``; RuntimeError without one."""
    try:
        reference = store.load("reference")
    except KeyError as missing:
        raise RuntimeError("no reference snapshot; train first") from missing
    current = features.date_range(features.prepare(table, keys), "date", *window)
    columns = [c for c in features.FEATURES if c in current.columns]
    return drift.report(reference, features.feature_columns(current, "demand"), columns, "demand")
