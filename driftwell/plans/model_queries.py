"""Queries on scored rows, cards, registry events and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import features, metrics, models, registry, risk
from driftwell.sources.shared import materialise, shared_path
from driftwell.sources.tables import ModelStore, Snapshots, load_model, read, save_model

METRICS = risk.METRICS


def _scored(spark, d, scale: float = 600_000.0) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = read(spark, d, "orders").join(c, "o_custkey")
    prob = F.least(F.col("o_totalprice") / scale, F.lit(1.0))
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y_true"), (prob > 0.5).cast("int").alias("y_pred"), prob.alias("y_prob"), "o_orderpriority", "c_mktsegment")


def classifier_metrics(spark, d):
    return metrics.performance(_scored(spark, d)).select(*(F.round(c, 6).alias(c) for c in METRICS))


def gain_table(spark, d):
    return metrics.gain_table(_scored(spark, d))


SLICES = ["o_orderpriority", "c_mktsegment", "absent"]


def fairness_slices(spark, d):
    s = metrics.slice_report(metrics.fairness_slices(_scored(spark, d), SLICES))
    return s.select("slice_name", "feature", "value", "n_samples", *(F.round(c, 6).alias(c) for c in ("approval_rate", "fpr", "fnr", "disparate_impact")), "violates")


def _card(spark, d, name: str, scale: float) -> DataFrame:
    rows = materialise(_scored(spark, d, scale))
    perf = metrics.performance(rows).select(F.struct(*METRICS).alias("performance"))
    slices = metrics.fairness_slices(rows, SLICES).agg(F.array_sort(F.collect_list(F.struct("slice_name", "feature", "value", "n_samples", "approval_rate", "fpr", "fnr", "disparate_impact"))).alias("fairness_slices"))
    size = rows.agg(F.count("*").alias("training_dataset_size"))
    return perf.crossJoin(slices).crossJoin(size).withColumns({"model_id": F.lit(name), "model_name": F.lit(name), "version": F.lit("1")})  # one row each


def _cards(spark, d) -> DataFrame:
    return risk.with_risk(_card(spark, d, "a", 600_000.0).unionByName(_card(spark, d, "b", 400_000.0)))


def risk_score(spark, d):
    c = risk.with_risk(_card(spark, d, "a", 600_000.0))
    return c.select("model_id", "risk_score", "risk_factors.performance", "risk_factors.fairness", "risk_factors.data", "risk_factors.stability", "risk_label", F.col("risk_factors.details.fairness").alias("fairness_detail"), F.col("risk_factors.details.data").alias("data_detail"))


def card_compare(spark, d):
    c = risk.compare(_cards(spark, d), "a", "b")
    return c.select("metric", *(F.round(x, 6).alias(x) for x in ("a", "b", "delta")))


def card_promotion(spark, d):
    return risk.promotion(_cards(spark, d))


def card_json(spark, d):
    back = risk.from_json(risk.to_json(_cards(spark, d)))
    return back.select("model_id", F.round("performance.accuracy", 6).alias("accuracy"), F.size("fairness_slices").cast("long").alias("n_slices"), F.size("feature_names").cast("long").alias("n_features"))


def _events(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "P", "production").otherwise("staging")
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("m"), F.col("o_custkey")).alias("model_id"), F.concat(F.lit("name"), F.col("o_custkey")).alias("model_name"), F.lit("1").alias("version"), F.col("o_orderdate").alias("registered_at"), status.alias("status"), F.lit(None).cast("string").alias("model_path"), F.lit(None).cast("string").alias("card_path"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("tags"))


def registry_current(spark, d):
    return registry.current(_events(spark, d), "production").select("model_id", "seq", "status", "registered_at")


def registry_update(spark, d):
    e = materialise(_events(spark, d))
    first = e.orderBy("seq").first()["model_id"]
    now = registry.current(e.unionByName(registry.status_event(e, first, "archived")))
    return now.groupBy("status").agg(F.count("*").alias("n"))


def registry_tags(spark, d):
    e = registry.tags_to_map(registry.tags_to_json(_events(spark, d)))
    return e.groupBy(F.col("tags")["priority"].alias("priority")).agg(F.count("*").alias("n"))


def _artifacts(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("artifact_id"), F.lit("model").alias("artifact_type"), F.lit(1).alias("version"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "promote").otherwise("save").alias("event"), F.create_map(F.lit("mae"), F.col("o_totalprice")).alias("metadata"))


def champions(spark, d):
    c = registry.champions(_artifacts(spark, d))
    return c.groupBy("is_champion").agg(F.count("*").alias("n"), F.round(F.sum(F.col("metadata")["mae"]), 2).alias("mae"))


def next_version(spark, d):
    return registry.next_version(_artifacts(spark, d))


def regression_metrics(spark, d):
    rows = read(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("guess"))
    out = metrics.regression(rows, "l_extendedprice", "guess")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


def promotion_gate(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    e = F.col("y") - F.col("p")
    by = rows.groupBy("l_returnflag").agg(F.round(F.avg(F.abs(e)) / 500, 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)) / 500, 4).alias("rmse"), F.round(F.corr("y", "p"), 4).alias("r2"))
    return models.gate(by.withColumn("champion_mae", F.when(F.col("l_returnflag") == "A", F.lit(40.0)).when(F.col("l_returnflag") == "N", F.lit(0.5)))).select("l_returnflag", "passed", "reason")


def stratified_split(spark, d):
    s = models.stratified_split(_scored(spark, d), "y_true", "id")
    return s.groupBy("y_true").agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))


def linear_attribution(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax")
    phi = models.linear_attributions(rows, rows, {"l_quantity": 1500.0, "l_discount": -200.0, "l_tax": 10.0})
    return metrics.ranked_importances(phi).select("feature", F.round("mean_abs", 4).alias("mean_abs"), "rank")


def _price_rows(spark, d):
    return read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))


def regressor_gate(spark, d):
    """The boosted regressor, trained on three of four rows by hash, and the gate's decision on the others."""
    rows = materialise(_price_rows(spark, d))
    test = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    model = models.train_regressor(rows.where(~test), ["l_quantity", "l_discount", "l_tax"], "label")
    return models.gate(metrics.regression(model.transform(rows.where(test)), "label", "prediction").withColumn("champion_mae", F.lit(None).cast("double"))).select("passed", "reason")


def _parts(spark, d):
    """Parts with two features and a label that is linear in them, and as a background one row for each nation."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("size"), (F.col("n_regionkey") * 100.0 + 1000.0).alias("price"))
    return materialise(p.withColumn("label", 3.0 * F.col("size") - 0.5 * F.col("price") + 7.0)), n


def sampled_attribution(spark, d):
    """Importances by sampled attributions of the boosted regressor."""
    rows, background = _parts(spark, d)
    model = models.train_regressor(rows, ["size", "price"], "label")
    phi = models.sampled_attributions(model, rows, background, ["size", "price"])
    return metrics.ranked_importances(phi)


def attribution_linear(spark, d):
    """Sampled attributions of a linear model, which are exact: the standard error is 0."""
    rows, background = _parts(spark, d)
    model = models.train_line(rows, ["size", "price"], "label")
    phi = models.sampled_attributions(model, rows, background, ["size", "price"])
    return phi.select("id", "feature", F.round("phi", 3).alias("phi"), (F.col("standard_error") < 1e-3).alias("exact"))


def attribution_sums(spark, d):
    """How many rows there are whose attributions by a boosted model sum to its prediction less the background's mean."""
    rows, background = _parts(spark, d)
    model = models.train_regressor(rows, ["size", "price"], "label", trees=2)
    base = model.transform(background).agg(F.avg("prediction")).first()[0]
    sums = models.sampled_attributions(model, rows, background, ["size", "price"], max_rounds=2).groupBy("id").agg(F.sum("phi").alias("phi"))
    told = model.transform(rows).select("id", "prediction").join(sums, "id")
    return told.groupBy((F.abs(F.col("phi") - (F.col("prediction") - F.lit(base))) < 1e-6).alias("sums")).agg(F.count("*").alias("n"))


def _demand(spark, d) -> DataFrame:
    """Daily demand and mean price by event type as store and a hash bucket of users as product."""
    e = read(spark, d, "events").where("value is not null")
    series = e.groupBy(F.col("event_type").alias("store_id"), (F.col("user_id") % 4).alias("product_id"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("demand"), F.avg("value").alias("price"))
    return features.calendar(series, "date").withColumns({"store_size": F.lit("small"), "product_category": F.lit("A")})


def workflow(spark, d):
    """Training, gate and snapshot, and then the drift report of the days after it."""
    table = materialise(_demand(spark, d))
    root = shared_path(spark, "workflow")
    store = Snapshots(spark, root)
    loose = models.Gate(max_mae=1e12, max_rmse=1e12, min_r2=-1e12)
    models.training_workflow(table, ["store_id", "product_id"], ("2024-01-15", "2024-01-21"), ("2024-01-22", "2024-01-24"), store, f"{root}/model", limits=loose, trees=2)
    return models.monitoring_workflow(table, ["store_id", "product_id"], ("2024-01-25", "2024-01-30"), store).select("n_reference_samples", "n_current_samples", "overall_drift_detected", "retraining_recommended", "summary")


def workflow_line(spark, d):
    """The training workflow with least squares on one feature, and the row counts of the monitoring report after it."""
    table = materialise(_demand(spark, d))
    root = shared_path(spark, "workflow")
    store = Snapshots(spark, root)
    loose = models.Gate(max_mae=1e12, max_rmse=1e12, min_r2=-1e12)
    line = lambda rows, _, label: models.train_line(rows, ["lag_1_demand"], label)
    trained = models.training_workflow(table, ["store_id", "product_id"], ("2024-01-15", "2024-01-21"), ("2024-01-22", "2024-01-24"), store, f"{root}/model", limits=loose, train_model=line)
    report = models.monitoring_workflow(table, ["store_id", "product_id"], ("2024-01-25", "2024-01-30"), store)
    return trained.crossJoin(report).select("n_train_samples", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")), "passed", "n_reference_samples", "n_current_samples")  # one row each


def logistic_solution(spark, d):
    """Weight and intercept of the logistic model of one feature."""
    rows = materialise(_scored(spark, d).select(F.col("y_true").cast("double").alias("y"), "y_prob"))
    fitted = models.train_classifiers(rows, ["y_prob"], "y", trees=1)["logistic"].stages[-1]
    return spark.createDataFrame([(float(fitted.coefficients[0]), float(fitted.intercept))], "weight double, intercept double").select(F.round("weight", 2).alias("weight"), F.round("intercept", 2).alias("intercept"))


def clamped_predictions(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", features.clamped((F.col("o_totalprice") - 200_000) / 7).alias("prediction"))


def top_slices(spark, d):
    s = metrics.fairness_slices(_scored(spark, d), SLICES)
    return s.orderBy("disparate_impact", "slice_name").limit(3).select("slice_name", F.round("disparate_impact", 6).alias("disparate_impact"))


def classifier_training(spark, d):
    """Both classifiers on an exact split, and their metrics on its test part."""
    s = materialise(models.stratified_split(_scored(spark, d).select("id", F.col("y_true").cast("double").alias("y_true"), "y_prob"), "y_true", "id"))
    out = None
    for name, model in models.train_classifiers(s.where("not is_test"), ["y_prob"], "y_true", trees=2).items():
        p = model.transform(s.where("is_test")).select("y_true", F.col("prediction").alias("y_pred"))
        row = metrics.confusion(p).select(F.lit(name).alias("model"), "accuracy", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def _line(spark, d):
    """A pipeline of one feature by least squares, and its rows (price, demand)."""
    rows = materialise(read(spark, d, "lineitem").select(F.col("l_quantity").alias("price"), F.col("l_extendedprice").alias("demand")))
    return models.train_line(rows, ["price"], "demand"), rows


def model_round_trip(spark, d):
    """A fitted model's predictions after it was saved and loaded."""
    model, rows = _line(spark, d)
    path = shared_path(spark, "model")
    save_model(model, path)
    seen = rows.select("price").distinct()
    return load_model(path).transform(seen).select("price", F.round("prediction", 4).alias("prediction"))


def batch_prediction(spark, d):
    """Raw requests through a saved model that holds its serving features, clamped at 0."""
    path = shared_path(spark, "serving")
    save_model(models.serving_model(_line(spark, d)[0]), path)
    model = load_model(path)
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("store_id"), F.col("o_orderkey").alias("product_id"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 10_000 - 5).alias("price"))
    return models.predictions(model, o).select("product_id", "predicted_demand")


def model_store(spark, d):
    """Two models saved and one promoted: the predictions of both by id, and those of the champion."""
    store = ModelStore(spark, shared_path(spark, "store"))
    rows = materialise(read(spark, d, "lineitem").select(F.col("l_quantity").alias("price"), F.col("l_extendedprice").alias("demand"), "l_discount"))
    for name, part in (("low", rows.where("l_discount < 0.05")), ("high", rows.where("l_discount >= 0.05"))):
        store.save(models.train_line(part, ["price"], "demand"), name, {"rows": float(part.count())})
    store.promote("low")
    at = spark.range(1, 11).select(F.col("id").cast("double").alias("price"))
    told = registry.champions(store.events()).select(F.col("artifact_id").alias("model"), "version", F.col("metadata")["rows"].alias("n_rows"), "is_champion")
    out = None
    for name, model in (("low", store.load("low")), ("high", store.load("high")), ("champion", store.load_champion())):
        p = model.transform(at).select(F.lit(name).alias("model"), "price", F.round("prediction", 4).alias("prediction"))
        out = p if out is None else out.unionByName(p)
    return out.join(told, "model", "left").select("model", "price", "prediction", F.col("version").cast("long").alias("version"), "n_rows", "is_champion")


def champion_metric(spark, d):
    """The metric of the artifact promoted last."""
    return registry.champions(_artifacts(spark, d)).where("is_champion").select("artifact_id", F.col("metadata")["mae"].alias("mae"))


def top_importances(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax")
    phi = models.linear_attributions(rows, rows, {"l_quantity": 1500.0, "l_discount": -200.0, "l_tax": 10.0})
    return metrics.top_importances(phi, 2).select("feature", F.round("mean_abs", 4).alias("mean_abs"), "rank")


QUERIES = {f.__name__: f for f in (classifier_metrics, gain_table, fairness_slices, risk_score, card_compare, card_promotion, card_json, registry_current, registry_update, registry_tags, champions, next_version, regression_metrics, promotion_gate, stratified_split, linear_attribution, regressor_gate, sampled_attribution, attribution_linear, attribution_sums, workflow, workflow_line, logistic_solution, clamped_predictions, top_slices, classifier_training, model_round_trip, batch_prediction, model_store, champion_metric, top_importances)}


def _rows(scale: float) -> str:
    return f"select o_orderkey as id, cast(o_orderstatus = 'F' as int) as t, cast(least(o_totalprice / {scale}, 1.0) > 0.5 as int) as p, least(o_totalprice / {scale}, 1.0) as s, o_orderpriority, c_mktsegment from orders join customer on c_custkey = o_custkey"


def _perf(name: str, scale: float) -> str:
    return f"""{name}_s as ({_rows(scale)}),
{name}_n as (select count(*) as n, sum(cast(t = p as int)) as same, count(*) filter (where t = 1 and p = 1) as tp, count(*) filter (where t = 0 and p = 1) as fp, count(*) filter (where t = 1 and p = 0) as fn from {name}_s),
{name}_m as (select same / n as accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall from {name}_n),
{name}_t as (select s, count(*) filter (where t = 1) as pos, count(*) filter (where t = 0) as neg from {name}_s group by s),
{name}_c as (select pos, neg, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over () as tp, sum(neg) over () as tn from {name}_t window w as (order by s rows unbounded preceding)),
{name}_r as (select sum(pos * (cn - neg + neg / 2.0)) / max(tp * tn) as roc_auc, max(abs(cp / tp - cn / tn)) as ks_statistic from {name}_c),
{name} as (select accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1, roc_auc, 2 * roc_auc - 1 as gini, ks_statistic from {name}_m, {name}_r),
{name}_f as (select feature, value, count(*) as n_samples, avg(cast(p = 0 as double)) as approval_rate, coalesce(avg(cast(p = 1 as double)) filter (where t = 0), 0.0) as fpr, coalesce(avg(cast(p = 0 as double)) filter (where t = 1), 0.0) as fnr
 from (select t, p, 'o_orderpriority' as feature, o_orderpriority as value from {name}_s union all select t, p, 'c_mktsegment', c_mktsegment from {name}_s) where value is not null group by 1, 2 having count(*) >= 30),
{name}_d as (select *, feature || '=' || value as slice_name, coalesce(approval_rate / nullif((select avg(cast(p = 0 as double)) from {name}_s), 0), 0.0) as disparate_impact from {name}_f),
{name}_k as (select *, least(25.0, (case when gini <= 0.3 then 20.0 when gini >= 0.5 then 0.0 else 20.0 * (1.0 - (gini - 0.3) / 0.2) end) + (case when f1 < 0.5 then 5.0 else 0.0 end)) as perf,
 round(25.0 * coalesce((select avg(cast(disparate_impact < 0.8 as double)) from {name}_d), 0.0), 2) as fair,
 (select round(case when n <= 1000 then 25.0 when n >= 10000 then 0.0 else 25.0 * (1.0 - (n - 1000) / 9000.0) end, 2) from {name}_n) as data,
 round(case when ks_statistic <= 0.2 then 25.0 when ks_statistic >= 0.4 then 0.0 else 25.0 * (1.0 - (ks_statistic - 0.2) / 0.2) end, 2) as stab from {name}),
{name}_z as (select *, round(perf + fair + data + stab, 2) as risk_score from {name}_k)"""


_BOTH = f"with {_perf('a', 600000.0)}, {_perf('b', 400000.0)}"
_EVENTS = "select o_orderkey as seq, 'm' || o_custkey as model_id, o_orderdate as registered_at, case o_orderstatus when 'F' then 'archived' when 'P' then 'production' else 'staging' end as status from orders"
_LAST = f"select * from ({_EVENTS}) qualify row_number() over (partition by model_id order by seq desc) = 1"

ORACLE_SQL = {
    "classifier_metrics": f"with {_perf('a', 600000.0)} select " + ", ".join(f"round({m}, 6) as {m}" for m in METRICS) + " from a",
    "gain_table": f"""with s as ({_rows(600000.0)}), r as (select t, row_number() over (order by s desc, id) as k from s), n as (select count(*) as n, sum(t) as p from s),
c as (select d, n, p, cast(floor(n * d / 10) as bigint) as cut from n, (select unnest(range(1, 11)) as d)), g as (select d, any_value(n) as n, any_value(p) as p, any_value(cut) as cut, coalesce(sum(t), 0) as b from c left join r on k <= cut group by d)
select cast(d * 10 as int) as threshold, round(coalesce(b / nullif(p, 0), 0.0), 4) as cumulative_bad, round(coalesce((cut - b) / nullif(n - p, 0), 0.0), 4) as cumulative_good, round(abs(coalesce(b / nullif(p, 0), 0.0) - coalesce((cut - b) / nullif(n - p, 0), 0.0)), 4) as ks from g""",
    "fairness_slices": f"with {_perf('a', 600000.0)} select slice_name, feature, value, n_samples, round(approval_rate, 6) as approval_rate, round(fpr, 6) as fpr, round(fnr, 6) as fnr, round(disparate_impact, 6) as disparate_impact, disparate_impact < 0.8 as violates from a_d",
    "risk_score": f"""with {_perf('a', 600000.0)}, v as (select count(*) filter (where disparate_impact < 0.8) as k, count(*) as n, string_agg(case when disparate_impact < 0.8 then slice_name end, ', ' order by slice_name) as names from a_d)
select 'a' as model_id, risk_score, round(perf, 2) as performance, fair as fairness, data, stab as stability, case when risk_score <= 25 then 'Low' when risk_score <= 50 then 'Medium' when risk_score <= 75 then 'High' else 'Critical' end as risk_label,
case when v.n = 0 then 'No fairness slices available; risk assumed 0.' else v.k || '/' || v.n || ' slices violate disparate impact < 0.8; ' || coalesce('violations: ' || v.names, 'none') end as fairness_detail,
'Training size = ' || format('{{:,}}', (select n from a_n)) || ' (min=1,000, target=10,000); score=' || printf('%.1f', data) || '/25' as data_detail from a_z, v""",
    "card_compare": _BOTH + " " + " union all ".join(f"select '{m}' as metric, round(a_z.{m}, 6) as a, round(b_z.{m}, 6) as b, round(b_z.{m} - a_z.{m}, 6) as delta from a_z, b_z" for m in [*METRICS, "risk_score"]),
    "card_promotion": _BOTH + ", u as (select 'a' as model_id, risk_score, gini from a_z union all select 'b', risk_score, gini from b_z) select model_id, case when row_number() over (order by risk_score, gini desc, model_id) = 1 then 'production' else 'archived' end as status from u",
    "card_json": _BOTH + " select 'a' as model_id, round(accuracy, 6) as accuracy, (select count(*) from a_d) as n_slices, 0::bigint as n_features from a_z union all select 'b', round(accuracy, 6), (select count(*) from b_d), 0::bigint from b_z",
    "registry_current": f"select model_id, seq, status, registered_at from ({_LAST}) where status = 'production'",
    "registry_update": f"with f as (select 'm' || o_custkey as model_id from orders order by o_orderkey limit 1) select case when model_id = (select model_id from f) then 'archived' else status end as status, count(*) as n from ({_LAST}) group by 1",
    "registry_tags": "select o_orderpriority as priority, count(*) as n from orders group by 1",
    "champions": "with l as (select o_custkey, arg_max(o_totalprice, o_orderkey) as mae, coalesce(max(o_orderkey) filter (where o_orderstatus = 'P') = (select max(o_orderkey) from orders where o_orderstatus = 'P'), false) as is_champion from orders group by 1) select is_champion, count(*) as n, round(sum(mae), 2) as mae from l group by 1",
    "next_version": "select count(distinct o_custkey) + 1 as version from orders where o_orderstatus <> 'P'",
    "regression_metrics": "with r as (select l_extendedprice as y, l_extendedprice - l_quantity * 1500.0 as e from lineitem) select round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(1 - sum(e * e) / (var_pop(y) * count(y)), 4) as r2 from r",
    "promotion_gate": """with r as (select l_returnflag, l_extendedprice as y, l_quantity * 1500.0 as p from lineitem), g as (select l_returnflag, round(avg(abs(y - p)) / 500, 4) as mae, round(sqrt(avg((y - p) * (y - p))) / 500, 4) as rmse, round(corr(y, p), 4) as r2, case l_returnflag when 'A' then 40.0 when 'N' then 0.5 end as c from r group by 1),
t as (select l_returnflag, case when mae > 50.0 then printf('FAILED: MAE %.4f exceeds threshold 50.0', mae) when rmse > 75.0 then printf('FAILED: RMSE %.4f exceeds threshold 75.0', rmse) when r2 < 0.65 then printf('FAILED: R2 %.4f below minimum 0.65', r2)
when mae >= c * (1 - 0.02) then printf('FAILED: MAE %.4f does not improve champion %.4f by 2%% (required < %.4f)', mae, c, c * (1 - 0.02)) else printf('PASSED: MAE=%.4f, RMSE=%.4f, R2=%.4f', mae, rmse, r2) || coalesce(printf(', improved champion by %.1f%%', (c - mae) / c * 100), '') end as reason from g)
select l_returnflag, starts_with(reason, 'PASSED') as passed, reason from t""",
    "stratified_split": f"with s as ({_rows(600000.0)}) select t as y_true, cast(floor(count(*) * 0.25) as bigint) as n_test, count(*) - cast(floor(count(*) * 0.25) as bigint) as n_train from s group by 1",
    "linear_attribution": """with m as (select avg(l_quantity) as q, avg(l_discount) as d, avg(l_tax) as t from lineitem), a as (select 'l_quantity' as feature, avg(abs(1500.0 * (l_quantity - q))) as v from lineitem, m union all select 'l_discount', avg(abs(-200.0 * (l_discount - d))) from lineitem, m union all select 'l_tax', avg(abs(10.0 * (l_tax - t))) from lineitem, m)
select feature, round(v, 4) as mean_abs, cast(row_number() over (order by v desc, feature) as int) as rank from a""",
    "attribution_linear": """with b as (select avg(n_nationkey) as s, avg(n_regionkey * 100.0 + 1000.0) as p from nation)
select p_partkey as id, 'size' as feature, round(3.0 * (p_size - s), 3) as phi, true as exact from part, b union all select p_partkey, 'price', round(-0.5 * (p_retailprice - p), 3), true from part, b""",
    "attribution_sums": "select true as sums, count(*) as n from part",
    "workflow_line": """with s as (select event_type as store_id, user_id % 4 as product_id, cast(ts as date) as date, sum(value) as demand, avg(value) as price from events where value is not null group by 1, 2, 3),
l as (select *, lag(demand, 1) over w as l1, lag(demand, 7) over w as l7, lag(demand, 14) over w as l14, case when count(demand) over w7 = 7 then 1 end as r7, case when count(demand) over w14 = 14 then 1 end as r14 from s
window w as (partition by store_id, product_id order by date), w7 as (partition by store_id, product_id order by date rows between 7 preceding and 1 preceding), w14 as (partition by store_id, product_id order by date rows between 14 preceding and 1 preceding)),
f as (select * from l where l1 is not null and l7 is not null and l14 is not null and r7 is not null and r14 is not null),
a as (select * from f where date between date '2024-01-15' and date '2024-01-21'), m as (select regr_slope(demand, l1) as b, regr_intercept(demand, l1) as a, count(*) as n from a),
v as (select demand as y, demand - (m.a + m.b * l1) as e from f, m where date between date '2024-01-22' and date '2024-01-24')
select (select n from m) as n_train_samples, round(avg(abs(e)), 4) as mae, round(sqrt(avg(e * e)), 4) as rmse, round(1 - sum(e * e) / (var_pop(y) * count(y)), 4) as r2, true as passed, (select n from m) as n_reference_samples, (select count(*) from f where date between date '2024-01-25' and date '2024-01-30') as n_current_samples from v""",
    "logistic_solution": f"""with recursive s as materialized (select t::double as y, s as x from ({_rows(600000.0)})), c as (select count(*)::double as n from s),
w(i, a, b) as (select 0, 0.0::double, 0.0::double union all
 select i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) from (
  select i, a, b, sum(p - y) as ga, sum((p - y) * x) + b / 0.1 as gb, sum(p * (1 - p)) as haa, sum(p * (1 - p) * x) as hab, sum(p * (1 - p) * x * x) + 1 / 0.1 as hbb
  from (select i, a, b, x, y, 1 / (1 + exp(-(a + b * x))) as p from w, s where i < 12) group by i, a, b))
select round(b, 2) as weight, round(a, 2) as intercept from w where i = 12""",
    "clamped_predictions": "select o_orderkey, greatest(0.0, round_even((o_totalprice - 200000) / 7, 2)) as prediction from orders",
    "top_slices": f"with {_perf('a', 600000.0)} select slice_name, round(disparate_impact, 6) as disparate_impact from a_d order by a_d.disparate_impact, slice_name limit 3",
    "model_round_trip": "with m as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem) select distinct l_quantity as price, round(a + b * l_quantity, 4) as prediction from lineitem, m",
    "batch_prediction": "with m as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem) select o_orderkey as product_id, greatest(0.0, round_even(a + b * (o_totalprice / 10000 - 5), 2)) as predicted_demand from orders, m",
    "model_store": """with m as (select case when l_discount < 0.05 then 'low' else 'high' end as model, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, cast(count(*) as double) as n from lineitem group by 1),
k as (select model, b, a, case model when 'low' then 1::bigint else 2::bigint end as version, n as n_rows, model = 'low' as is_champion from m union all select 'champion', b, a, null, null, null from m where model = 'low'), x as (select unnest(range(1, 11)) as p)
select model, cast(p as double) as price, round(a + b * p, 4) as prediction, version, n_rows, is_champion from k, x""",
    "champion_metric": "select cast(o_custkey as varchar) as artifact_id, (select arg_max(o_totalprice, o_orderkey) from orders as b where b.o_custkey = a.o_custkey) as mae from orders as a where o_orderstatus = 'P' order by o_orderkey desc limit 1",
    "top_importances": """with m as (select avg(l_quantity) as q, avg(l_discount) as d, avg(l_tax) as t from lineitem), a as (select 'l_quantity' as feature, avg(abs(1500.0 * (l_quantity - q))) as v from lineitem, m union all select 'l_discount', avg(abs(-200.0 * (l_discount - d))) from lineitem, m union all select 'l_tax', avg(abs(10.0 * (l_tax - t))) from lineitem, m)
select feature, round(v, 4) as mean_abs, cast(row_number() over (order by v desc, feature) as int) as rank from a order by v desc, feature limit 2""",
}
