from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import metrics, models, registry, risk
from driftwell.plans import catalog


def scored(spark, true, prob, pred=None):
    pred = pred or [int(p > 0.5) for p in prob]
    return spark.createDataFrame([(k, t, p, float(s)) for k, (t, p, s) in enumerate(zip(true, pred, prob))], "id long, y_true int, y_pred int, y_prob double")


def test_eight_rows(spark):
    r = metrics.performance(scored(spark, [1, 0, 1, 0, 1, 0, 1, 0], [.9, .1, .8, .2, .7, .3, .4, .6], [1, 0, 1, 0, 1, 0, 0, 1])).first()
    assert r["accuracy"] == 0.75 and r["gini"] == pytest.approx(2 * r["roc_auc"] - 1)


def test_perfect_ranking_and_no_division(spark):
    r = metrics.performance(scored(spark, [0, 0, 1, 1, 0, 1], [.1, .2, .9, .85, .15, .95])).first()
    assert r["roc_auc"] == 1.0 and r["gini"] == 1.0 and r["ks_statistic"] == 1.0
    r = metrics.performance(scored(spark, [0, 0], [.1, .2])).first()
    assert (r["precision"], r["recall"], r["f1"], r["roc_auc"]) == (0.0, 0.0, 0.0, 0.0)


def test_auc_and_ks_against_pairs(spark):
    rng = np.random.default_rng(2)
    t, s = rng.integers(0, 2, 300), rng.random(300).round(2)
    r = metrics.ranking(scored(spark, t.tolist(), s.tolist()).repartition(7)).first()
    pos, neg = s[t == 1], s[t == 0]
    pairs = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
    assert r["roc_auc"] == pytest.approx(pairs)
    v = np.unique(s)
    assert r["ks_statistic"] == pytest.approx(max(abs((pos <= x).mean() - (neg <= x).mean()) for x in v))


def test_gain_table(spark):
    rng = np.random.default_rng(3)
    t, s = rng.integers(0, 2, 57), rng.random(57).round(1)
    rows = metrics.gain_table(scored(spark, t.tolist(), s.tolist())).orderBy("threshold").collect()
    order = sorted(range(57), key=lambda k: (-s[k], k))
    for d, r in enumerate(rows, 1):
        cut = order[: 57 * d // 10]
        assert r["cumulative_bad"] == pytest.approx(t[cut].sum() / t.sum(), abs=1e-4)
    assert len(rows) == 10 and rows[-1]["ks"] == 0


def test_small_slices_are_dropped(spark):
    rows = [(0, 0, "a")] * 10 + [(0, 0, "b")] * 200 + [(1, 0, None)] * 40
    s = metrics.fairness_slices(spark.createDataFrame(rows, "y_true int, y_pred int, g string"), ["g", "absent"]).collect()
    assert [(r["value"], r["n_samples"], r["disparate_impact"]) for r in s] == [("b", 200, 1.0)]


def card(spark, gini=0.6, f1=0.8, n=50_000, ks=0.6, di=(), name="m"):
    perf = ", ".join(f"'{m}', {v}D" for m, v in dict(accuracy=.9, precision=.8, recall=.8, f1=f1, roc_auc=.8, gini=gini, ks_statistic=ks).items())
    slices = ", ".join(f"named_struct('slice_name', 's{k}', 'feature', 'f', 'value', '{k}', 'n_samples', 50L, 'approval_rate', .5D, 'fpr', 0D, 'fnr', 0D, 'disparate_impact', {v}D)" for k, v in enumerate(di))
    kind = "array<struct<slice_name:string,feature:string,value:string,n_samples:bigint,approval_rate:double,fpr:double,fnr:double,disparate_impact:double>>"
    return spark.sql(f"select '{name}' model_id, named_struct({perf}) performance, cast(array({slices}) as {kind}) fairness_slices, {n}L training_dataset_size")


@pytest.mark.parametrize("kw, part, value", [
    (dict(gini=.1), "performance", 20), (dict(gini=.6), "performance", 0), (dict(f1=.4), "performance", 5), (dict(n=100), "data", 25), (dict(n=50_000), "data", 0),
    (dict(ks=.05), "stability", 25), (dict(ks=.6), "stability", 0), (dict(di=(.6, .9)), "fairness", 12.5), (dict(), "fairness", 0), (dict(gini=.4), "performance", 10),
])
def test_risk_parts(spark, kw, part, value):
    assert risk.with_risk(card(spark, **kw)).first()["risk_factors"][part] == pytest.approx(value)


def test_risk_labels(spark):
    out = spark.createDataFrame([(x,) for x in (25.0, 25.5, 50.0, 51.0, 75.0, 76.0)], "s double").select(risk.label(F.col("s"))).collect()
    assert [r[0] for r in out] == ["Low", "Medium", "Medium", "High", "High", "Critical"]


def test_compare_promote_and_json(spark):
    both = risk.with_risk(card(spark, gini=.6, name="a").unionByName(card(spark, gini=.35, name="b", n=5_000)))
    rows = {r["metric"]: r["delta"] for r in risk.compare(both, "a", "b").collect()}
    assert rows["gini"] == pytest.approx(-.25) and rows["risk_score"] > 0
    assert {r["model_id"]: r["status"] for r in risk.promotion(both).collect()} == {"a": "production", "b": "archived"}
    back = risk.from_json(risk.to_json(both)).orderBy("model_id").first()
    assert back["feature_names"] == [] and back["performance"]["gini"] == .6
    none = {r["metric"]: r["delta"] for r in risk.compare(both, "a", "absent").collect()}
    assert set(none.values()) == {None}


def events(spark):
    rows = [(1, "a", "staging", "2024-01-01"), (2, "b", "staging", "2024-01-02"), (3, "a", "production", "2024-01-01")]
    df = spark.createDataFrame(rows, "seq long, model_id string, status string, at string")
    return df.select("seq", "model_id", F.col("model_id").alias("model_name"), F.lit("1").alias("version"), F.to_timestamp("at").alias("registered_at"), "status", F.lit("").alias("model_path"), F.lit("").alias("card_path"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"))


def test_registry(spark):
    e = events(spark)
    assert [(r["model_id"], r["status"]) for r in registry.current(e).collect()] == [("b", "staging"), ("a", "production")]
    e = e.unionByName(registry.status_event(e, "b", "archived"))
    assert [r["model_id"] for r in registry.current(e, "archived").collect()] == ["b"]
    with pytest.raises(ValueError):
        registry.status_event(e, "b", "gone")
    with pytest.raises(KeyError):
        registry.status_event(e, "zz", "archived")
    assert registry.tags_to_map(registry.tags_to_json(e)).first()["tags"] == {"k": "v"}


def test_champions(spark):
    rows = [(1, "x", "save", 5.0), (2, "y", "save", 4.0), (3, "x", "promote", 5.0), (4, "y", "promote", 4.0)]
    df = spark.createDataFrame(rows, "seq long, artifact_id string, event string, mae double").select("seq", "artifact_id", F.lit("model").alias("artifact_type"), F.lit(1).alias("version"), "event", F.create_map(F.lit("mae"), "mae").alias("metadata"))
    assert {r["artifact_id"]: r["is_champion"] for r in registry.champions(df).collect()} == {"x": False, "y": True}
    assert registry.champion_metric(df) == 4.0 and registry.champion_metric(df.limit(0)) is None and registry.next_version(df).first()["version"] == 3


@pytest.mark.parametrize("mae, rmse, r2, champion, word", [(60, 10, .9, None, "MAE 60.0000 exceeds"), (10, 80, .9, None, "RMSE"), (10, 20, .5, None, "R2"), (10, 20, .9, 10.0, "improve"), (9, 20, .9, 10.0, "PASSED"), (10, 20, .9, None, "PASSED")])
def test_gate(spark, mae, rmse, r2, champion, word):
    df = spark.createDataFrame([(float(mae), float(rmse), r2, champion)], "mae double, rmse double, r2 double, champion_mae double")
    r = models.gate(df).first()
    assert word in r["reason"] and r["passed"] == (word == "PASSED")


def test_regression(spark):
    r = metrics.regression(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double"), "y", "p").first()
    assert (round(r["mae"], 6), round(r["rmse"], 6), r["r2"]) == (0.666667, 0.816497, 0.75)


def test_attributions(spark):
    rows = spark.createDataFrame([(k, float(k), float(k % 5)) for k in range(60)], "id long, a double, b double")
    phi = models.linear_attributions(rows, rows, {"a": 2.0, "b": -1.0})
    ranked = metrics.ranked_importances(phi).orderBy("rank").collect()
    assert [(r["feature"], r["rank"]) for r in ranked] == [("a", 1), ("b", 2)]
    total = phi.groupBy("id").agg(F.sum("phi").alias("s")).join(rows, "id").select((F.col("s") - (2 * F.col("a") - F.col("b") - 57)).alias("d"))
    assert all(abs(r["d"]) < 1e-9 for r in total.collect())
    model = models.train_regressor(rows.withColumn("y", 3 * F.col("a")), ["a", "b"], "y", trees=3)
    sampled = metrics.ranked_importances(models.sampled_attributions(model, rows, rows, ["a", "b"], max_rounds=2, background_rows=16)).orderBy("rank").collect()
    assert sampled[0]["feature"] == "a" and sampled[1]["mean_abs"] <= sampled[0]["mean_abs"]


def test_split_is_exact(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = {r["y"]: r["n"] for r in models.stratified_split(df.repartition(5), "y", "id").where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 17, 1: 8}


def test_attributions_of_a_classifier_meet_their_error(spark):
    """Exact values of three features by all orders, within the stated errors; sums are the class's probability less the background's mean."""
    rows = spark.createDataFrame([(k, float(k % 5), float(k % 3), float(k % 7), float(k % 5 > 1 and k % 3 < 2)) for k in range(60)], "id int, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    model = models.train_classifiers(rows, names, "y", trees=6)["boosted"]
    background = rows.where("id < 8")
    asked = rows.where("id between 20 and 26")
    got = {(r["id"], r["feature"]): r for r in models.sampled_attributions(model, asked, background, names, error=0.01, max_rounds=12).collect()}
    probability = lambda df: {tuple(r[:3]): float(r["probability"][1]) for r in model.transform(df).select(*names, "probability").collect()}
    others = [tuple(r) for r in background.select(*names).collect()]
    mixed = {tuple(x[i] if m >> i & 1 else b[i] for i in range(3)) for x in (tuple(r) for r in asked.select(*names).collect()) for b in others for m in range(8)}
    f = probability(spark.createDataFrame(sorted(mixed), "a double, b double, c double"))
    for r in asked.collect():
        x = (r["a"], r["b"], r["c"])
        at = lambda taken: sum(f[tuple(x[i] if i in taken else b[i] for i in range(3))] for b in others) / len(others)  # noqa: B023, E731
        total = 0.0
        for i, name in enumerate(names):
            exact = sum(at(set(o[: o.index(i) + 1])) - at(set(o[: o.index(i)])) for o in itertools.permutations(range(3))) / 6
            found = got[r["id"], name]
            assert abs(found["phi"] - exact) <= 5 * found["standard_error"] + 1e-6
            assert 2 <= found["rounds"] <= 12 and (found["standard_error"] <= 0.01 or found["rounds"] == 12)
            total += found["phi"]
        assert total == pytest.approx(at({0, 1, 2}) - at(set()), abs=1e-9)


class Watched:
    """A fitted model that notes the partitions and rows of what it is given."""

    def __init__(self, model):
        self.model, self.stages, self.given = model, model.stages, []

    def transform(self, df):
        self.given.append((df.rdd.getNumPartitions(), df.count()))
        return self.model.transform(df)


def test_attributions_draw_equal_rows_once_and_in_many_tasks(spark):
    rows = spark.range(240).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).coalesce(1)
    model = Watched(models.train_regressor(rows.withColumn("y", 3 * F.col("a") + F.col("b")), ["a", "b"], "y", trees=2))
    got = models.sampled_attributions(model, rows, rows.limit(5), ["a", "b"], max_rounds=2).collect()
    assert len(got) == 480 and len({(r["id"] % 12, r["feature"], r["phi"]) for r in got}) == 24
    partitions, count = model.given[-1]
    assert partitions == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert count <= 12 * 5 * 2


@pytest.mark.parametrize("names", [["a"], ["a", "b"]])
def test_attributions_of_a_line_are_exact_and_score_mixed_rows_once(spark, names):
    rows = spark.range(30).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    background = rows.where("id < 4")
    model = Watched(models.train_line(rows.withColumn("y", 2 * F.col("a") - (F.col("b") if "b" in names else 0)), names, "y"))
    got = {(r["id"], r["feature"]): r for r in models.sampled_attributions(model, rows, background, names).collect()}
    assert len(got) == 30 * len(names)
    for (k, name), r in got.items():
        assert r["phi"] == pytest.approx(2 * (k - 1.5) if name == "a" else 1.5 - k % 7, abs=1e-6) and r["standard_error"] < 1e-6
    assert sum(count for _, count in model.given) <= 4 + 30 + 30 * 4 * 2


def test_training_holds_few_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 50, raising=False)
    seen, fit = [], models.Pipeline.fit

    def watched(self, df):
        seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, df)

    monkeypatch.setattr(models.Pipeline, "fit", watched)
    rows = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y")).coalesce(1)
    models.train_regressor(rows, ["a"], "y", trees=1)
    models.train_classifiers(rows, ["a"], "y", trees=1)
    models.train_regressor(rows.limit(40), ["a"], "y", trees=1)
    assert all(sum(counts) == 400 and max(counts) <= 60 for counts in seen[:3]) and seen[3] == [40]


def test_attributions_leave_out_rows_that_the_model_skips(spark):
    rows = spark.createDataFrame([(k, float(k), float(k % 3)) for k in range(12)], "id int, a double, b double")
    model = models.train_regressor(rows.withColumn("y", 3 * F.col("a") - F.col("b")), ["a", "b"], "y", trees=2)
    gap = spark.createDataFrame([(99, None, 1.0)], rows.schema)
    background = rows.where("id < 4")
    base = model.transform(background).agg(F.avg("prediction")).first()[0]
    sums = models.sampled_attributions(model, rows.unionByName(gap), background.unionByName(gap), ["a", "b"], max_rounds=2).groupBy("id").agg(F.sum("phi").alias("phi"))
    got = {r["id"]: r["phi"] for r in sums.collect()}
    want = {r["id"]: r["prediction"] - base for r in model.transform(rows).select("id", "prediction").collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name, train", [("attribution_linear", "train_line"), ("attribution_sums", "train_regressor")])
def test_attribution_queries_score_repeated_parts_once_and_in_many_tasks(spark, tmp_path, monkeypatch, name, train):
    """Parts three times with shifted keys, in one file: the rows of the SQL, and as many mixed rows as those of one copy."""
    fit, fitted = getattr(models, train), []

    def watched(*args, **options):
        fitted.append(Watched(fit(*args, **options)))
        return fitted[-1]

    monkeypatch.setattr(models, train, watched)
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    copies = parts.crossJoin(spark.range(3).withColumnRenamed("id", "k")).withColumn("p_partkey", F.col("p_partkey") + 1_000_000 * F.col("k")).drop("k")
    copies.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("part", "nation"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.fetchall())
    distinct, tasks = copies.select("p_size", "p_retailprice").distinct().count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = [(partitions, count) for partitions, count in fitted[0].given if count > copies.count()]
    assert mixed == [(tasks, distinct * 25 * 2)] and tasks > 1


def test_training_deals_rows_over_idle_cores(spark, monkeypatch):
    monkeypatch.setattr(models, "CORE_ROWS", 50, raising=False)
    seen, fit, cores = [], models.Pipeline.fit, spark.sparkContext.defaultParallelism

    def watched(self, df):
        seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, df)

    monkeypatch.setattr(models.Pipeline, "fit", watched)
    rows = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    models.train_regressor(rows.coalesce(1), ["a"], "y", trees=1)
    models.train_regressor(rows.limit(90).coalesce(1), ["a"], "y", trees=1)
    assert cores > 1 and sum(seen[0]) == 400 and len(seen[0]) == min(cores, 8) and seen[1] == [90]


def test_regressor_gate_trains_all_trees_on_three_of_four_rows(spark, monkeypatch):
    """200 trees, and the gate's decision on what they predict for the other rows."""
    train, seen = models.train_regressor, []

    def watched(df, *args, **options):
        seen.append((df, train(df, *args, **options)))
        return seen[-1][1]

    monkeypatch.setattr(models, "train_regressor", watched)
    passed, reason = catalog.QUERIES["regressor_gate"](spark, "/root/testdata/sf0.001").select("passed", "reason").first()
    ((trained, model),) = seen
    assert model.stages[-1].getNumTrees == len(model.stages[-1].trees) == 200
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    others = model.transform(rows.join(trained, "id", "left_anti")).select("l_extendedprice", "prediction").collect()
    assert trained.count() + len(others) == rows.count() and 0.2 < len(others) / rows.count() < 0.3
    mae = sum(abs(r["l_extendedprice"] - r["prediction"]) for r in others) / len(others)
    assert not passed and float(reason.split()[2]) == pytest.approx(mae, abs=1e-4)


def test_sampled_attribution_explains_a_model_of_all_trees(spark, monkeypatch):
    """200 trees on all parts; importances are those of exact values, by both orders of the two features."""
    train, seen = models.train_regressor, []

    def watched(df, *args, **options):
        seen.append((df.count(), train(df, *args, **options)))
        return seen[-1][1]

    monkeypatch.setattr(models, "train_regressor", watched)
    got = {r["feature"]: r["mean_abs"] for r in catalog.QUERIES["sampled_attribution"](spark, "/root/testdata/sf0.001").collect()}
    ((n, model),) = seen
    assert model.stages[-1].getNumTrees == len(model.stages[-1].trees) == 200
    parts = [(float(r["p_size"]), float(r["p_retailprice"])) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()]
    others = [(float(r["n_nationkey"]), r["n_regionkey"] * 100.0 + 1000.0) for r in spark.read.parquet("/root/testdata/sf0.001/nation.parquet").collect()]
    assert n == len(parts)
    mixed = sorted({m for x in parts for b in others for m in (x, b, (x[0], b[1]), (b[0], x[1]))})
    f = {(r["size"], r["price"]): r["prediction"] for r in model.transform(spark.createDataFrame(mixed, "size double, price double")).collect()}
    exact = [[sum(f[x] - f[b[0], x[1]] + f[x[0], b[1]] - f[b] for b in others), sum(f[x] - f[x[0], b[1]] + f[b[0], x[1]] - f[b] for b in others)] for x in parts]
    size, price = (sum(abs(e[i]) for e in exact) / len(parts) / len(others) / 2 for i in range(2))
    assert got == {"size": pytest.approx(size, abs=1e-9), "price": pytest.approx(price, abs=1e-9)}
