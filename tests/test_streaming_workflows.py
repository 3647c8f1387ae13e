from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from driftwell.operators import drift, features, models
from driftwell.operators.summaries import ReferenceSummary
from driftwell.sources.tables import Snapshots, load_model, read_observations
from driftwell.streaming import monitor


def write_json(folder, name, values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"ts": f"2024-01-{1 + k // 200:02d}T00:00:00Z", "x": v}) for k, v in enumerate(values)))


def test_reports_of_batches(spark, tmp_path):
    reference = spark.range(1000).select((F.col("id") * 1.0).alias("x"))
    write_json(tmp_path / "in", "a.json", [float(k) for k in range(400)] + [5000.0] * 400)
    assert read_observations(spark, str(tmp_path / "in"), "ts timestamp, x double").count() == 800
    stream = monitor.observations(spark, str(tmp_path / "in"), "ts timestamp, x double")
    summary = ReferenceSummary.build(reference, ["x"], str(tmp_path / "summary"))
    for _ in range(2):  # the second run finds nothing new
        monitor.start_reports(stream, summary, str(tmp_path / "out"), str(tmp_path / "cp"), first=F.min("x")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/reports")).collect()
    assert {r["first"] for r in rows} == {0.0} and spark.read.parquet(str(tmp_path / "out/rows")).count() == 2
    assert [(r["batch_id"], r["n_current_samples"], r["retraining_recommended"]) for r in rows] == [(0, 800, True)]


def test_window_counts_are_psi_of_finished_windows(spark, tmp_path):
    reference = spark.range(1000).select((F.col("id") * 1.0).alias("x"))
    write_json(tmp_path / "in", "a.json", [float(k % 1000) for k in range(1000)])
    edges, counts = monitor.reference_counts(reference, ["x"])
    stream = monitor.observations(spark, str(tmp_path / "in"), "ts timestamp, x double")
    monitor.start_windows(stream, edges, ["x"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = monitor.window_psi(spark.read.parquet(str(tmp_path / "out")), counts).collect()
    assert got and all(r["severity"] == "critical" for r in got)


def test_many_shuffled_files_lose_no_window(spark, tmp_path):
    reference = spark.range(1000).select((F.col("id") * 1.0).alias("x"))
    folder, rng = tmp_path / "in", random.Random(1)
    folder.mkdir()
    ages = rng.sample(range(130), 130)
    for k in range(130):
        rows = [{"ts": f"2024-01-{1 + k // 6:02d}T0{j}:00:00Z", "x": float(rng.randrange(1000))} for j in range(3)]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{k}.json", (1_700_000_000 + ages[k],) * 2)
    edges, _ = monitor.reference_counts(reference, ["x"])
    want = {tuple(r) for r in monitor.window_counts(spark.read.schema("ts timestamp, x double").json(str(folder)), edges, ["x"]).collect()}
    days = {r[0] for r in want}

    def run(name, start, max_files):
        start(monitor.observations(spark, str(folder), "ts timestamp, x double", max_files), edges, ["x"], str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / name)).select("window_start", "feature", "bin", "n_cur").collect()}

    assert len(days) == 22 and run("all", monitor.start_all_windows, 100) == want
    finished = run("finished", monitor.start_windows, None)
    assert finished == {r for r in want if r[0] in {x[0] for x in finished}} and len({r[0] for r in finished}) >= 20


def demand(spark, days=40):
    rows = spark.range(days * 2).select((F.col("id") % 2).cast("int").alias("store_id"), F.lit(1).alias("product_id"), F.expr("date_add(date'2024-01-01', cast(id div 2 as int))").alias("date"), (10 + F.col("id") % 7).cast("double").alias("demand"), (1 + F.col("id") % 3).cast("double").alias("price"))
    return features.calendar(rows, "date").withColumns({"store_size": F.lit("large"), "product_category": F.lit("B")})


def test_training_then_monitoring(spark, tmp_path):
    store, table = Snapshots(spark, str(tmp_path / "s")), demand(spark)
    with pytest.raises(RuntimeError):
        models.monitoring_workflow(table, ["store_id", "product_id"], ("2024-01-30", "2024-02-05"), store)
    path = str(tmp_path / "model")
    limits = models.Gate(min_r2=-100.0)
    r = models.training_workflow(table, ["store_id", "product_id"], ("2024-01-15", "2024-01-27"), ("2024-01-28", "2024-02-02"), store, path, limits=limits, trees=2).first()
    assert r["passed"] and r["rmse"] >= r["mae"] and r["n_train_samples"] == 26
    model = load_model(path)
    assert load_model(None) is None
    got = models.predictions(model, table.limit(3)).collect()
    assert len(got) == 3 and all(x["predicted_demand"] >= 0 for x in got)
    report = models.monitoring_workflow(table, ["store_id", "product_id"], ("2024-02-03", "2024-02-09"), store).first()
    assert report["n_reference_samples"] == 26 and report["n_current_samples"] == 14
    failed = models.training_workflow(table, ["store_id", "product_id"], ("2024-01-15", "2024-01-27"), ("2024-01-28", "2024-02-02"), store, path, limits=models.Gate(max_mae=0.0), trees=1).first()
    assert not failed["passed"] and "MAE" in failed["reason"]


def test_classifiers(spark):
    rows = spark.range(200).select("id", (F.col("id") * 1.0).alias("a"), (F.col("id") > 100).cast("double").alias("y"))
    found = models.train_classifiers(rows, ["a"], "y", trees=2)
    for m in found.values():
        assert m.transform(rows).where("prediction = y").count() > 180


def drift_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("range_values", [60, 1 << 16])
def test_summary_rows_equal_both_tables(spark, tmp_path, range_values):
    """Against ranges of any size: values inside, between, below and above them, ties, missing values, absent columns."""
    rng = random.Random(range_values)
    reference = spark.createDataFrame([(float(rng.randrange(300)), rng.gauss(0, 1), 5.0, None) for _ in range(900)], "x double, y double, flat double, void double")
    batches = [
        [(float(rng.randrange(280, 320)), rng.gauss(1, 2), 5.0, 1.0) for _ in range(70)],
        [(-1.0, None, 6.0, None), (1000.0, float("nan"), 4.0, None)],
        [(3.5, 0.0, 5.0, None)],
    ]
    summary = ReferenceSummary.build(reference, None, str(tmp_path / "s"), range_values)
    for rows in batches if range_values < 100 else batches[:1]:
        batch = spark.createDataFrame(rows, reference.schema).drop("void" if len(rows) == 1 else "nothing")
        want = drift_rows(drift.feature_drift(reference, batch))
        assert want and drift_rows(summary.drift_rows(batch)) == want
        assert summary.report(batch).first() == drift.report(reference, batch).first()
    assert summary.drift_rows(spark.createDataFrame([(1,)], "other long")).count() == 0


def test_summaries_of_parts_merge(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") * 37 % 501).cast("double").alias("x"), F.col("id"))
    parts = [ReferenceSummary.build(rows.where(f"id % 3 = {k}").select("x"), ["x"], str(tmp_path / f"p{k}"), 50) for k in range(3)]
    merged, whole = ReferenceSummary.merged(parts, str(tmp_path / "m"), 50), ReferenceSummary.build(rows.select("x"), ["x"], str(tmp_path / "w"), 50)
    assert merged.facts().first() == whole.facts().first() and merged.row_count().first() == whole.row_count().first()
    assert sorted(map(tuple, merged.values().collect())) == sorted(map(tuple, whole.values().collect()))


def test_a_batch_reads_only_the_ranges_that_it_touches(spark, tmp_path):
    reference = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    summary = ReferenceSummary.build(reference, ["x"], str(tmp_path / "s"), 100)
    batch = spark.createDataFrame([(5000.5, 2), (5001.0, 1)], "value double, c long").withColumn("feature", F.lit("x"))
    ties = summary.ties(batch)
    # 100 values of one range, 99 other ranges and one value between; no file of the reference is read.
    assert ties.count() == 100 + 99 + 1
    assert not any("range" in f for f in ties.inputFiles()) and ties.agg(F.max("cum_r"), F.max("cum_c")).first()[:] == (10_000, 3)
