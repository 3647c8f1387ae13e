from __future__ import annotations

import numpy as np
import pytest

from driftwell.operators import drift


def frame(spark, **columns):
    return spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*columns.values())], ", ".join(f"{c} double" for c in columns))


def numpy_psi(a, b):
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    if len(edges) < 2:
        return 0.0
    b = np.clip(b, edges[0], edges[-1])
    e, c = np.histogram(a, edges)[0] / len(a), np.histogram(b, edges)[0] / len(b)
    e, c = np.where(e == 0, 1e-6, e), np.where(c == 0, 1e-6, c)
    return float(((c - e) * np.log(c / e)).sum())


def numpy_ks(a, b):
    v = np.union1d(a, b)
    return float(np.abs(np.searchsorted(np.sort(a), v, "right") / len(a) - np.searchsorted(np.sort(b), v, "right") / len(b)).max())


@pytest.mark.parametrize("shift", [0.0, 0.4, 3.0])
@pytest.mark.parametrize("ties", [False, True])
def test_psi_and_ks_equal_numpy(spark, shift, ties):
    rng = np.random.default_rng(4)
    a, b = rng.normal(10, 2, 900), rng.normal(10 + shift, 2, 500)
    if ties:
        a, b = a.round(), b.round()
    values = drift.sides(frame(spark, x=a).repartition(7), frame(spark, x=b))
    assert drift.psi(values).first()["psi"] == pytest.approx(numpy_psi(a, b), abs=1e-9)
    k = drift.ks(values).first()
    assert k["ks"] == pytest.approx(numpy_ks(a, b), abs=1e-12) and (k["n_ref"], k["n_cur"]) == (900, 500)


def test_same_population_does_not_drift(spark):
    a = frame(spark, x=np.arange(1000), y=np.arange(1000) % 7)
    rows = drift.feature_drift(a, a).collect()
    assert len(rows) == 4 and not any(r["is_drift"] for r in rows) and all(r["statistic"] == 0 for r in rows)
    assert {r["p_value"] for r in rows} == {None, 1.0}


def test_shift_is_critical_and_reported(spark):
    rng = np.random.default_rng(1)
    a, b = frame(spark, x=rng.normal(10, 2, 2000), y=rng.normal(0, 1, 2000)), frame(spark, x=rng.normal(20, 2, 2000), y=rng.normal(0, 1, 2000))
    r = drift.report(a, b, ["x", "y", "absent"], label="y").first()
    assert r["overall_drift_detected"] and r["retraining_recommended"] and "CRITICAL" in r["summary"] and "x" in r["summary"]
    assert (r["n_reference_samples"], r["n_current_samples"], len(r["feature_drift"])) == (2000, 2000, 4)
    assert r["label_drift"]["feature"] == "y"


def test_missing_values_and_empty_sides(spark):
    a = spark.createDataFrame([(1.0, None), (float("nan"), None), (2.0, None)], "x double, y double")
    b = spark.createDataFrame([(1.0, 5.0), (None, 6.0)], "x double, y double")
    assert {r["feature"] for r in drift.feature_drift(a, b).collect()} == {"x"}
    assert drift.feature_drift(a.limit(0), b).count() == 0
    assert not drift.report(a.limit(0), b).first()["overall_drift_detected"]


def test_constant_feature_has_no_psi(spark):
    a = frame(spark, x=[3] * 20)
    assert drift.psi(drift.sides(a, frame(spark, x=[4] * 20))).first()["psi"] == 0.0


def test_zero_mean_shift_is_against_one(spark):
    r = drift.means(drift.sides(frame(spark, x=[-1, 1]), frame(spark, x=[1, 2]))).first()
    assert r["mean_shift_pct"] == 150.0


def test_histogram_densities_sum_to_one(spark):
    values = drift.sides(frame(spark, x=range(100)), frame(spark, x=range(50, 250)))
    h = drift.paired_histogram(values).collect()
    width = 249 / 30
    for side in ("reference", "current"):
        assert sum(r["density"] * width for r in h if r["side"] == side) == pytest.approx(1)


def test_what_if(spark):
    df = spark.sql("select timestamp'2024-01-01' d, 10.0D p, 10.0D q union all select timestamp'2024-02-01', 10.0D, 10.0D")
    rows = drift.what_if(df, "d", "2024-02-01", "p", "q").orderBy("d").collect()
    assert [(r["p"], r["q"]) for r in rows] == [(10.0, 10.0), (15.0, 6.0)]
