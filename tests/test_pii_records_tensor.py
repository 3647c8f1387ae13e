from __future__ import annotations

import random
import re
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from driftwell.operators import decomposition, features, models, pii_spans, records, registry, tensor
from driftwell.sources.event_log import EventLog
from driftwell.sources.tables import ModelStore, Snapshots, export_csv, load_model, save_model

POSITIVE = {
    "SSN": ["id 123-45-6789."], "PHONE": ["call 800-555-1234", "312.555.0192", "+1 650-555-2020"], "EMAIL": ["john+work@company.org"],
    "DATE_OF_BIRTH": ["DOB: 3-7-85", "DOB 12/31/1999", "Date of Birth: January 15, 1990"], "CREDIT_CARD": ["4111 1111 1111 1111", "5500-0000-0000-0004"],
}
NEGATIVE = {"SSN": "123456789", "PHONE": "Extension: 5555", "EMAIL": "@ the office", "DATE_OF_BIRTH": "Start Date: January 15, 2024", "CREDIT_CARD": "12345678"}


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_patterns(spark):
    cases = [(k, t) for k, ts in POSITIVE.items() for t in ts]
    rows = pii_spans.identify(docs(spark, [t for _, t in cases])).orderBy("doc_id").collect()
    for (kind, _), r in zip(cases, rows, strict=True):
        assert [s["pii_type"] for s in r["spans"]] == [kind]
    rows = pii_spans.identify(docs(spark, list(NEGATIVE.values()))).orderBy("doc_id").collect()
    for kind, r in zip(NEGATIVE, rows, strict=True):
        assert kind not in [s["pii_type"] for s in r["spans"]]


def test_offsets_equal_python(spark):
    texts = ["é 800-555-1234 🙂 a@b.co, c@d.org", None, "", "x" * 3000 + " 123-45-6789", "٣٣٣-٣٣-٣٣٣٣", "DOB: 1/2/90 dob 3/4/91"]
    for kind, pattern in pii_spans.PATTERNS:
        got = docs(spark, texts).select("doc_id", pii_spans.matches(F.coalesce("text", F.lit("")), kind, pattern).alias("s")).orderBy("doc_id").collect()
        for t, r in zip(texts, got, strict=True):
            assert [(s["start"], s["end"]) for s in r["s"]] == [m.span() for m in re.finditer(pattern.replace("(?U)", ""), t or "")]


def test_overlap_table(spark):
    pairs = [((0, 10), (5, 15), True), ((0, 5), (5, 10), False), ((0, 5), (10, 20), False), ((0, 20), (5, 10), True)]
    for a, b, want in pairs:
        row = spark.range(1).select(pii_spans.overlaps(F.struct(F.lit(a[0]).alias("start"), F.lit(a[1]).alias("end")), F.struct(F.lit(b[0]).alias("start"), F.lit(b[1]).alias("end"))).alias("o"))
        assert row.first()["o"] is want


def test_entities_yield_to_patterns_and_redaction(spark):
    d = docs(spark, ["Ann Lee wrote a@b.co today", "The salary is $90,000 per year."])
    e = spark.createDataFrame([(0, "PERSON", "Ann Lee", 0, 7, 0.0), (0, "ORG", "a@b.co", 14, 20, 0.9), (0, "DATE", "today", 21, 26, 0.9)], "doc_id long, label string, text string, start int, end int, score double")
    r = pii_spans.report(pii_spans.identify(d, e)).orderBy("doc_id").collect()
    assert [(s["pii_type"], s["method"], s["confidence"]) for s in r[0]["spans"]] == [("PERSON", "ner", 0.85), ("EMAIL", "regex", 1.0)]
    assert r[0]["redacted"] == "[REDACTED] wrote [REDACTED] today" and r[0]["pii_types"] == ["EMAIL", "PERSON"]
    assert r[1]["redacted"] == "The salary is $90,000 per year." and r[1]["n_spans"] == 0
    assert pii_spans.identify(d, e, threshold=0.9).orderBy("doc_id").first()["spans"][0]["pii_type"] == "EMAIL"


def random_spans(rng, n, kind, longest, size):
    return [(kind, "t", a, a + rng.randrange(1, longest), "m", 1.0) for a in sorted(rng.randrange(size) for _ in range(n))]


def greedy(spans):
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s[2], -s[3], s[0])):
        if s[2] >= end:
            out.append(s)
            end = s[3]
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 255, 256, 257, 900])
def test_sweeps_equal_one_by_one(spark, n):
    """Non-overlap, entities against patterns, and redaction, over none, one and several chunks."""
    rng = random.Random(n)
    text = "".join(rng.choice("aé🙂 xyz") for _ in range(max(3 * n, 10)))
    a, b = (random_spans(rng, n, k, 6, max(3 * n - 8, 1)) for k in ("A", "B"))
    schema = f"text string, a array<{pii_spans.SPAN}>, b array<{pii_spans.SPAN}>"
    row = spark.createDataFrame([(text, a, b)], schema).select(
        pii_spans.resolved(F.concat("a", "b")).alias("resolved"), pii_spans.without_overlaps(F.col("b"), pii_spans.resolved(F.col("a"))).alias("apart"), pii_spans.redacted(F.col("text"), pii_spans.resolved(F.col("a")), "#").alias("redacted")).first()
    assert [tuple(s) for s in row["resolved"]] == greedy(a + b)
    disjoint = greedy(a)
    assert sorted(map(tuple, row["apart"])) == sorted(e for e in b if not any(max(e[2], r[2]) < min(e[3], r[3]) for r in disjoint))
    for _, _, start, end, *_ in reversed(disjoint):
        text = text[:start] + "#" + text[end:]
    assert row["redacted"] == text


def test_many_matches_in_one_text(spark):
    """32 times as many matches take in proportion: far from the thousandfold of a quadratic pass."""
    seconds = {}
    for n in (2_000, 64_000):
        d = docs(spark, ["call 123-45-6789 ok, " * n])
        start = time.perf_counter()
        r = pii_spans.report(pii_spans.identify(d)).select("n_spans", F.length("redacted").alias("chars"), F.element_at("spans", -1)["end"].alias("end")).first()
        seconds[n] = time.perf_counter() - start
        assert r[:] == (n, n * len("call [REDACTED] ok, "), n * 21 - 5)
    assert seconds[64_000] < 32 * seconds[2_000] + 20, seconds


def test_function_source_is_checked(spark):
    def recognise(texts):
        return [[("PERSON", t[:3], 0, 3, 0.9), ("ORG", "no", 0, 2, 0.9), ("LOC", t[:1], -1, 0, 0.9), (None, t[4:6], 4, 6, 0.9), ("GPE", t[4:], 4, len(t), 2.0), ("PERSON", "x", 4, 99, 0.9)] for t in texts]

    d = docs(spark, ["Ann é🙂 Lee", "Bob at home"])
    found = pii_spans.recognised(d, recognise, batch_texts=1)
    assert {tuple(r) for r in pii_spans.rejected_entities(found).collect()} == {("text", 2), ("offsets", 4), ("label", 2)}
    spans = pii_spans.identify(d, pii_spans.usable_entities(found)).orderBy("doc_id").collect()
    assert [[(s["pii_type"], s["text"], s["confidence"]) for s in r["spans"]] for r in spans] == [[("PERSON", "Ann", 0.9), ("ADDRESS", "é🙂 Lee", 0.85)], [("PERSON", "Bob", 0.9), ("ADDRESS", "at home", 0.85)]]
    assert pii_spans.recognised(d.limit(0), recognise).count() == 0
    with pytest.raises(Exception, match="the recogniser gave 0 results"):
        pii_spans.recognised(d, lambda texts: []).count()


def test_precision_recall(spark):
    schema = "doc_id long, pii_type string, start int, end int"
    p = spark.createDataFrame([(0, "A", 0, 5), (0, "A", 3, 8), (0, "B", 20, 25), (1, "A", 0, 1)], schema)
    t = spark.createDataFrame([(0, "A", 0, 10), (0, "A", 30, 40), (2, "A", 0, 1)], schema)
    got = {r["doc_id"]: (round(r["precision"], 4), r["recall"], r["recall_ref"]) for r in pii_spans.precision_recall(p, t).collect()}
    assert got == {0: (0.6667, 0.5, 1.0), 1: (0.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0)}


def test_wrong_offsets(spark):
    d = docs(spark, ["abcdef"])
    s = spark.createDataFrame([(0, "bc", 1, 3), (0, "xx", 1, 3), (0, None, 0, 1)], "doc_id long, text string, start int, end int")
    assert pii_spans.wrong_offsets(s, d).count() == 2


def test_age_and_labs(spark):
    r = spark.sql("select date'1975-04-20' a, date'1960-11-05' b").select(records.age(F.col("a"), F.lit("2024-04-19").cast("date")).alias("a"), records.age(F.col("b"), F.lit("2024-11-05").cast("date")).alias("b")).first()
    assert (r["a"], r["b"]) == (48, 64)
    values = spark.createDataFrame([(95.0,), (115.0,), (35.0,)], "v double").select(records.marker(F.col("v"), F.lit(70.0), F.lit(100.0)).alias("m"), records.abnormal(F.col("v"), F.lit(70.0), F.lit(100.0)).alias("a")).collect()
    assert [(x["m"], x["a"]) for x in values] == [("", False), (" [H]", True), (" [L]", True)]


def test_rules_count_nulls_as_broken(spark):
    p = spark.sql("select date'2999-01-01' dob, 'B' sex, ' ' zip_code union all select date'1990-01-01', 'M', '1' union all select null, null, null")
    got = {r["rule"]: r["n_violations"] for r in records.violations(p, records.patient_rules("2024-01-01")).collect()}
    assert got == {"dob_in_past": 2, "sex": 2, "zip_code": 2}
    assert records.quarantine(p, records.patient_rules("2024-01-01")).count() == 2
    e = spark.sql("select 'telehealth' encounter_type, array(named_struct('code', '', 'description', 'x')) diagnoses")
    assert {r["n_violations"] for r in records.violations(e, records.encounter_rules()).collect()} == {1}
    assert records.violations(spark.sql("select 200 reference_low, 100 reference_high"), records.lab_rules()).first()["n_violations"] == 1
    assert {r["n_violations"] for r in records.violations(spark.sql("select 'progress_note' note_type, '  ' text"), records.note_rules()).collect()} == {1}


def test_children_and_orphans(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 5), (1, 4), (3, 1), (None, 1)], "k long, v int")
    rows = {r["k"]: [x["v"] for x in r["vs"]] for r in records.with_children(a, b, "k", ["v"], "vs").collect()}
    assert rows == {1: [4, 5], 2: []}
    assert records.orphans(b, a, "k", "k").count() == 2


def test_texts(spark):
    dx = spark.sql("select array(named_struct('code', 'E11.9', 'description', 'd1'), named_struct('code', 'I10', 'description', 'd2')) dx")
    r = dx.select(records.diagnosis_text(F.col("dx")).alias("t"), records.diabetic(F.col("dx")).alias("d")).first()
    assert r["t"] == "  1. E11.9 - d1\n  2. I10 - d2" and r["d"]
    assert spark.range(1).select(pii_spans.shortened(F.lit("x" * 30))).first()[0] == "x" * 27 + "_"


def cells(spark, x):
    return spark.createDataFrame([(int(i), int(j), int(k), float(v)) for (i, j, k), v in np.ndenumerate(x)], "machine long, sensor long, t long, value double")


def test_scores_and_reconstruction(spark):
    rng = np.random.default_rng(0)
    a, b, c, w = rng.random((4, 2)), rng.random((3, 2)), rng.random((5, 2)), [2.0, 0.5]
    x = np.einsum("r,ir,jr,kr->ijk", w, a, b, c)
    rows = [(m, k, [float(v) for v in row]) for m, f in zip(tensor.MODES, (a, b, c)) for k, row in enumerate(f)]
    factors = spark.createDataFrame(rows, "mode string, idx long, vec array<double>")
    est = decomposition.reconstruct(cells(spark, x), factors, w)
    assert tensor.relative_error(est).first()[0] < 1e-12
    noisy = decomposition.reconstruct(cells(spark, x + 0.1), factors, w)
    s = {(r["machine"], r["t"]): r["score"] for r in tensor.scores(noisy).collect()}
    want = np.sqrt((0.1**2) * 3) / (np.sqrt(((x[1, :, 2] + 0.1) ** 2).sum()) + 1e-8)
    assert s[1, 2] == pytest.approx(want)


def test_cp_recovers_low_rank_and_flags_faults(spark):
    rng = np.random.default_rng(1)
    x = np.einsum("ir,jr,kr->ijk", rng.random((5, 2)), rng.random((3, 2)), rng.random((12, 2))) + rng.normal(0, 0.001, (5, 3, 12))
    det = tensor.fit_detector(cells(spark, x), rank=2, rounds=15)
    y = x.copy()
    y[2, :, 4:6] += 3
    flags = det.flag(cells(spark, y))
    hit = tensor.fault_hits(flags, spark.createDataFrame([(2, 4, 6, "spike")], "machine long, t_start long, t_end long, type string")).first()
    assert hit["n_flagged"] == 2
    assert det.flag(cells(spark, x)).where("is_anomaly").count() <= 0.06 * 60 + 1
    with pytest.raises(RuntimeError):
        tensor.flagged(flags, None)
    median = flags.agg(F.percentile("score", F.lit(0.5))).first()[0]
    assert hit["max_score"] > median and tensor.summary(flags).first()["machine"].startswith("machine_0")


def test_snapshots_and_csv(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(KeyError):
        store.load("a")
    store.save("a", spark.range(3))
    store.save("a", spark.range(5))
    store.save("b", spark.range(1))
    old = store.load("a", version=1)
    between = store.versions("a").where("version = 1").first()["saved_at"]
    store.save("a", spark.range(7))
    assert old.count() == 3 and store.load("a", version=2).count() == 5 and store.load("a", as_of=between).count() == 3
    assert store.load("a").count() == 7 and [r["name"] for r in store.list().collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        store.load("a", version=9)
    with pytest.raises(KeyError):
        store.load("a", as_of=datetime(2001, 1, 1))
    export_csv({"x": spark.range(2)}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/x")).count() == 2


def test_score_rows_hold_every_step(spark):
    from driftwell.operators import tensor

    scored = spark.createDataFrame([(m, t, m + t / 100) for m in range(3) for t in range(40) if (m, t) != (1, 7)], "machine long, t long, score double")
    rows = {r["machine"]: dict(zip(r["steps"], r["scores"], strict=True)) for r in tensor.score_rows(scored).collect()}
    assert {(m, t): s for m, r in rows.items() for t, s in r.items()} == {(r["machine"], r["t"]): r["score"] for r in scored.collect()}


def test_windows_meet_scores_by_cells(spark):
    """Windows of any length, empty, reversed, repeated and before time 0, against pairwise comparison."""
    rng = random.Random(4)
    flags = [(m, t, rng.random(), rng.random() < 0.3) for m in range(3) for t in range(-40, 700) if rng.random() < 0.9]
    windows = [(rng.randrange(4), a, a + rng.choice([-3, 0, 1, 7, 8, 9, 63, 64, 65, 600]), "x") for a in (rng.randrange(-60, 720) for _ in range(150))]
    windows += [windows[0], (None, 0, 9, "x"), (1, 5, 6, None)]
    got = {(r["machine"], r["t_start"], r["t_end"], r["type"]): (r["max_score"], r["n_flagged"]) for r in tensor.fault_hits(
        spark.createDataFrame(flags, "machine int, t int, score double, is_anomaly boolean"), spark.createDataFrame(windows, "machine int, t_start int, t_end int, type string")).collect()}
    assert set(got) == set(windows)
    for w, found in got.items():
        inside = [(s, f) for m, t, s, f in flags if m == w[0] and w[1] <= t < w[2]]
        assert found == (max((s for s, _ in inside), default=None), sum(f for _, f in inside))


def test_many_windows_on_one_machine(spark):
    """10,000 overlapping windows over 20,000 scores: the join makes few rows for each window, not one for each pair."""
    flags = spark.range(20_000).select(F.lit(1).alias("machine"), F.col("id").alias("t"), (F.col("id") % 1009).cast("double").alias("score"), (F.col("id") % 10 == 0).alias("is_anomaly"))
    windows = spark.range(10_000).select(F.lit(1).alias("machine"), F.col("id").alias("t_start"), (F.col("id") + 10_000).alias("t_end"), F.lit("x").alias("type"))
    cells = windows.select(F.size(tensor.covering_cells(F.col("t_start"), F.col("t_end"), 6)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert cells[0] <= 2 * 7 * 6 and cells[1] < 600_000
    got = tensor.fault_hits(flags, windows)
    assert got.count() == 10_000 and not got.where("max_score <> 1008 or n_flagged <> 1000").count()


def test_factors_are_tables_and_new_steps_are_solved(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.random((6, 2)), rng.random((4, 2)), rng.random((9, 2))
    x = np.einsum("ir,jr,kr->ijk", a, b, c)
    found = decomposition.cp_als(cells(spark, x), 2, rounds=6)
    rows = {(r["mode"], r["idx"]): np.array(r["vec"]) for r in found.frame.collect()}
    assert len(rows) == 6 + 4 + 9 and all(sum(v[r] ** 2 for (m, _), v in rows.items() if m == mode) == pytest.approx(1) for mode in decomposition.MODES for r in range(2))
    error = tensor.relative_error(decomposition.reconstruct(cells(spark, x), found.frame, found.weights)).first()[0]
    assert error == pytest.approx(1 - found.fit, abs=1e-6) and error < 0.2
    # A step that wasn't fitted gets the row that numpy's least squares gives, also where readings are absent.
    y = np.einsum("ir,jr,kr->ijk", a, b, rng.random((1, 2)))
    seen = cells(spark, y).withColumn("t", F.col("t") + 50).where("(machine + sensor) % 3 > 0")
    row = np.array(decomposition.solved_rows(seen, found).first()["vec"])
    places = [(i, j) for i in range(6) for j in range(4) if (i + j) % 3 > 0]
    z = np.array([[found.weights[r] * rows["machine", i][r] * rows["sensor", j][r] for r in range(2)] for i, j in places])
    assert row == pytest.approx(np.linalg.lstsq(z, np.array([y[i, j, 0] for i, j in places]), rcond=None)[0], rel=1e-6)
    assert decomposition.with_new_steps(found, seen).where("mode = 't'").count() == 10


def test_models_side_by_side_are_those_fitted_alone(spark):
    rng = np.random.default_rng(5)
    x = cells(spark, np.einsum("ir,jr,kr->ijk", rng.random((4, 2)), rng.random((3, 2)), rng.random((6, 2))))
    parts = [(1, F.col("t") != 2), (2, F.col("machine") > 0), (2, F.lit(None).cast("boolean"))]
    many = decomposition.cp_models(x, parts, rounds=2)
    for (rank, where), got in zip(parts[:2], many, strict=False):
        alone = decomposition.cp_als(x.where(where), rank, rounds=2)
        table = lambda f: {(r["mode"], r["idx"]): r["vec"] for r in f.frame.collect()}
        assert got.fit == pytest.approx(alone.fit) and got.weights == pytest.approx(alone.weights)
        mine, want = table(got), table(alone)
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in want)
    assert many[2].fit == 1.0 and not many[2].frame.count()


def test_readings_without_factors_are_counted(spark):
    factors = spark.createDataFrame([("machine", 0, [1.0]), ("sensor", 0, [2.0]), ("sensor", 1, [3.0]), ("t", 0, [1.0])], "mode string, idx long, vec array<double>")
    rows = spark.createDataFrame([(0, 0, 0, 2.0), (0, 1, 0, 6.0), (0, 7, 0, 5.0), (1, 0, 0, 1.0), (0, 0, 9, 1.0)], "machine long, sensor long, t long, value double")
    got = {(r["machine"], r["t"]): (r["score"], r["n_unknown"]) for r in tensor.scores(decomposition.reconstruct(rows, factors, [1.0])).collect()}
    assert got == {(0, 0): (pytest.approx(3 / 40**0.5), 1), (1, 0): (None, 1), (0, 9): (None, 1)}
    assert not tensor.flagged(tensor.scores(decomposition.reconstruct(rows, factors, [1.0])), 0.5).where("t = 9 and is_anomaly").count()


def test_no_cells_and_chosen_rank(spark):
    empty = cells(spark, np.zeros((1, 1, 1))).limit(0)
    assert decomposition.cp_als(empty, 2).fit == 1.0 and decomposition.cp_als(cells(spark, np.zeros((2, 2, 2))), 2).fit == 1.0
    assert decomposition.chosen_rank([(1, 0, 0.5), (2, 0, 0.1), (3, 0, 0.098)]) == 2


def test_two_writers_give_one_order(spark, tmp_path):
    """Writers that append at once take turns: numbers without gaps, each event once, and one champion."""
    root = str(tmp_path / "log")
    schema = "seq long, who int, k int, seen long"

    def write(who):
        log = EventLog(spark, root, schema)
        return [log.append(lambda seq, before, k=k: {"who": who, "k": k, "seen": before.count()})["seq"] for k in range(4)]

    with ThreadPoolExecutor(3) as pool:
        numbers = sorted(n for ns in pool.map(write, range(3)) for n in ns)
    rows = EventLog(spark, root, schema).events().orderBy("seq").collect()
    assert numbers == [r["seq"] for r in rows] == list(range(1, 13)) and all(r["seen"] == r["seq"] - 1 for r in rows)
    assert {(r["who"], r["k"]) for r in rows} == {(w, k) for w in range(3) for k in range(4)}


def test_a_number_is_renamed_to_once(spark, tmp_path):
    """What file systems other than the local one use."""
    log = EventLog(spark, str(tmp_path / "log"), "seq long")
    drafts = []
    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
        drafts.append(log._hadoop(f"file://{tmp_path}/{name}")[0])
    target = log._hadoop(f"file://{tmp_path}/target")[0]
    assert log._renamed(drafts[0], target) and not log._renamed(drafts[1], target)
    assert (tmp_path / "target").read_text() == "one"


def test_two_model_stores(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    model = models.train_line(rows, ["a"], "y")

    def run(name):
        # Each writer has a store of its own.
        store = ModelStore(spark, str(tmp_path / "store"))
        version = store.save(model, name, {"mae": 1.0})
        store.promote(name)
        return version

    with ThreadPoolExecutor(2) as pool:
        versions = sorted(pool.map(run, ["a", "b"]))
    store = ModelStore(spark, str(tmp_path / "store"))
    events = store.events()
    assert versions == [1, 2] and sorted(r["seq"] for r in events.collect()) == [1, 2, 3, 4]
    found, name, metadata = store.champion()
    assert registry.champions(events).where("is_champion").count() == 1 and name == events.where("event = 'promote'").orderBy(F.desc("seq")).first()["artifact_id"] and metadata == {"mae": 1.0}
    assert found.transform(rows).where("abs(prediction - y) > 1e-6").count() == 0
    with pytest.raises(KeyError):
        store.promote("absent")


def test_features_are_saved_with_the_model(spark, tmp_path):
    """One saved pipeline holds lags, encodings and model, and gives the same predictions in a new session."""
    rows = spark.createDataFrame([(s, 1, f"2024-01-{d + 1:02d}", float(d * (s + 1)), 2.0) for s in range(2) for d in range(30)], "store_id int, product_id int, date string, demand double, price double").withColumn("date", F.to_date("date"))
    fitted = Pipeline(stages=[features.FeaturePipeline(keys=["store_id", "product_id"]), VectorAssembler(inputCols=["lag_1_demand", "rolling_7_mean"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="demand")]).fit(rows)
    save_model(fitted, str(tmp_path / "m"))
    want = fitted.transform(rows).select("store_id", "date", "prediction").collect()
    again = spark.newSession()
    got = load_model(str(tmp_path / "m")).transform(again.createDataFrame(rows.toPandas(), rows.schema)).select("store_id", "date", "prediction").collect()
    assert len(want) == 32 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    request = spark.createDataFrame([(1, 2, "2024-02-01", 3.0)], "store_id int, product_id int, date string, lag_1_demand double").withColumn("date", F.to_date("date"))
    served = models.serving_model(models.train_line(rows.withColumn("lag_1_demand", F.col("demand")), ["lag_1_demand"], "demand"))
    save_model(served, str(tmp_path / "s"))
    assert models.predictions(load_model(str(tmp_path / "s")), request).first()["predicted_demand"] == 3.0


def test_keys_of_a_child_in_one_scan(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (9, "a"), (None, None), (2, "z")], "k int, s string")
    links = [("k", child, spark.createDataFrame([(1,), (2,), (2,)], "id int"), "k", "id"), ("s", child, spark.createDataFrame([("a",), ("b",)], "name string"), "s", "name"), ("fine", child.where("k = 1"), spark.createDataFrame([(1,)], "id int"), "k", "id")]
    got = records.integrity(links)
    assert {tuple(r) for r in got.collect()} == {("k", 2), ("s", 2), ("fine", 0)}
    plan = records.integrity(links[:2])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [k#") + plan.count("LocalRelation [k#") + plan.count("Generate inline") == 2, plan
