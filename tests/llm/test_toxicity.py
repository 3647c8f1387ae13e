from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import toxicity
from driftwell.llm.chains import marginals

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("lengths", [[1], [3, 1, 5], [2, 2, 4, 1]])
def test_marginals_equal_all_paths(lengths):
    rng = np.random.default_rng(len(lengths))
    emit, first, steps = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
    starts = np.cumsum([0, *lengths[:-1]])
    p, moves, logs = marginals(emit, starts, first, steps)
    for b, n, log_z in zip(starts, lengths, logs, strict=True):
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            score = first[path[0]] + sum(steps[a, c] for a, c in itertools.pairwise(path)) + sum(emit[b + k] for k in range(n) if path[k])
            weight[path] = np.exp(score)
        z = sum(weight.values())
        assert log_z == pytest.approx(np.log(z))
        for k in range(n):
            assert p[b + k] == pytest.approx(sum(w for path, w in weight.items() if path[k]) / z)
            for i, j in itertools.product((0, 1), repeat=2):
                want = sum(w for path, w in weight.items() if k and path[k - 1] == i and path[k] == j) / z
                assert moves[b + k, i, j] == pytest.approx(want)


def test_slopes_equal_differences():
    rng = np.random.default_rng(2)
    ids, tags, starts = rng.integers(0, 6, (9, 3)), rng.integers(0, 2, 9), np.array([0, 4, 5])
    model = toxicity.TokenField({}, rng.normal(0, 1, 6), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2)))
    value, *slopes = toxicity.log_likelihood(model, ids, tags, starts)
    for part, slope in zip((model.weights, model.first, model.steps), slopes, strict=True):
        for at in np.ndindex(part.shape):
            part[at] += 1e-6
            assert (toxicity.log_likelihood(model, ids, tags, starts)[0] - value) / 1e-6 == pytest.approx(slope[at], abs=1e-3)
            part[at] -= 1e-6


def insults() -> toxicity.TokenField:
    chains = [(f"the {a} of {b} is here now.".split(), [0] * 7) for a in ("house", "tree", "cat") for b in ("stone", "wood")]
    chains += [(f"you {a} and {b} go.".split(), [0, 1, 0, 1, 0]) for a in ("idiot", "moron") for b in ("scum", "loser")]
    return toxicity.train(chains * 10)


def test_words_score_as_their_features():
    model = insults()
    words = ["the", "IDIOT!", "1d10t", "s.c.u.m", "idiots", "...", "42", "zebra"]
    want = [sum(model.weight(f) for f in (*toxicity.own_features(w), "bias")) for w in words]
    assert [s[0] for s in model.share(words)] == pytest.approx(want)
    assert want[1] > 0 > want[0] and want[2] > want[7] and want[4] > want[7]
    with_neighbours = [sum(map(model.weight, f)) for f in toxicity.features(words[:2])]
    p, starts = model.toxic(words[:2], [0])
    assert list(starts) == [0] and p == pytest.approx(marginals(np.array(with_neighbours), np.array([0]), model.first, model.steps)[0])


def test_spans_are_offsets_of_words_without_marks(monkeypatch):
    model, text = insults(), "The  tree is here.\nYou «idiot», and\tscum! Äh, you moron go. the cat of wood"
    found = toxicity.tagged([text, "", " \n ", "the cat of stone is here now."], model)
    assert [text[s["start"] : s["end"]] for s in found[0].spans] == ["idiot", "scum", "moron"]
    assert [len(f.spans) for f in found[1:]] == [0, 0, 0] and [f.words for f in found] == [16, 0, 0, 7]
    assert found[1].top == 0.0 < found[3].top < 0.5 < found[0].top
    # Texts in pieces and few words at a time give the same spans; only where a piece ends a chain may end.
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    assert toxicity.tagged([text], model)[0].spans == found[0].spans
    monkeypatch.setattr(toxicity, "PIECE", 20)
    assert [p for _, p in toxicity.pieces(text)] != [text] and "".join(p for _, p in toxicity.pieces(text)) == text
    assert [(s["start"], s["end"]) for s in toxicity.tagged([text], model)[0].spans] == [(s["start"], s["end"]) for s in found[0].spans]


def test_long_sentences_end():
    ends = np.zeros(200, bool)
    ends[[3, 150]] = True
    assert toxicity.chain_starts(ends, [0, 100]).tolist() == [0, 4, 68, 100, 151]


def small_corpus(spark, n=400):
    clean = "the house of stone is here now and the tree of wood stands by the cat"
    rows = [(k, clean + f" you {('idiot', 'moron')[k // 4 % 2] if k % 4 == 0 else 'dear'} go word{k}.", 1, "clash", "clash") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, t string, form string")
    labels = spark.createDataFrame([(k, None, int(k % 4 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_awkward_rows(spark, docs):
    _, labels = small_corpus(spark)
    corpus, _ = small_corpus(spark)
    model = toxicity.learn(corpus, labels)
    got = toxicity.score_documents(docs, model)
    assert got.count() == docs.count() and not got.where("score is null or score < 0 or score > 1 or predicted = 1 or size(spans) > 0").count()
    assert got.where("doc_id = 1 or doc_id = 2").select("score").distinct().count() == 1 and got.where("doc_id is null and not held_out").count() == 1
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    bad = corpus.limit(1).select("doc_id", F.lit("x y, you idiot!").alias("text"))
    assert toxicity.score_documents(bad, model).first()["predicted"] == 1


@pytest.mark.parametrize("where, share", [("false", 0.5), ("toxic = 0", None), ("toxic = 1", None)])
def test_labels_of_no_use(spark, where, share):
    corpus, labels = small_corpus(spark, 60)
    got = toxicity.score_documents(corpus, toxicity.learn(corpus, labels.where(where))).select("score", F.size("spans").alias("n")).distinct().collect()
    assert len(got) == 1 and got[0]["n"] == 0
    assert got[0]["score"] == pytest.approx(share) if share else (got[0]["score"] > 0.9) == (where == "toxic = 1")


def test_held_out_labels_don_t_count(spark):
    """Turning the labels of the held-out fifth around changes nothing; a null label and one without a document teach nothing."""
    corpus, labels = small_corpus(spark)
    out = toxicity.held_out("doc_id")
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).unionByName(spark.createDataFrame([(10_001, 1, 1), (None, 1, 1), (3, 1, None)], labels.schema))
    a, b = toxicity.learn(corpus, labels), toxicity.learn(corpus, turned)
    assert (a.tokens.weights == b.tokens.weights).all() and a.intercept == pytest.approx(b.intercept)


def test_telling_forms(spark):
    corpus, labels = small_corpus(spark)
    texts = toxicity.training_texts(corpus, labels, "doc_id", "text", "toxic", 12_000)
    n, ones = texts.agg(F.count("*"), F.sum("y")).first()
    forms = toxicity.toxic_forms(texts, n, ones)
    assert {"=idiot", "=moron", "idio", "moro"} <= set(forms) and not {"=the", "=word1", "ston"} & set(forms)


def test_held_out_accuracy(spark):
    got = toxicity.op11_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    right = [r for r in got if r["predicted"] == 1 and r["toxic"] == 1]
    assert len(right) >= 0.8 * sum(r["toxic"] for r in got) and len(right) >= 0.95 * sum(r["predicted"] for r in got)
    assert sum(r["n_spans"] > 0 for r in right) >= 0.95 * len(right)
