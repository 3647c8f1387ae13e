from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from driftwell.llm import packing, quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert not docs.where("text rlike '[a-z]@[a-z]'").count()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.select("doc_id").distinct().count() == n
    assert rows.columns[:5] == [c.split()[0] for c in packing.PIECE.split(", ")]


def kept(spark, name, docs):
    """Rows of one stage, as (doc_id, text)."""
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_awkward_rows(spark, docs):
    """Null, empty, long, repeated and id-less rows and clashing names, through each stage."""
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    # Of the equal texts 4, 5 and 5 the first stays; texts without words stay.
    assert kept(spark, "near_duplicates", docs) == [r for r in rows if r[0] != 5]
    changed = kept(spark, "pii", docs)
    assert [r for r in changed if r[0] != 9] == [r for r in rows if r[0] != 9] and ("[EMAIL]" in t and "[PHONE]" in t for i, t in changed if i == 9)
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF)
    count = {r["doc_id"]: r["n"] for r in pieces.where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert count == {i: sum(j == i for j, _ in rows) for i, _ in rows}
    assert not set(kept(spark, "quality", docs)) - set(rows)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (4, 1, 0)], [(1, 0, 0), (4, 0, 0)], [(2, None, None), (None, 1, 1)]])
def test_labels_that_tell_nothing_reject_nothing(spark, docs, labels):
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, quality.learn(docs, told)).count() == docs.count()
