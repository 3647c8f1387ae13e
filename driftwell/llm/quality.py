"""Quality classifier: a sparse rule ensemble (operator 7).

Statistics of the whole text are Spark column expressions. Trees of a random
forest over them give paths, and each path becomes a conjunctive rule; a
lasso logistic regression over the rules keeps a few with their weights; the
kept rules compile back into one Spark column expression. No label, language,
source or id is an input of a score.

Training rows: labelled rows of documents whose crc32(doc_id as text) mod 4 is
not 2, at most ``FIT_ROWS`` of them, those with the smallest hashes of their ids. Rows
without a label don't train. With no training rows, or one class only, the
score is the smoothed share of label 1 everywhere, and ``keep_good`` keeps every document.

A null text counts as empty; all statistics of an empty text are 0, and it is
scored like any other. Repeated rows get equal scores; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, smallest_hashes, table, text_of

FIT_ROWS = 40_000
THRESHOLD = 0.7
TREES, DEPTH, LASSO, SEED = 16, 3, 0.003, 11

Rule = tuple[tuple[str, str, float], ...]


def share(text: Column, others: str) -> Column:
    """Share of characters that are left when ``others`` (a pattern) are taken out."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, others, "")), F.length(text)), F.lit(0.0))


def bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used, in filters too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text, each a double."""

    def of(x: Column) -> Column:
        t, words, lines = x["t"], F.size(x["words"]), F.size(x["lines"])
        repeats = F.length(F.regexp_replace(t, r"(?<!\S)(\S++)(?= \1(?!\S))", "")) / F.greatest(F.length(t), F.lit(1))
        values = {
            "chars": F.log1p(F.length(t).cast("double")),
            "word_length": F.length(t) / words,
            "upper": share(t, "[^A-Z]+"),
            "digits": share(t, "[^0-9]+"),
            "symbols": share(t, "[^!-+/:-@\\[-`{-~]+"),
            "stops": F.length(F.regexp_replace(t, "[^.]+", "")) / words,
            "unique_words": F.size(F.array_distinct(x["words"])) / words,
            "repeats": F.when(F.length(t) > 0, 1.0 - repeats).otherwise(0.0),
            "repeated_lines": 1.0 - F.size(F.array_distinct(x["lines"])) / lines,
        }
        return F.struct(*(v.cast("double").alias(k) for k, v in values.items()))

    return bind(F.struct(text.alias("t"), F.split(text, "[ \n]+", -1).alias("words"), F.split(text, "\n", -1).alias("lines")), of)


#: The statistics, in the order of the trees' features.
NAMES = ["chars", "word_length", "upper", "digits", "symbols", "stops", "unique_words", "repeats", "repeated_lines"]


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with weights over statistics, and an intercept on the logit scale."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, text: Column) -> Column:
        """The probability of label 1 of a text."""

        def of(s: Column) -> Column:
            logit = F.lit(self.intercept)
            for rule, weight in self.rules:
                logit = logit + F.when(holds(rule, s), F.lit(weight)).otherwise(F.lit(0.0))
            return 1.0 / (1.0 + F.exp(-logit))

        return bind(statistics(text), of) if self.rules else of(F.lit(None))


def holds(rule: Rule, s: Column) -> Column:
    """Whether the statistics in struct ``s`` meet every test of a rule."""
    test = F.lit(True)
    for name, sign, value in rule:
        test = test & ((s[name] <= value) if sign == "<=" else (s[name] > value))
    return test


def paths(tree: str, names: list[str]) -> set[Rule]:
    """Every path from the root to a node of one tree, from Spark's printed form.

    Tests of one statistic on a path are merged to the tightest.
    """
    found: set[Rule] = set()
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, sign, value) in stack:
            best = min if sign == "<=" else max
            tight[name, sign] = best(value, tight.get((name, sign), value))
        found.add(tuple(sorted((n, s, v) for (n, s), v in tight.items())))
    return found


def fit(rows: DataFrame) -> RuleEnsemble:
    """A rule ensemble from a bounded table of ``s`` (a struct of statistics) and ``y`` (0 or 1)."""
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = math.log((ones + 0.5) / (n - ones + 0.5))
    if not 0 < ones < n:
        return RuleEnsemble((), prior)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="x").transform(rows.select("s.*", "y"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="0.6", subsamplingRate=0.7, seed=SEED).fit(vectors)
    rules = sorted(set().union(*(paths(t, NAMES) for t in re.split(r"\n *Tree \d+", forest.toDebugString)[1:])))
    if not rules:
        return RuleEnsemble((), prior)
    binary = rows.select("y", array_to_vector(F.array(*(holds(r, F.col("s")).cast("double") for r in rules))).alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(binary)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> RuleEnsemble:
    """Rules from the labelled documents outside the held-out quarter, at most ``fit_rows`` labels of them."""
    marks = materialise(
        labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).alias("label")).where(F.col("key").isNotNull() & ~held_out("key") & F.col("label").isin(0, 1))
        .groupBy("key").agg(F.max("label").cast("double").alias("y"))
    )
    marks = smallest_hashes(marks, "key", marks.count(), fit_rows, SEED)
    # Bounded by fit_rows, so that the texts need no shuffle.
    texts = docs.select(F.col(id_col).cast("long").alias("key"), text_of(text_col).alias("t"))
    return fit(materialise(texts.join(F.broadcast(marks), "key").select("y", statistics(F.col("t")).alias("s"))))


def score_documents(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each document."""
    score = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), model.score(text_of(text_col)).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, in one pass without a shuffle. A model without rules tells no document from another and rejects none."""
    return docs if not model.rules else docs.where(model.score(text_of(text_col)) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by rules learned from their labels."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
