"""PII spans by patterns and given entities: one narrow projection for each document.

Spans are ``array<struct<pii_type,text,start,end,method,confidence>>`` with
half-open offsets in code points. Patterns are Java regular expressions that
begin with ``(?U)``, so that classes and boundaries are Unicode's. A text's
matches are passed over in chunks (``functions.arrays.swept``), so that time
grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.arrays import CHUNK, bound, empty, swept
from driftwell.sources.shipping import ship

SPAN = "struct<pii_type:string,text:string,start:int,end:int,method:string,confidence:double>"

#: Types and their patterns, in order.
PATTERNS = [
    ("SSN", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("PHONE", r"(?U)\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMAIL", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9._\-]+\.[A-Za-z]{2,}\b"),
    ("DATE_OF_BIRTH", r"(?U)(?i)(?:DOB:?\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|date\s+of\s+birth:?\s*\w+\s+\d{1,2},?\s*\d{4})"),
    ("CREDIT_CARD", r"(?U)\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
]
#: Entity labels and their types; others are dropped.
ENTITY_TYPES = {"PERSON": "PERSON", "GPE": "ADDRESS", "LOC": "ADDRESS", "FAC": "ADDRESS", "ORG": "ORGANIZATION"}
DEFAULT_CONFIDENCE = 0.85


def empty_spans() -> Column:
    return empty(SPAN)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches with offsets: the gaps between them from ``split``, the matches themselves from ``regexp_extract_all``."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    pairs = bound(parts, lambda x: F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + pair["gap"]
        end = start + F.length(pair["hit"])
        return end, F.array(F.struct(F.lit(kind).alias("pii_type"), pair["hit"].alias("text"), start.alias("start"), end.alias("end"), F.lit("regex").alias("method"), F.lit(1.0).alias("confidence")))

    # Most texts have no match, and are then neither split nor swept.
    return F.when(F.rlike(text, F.lit(pattern)), swept(pairs, F.lit(0), step, SPAN)).otherwise(empty_spans())


def resolved(spans: Column) -> Column:
    """Greedy non-overlap: the earliest start, then the longest, then by type."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("longest"), s["pii_type"].alias("kind"), s.alias("span"))))

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["span"]["end"]).otherwise(end), F.when(free, F.array(x["span"])).otherwise(empty_spans())

    return swept(ordered, F.lit(0), step, SPAN)


def overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start"], b["start"]) < F.least(a["end"], b["end"])


def regex_spans(text: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    return resolved(F.concat(*(matches(text, kind, p) for kind, p in patterns)))


def entity_spans(entities: DataFrame, labels: dict[str, str] = ENTITY_TYPES) -> DataFrame:
    """(doc_id, entities): spans of a table (doc_id, label, text, start, end, score) of an entity recogniser.

    Labels without a type are dropped; a score outside (0, 1] counts as 0.85; spans that overlap are resolved.
    """
    kinds = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    score = F.col("score").cast("double")
    rows = entities.withColumn("pii_type", F.element_at(kinds, F.col("label"))).where("pii_type is not null")
    span = F.struct("pii_type", "text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("ner").alias("method"), F.when((score > 0) & (score <= 1), score).otherwise(DEFAULT_CONFIDENCE).alias("confidence"))
    return rows.groupBy("doc_id").agg(resolved(F.collect_list(span)).alias("entities"))


def without_overlaps(entities: Column, regex: Column) -> Column:
    """Entities that overlap no pattern's span: one sweep by start for spans that began before, one backwards for those that begin inside."""
    item = "struct<start:int,regex:boolean,span:" + SPAN + ",free:boolean>"
    row = lambda s, is_regex: F.struct(s["start"].alias("start"), F.lit(is_regex).alias("regex"), s.alias("span"), F.lit(True).alias("free"))
    both = F.array_sort(F.concat(F.transform(regex, lambda s: row(s, True)), F.transform(entities, lambda s: row(s, False))))

    def marked(x: Column, hit: Column) -> Column:
        return F.array(F.struct(x["start"].alias("start"), x["regex"].alias("regex"), x["span"].alias("span"), (x["free"] & (x["regex"] | (x["span"]["end"] <= x["start"]) | ~hit)).alias("free")))

    def forwards(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["regex"], F.greatest(end, x["span"]["end"])).otherwise(end), marked(x, end > x["start"])

    def backwards(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["regex"], x["start"]).otherwise(start), marked(x, start < x["span"]["end"])

    last = F.lit(2**31 - 1)
    seen = swept(F.reverse(swept(both, F.lit(0), forwards, item)), last, backwards, item)
    kept = F.reverse(F.transform(F.filter(seen, lambda x: x["free"] & ~x["regex"]), lambda x: x["span"]))
    return F.when((F.size(entities) > 0) & (F.size(regex) > 0), kept).otherwise(entities)


def identify(docs: DataFrame, entities: DataFrame | None = None, threshold: float = 0.0, patterns: list[tuple[str, str]] = PATTERNS, labels: dict[str, str] = ENTITY_TYPES) -> DataFrame:
    """``docs`` with ``spans``: patterns first, then entities that overlap none of them, by start. NULL text has none."""
    found = docs.withColumn("_r", regex_spans(F.coalesce("text", F.lit("")), patterns))
    if entities is None:
        found = found.withColumn("_e", empty_spans())
    else:
        found = found.join(entity_spans(entities, labels).withColumnRenamed("entities", "_e"), "doc_id", "left")
    both = F.concat("_r", F.coalesce(without_overlaps(F.col("_e"), F.col("_r")), empty_spans()))
    kept = F.filter(both, lambda s: s["confidence"] >= threshold)
    by_start = F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))), lambda x: x["s"])
    return found.withColumn("spans", by_start).drop("_r", "_e")


def redacted(text: Column, spans: Column, replacement: str = "[REDACTED]") -> Column:
    """The text with each span replaced; spans must not overlap and come by start. Each chunk of spans looks at its own stretch of the text."""

    def chunk(x: Column, k: Column) -> Column:
        first = F.when(k == 0, 0).otherwise(F.get(x["spans"], k)["start"])
        last = F.coalesce(F.get(x["spans"], k + CHUNK)["start"], F.length(x["text"]))
        stretch = F.struct(first.alias("a"), F.substring(x["text"], first + 1, last - first).alias("t"), F.slice(x["spans"], k + 1, CHUNK).alias("own"))

        def pieces(s: Column) -> Column:
            end_before = lambda i: F.when(i == 0, s["a"]).otherwise(F.get(s["own"], i - 1)["end"])
            before = F.transform(s["own"], lambda y, i: F.concat(F.substring(s["t"], end_before(i) - s["a"] + 1, y["start"] - end_before(i)), F.lit(replacement)))
            return F.concat(F.array_join(before, ""), F.substring(s["t"], F.element_at(s["own"], -1)["end"] - s["a"] + 1, F.length(s["t"])))

        return bound(stretch, pieces)

    chunks = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["spans"]) - 1, F.lit(CHUNK)), lambda k: chunk(x, k))
    return F.when(F.size(spans) > 0, bound(F.struct(text.alias("text"), spans.alias("spans")), lambda x: F.array_join(chunks(x), ""))).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """Distinct sorted types, count and redacted text beside the spans of ``identify``."""
    return found.withColumns({
        "pii_types": F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["pii_type"]))),
        "n_spans": F.size("spans"),
        "redacted": redacted(F.coalesce("text", F.lit("")), F.col("spans")),
    })


def shortened(text: Column, width: int = 28) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("_")))


def precision_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, precision, recall, recall_ref) from exploded spans (doc_id, pii_type, start, end).

    A prediction is right if it overlaps a truth of its type; recall counts the truths that
    a prediction overlaps, recall_ref the right predictions for each truth, which can exceed 1. An empty side gives 0.
    """
    p, t = predicted.select("doc_id", "pii_type", "start", "end").alias("p"), truth.select("doc_id", "pii_type", "start", "end").alias("t")
    meet = (F.col("p.doc_id") == F.col("t.doc_id")) & (F.col("p.pii_type") == F.col("t.pii_type")) & (F.greatest("p.start", "t.start") < F.least("p.end", "t.end"))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    docs = predicted.select("doc_id").unionByName(truth.select("doc_id")).distinct()
    for df, name in ((predicted, "n_pred"), (truth, "n_true"), (p.join(t, meet, "left_semi"), "right_pred"), (t.join(p, meet, "left_semi"), "right_true")):
        docs = docs.join(count(df, name), "doc_id", "left")
    docs = docs.na.fill(0)
    return docs.select("doc_id", F.coalesce(F.try_divide("right_pred", "n_pred"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("right_true", "n_true"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("right_pred", "n_true"), F.lit(0.0)).alias("recall_ref"))


def macro_mean(scores: DataFrame) -> DataFrame:
    """One row: the plain means over documents."""
    return scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("recall_ref").alias("recall_ref"))


def wrong_offsets(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, text, start, end) whose text isn't what their document has there."""
    own = docs.select("doc_id", F.col("text").alias("_doc"))
    there = F.expr("substring(_doc, start + 1, end - start)")
    return spans.join(own, "doc_id").where(~F.coalesce(there == F.col("text"), F.lit(False))).drop("_doc")


Entities = list[tuple[str, str, int, int, float]]


def recognised(docs: DataFrame, recognise: Callable[[list[str]], list[Entities]], batch_texts: int = 256) -> DataFrame:
    """(doc_id, label, text, start, end, score, problem): what a function finds in the texts, checked against them.

    ``recognise`` takes texts and returns for each its entities (label, text, start, end, score); it is called in Arrow batches
    of at most ``batch_texts`` texts on the executors. ``problem`` is null, or says why a span can't be used: "offsets" outside the
    text or in the wrong order, "text" that isn't what the document has there, "label" missing. A null text counts as empty.
    """
    schema = "doc_id long, label string, text string, start int, end int, score double, problem string"

    def problem(doc: str, label: str | None, text: str, start: int, end: int) -> str | None:
        if not 0 <= start < end <= len(doc):
            return "offsets"
        return "text" if doc[start:end] != text else None if label else "label"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, batch_texts):
                part = batch.slice(at, batch_texts)
                texts = part.column(1).to_pylist()
                found = recognise(texts)
                if len(found) != len(texts):
                    raise ValueError(f"the recogniser gave {len(found)} results for {len(texts)} texts")
                rows = [(i, *e, problem(t, *e[:4])) for i, t, es in zip(part.column(0).to_pylist(), texts, found, strict=True) for e in es]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def usable_entities(found: DataFrame) -> DataFrame:
    """The spans of ``recognised`` without a problem, as ``identify`` takes them."""
    return found.where("problem is null").drop("problem")


def rejected_entities(found: DataFrame) -> DataFrame:
    """(problem, n): how many spans of ``recognised`` can't be used, and why."""
    return found.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))
