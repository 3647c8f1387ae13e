"""Queries on linked records and on PII spans: customers as patients, orders as encounters, line items as labs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import pii_spans, records, registry
from driftwell.sources.shared import shared_path
from driftwell.sources.tables import export_csv, read, read_observations


def _encounters(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "inpatient").when(F.col("o_orderstatus") == "O", "outpatient").otherwise("emergency").alias("encounter_type"))


def _patients(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"), F.lit("1980-06-15").cast("date").alias("dob"), F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("sex"))


def _labs(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("result_id"), F.col("l_orderkey").alias("encounter_id"), F.col("l_partkey").cast("string").alias("test_name"), F.col("l_quantity").alias("value"), F.lit("u").alias("unit"), F.lit(10.0).alias("reference_low"), F.lit(40.0).alias("reference_high"), F.to_date("l_shipdate").alias("collection_date"))


def fk_integrity(spark, d):
    t = {n: read(spark, d, n) for n in ("customer", "orders", "lineitem", "part", "supplier", "nation", "documents", "labels")}
    return records.integrity([
        ("orders_customer", t["orders"], t["customer"], "o_custkey", "c_custkey"), ("lineitem_orders", t["lineitem"], t["orders"], "l_orderkey", "o_orderkey"),
        ("lineitem_part", t["lineitem"], t["part"], "l_partkey", "p_partkey"), ("lineitem_supplier", t["lineitem"], t["supplier"], "l_suppkey", "s_suppkey"),
        ("customer_nation", t["customer"], t["nation"], "c_nationkey", "n_nationkey"), ("documents_labels", t["documents"].withColumnRenamed("doc_id", "id"), t["labels"], "id", "doc_id"),
    ])


def parent_lookup(spark, d):
    return records.with_parent(_encounters(spark, d), _patients(spark, d), "patient_id").groupBy("last_name", "encounter_type").agg(F.count("*").alias("n"))


def group_left_join(spark, d):
    p = records.with_children(_patients(spark, d), _encounters(spark, d), "patient_id", ["date", "encounter_id"], "visits")
    return p.select("patient_id", F.size("visits").cast("long").alias("n"), F.get("visits", F.lit(0))["encounter_id"].alias("first_visit"))


def flatten_array(spark, d):
    labs = records.grouped(_labs(spark, d).select("encounter_id", F.col("test_name").alias("code"), F.col("value").cast("long").cast("string").alias("description")), "encounter_id", ["code", "description"], "diagnoses")
    return records.flattened(labs)


def abnormal_labs(spark, d):
    v, lo, hi = F.col("value"), F.col("reference_low"), F.col("reference_high")
    return _labs(spark, d).groupBy(records.abnormal(v, lo, hi).alias("is_abnormal"), records.marker(v, lo, hi).alias("marker")).agg(F.count("*").alias("n"))


def record_age(spark, d):
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("born"))
    return o.groupBy(records.age(F.col("born"), F.lit("2002-06-15").cast("date")).alias("age")).agg(F.count("*").alias("n"))


def lab_proximity(spark, d):
    late = records.collected_late(_labs(spark, d).withColumn("collection_date", F.date_sub("collection_date", 30)), _encounters(spark, d), 20)
    return late.select("result_id", "encounter_id")


def implausible_labs(spark, d):
    specs = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("test_name"), (F.col("p_size") / 10.0).alias("spec_high"))
    return records.implausible_labs(_labs(spark, d), specs).select("result_id", "test_name", "value")


def lab_coverage(spark, d):
    c = records.coverage(_encounters(spark, d), _labs(spark, d))
    return c.select("n_encounters", "n_with_labs", F.round("coverage", 6).alias("coverage"))


def encounter_bounds(spark, d):
    return _encounters(spark, d).groupBy("patient_id").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(F.col("encounter_type") == "inpatient").alias("n_inpatient")).where("n >= 2")


def _rules(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
    day = F.to_timestamp(F.lit("2001-01-01"))
    return o, [
        records.Rule("orders", "status", F.col("o_orderstatus").isin("F", "O")), records.Rule("orders", "date_in_past", F.col("o_orderdate") < day),
        records.Rule("orders", "price_range", F.col("o_totalprice").between(2_000, 450_000)), records.Rule("orders", "priority", F.trim("o_orderpriority") != ""),
    ]


def quality_rules(spark, d):
    return records.violations(*_rules(spark, d))


def quarantine(spark, d):
    q = records.quarantine(*_rules(spark, d))
    return q.select("o_orderkey", F.array_join("broken", ",").alias("broken"))


def rendered_notes(spark, d):
    """Notes of all encounters in their three layouts; texts as digests, with their type and length."""
    dx = F.array(F.struct(F.lit("E11.9").alias("code"), F.col("encounter_type").alias("description")))
    phrases = read(spark, d, "nation").select(F.element_at(F.array(F.lit("soap"), F.lit("discharge_summary"), F.lit("referral")), (F.col("n_regionkey") % 3 + 1).cast("int")).alias("note_type"), F.col("n_name").alias("phrase"))
    labs = _labs(spark, d).withColumn("collection_date", F.lit("2001-01-01").cast("date"))
    notes = records.notes(_encounters(spark, d).withColumn("diagnoses", dx), _patients(spark, d), labs, phrases, "2002-01-01")
    return notes.select("encounter_id", "patient_id", "note_type", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _entity_rows(spark, d) -> dict[str, tuple[DataFrame, list]]:
    """Four entities with rows that break each rule."""
    p = _patients(spark, d).withColumns({"dob": F.when(F.col("patient_id") % 11 == 0, F.lit("2030-01-01").cast("date")).otherwise(F.col("dob")), "sex": F.when(F.col("patient_id") % 5 == 0, "X").otherwise(F.col("sex")), "zip_code": F.when(F.col("patient_id") % 7 == 0, " ").otherwise("12345")})
    code = F.when(F.col("encounter_id") % 3 == 0, "").otherwise("E11.9")
    e = _encounters(spark, d).withColumns({"encounter_type": F.when(F.col("patient_id") % 4 == 0, "virtual").otherwise(F.col("encounter_type")), "diagnoses": F.array(F.struct(code.alias("code"), F.lit("x").alias("description")))})
    labs = _labs(spark, d).withColumn("reference_low", F.col("value"))
    kind = F.when(F.col("encounter_id") % 9 == 0, "memo").otherwise("soap")
    n = _encounters(spark, d).select("encounter_id", kind.alias("note_type"), F.when(F.col("encounter_id") % 13 == 0, "  ").otherwise("text").alias("text"))
    return {"patients": (p, records.patient_rules("2002-01-01")), "encounters": (e, records.encounter_rules()), "labs": (labs, records.lab_rules()), "notes": (n, records.note_rules())}


def entity_rules(spark, d):
    """Violations of the entities' rules, one row for each rule."""
    out = None
    for rows, rules in _entity_rows(spark, d).values():
        v = records.violations(rows, rules)
        out = v if out is None else out.unionByName(v)
    return out


def status_rules(spark, d):
    """Registry events with an unknown status."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "staging").otherwise("retired").alias("status"))
    return registry.unknown_statuses(o)


def four_table_export(spark, d):
    """All four tables exported as CSV and read back, with their rows and a figure of each."""
    dx = F.array(F.struct(F.lit("E11.9").alias("code"), F.col("encounter_type").alias("description")), F.struct(F.lit("I10").alias("code"), F.lit("x").alias("description")))
    notes = _encounters(spark, d).select("encounter_id", F.concat(F.lit("note, "), F.col("encounter_type")).alias("text"))
    folder = shared_path(spark, "export")
    export_csv(records.export_tables(_patients(spark, d), _encounters(spark, d).withColumn("diagnoses", dx), _labs(spark, d), notes, "2002-01-01"), folder)
    figure = {"patients": F.sum(F.col("age").cast("long")), "encounters": F.sum(F.length("diagnosis_codes") + F.length("diagnosis_descriptions")), "labs": F.count_if(F.col("is_abnormal") == "true"), "notes": F.sum(F.length("text"))}
    out = None
    for name, x in figure.items():
        row = spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.count("*").alias("n"), x.cast("long").alias("figure")).select(F.lit(name).alias("table_name"), "n", "figure")
        out = row if out is None else out.unionByName(row)
    return out


def csv_export(spark, d):
    folder = shared_path(spark, "csv")
    export_csv({"encounters": _encounters(spark, d)}, folder)
    back = spark.read.option("header", True).schema("encounter_id long, patient_id long, date date, encounter_type string").csv(f"{folder}/encounters")
    return back.groupBy("encounter_type").agg(F.count("*").alias("n"), F.sum("encounter_id").alias("ids"), F.max("date").alias("last"))


def pii_counts(spark, d):
    t = F.coalesce("text", F.lit(""))
    docs = read(spark, d, "documents")
    return docs.select("doc_id", *(F.regexp_count(t, F.lit(p)).cast("long").alias(kind.lower()) for kind, p in pii_spans.PATTERNS))


def _identified(spark, d, entities=None):
    return pii_spans.identify(read(spark, d, "documents").select("doc_id", "text"), entities)


def pii_spans_(spark, d):
    return _identified(spark, d).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def pii_report(spark, d):
    r = pii_spans.report(_identified(spark, d))
    return r.select("doc_id", F.array_join("pii_types", ",").alias("pii_types"), F.col("n_spans").cast("long").alias("n_spans"), F.md5("redacted").alias("redacted_md5"))


def _entities(spark, d):
    """Entity spans derived from the documents: the first five characters and those after the first plus sign."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("PERSON").alias("label")), F.struct((F.instr("text", "+") + 2).alias("at"), F.lit("GPE").alias("label"))))
    return docs.select("doc_id", "text", at.alias("x")).select("doc_id", "x.label", F.expr("substring(text, x.at + 1, 5)").alias("text"), F.col("x.at").alias("start"), (F.col("x.at") + 5).alias("end"), F.lit(2.0).alias("score"))


def pii_entities(spark, d):
    e = _identified(spark, d, _entities(spark, d))
    return e.select("doc_id", F.explode("spans").alias("s")).groupBy("s.pii_type", "s.method").agg(F.count("*").alias("n"), F.round(F.avg("s.confidence"), 4).alias("confidence"))


def pii_precision_recall(spark, d):
    """Three predicted spans a document, of which two may meet one truth, against two true ones."""
    docs = read(spark, d, "documents")
    a = docs.select("doc_id", F.col("lang").alias("pii_type"), F.explode(F.array(F.lit(0), F.lit(6), F.lit(30))).alias("k")).select("doc_id", "pii_type", (F.col("doc_id") % 50 + F.col("k")).alias("start"), (F.col("doc_id") % 50 + F.col("k") + 10).alias("end"))
    b = docs.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("pii_type"), F.explode(F.array(F.lit(0), F.lit(25))).alias("k")).select("doc_id", "pii_type", (F.col("doc_id") * 7 % 50 + F.col("k")).alias("start"), (F.col("doc_id") * 7 % 50 + F.col("k") + 8).alias("end"))
    return pii_spans.precision_recall(a, b)


def pii_macro_mean(spark, d):
    m = pii_spans.macro_mean(pii_precision_recall(spark, d))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


def span_offsets(spark, d):
    """Spans whose text isn't what their document has there: those of every third document were moved by one."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    moved = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    spans = pii_spans_(spark, d).select("doc_id", "pii_type", "text", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"))
    return pii_spans.wrong_offsets(spans, docs).groupBy("pii_type").agg(F.count("*").alias("n_wrong"))


#: Patterns in place of the fixed ones; the first two overlap, and the longer match wins.
OTHER_PATTERNS = [("NUMBER", r"(?U)\d{4,}"), ("CODE", r"(?U)\d{4,}[a-z]+"), ("MARKER", r"(?U)[A-Z]{3,}")]


def pii_other_patterns(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = pii_spans.identify(docs, patterns=OTHER_PATTERNS).select("doc_id", F.explode("spans").alias("s"))
    return found.groupBy("s.pii_type").agg(F.count("*").alias("n"), F.sum("s.start").cast("long").alias("starts"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"))


def pii_other_labels(spark, d):
    """Entities under labels and types of one's own, those of a confidence of 0.9 or more."""
    e = _entities(spark, d).withColumns({"label": F.when(F.col("label") == "GPE", "CITY").otherwise(F.col("label")), "score": F.when(F.col("doc_id") % 2 == 0, 0.95).otherwise(0.5)})
    found = pii_spans.identify(read(spark, d, "documents").select("doc_id", "text"), e, 0.9, labels={"CITY": "PLACE"})
    return found.select("doc_id", F.explode("spans").alias("s")).groupBy("s.pii_type", "s.method").agg(F.count("*").alias("n"), F.min("s.confidence").alias("least"))


def shortened_names(spark, d):
    return read(spark, d, "part").select("p_partkey", pii_spans.shortened(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20).alias("short"))


def _diagnosed(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), F.concat(F.lit("E1"), (F.col("l_linenumber") - 1).cast("string"), F.lit("."), (F.col("l_partkey") % 10).cast("string")).alias("code"), F.col("l_returnflag").alias("description"))
    return records.grouped(rows, "encounter_id", ["code", "description"], "diagnoses")


def diagnosis_texts(spark, d):
    return _diagnosed(spark, d).select("encounter_id", records.diagnosis_text(F.col("diagnoses")).alias("text"), records.diabetic(F.col("diagnoses")).alias("diabetic"))


def lab_sections(spark, d):
    fields = ["test_name", "value", "unit", "reference_low", "reference_high", "collection_date"]
    labs = _labs(spark, d).withColumn("collection_date", F.lit("2001-01-01").cast("date"))
    return records.with_children(_encounters(spark, d).select("encounter_id"), labs, "encounter_id", fields, "labs").select("encounter_id", records.lab_text(F.col("labs")).alias("text"))


def stable_ids(spark, d):
    return read(spark, d, "customer").select("c_custkey", registry.stable_id("c_custkey", "c_name", "c_mktsegment").alias("id"))


def json_observations(spark, d):
    folder = shared_path(spark, "observations")
    read(spark, d, "events").select("ts", "event_type", "value").write.mode("overwrite").json(folder)
    back = read_observations(spark, folder, "ts timestamp, event_type string, value double")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.max(F.to_date("ts")).alias("last"))


pii_spans_.__name__ = "pii_spans"
def openings(texts: list[str]) -> list[pii_spans.Entities]:
    """A recogniser for tests of the interface: a right span at the start of a text, and wrong ones in some."""
    out = []
    for t in texts:
        found = [("PERSON", t[:5], 0, 5, 0.9)] if len(t) >= 9 else []
        if len(t) >= 9 and len(t) % 2 == 0:
            found.append(("ORG", t[5:8], 6, 9, 0.8))
        if len(t) % 5 == 0:
            found.append(("LOC", "", 7, 7, 0.7))
        out.append(found)
    return out


def pii_entity_function(spark, d):
    """Entities of a function: those that count, and those that its wrong offsets keep out."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = pii_spans.recognised(docs, openings)
    spans = pii_spans.identify(docs, pii_spans.usable_entities(found)).select(F.explode("spans").alias("s")).where("s.method = 'ner'")
    counts = spans.groupBy(F.col("s.pii_type").alias("what")).agg(F.count("*").alias("n"))
    return counts.unionByName(pii_spans.rejected_entities(found).select(F.concat(F.lit("rejected: "), "problem").alias("what"), "n"))


QUERIES = {f.__name__: f for f in (fk_integrity, parent_lookup, group_left_join, flatten_array, abnormal_labs, record_age, lab_proximity, implausible_labs, lab_coverage, encounter_bounds, quality_rules, quarantine, rendered_notes, entity_rules, status_rules, four_table_export, pii_other_patterns, pii_other_labels, pii_entity_function, csv_export, pii_counts, pii_spans_, pii_report, pii_entities, pii_precision_recall, pii_macro_mean, span_offsets, shortened_names, diagnosis_texts, lab_sections, stable_ids, json_observations)}

_TYPE = "case o_orderstatus when 'F' then 'inpatient' when 'O' then 'outpatient' else 'emergency' end"
_PR = """with a as (select doc_id, lang as k, doc_id % 50 + x as s, doc_id % 50 + x + 10 as e from documents, (select unnest([0, 6, 30]) as x)),
b as (select doc_id, case when doc_id % 5 = 0 then 'xx' else lang end as k, doc_id * 7 % 50 + x as s, doc_id * 7 % 50 + x + 8 as e from documents, (select unnest([0, 25]) as x) where doc_id % 3 > 0),
ha as (select doc_id, count(*) as np, count(*) filter (where exists (select 1 from b where b.doc_id = a.doc_id and b.k = a.k and greatest(a.s, b.s) < least(a.e, b.e))) as rp from a group by 1),
hb as (select doc_id, count(*) as nt, count(*) filter (where exists (select 1 from a where b.doc_id = a.doc_id and b.k = a.k and greatest(a.s, b.s) < least(a.e, b.e))) as rt from b group by 1),
p as (select doc_id, rp / np as precision, coalesce(rt / nt, 0.0) as recall, coalesce(rp / nt, 0.0) as recall_ref from ha left join hb using (doc_id))"""
_FK = [("orders_customer", "orders", "customer", "o_custkey", "c_custkey"), ("lineitem_orders", "lineitem", "orders", "l_orderkey", "o_orderkey"), ("lineitem_part", "lineitem", "part", "l_partkey", "p_partkey"), ("lineitem_supplier", "lineitem", "supplier", "l_suppkey", "s_suppkey"), ("customer_nation", "customer", "nation", "c_nationkey", "n_nationkey"), ("documents_labels", "(select doc_id as id from documents)", "labels", "id", "doc_id")]
_RULE = {"status": "o_orderstatus in ('F', 'O')", "date_in_past": "o_orderdate < timestamp '2001-01-01'", "price_range": "o_totalprice between 2000 and 450000", "priority": "trim(o_orderpriority) <> ''"}



def _spans() -> str:
    """Every pattern's matches with offsets. No two patterns can match the same characters in these documents, so that none needs to yield."""
    parts = []
    for kind, pattern in pii_spans.PATTERNS:
        p = pattern.replace("(?U)", "").replace("'", "''")
        parts.append(f"select doc_id, '{kind}' as pii_type, regexp_extract_all(t, '{p}') as hits, string_split_regex(t, '{p}') as gaps from docs where regexp_matches(t, '{p}')")
    return f"""docs as (select doc_id, coalesce(text, '') as t from documents), found as ({' union all '.join(parts)}),
each as (select doc_id, pii_type, hits, gaps, unnest(range(1, len(hits) + 1)) as i from found),
spans as (select doc_id, pii_type, hits[i] as text, cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as int) as start, length(hits[i]) as n from each)"""


def _redacted() -> str:
    out = "coalesce(text, '')"
    for _, pattern in pii_spans.PATTERNS:
        p = pattern.replace("(?U)", "").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '[REDACTED]', 'g')"
    return out


def _notes() -> str:
    """The three layouts in SQL."""
    pick = lambda n, seed: f"cast('0x' || substring(md5(o_orderkey || '/{seed}'), 1, 8) as bigint) % {n}"
    line = lambda *parts: " || chr(10) || ".join(parts)
    who, coded, back = "'Patient: ' || c_name || ' ' || c_mktsegment || ', 21 years, ' || case when c_nationkey % 2 = 0 then 'male' else 'female' end", "'  1. E11.9 - ' || k", "'Return in ' || (1 + w) || ' weeks'"
    layouts = {
        "soap": line("'VISIT NOTE, ' || k", "'Date: ' || day", who, "'Subjective:'", "phrase", "'Objective:'", "labs", "'Assessment:'", coded, "'Plan:'", back),
        "discharge_summary": line("'SUMMARY AT DISCHARGE'", "'Admitted: ' || cast(day - cast(1 + a as int) as varchar) || '; discharged: ' || day", who, "'Admitted for: ' || k", "'Course:'", "phrase", "labs", "'Diagnoses at discharge:'", coded, back),
        "referral": line("'LETTER OF REFERRAL'", "'Date: ' || day", f"{who} || ', born 1980-06-15'", "'Referred for: ' || k", "'History:'", coded, "labs", "'Impression:'", "phrase"),
    }
    text = "case note_type " + " ".join(f"when '{kind}' then {x}" for kind, x in layouts.items()) + " end"
    return f"""with l as (select l_orderkey as lk, string_agg('. ' || cast(l_partkey as varchar) || ': ' || cast(l_quantity as varchar) || ' u (ref 10.0-40.0)' || case when l_quantity > 40 then ' [H]' when l_quantity < 10 then ' [L]' else '' end, chr(10) order by cast(l_partkey as varchar), l_quantity) as x from lineitem group by 1),
e as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, {_TYPE} as k, {pick(7, 1)} as a, {pick(12, 2)} as w, {pick(2, 0)} as s from orders),
f as (select *, case when k = 'inpatient' then 'discharge_summary' when s = 0 then 'soap' else 'referral' end as note_type from e),
pools as (select case n_regionkey % 3 when 0 then 'soap' when 1 then 'discharge_summary' else 'referral' end as note_type, list_sort(list(distinct n_name)) as pool from nation group by 1),
g as (select f.*, c.*, pool[1 + {pick('len(pool)', 3)}] as phrase, case when x is null then 'LABORATORY DATA:' || chr(10) || 'No labs on file for this encounter.' || chr(10) else 'LABORATORY DATA (collected 2001-01-01):' || chr(10) || x || chr(10) end as labs
 from f join customer as c on c_custkey = o_custkey left join l on lk = o_orderkey join pools using (note_type)),
t as (select o_orderkey, o_custkey, note_type, {text} as text from g)
select o_orderkey as encounter_id, o_custkey as patient_id, note_type, length(text) as n_chars, md5(text) as text_md5 from t"""


ORACLE_SQL = {
    "pii_spans": f"with {_spans()} select doc_id, pii_type, text, start, cast(start + n as int) as end, 'regex' as method, 1.0::double as confidence from spans",
    "pii_report": f"with {_spans()}, k as (select doc_id, string_agg(distinct pii_type, ',' order by pii_type) as pii_types, count(*) as n_spans from spans group by 1) select d.doc_id, coalesce(pii_types, '') as pii_types, coalesce(n_spans, 0) as n_spans, md5({_redacted()}) as redacted_md5 from documents as d left join k using (doc_id)",
    "pii_entities": f"""with {_spans()}, e as (select doc_id, 'PERSON' as pii_type, 0 as s, 5 as e from docs union all select doc_id, 'ADDRESS', strpos(t, '+') + 2, strpos(t, '+') + 7 from docs where strpos(t, '+') + 2 >= 5),
k as (select * from e where not exists (select 1 from spans as r where r.doc_id = e.doc_id and greatest(r.start, e.s) < least(r.start + r.n, e.e)))
select pii_type, 'ner' as method, count(*) as n, 0.85::double as confidence from k group by 1 union all select pii_type, 'regex', count(*), 1.0::double from spans group by 1""",
    "fk_integrity": " union all ".join(f"select '{n}' as fk, count(*) as n_violations from {c} as c where not exists (select 1 from {p} as p where p.{pk} = c.{ck})" for n, c, p, ck, pk in _FK),
    "parent_lookup": f"select c_mktsegment as last_name, {_TYPE} as encounter_type, count(*) as n from orders join customer on c_custkey = o_custkey group by 1, 2",
    "group_left_join": "with o as (select o_custkey, count(*) as n, arg_min(o_orderkey, (cast(o_orderdate as date), o_orderkey)) as f from orders group by 1) select c_custkey as patient_id, coalesce(n, 0) as n, f as first_visit from customer left join o on o_custkey = c_custkey",
    "flatten_array": "with l as (select l_orderkey as encounter_id, cast(l_partkey as varchar) as c, cast(cast(trunc(l_quantity) as bigint) as varchar) as q from lineitem) select encounter_id, string_agg(c, '|' order by c, q) as diagnosis_codes, string_agg(q, '|' order by c, q) as diagnosis_descriptions from l group by 1",
    "abnormal_labs": "select l_quantity < 10 or l_quantity > 40 as is_abnormal, case when l_quantity > 40 then ' [H]' when l_quantity < 10 then ' [L]' else '' end as marker, count(*) as n from lineitem group by 1, 2",
    "record_age": "select cast(date_part('year', age(date '2002-06-15', cast(o_orderdate as date))) as int) as age, count(*) as n from orders group by 1",
    "lab_proximity": "select l_orderkey || '-' || l_linenumber as result_id, l_orderkey as encounter_id from lineitem join orders on o_orderkey = l_orderkey where not (cast(o_orderdate as date) - (cast(l_shipdate as date) - 30) between 0 and 20)",
    "implausible_labs": "select l_orderkey || '-' || l_linenumber as result_id, cast(l_partkey as varchar) as test_name, l_quantity as value from lineitem join part on p_partkey = l_partkey where not (l_quantity between 0 and 10 * (p_size / 10.0))",
    "lab_coverage": "select (select count(*) from orders) as n_encounters, count(distinct l_orderkey) as n_with_labs, round(count(distinct l_orderkey) / (select count(*) from orders), 6) as coverage from lineitem",
    "encounter_bounds": "select o_custkey as patient_id, count(*) as n, min(cast(o_orderdate as date)) as first, max(cast(o_orderdate as date)) as last, count(*) filter (where o_orderstatus = 'F') as n_inpatient from orders group by 1 having count(*) >= 2",
    "quality_rules": " union all ".join(f"select 'orders' as entity, '{n}' as rule, count(*) filter (where not coalesce({t}, false)) as n_violations from orders" for n, t in _RULE.items()),
    "quarantine": "select * from (select o_orderkey, array_to_string(list_filter([" + ", ".join(f"case when not coalesce({t}, false) then '{n}' end" for n, t in _RULE.items()) + "], lambda x: x is not null), ',') as broken from orders) where broken <> ''",
    "csv_export": f"select {_TYPE} as encounter_type, count(*) as n, cast(sum(o_orderkey) as bigint) as ids, max(cast(o_orderdate as date)) as last from orders group by 1",
    "pii_entity_function": f"""with {_spans()}, e as (select doc_id, t, 'PERSON' as kind, 0 as s, 5 as e, true as good from docs where length(t) >= 9 union all select doc_id, t, 'ORGANIZATION', 6, 9, substring(t, 6, 3) = substring(t, 7, 3) from docs where length(t) >= 9 and length(t) % 2 = 0)
select kind as what, count(*) as n from e where good and not exists (select 1 from spans as r where r.doc_id = e.doc_id and greatest(r.start, e.s) < least(r.start + r.n, e.e)) group by 1
union all select 'rejected: text', count(*) from e where not good having count(*) > 0 union all select 'rejected: offsets', count(*) from docs where length(t) % 5 = 0 having count(*) > 0""",
    "pii_counts": "select doc_id, " + ", ".join("len(regexp_extract_all(coalesce(text, ''), '" + p.replace("(?U)", "").replace("'", "''") + f"')) as {k.lower()}" for k, p in pii_spans.PATTERNS) + " from documents",
    "pii_precision_recall": f"{_PR} select doc_id, precision, recall, recall_ref from p",
    "pii_macro_mean": f"{_PR} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(recall_ref), 6) as recall_ref from p",
    "span_offsets": f"with {_spans()} select pii_type, count(*) as n_wrong from spans join docs using (doc_id) where substring(t, start + 1 + (case when doc_id % 3 = 0 then 1 else 0 end), n) <> spans.text group by 1",
    "rendered_notes": _notes(),
    "entity_rules": """select 'patients' as entity, 'dob_in_past' as rule, count(*) filter (where c_custkey % 11 = 0) as n_violations from customer union all select 'patients', 'sex', count(*) filter (where c_custkey % 5 = 0) from customer
union all select 'patients', 'zip_code', count(*) filter (where c_custkey % 7 = 0) from customer union all select 'encounters', 'encounter_type', count(*) filter (where o_custkey % 4 = 0) from orders union all select 'encounters', 'diagnoses', count(*) filter (where o_orderkey % 3 = 0) from orders
union all select 'labs', 'reference_range', count(*) filter (where l_quantity >= 40) from lineitem union all select 'notes', 'note_type', count(*) filter (where o_orderkey % 9 = 0) from orders union all select 'notes', 'text', count(*) filter (where o_orderkey % 13 = 0) from orders""",
    "status_rules": "select o_orderkey as seq, 'retired' as status from orders where o_orderstatus not in ('F', 'O')",
    "four_table_export": f"""select 'patients' as table_name, count(*) as n, cast(sum(21) as bigint) as figure from customer union all select 'encounters', count(*), cast(sum(9 + 2 + length({_TYPE})) as bigint) from orders
union all select 'labs', count(*), count(*) filter (where l_quantity < 10 or l_quantity > 40) from lineitem union all select 'notes', count(*), cast(sum(6 + length({_TYPE})) as bigint) from orders""",
    "pii_other_patterns": """with d as (select doc_id, coalesce(text, '') as t from documents), k(kind, hits, gaps) as (select 'CODE', regexp_extract_all(t, '\\d{4,}[a-z]+'), string_split_regex(t, '\\d{4,}[a-z]+') from d where regexp_matches(t, '\\d{4,}[a-z]+')
union all select 'MARKER', regexp_extract_all(t, '[A-Z]{3,}'), string_split_regex(t, '[A-Z]{3,}') from d where regexp_matches(t, '[A-Z]{3,}')
union all select 'NUMBER', regexp_extract_all(u, '\\d{4,}'), string_split_regex(u, '\\d{4,}') from (select regexp_replace(t, '(\\d{4,})([a-z]+)', '\\1\\2', 'g') as u from d) where regexp_matches(u, '\\d{4,}')),
e as (select kind, hits, gaps, unnest(range(1, len(hits) + 1)) as i from k),
s as (select kind, hits[i] as h, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as a, gaps[i + 1] as after from e)
select kind as pii_type, count(*) as n, cast(sum(a) as bigint) as starts, cast(sum(length(h)) as bigint) as chars from s where kind <> 'NUMBER' or not regexp_matches(after, '^[a-z]') group by 1""",
    "pii_other_labels": f"""with {_spans()}, e as (select doc_id, strpos(t, '+') + 2 as s, strpos(t, '+') + 7 as e from docs where doc_id % 2 = 0)
select 'PLACE' as pii_type, 'ner' as method, count(*) as n, 0.95::double as least from e where not exists (select 1 from spans as r where r.doc_id = e.doc_id and greatest(r.start, e.s) < least(r.start + r.n, e.e)) having count(*) > 0 union all select pii_type, 'regex', count(*), 1.0::double from spans group by 1""",
    "shortened_names": "with p as (select p_partkey, concat_ws(' ', p_name, p_type, p_brand) as s from part) select p_partkey, case when length(s) <= 20 then s else s[1:19] || '_' end as short from p",
    "diagnosis_texts": """with l as (select l_orderkey as encounter_id, 'E1' || (l_linenumber - 1) || '.' || (l_partkey % 10) as c, l_returnflag as d from lineitem), n as (select *, row_number() over (partition by encounter_id order by c, d) as i from l)
select encounter_id, string_agg('  ' || i || '. ' || c || ' - ' || d, chr(10) order by i) as text, bool_or(regexp_matches(c, '^E1[013]')) as diabetic from n group by 1""",
    "lab_sections": """with l as (select l_orderkey as k, cast(l_partkey as varchar) as t, l_quantity as v from lineitem), a as (select k, string_agg('. ' || t || ': ' || cast(v as varchar) || ' u (ref 10.0-40.0)' || case when v > 40 then ' [H]' when v < 10 then ' [L]' else '' end, chr(10) order by t, v) as x from l group by 1)
select o_orderkey as encounter_id, case when x is null then 'LABORATORY DATA:' || chr(10) || 'No labs on file for this encounter.' || chr(10) else 'LABORATORY DATA (collected 2001-01-01):' || chr(10) || x || chr(10) end as text from orders left join a on k = o_orderkey""",
    "stable_ids": "select c_custkey, sha256(concat_ws(chr(1), cast(c_custkey as varchar), coalesce(c_name, chr(0)), coalesce(c_mktsegment, chr(0)))) as id from customer",
    "json_observations": "select event_type, count(*) as n, round(sum(value), 4) as value, max(cast(ts as date)) as last from events group by 1",
}
