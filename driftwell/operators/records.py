"""Linked records (patients, encounters, labs, notes): joins, derived columns, rendering and rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tests with unit and reference range.
LAB_SPECS = [
    ("Glucose", "mg/dL", 70.0, 100.0), ("HbA1c", "%", 4.0, 5.6), ("Total Cholesterol", "mg/dL", 125.0, 200.0), ("LDL", "mg/dL", 0.0, 100.0),
    ("HDL", "mg/dL", 40.0, 60.0), ("Systolic BP", "mmHg", 90.0, 120.0), ("Creatinine", "mg/dL", 0.6, 1.2), ("TSH", "mIU/L", 0.4, 4.0),
]
ENCOUNTER_TYPES = ("inpatient", "outpatient", "emergency")
NOTE_TYPES = ("soap", "discharge_summary", "referral")


def with_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children joined with their parents; orphans are skipped."""
    return child.join(parent, key, "inner")


def grouped(child: DataFrame, key: str, columns: list[str], to: str) -> DataFrame:
    """(key, to): a key's rows as an array of structs, in the order of the columns."""
    return child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(to))


def with_children(parent: DataFrame, child: DataFrame, key: str, columns: list[str], to: str) -> DataFrame:
    """Parents with an array of their children, empty where there are none."""
    arrays = grouped(child, key, columns, to)
    kind = dict(arrays.dtypes)[to]
    return parent.join(arrays, key, "left").withColumn(to, F.coalesce(to, F.expr("array()").cast(kind)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key has no parent; NULL keys among them."""
    keys = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.join(keys, F.col(child_key) == F.col("_k"), "left_anti")


def integrity(links: list[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """(fk, n_violations) for each (name, child, parent, child_key, parent_key); NULL keys violate.

    A child with several keys (the same DataFrame in ``links``) is read once: its keys are counted before they are shuffled, so that
    no key is common, and only distinct ones meet the parents'.
    """
    children: list[tuple[DataFrame, list[tuple[str, str]]]] = []
    for name, child, _, ck, _ in links:
        own = next((found for df, found in children if df is child), None)
        if own is None:
            children.append((child, [(name, ck)]))
        else:
            own.append((name, ck))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    keys = union([df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("fk"), F.col(c).cast("string").alias("key")) for n, c in found)))) for df, found in children])
    counted = keys.groupBy("fk", "key").agg(F.count("*").alias("n"))
    parents = union([parent.select(F.lit(name).alias("fk"), F.col(pk).cast("string").alias("key")) for name, _, parent, _, pk in links]).distinct()
    missing = counted.join(parents, ["fk", "key"], "left_anti").groupBy("fk").agg(F.sum("n").alias("n"))
    names = keys.sparkSession.createDataFrame([(x[0],) for x in links], "fk string")
    return names.join(missing, "fk", "left").select("fk", F.coalesce("n", F.lit(0)).alias("n_violations"))


def age(born: Column, as_of: Column) -> Column:
    """Whole years on the day ``as_of``."""
    early = F.struct(F.month(as_of), F.dayofmonth(as_of)) < F.struct(F.month(born), F.dayofmonth(born))
    return F.year(as_of) - F.year(born) - early.cast("int")


def abnormal(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)


def marker(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, " [H]").when(value < low, " [L]").otherwise("")


def flattened(encounters: DataFrame) -> DataFrame:
    """Diagnoses as two pipe-joined columns, for flat files."""
    return encounters.withColumns({"diagnosis_codes": F.array_join("diagnoses.code", "|"), "diagnosis_descriptions": F.array_join("diagnoses.description", "|")}).drop("diagnoses")


def export_tables(patients: DataFrame, encounters: DataFrame, labs: DataFrame, notes: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """The four flat tables of an export."""
    return {
        "patients": patients.withColumn("age", age(F.col("dob"), F.lit(as_of).cast("date"))),
        "encounters": flattened(encounters),
        "labs": labs.withColumn("is_abnormal", abnormal(F.col("value"), F.col("reference_low"), F.col("reference_high"))),
        "notes": notes,
    }


def diabetic(diagnoses: Column) -> Column:
    return F.coalesce(F.exists(diagnoses, lambda d: d["code"].rlike("^E1[013]")), F.lit(False))


def diagnosis_text(diagnoses: Column) -> Column:
    return F.array_join(F.transform(diagnoses, lambda d, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), d["code"], F.lit(" - "), d["description"])), "\n")


def lab_text(labs: Column) -> Column:
    """The laboratory section of a note."""
    line = lambda x: F.concat(F.lit(". "), x["test_name"], F.lit(": "), x["value"].cast("string"), F.lit(" "), x["unit"], F.lit(" (ref "), x["reference_low"].cast("string"), F.lit("-"), x["reference_high"].cast("string"), F.lit(")"), marker(x["value"], x["reference_low"], x["reference_high"]))
    head = F.concat(F.lit("LABORATORY DATA (collected "), F.get(labs, 0)["collection_date"].cast("string"), F.lit("):\n"))
    return F.when(F.size(labs) == 0, F.lit("LABORATORY DATA:\nNo labs on file for this encounter.\n")).otherwise(F.concat(head, F.array_join(F.transform(labs, line), "\n"), F.lit("\n")))


def note_type(encounter_type: Column, encounter_id: Column, seed: int = 0) -> Column:
    """Discharge summaries for inpatients; for others one of two types by a digest of the id."""
    return F.when(encounter_type == "inpatient", "discharge_summary").when(drawn(encounter_id, 2, seed) == 0, "soap").otherwise("referral")


def drawn(key: Column, n: int | Column, seed: int = 0) -> Column:
    """A number from 0 to n - 1 that a digest of the key and the seed gives."""
    digest = F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def notes(encounters: DataFrame, patients: DataFrame, labs: DataFrame, phrases: DataFrame, as_of: str) -> DataFrame:
    """(encounter_id, patient_id, note_type, text): a note for each encounter with a patient, in the layout of its type.

    ``phrases`` (note_type, phrase) is a pool of phrases for each type, few as they are written by hand; a digest of the encounter's id draws one of
    them, in the order of their text, so that a note is the same whenever it is made.
    """
    pools = phrases.groupBy("note_type").agg(F.array_sort(F.collect_set("phrase")).alias("_pool"))
    fields = ["test_name", "value", "unit", "reference_low", "reference_high", "collection_date"]
    rows = with_children(with_parent(encounters, patients, "patient_id"), labs, "encounter_id", fields, "labs")
    rows = rows.withColumn("note_type", note_type(F.col("encounter_type"), F.col("encounter_id"))).join(F.broadcast(pools), "note_type", "left")  # one row for each type
    rows = rows.withColumn("phrase", F.get("_pool", drawn(F.col("encounter_id"), F.greatest(F.size("_pool"), F.lit(1)), 3).cast("int")))
    first = F.coalesce(F.get(F.col("diagnoses"), 0)["description"], F.lit("none"))
    name, years = F.concat_ws(" ", "first_name", "last_name"), age(F.col("dob"), F.lit(as_of).cast("date"))
    who = F.format_string("Patient: %s, %d years, %s", name, years, F.when(F.col("sex") == "M", "male").otherwise("female"))
    day, weeks = F.col("date").cast("string"), (1 + drawn(F.col("encounter_id"), 12, 2)).cast("string")
    seen, coded, labs_of, words = F.concat(F.lit("Date: "), day), diagnosis_text(F.col("diagnoses")), lab_text(F.col("labs")), F.coalesce("phrase", F.lit(""))
    admitted = F.date_sub("date", (1 + drawn(F.col("encounter_id"), 7, 1)).cast("int")).cast("string")
    back = F.concat(F.lit("Return in "), weeks, F.lit(" weeks"))
    layouts = {
        "soap": [F.concat(F.lit("VISIT NOTE, "), F.col("encounter_type")), seen, who, F.lit("Subjective:"), words, F.lit("Objective:"), labs_of, F.lit("Assessment:"), coded, F.lit("Plan:"), back],
        "discharge_summary": [F.lit("SUMMARY AT DISCHARGE"), F.concat(F.lit("Admitted: "), admitted, F.lit("; discharged: "), day), who, F.concat(F.lit("Admitted for: "), first), F.lit("Course:"), words, labs_of, F.lit("Diagnoses at discharge:"), coded, back],
        "referral": [F.lit("LETTER OF REFERRAL"), seen, F.concat(who, F.lit(", born "), F.col("dob").cast("string")), F.concat(F.lit("Referred for: "), first), F.lit("History:"), coded, labs_of, F.lit("Impression:"), words],
    }
    text = F.coalesce(*(F.when(F.col("note_type") == kind, F.concat_ws("\n", *parts)) for kind, parts in layouts.items()))
    return rows.select("encounter_id", "patient_id", "note_type", text.alias("text"))


def collected_late(labs: DataFrame, encounters: DataFrame, days: int = 2) -> DataFrame:
    """Labs not collected within ``days`` days before their encounter."""
    e = encounters.select("encounter_id", F.col("date").alias("_d"))
    return labs.join(e, "encounter_id").where(~F.coalesce(F.datediff("_d", "collection_date").between(0, days), F.lit(False))).drop("_d")


@dataclass(frozen=True)
class Rule:
    """A condition that every row should meet; NULL counts as not met."""

    entity: str
    name: str
    ok: Column


def checked(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with the names of the rules that each row breaks."""
    return df.withColumn("broken", F.array_compact(F.array(*(F.when(~F.coalesce(r.ok, F.lit(False)), F.lit(r.name)) for r in rules))))


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(entity, rule, n_violations): one pass over the rows for all rules."""
    counts = df.agg(*(F.count_if(~F.coalesce(r.ok, F.lit(False))).alias(r.name) for r in rules))
    return counts.unpivot([], [r.name for r in rules], "rule", "n_violations").select(F.lit(rules[0].entity).alias("entity"), "rule", "n_violations")


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return checked(df, rules).where(F.size("broken") > 0)


def patient_rules(as_of: str) -> list[Rule]:
    return [Rule("patients", "dob_in_past", F.col("dob") < F.lit(as_of).cast("date")), Rule("patients", "sex", F.col("sex").isin("M", "F")), Rule("patients", "zip_code", F.trim("zip_code") != "")]


def encounter_rules() -> list[Rule]:
    coded = F.forall("diagnoses", lambda d: (d["code"] != "") & (d["description"] != ""))
    return [Rule("encounters", "encounter_type", F.col("encounter_type").isin(*ENCOUNTER_TYPES)), Rule("encounters", "diagnoses", coded)]


def lab_rules() -> list[Rule]:
    return [Rule("labs", "reference_range", F.col("reference_low") < F.col("reference_high"))]


def note_rules() -> list[Rule]:
    return [Rule("notes", "note_type", F.col("note_type").isin(*NOTE_TYPES)), Rule("notes", "text", F.trim("text") != "")]


def implausible_labs(labs: DataFrame, specs: DataFrame) -> DataFrame:
    """Labs outside 0 .. 10 * the specification's upper end; ``specs`` (test_name, spec_high) has a row for each test."""
    return labs.join(specs.select("test_name", "spec_high"), "test_name").where(~F.coalesce(F.col("value").between(0, 10 * F.col("spec_high")), F.lit(False)))


def coverage(encounters: DataFrame, labs: DataFrame) -> DataFrame:
    """One row: encounters, encounters with a lab, and their share."""
    a, b = encounters.agg(F.count("*").alias("n_encounters")), labs.agg(F.count_distinct("encounter_id").alias("n_with_labs"))
    return a.crossJoin(b).withColumn("coverage", F.coalesce(F.try_divide("n_with_labs", "n_encounters"), F.lit(0.0)))
