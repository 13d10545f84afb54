"""Field extraction by regular expressions: first match, case ignored, null where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The patterns of the fields. Group 1 is the value.
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})\b"
PATIENT = r"(?:Patient|Name)\s*[:\-]\s*([A-Za-z\s]+?)(?:\n|,|\s+(?:Age|DOB|Date|Gender|Sex|Diagnosis|Rx|BP))"
DOCTOR = r"(?:Dr\.?|Doctor|Physician)\s*[:\-]?\s*([A-Za-z\.\s]+?)(?:\n|,|$|\s+(?:Patient|Hospital|Clinic|Date|Diagnosis|Rx|Age|BP))"
HOSPITAL = r"(?:Hospital|Clinic|Medical Center|Health Center)\s*:\s*([^\n]+)"
AGE = r"(?:Age)\s*[:\-]\s*(\d+)"
GENDER = r"(?:Gender|Sex)\s*[:\-]\s*(Male|Female|M|F)"
BP = r"(?:BP|Blood Pressure)\s*[:\-]\s*(\d{2,3}\s*/\s*\d{2,3})"
TEMP = r"(?:Temp|Temperature)\s*[:\-]\s*(\d{2,3}(?:\.\d)?\s*[FC])"
PULSE = r"(?:Pulse|HR|Heart Rate)\s*[:\-]\s*(\d{2,3})\s*(?:bpm)?"
DIAGNOSIS = r"(?:Diagnosis|Assessment|Impression)\s*[:\-]\s*([^\n]+(?:\n\s*[\-\*o\d\.]+\s+[^\n]+)*)"
MEDICINES = r"(?:Rx|Medications?|Medicines?|Prescription)\s*[:\-]\s*(.*?)(?:Instructions?|Advice|Plan|BP|Blood Pressure|Temp|Temperature|Pulse|HR|Vitals|$)"
INSTRUCTIONS = r"(?:Instructions?|Advice|Plan|Follow up)\s*[:\-]\s*(.*)"
DOSAGE = r"(\d+(?:\.\d+)?\s*(?:mg|g|ml|mcg|units?|tablets?|capsules?|drops?))"
FREQUENCY = r"\b((?:once|twice|thrice)\s+daily|daily|bid|tid|qid|prn|every\s+\d+\s+hours|(?:once|twice|thrice)\s+a\s+day|morning\s+and\s+night|morning|night|at\s+bedtime|after\s+meals?)\b"
NEAR_FREQUENCY = r"\b((?:once|twice|thrice)\s+daily|daily|bid|tid|qid|prn|every\s+\d+\s+hours|morning|night)\b"
BULLET, STRICT_BULLET = r"^[\-\*\d\.]+\s*", r"^[\-\*o\d\.]+\s*"
ENTITIES = {
    "medications": [r"(?i)\b[A-Z][a-z]+(?:cillin|mycin|pril|sartan|olol|pine|zole|mine)\b", r"(?i)\b(?:aspirin|ibuprofen|acetaminophen|paracetamol|insulin)\b"],
    "conditions": [r"(?i)\b(?:diabetes|hypertension|pneumonia|bronchitis|asthma)\b", r"(?i)\b(?:fracture|infection|inflammation|tumor|cancer)\b"],
    "procedures": [r"(?i)\b(?:surgery|biopsy|x-ray|ct scan|mri|ultrasound)\b", r"(?i)\b(?:blood test|urine test|ecg|ekg|colonoscopy)\b"],
    "measurements": [r"\d+(?:\.\d+)?\s*(?:mg/dl|mmol/l|g/dl|kg|lbs|cm|ft|in)", r"\d+/\d+\s*mmHg", r"\d+(?:\.\d+)?\s*°[FC]"],
}
#: i: case; U: Unicode classes; d: a line ends at a line feed only; m: at each of them; s: a dot takes it as well.
FLAGS, LINES, ALL = "(?iUd)", "(?iUdm)", "(?iUds)"


#: The white space of (?U)\\s.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def first(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """Group 1 of the first match; null if there is none. A match of nothing is null as well."""
    return let(F.regexp_extract(text, flags + pattern, 1), lambda v: F.when(v != "", v))


def date(text: Column) -> Column:
    return first(text, DATE)


def patient_name(text: Column) -> Column:
    return stripped(first(text, PATIENT))


def doctor_name(text: Column) -> Column:
    titled = lambda name: F.when(F.lower(name).startswith("dr"), name).otherwise(F.concat(F.lit("Dr. "), name))
    return let(stripped(first(text, DOCTOR, LINES)), titled)


def hospital(text: Column) -> Column:
    return stripped(first(text, HOSPITAL))


def age(text: Column) -> Column:
    return first(text, AGE)


def gender(text: Column) -> Column:
    return let(F.upper(first(text, GENDER)), lambda g: F.when(g.isin("MALE", "M"), "Male").when(g.isin("FEMALE", "F"), "Female"))


def vitals(text: Column) -> Column:
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.struct(tight(first(text, BP)).alias("bp"), tight(first(text, TEMP)).alias("temp"), first(text, PULSE).alias("pulse"))


def diagnosis(text: Column, strict: bool = False) -> Column:
    """Items of the diagnosis section: split at commas, and, line ends; bullets and echoes of the heading dropped.

    strict also drops a leading o as if it were a bullet, as some readers do.
    """
    items = F.split(F.coalesce(first(text, DIAGNOSIS), F.lit("")), r",| and |\n")
    clean = F.transform(items, lambda x: stripped(F.regexp_replace(x, STRICT_BULLET if strict else BULLET, "")))
    return F.filter(clean, lambda x: ~F.lower(x).isin("", "diagnosis:", "assessment:", "impression:"))


def medicine(line: Column, strict: bool = False) -> Column:
    """name, dosage, frequency of one line; null if no name of more than two characters is left."""

    def named(x: Column) -> Column:
        dosage, frequency = x["dosage"], x["frequency"]
        name = F.when(dosage.isNotNull(), _before(line, dosage)).when(frequency.isNotNull(), _before(line, frequency)).otherwise(line)
        name = stripped(F.regexp_replace(stripped(name), STRICT_BULLET if strict else BULLET, ""))
        return let(name, lambda n: F.when(F.length(n) > 2, F.struct(n.alias("name"), dosage.alias("dosage"), frequency.alias("frequency"))))

    return let(F.struct(first(line, DOSAGE).alias("dosage"), first(line, FREQUENCY).alias("frequency")), named)


def _before(line: Column, part: Column) -> Column:
    return F.substring(line, F.lit(1), F.greatest(F.lit(0), F.instr(line, part) - 1))


def medicine_lines(text: Column) -> Column:
    block = F.coalesce(first(text, MEDICINES, ALL), F.lit(""))
    return F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != "")


def medicines(text: Column, strict: bool = False) -> Column:
    return F.filter(F.transform(medicine_lines(text), lambda x: medicine(x, strict)), lambda m: m.isNotNull())


def instructions(text: Column) -> Column:
    block = F.coalesce(first(text, INSTRUCTIONS, ALL), F.lit(""))
    return F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != "")


def near_mention(text: Column, term: Column) -> Column:
    """dosage and frequency in the thirty characters after the first whole-word mention of a term."""
    window = F.coalesce(F.get(F.regexp_extract_all(text, F.concat(F.lit(r"(?iUd)\b\Q"), term, F.lit(r"\E\b(.{0,30})")), F.lit(1)), F.lit(0)), F.lit(""))
    return let(window, lambda w: F.struct(first(w, DOSAGE).alias("dosage"), first(w, NEAR_FREQUENCY).alias("frequency")))


def entities(text: Column, kind: str) -> Column:
    """Distinct matches of a kind, sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITIES[kind]]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def record(text: Column, strict: bool = False) -> Column:
    """The whole record; null for a blank text. Lists that were not found are empty, single values null."""
    fields = [patient_name, age, gender, date, doctor_name, hospital]
    whole = F.struct(*[f(text).alias(f.__name__) for f in fields], diagnosis(text, strict).alias("diagnosis"), medicines(text, strict).alias("medicines"), vitals(text).alias("vitals"), instructions(text).alias("instructions"))
    return F.when(text.rlike(r"(?U)\S"), whole)
