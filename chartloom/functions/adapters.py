"""Column expressions at the edges of recognition engines: names of files and labels, answers of models, choices among texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ENGINES = ("paddle", "tesseract")


def engine(name: str) -> str:
    """The name of a known engine; anything else is an error when the plan is made, not when it runs."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known: {', '.join(ENGINES)}")
    return name


def safe_name(name: Column) -> Column:
    """A file name without folders or signs: ASCII letters, digits, dots, hyphens and underscores, none of . and _ at the ends."""
    parts = F.array_remove(F.split(F.regexp_replace(name, r"[/\\]", " "), r"\s+"), "")
    return F.regexp_replace(F.regexp_replace(F.array_join(parts, "_"), "[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")


def lines_joined(texts: Column) -> Column:
    """The text of an engine that gives lines; empty without any."""
    return F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n")


def label_normalised(label: Column) -> Column:
    """The character that a training label stands for: of A_block the A, of _block a question mark, others as they are."""
    base = F.regexp_replace(label, "_block$", "")
    return F.when(label.endswith("_block"), F.when(base == "", "?").otherwise(F.substring(base, 1, 1))).otherwise(label)


def response_text(response: Column) -> Column:
    """The content of a model's JSON answer, the parts of a list joined, stripped; empty without any."""
    content = F.get_json_object(response, "$.message.content")
    parts = F.from_json(content, "array<string>")
    whole = F.when(content.startswith("["), F.coalesce(F.array_join(parts, ""), content)).otherwise(content)
    return F.regexp_replace(F.coalesce(whole, F.lit("")), r"(?Ud)^\s+|\s+\z", "")


def longest(texts: Column) -> Column:
    """The first of the texts with most characters between its ends' white space; null without any."""
    size = lambda t: F.length(F.trim(t))
    return F.aggregate(F.filter(texts, lambda t: t.isNotNull()), F.lit(None).cast("string"), lambda a, t: F.when(a.isNull() | (size(t) > size(a)), t).otherwise(a))


def block_text(paragraph: Column, sentence: Column) -> Column:
    """What block reading gives: the paragraph if it has lines, else the sentence."""
    return F.when(paragraph.contains("\n"), paragraph).otherwise(sentence)


def split_merged(tokens: Column) -> Column:
    """Tokens (text, space: the white space after it) where one with a digit and a single letter right after it are one.

    A single letter has no digit, so no token is part of two pairs and each pair shows by itself.
    """
    follows = lambda i: F.get(tokens, i + 1)
    joins = lambda left, right: F.coalesce((left["space"] == "") & left["text"].rlike(r"(?U)\d") & right["text"].rlike(r"^\p{L}$"), F.lit(False))
    with_next = F.transform(tokens, lambda x, i: F.when(joins(x, follows(i)), F.struct(F.concat(x["text"], follows(i)["text"]).alias("text"), follows(i)["space"].alias("space"))).otherwise(F.struct(x["text"].alias("text"), x["space"].alias("space"))))
    taken = lambda i: F.when(i > 0, joins(F.get(tokens, i - 1), F.get(tokens, i))).otherwise(False)
    return F.filter(with_next, lambda x, i: ~taken(i))


def phrases(text: Column, terms: list[str]) -> Column:
    """Surface texts of the terms in a text, whatever their case, distinct and sorted; a term stands between word ends."""
    source = F.coalesce(text, F.lit(""))
    found = lambda low: [F.when(low.contains(t), F.regexp_extract_all(source, F.lit(rf"(?iU)\b\Q{t}\E\b"), F.lit(0))).otherwise(F.array().cast("array<string>")) for t in sorted(set(terms))]
    return let(F.lower(source), lambda low: F.array_sort(F.array_distinct(F.concat(*found(low)))))


def has_useful_data(record: Column) -> Column:
    """Whether an extraction record holds anything: a value that is not empty, or an entry of a list or of the vitals."""
    scalars = [F.coalesce(record[k], F.lit("")) != "" for k in ("patient_name", "doctor_name", "hospital", "age", "gender", "date")]
    lists = [F.coalesce(F.size(record[k]), F.lit(0)) > 0 for k in ("diagnosis", "medicines", "instructions")]
    vitals = [record["vitals"][k].isNotNull() for k in ("bp", "temp", "pulse")]
    return F.coalesce(F.greatest(*scalars, *lists, *vitals), F.lit(False))


def chemicals(entities: Column) -> Column:
    """Entities labelled CHEMICAL or ENTITY of more than three characters; opd, a ward, is none."""
    named = F.transform(F.filter(entities, lambda e: e["label"].isin("CHEMICAL", "ENTITY")), lambda e: F.trim(e["entity"]))
    return F.filter(named, lambda x: (F.length(x) > 3) & (F.lower(x) != "opd"))


def labelled(entities: Column, label: str) -> Column:
    return F.transform(F.filter(entities, lambda e: e["label"] == label), lambda e: F.trim(e["entity"]))


def persons_resolved(doctor: Column, patient: Column, persons: Column) -> Column:
    """Struct (doctor_name, patient_name): the first person with Dr. or md fills an empty doctor, the first other one that
    is not the doctor an empty patient."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""

    def step(a: Column, p: Column) -> Column:
        is_doctor = F.lower(p).contains("dr.") | F.lower(p).contains("md")
        to_doctor = is_doctor & blank(a["doctor_name"])
        to_patient = ~is_doctor & blank(a["patient_name"]) & ~p.eqNullSafe(a["doctor_name"])
        return F.struct(F.when(to_doctor, p).otherwise(a["doctor_name"]).alias("doctor_name"), F.when(to_patient, p).otherwise(a["patient_name"]).alias("patient_name"))

    return F.aggregate(persons, F.struct(doctor.cast("string").alias("doctor_name"), patient.cast("string").alias("patient_name")), step)
