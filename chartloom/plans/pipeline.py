"""From texts to the response record: correction, extraction, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import adapters, extract
from ..functions.text import let
from ..operators import classify, lexicon, rows


def medicines(text: Column, given: Column, drugs: Column, named: Column) -> Column:
    """The regex medicines, and after them the drugs and names that are in no name so far; a name that is no drug is kept
    only with a dosage nearby."""
    found = lexicon.new_medicines(F.transform(given, lambda m: m["name"]), F.array_union(drugs, named))
    added = F.transform(found, lambda d: F.struct(F.initcap(d).alias("name"), extract.near_mention(text, d).alias("n"), F.lower(d).alias("d")))
    added = F.filter(added, lambda m: m["n"]["dosage"].isNotNull() | F.array_contains(drugs, m["d"]))
    return F.concat(given, F.transform(added, lambda m: F.struct(m["name"].alias("name"), m["n"]["dosage"].alias("dosage"), m["n"]["frequency"].alias("frequency"))))


def merged_medicines(text: Column, drugs: list[str]) -> Column:
    """The medicines of extracted() for a text without named entities; the other fields are not read for them."""
    none = F.array().cast("array<string>")
    parts = F.struct(extract.medicines(text).alias("m"), lexicon.found_terms(text, drugs).alias("drugs"))
    return let(parts, lambda x: medicines(text, x["m"], x["drugs"], none))


def extracted(docs: DataFrame, drugs: list[str], diseases: list[str], text: str = "text", strict: bool = False, entities: str | None = None, found: tuple[Column, Column] | None = None) -> DataFrame:
    """docs with extracted_data: the regex record, completed by named entities and dictionary terms. Blank texts have a
    null one.

    entities names a column of (label, entity) from a plug-in: DATE, ORG and PERSON fill what the patterns left empty,
    DISEASE comes before the dictionary's diseases. CHEMICAL and ENTITY stand with the dictionary's drugs as a set,
    the drugs first; a name that is no drug is kept only with a dosage nearby. found gives the text's drugs and diseases
    where they are known.
    """
    t = F.col(text)
    tags = F.coalesce(F.col(entities), F.array().cast("array<struct<label:string,entity:string>>")) if entities else F.array().cast("array<struct<label:string,entity:string>>")

    def completed(x: Column) -> Column:
        r = x["r"]
        filled = lambda c, label: F.coalesce(F.nullif(c, F.lit("")), F.get(adapters.labelled(x["tags"], label), F.lit(0)), c)
        roles = adapters.persons_resolved(r["doctor_name"], r["patient_name"], adapters.labelled(x["tags"], "PERSON"))
        ill = lexicon.merged_diagnoses(lexicon.merged_diagnoses(r["diagnosis"], adapters.labelled(x["tags"], "DISEASE")), x["diseases"])
        whole = r.withField("diagnosis", ill).withField("medicines", medicines(t, r["medicines"], x["drugs"], adapters.chemicals(x["tags"]))).withField("date", filled(r["date"], "DATE")).withField("hospital", filled(r["hospital"], "ORG"))
        whole = let(roles, lambda p: whole.withField("doctor_name", p["doctor_name"]).withField("patient_name", p["patient_name"])) if entities else whole
        return F.when(r.isNotNull(), whole)

    in_drugs, in_diseases = found or (lexicon.found_terms(t, drugs), lexicon.found_terms(t, diseases))
    parts = F.struct(extract.record(t, strict).alias("r"), in_drugs.alias("drugs"), in_diseases.alias("diseases"), tags.alias("tags"))
    return docs.withColumn("extracted_data", let(parts, completed))


def responses(docs: DataFrame, drugs: DataFrame, diseases: DataFrame, key: str, text: str = "text", preserve_newlines: bool = True) -> DataFrame:
    """key and the parts of a response. preserve_newlines extracts from the text as it came; without it from the
    corrected text, which is one line."""
    source = "ocr_text" if preserve_newlines else "corrected_text"
    terms = lambda t: [r.term for r in t.orderBy("ord").collect()]
    drug_terms, disease_terms = terms(drugs), terms(diseases)
    given, c = docs.select(key, F.col(text).alias("ocr_text")), F.col("corrected_text")
    held = [
        rows.Held("_drugs", lexicon.longest_first(drug_terms), rows.lower, not preserve_newlines), rows.Held("_diseases", lexicon.longest_first(disease_terms), rows.lower, not preserve_newlines),
        rows.Held("_words", sorted({*classify.KEYWORDS, *classify.URGENT, *classify.HIGH}), rows.lower, True), rows.Held("_parts", classify.NEEDED, rows.folded, True),
    ]
    out = lexicon.cascaded(given, drugs, diseases, "ocr_text", held=held)
    if out is None:
        out = given.join(lexicon.joined_cascade(given, drugs, diseases, key, "ocr_text"), key)
        found = None
        said = F.struct(let(classify.ranked(c), lambda r: classify.classification(r, c)).alias("classification"), classify.urgency(c).alias("urgency"), classify.keywords_found(c).alias("keywords"))
    else:
        found = lexicon.whole_terms(F.col(source), F.col("_drugs")), lexicon.whole_terms(F.col(source), F.col("_diseases"))
        said = classify.read(c, F.col("_words"), F.col("_parts"))
    out = extracted(out, drug_terms, disease_terms, source, found=found)
    kind = lambda x: F.struct(x["classification"]["document_type"].alias("document_type"), x["classification"]["confidence"].alias("confidence"), x["classification"]["secondary_types"].alias("secondary_types"), x["urgency"]["urgency"].alias("urgency"), x["urgency"]["urgency_confidence"].alias("urgency_confidence"), F.slice(x["keywords"], 1, 10).alias("keywords_found"))
    return out.select(key, "ocr_text", "corrected_text", "corrections", "matched_drugs", "matched_diseases", "extracted_data", let(said, kind).alias("classification"))


def envelopes(rows: DataFrame, key: str) -> DataFrame:
    """key and the response as JSON text."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("response"))
