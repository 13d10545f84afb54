"""Adapters, sinks, and the queries whose rules SQL has no words for, against plain Python."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from chartloom.functions import adapters as A
from chartloom.functions import text as T
from chartloom.plans import catalogue
from chartloom.plans.notes import notes
from chartloom.sources import documents, lexicons, sinks

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_engines():
    assert A.engine("paddle") == "paddle"
    with pytest.raises(ValueError):
        A.engine("other")


@pytest.mark.parametrize("name, safe", [("../../etc/passwd", "etc_passwd"), ("my cool movie.mov", "my_cool_movie.mov"), ("._a b._", "a_b"), ("ünï", "n"), ("", ""), ("a\\b/c.png", "a_b_c.png")])
def test_safe_names(spark, name, safe):
    assert one(spark, A.safe_name(F.col("n")), n=name) == safe


@pytest.mark.parametrize("answer, text", [({"message": {"content": " a\n"}}, "a"), ({"message": {"content": ["a ", "b", " "]}}, "a b"), ({"message": {}}, ""), ({"x": 1}, ""), ({"message": {"content": "[not a list"}}, "[not a list")])
def test_response_texts(spark, answer, text):
    assert one(spark, A.response_text(F.col("r")), r=json.dumps(answer)) == text


@pytest.mark.parametrize("raw, clean", [("```\nTranscription: a b\n```", "a b"), ("`a`", "`a`"), (" OCR:\tx ", "x"), ("```a", "```a"), ("", "")])
def test_responses_are_cleaned(spark, raw, clean):
    assert one(spark, T.response_cleaned(F.col("r")), r=raw) == clean


def test_choices(spark):
    assert one(spark, A.longest(F.array(F.col("a"), F.col("b"), F.col("c"))), a="  ab  ", b="abc", c="xyz") == "abc"
    assert one(spark, A.longest(F.array(F.col("a"))), a=None) is None
    assert one(spark, A.lines_joined(F.col("t")), t=["a", "b"]) == "a\nb"
    assert one(spark, F.transform(F.array(F.lit("A_block"), F.lit("_block"), F.lit("7"), F.lit("xy")), A.label_normalised), t="") == ["A", "?", "7", "xy"]


def test_persons(spark):
    def roles(doctor, patient, persons):
        r = spark.createDataFrame([(doctor, patient, persons)], "d string, p string, n array<string>").select(A.persons_resolved(F.col("d"), F.col("p"), F.col("n")).alias("x")).first().x
        return r.doctor_name, r.patient_name

    assert roles(None, None, ["Dr. A", "Dr. B", "C", "D"]) == ("Dr. A", "C")
    assert roles("C", None, ["C", "E md"]) == ("C", None)
    assert roles("", "P", []) == ("", "P")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", "A", 0.5, 1), ("b.png", None, None, 2)], "file string, character string, confidence double, more int")
    sinks.write_predictions(rows, f"{tmp_path}/p")
    sinks.write_predictions(rows, f"{tmp_path}/p")
    assert sorted((r.file, r.character) for r in spark.read.json(f"{tmp_path}/p").collect()) == [("a.png", "A"), ("b.png", None)]
    record = [("x.png", "printed", "t", None)]
    truth = spark.createDataFrame(record, documents.TRUTH)
    sinks.append_truth(truth, f"{tmp_path}/t")
    sinks.append_truth(truth.select("image_path", "type", "raw_text", "extracted_data"), f"{tmp_path}/t")
    assert spark.read.schema(documents.TRUTH).json(f"{tmp_path}/t").count() == 2


def plain_layers(token, medical, english):
    if len(token) < 3 or not re.search("[A-Za-z]", token):
        return token, None
    clean = re.sub("[^A-Za-z]", "", token.translate(str.maketrans("013568", "olesgb"))).lower()
    if not clean:
        return token, None
    near = lambda terms, cutoff: (difflib.get_close_matches(clean, sorted(terms), n=1, cutoff=cutoff) or [None])[0]
    for term, source in ((clean if clean in medical else None, "medical"), (clean if clean in english else None, "english"), (near(medical, 0.84), "medical"), (near(english, 0.93), "english")):
        if term:
            up = token.isupper()
            cased = term.upper() if up else term.capitalize() if token[0].isupper() and token[1:].islower() else term.lower() if token.islower() else term
            return cased, source
    return token, None


def test_layered_correction_of_the_whole_query(spark):
    texts = {r.doc_id: r.text for r in notes(spark, SF).collect()}
    medical, english = set(lexicons.DRUGS + lexicons.DISEASES), set(lexicons.ENGLISH)
    known = {}
    for r in catalogue.QUERIES["parser_layered_correction"](spark, SF).collect():
        out, changes = [], []
        for piece in re.findall(r"\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\w\s]", texts[r.doc_id]):
            if piece not in known:
                known[piece] = plain_layers(piece, medical, english)
            new, source = known[piece]
            out.append(new)
            changes += [(piece, new, source)] if new != piece else []
        assert r.corrected_text == "".join(out).strip()
        assert [tuple(c) for c in r.corrections] == changes
        assert r.dictionary_matches == sorted(t for t in medical | english if t in r.corrected_text.lower())


def test_envelopes_of_the_whole_query(spark):
    """The parts of the JSON response are those of the queries that give them one by one."""
    fixed = {r.doc_id: r for r in catalogue.QUERIES["correction_cascade"](spark, SF).collect()}
    kinds = {r.doc_id: r for r in catalogue.QUERIES["classify_notes"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in notes(spark, SF).collect()}
    rows = catalogue.QUERIES["clinical_pipeline_json"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        body = json.loads(r.response)
        assert body["ocr_text"] == texts[r.doc_id] and body["corrected_text"] == fixed[r.doc_id].corrected_text
        assert "|".join(body["matched_diseases"]) == fixed[r.doc_id].matched_diseases
        assert body["extracted_data"]["patient_name"] and body["classification"]["confidence"] <= 0.95
    assert kinds.keys() == texts.keys()
