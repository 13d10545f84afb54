import difflib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from chartloom.functions import extract, similarity
from chartloom.functions import text as T
from chartloom.operators import classify, decode, lexicon, metrics, segments
from chartloom.plans import pipeline
from chartloom.sources import documents as sources
from chartloom.sources import lexicons
from chartloom.streaming import ingest


def values(spark, texts, *columns):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    return [tuple(r)[1:] for r in sorted(df.select("id", *columns).collect())]


def python_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_is_symmetric_and_exact(spark):
    rnd = random.Random(3)
    pairs = [("", ""), ("a", ""), ("aspirin", "aspirln")] + [tuple("".join(rnd.choices("abcé", k=rnd.randint(0, 9))) for _ in "ab") for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity.lcs(F.col("a"), F.col("b")).alias("x"), similarity.lcs(F.col("b"), F.col("a")).alias("y"), similarity.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.x == r.y == python_lcs(r.a, r.b)
        assert r.r == pytest.approx(200 * r.x / (len(r.a) + len(r.b)) if r.a or r.b else 100)


def test_bound_never_hides_a_match(spark):
    rnd = random.Random(5)
    pairs = [tuple("".join(rnd.choices("abcd", k=rnd.randint(1, 9))) for _ in "ab") for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", F.expr(similarity.may_reach("a", "b", 85)).alias("may")).collect():
        assert r.may or 200 * python_lcs(r.a, r.b) < 85 * (len(r.a) + len(r.b))


def test_fuzzy_ties_go_to_file_order(spark):
    words = spark.createDataFrame([("abcdefgh",), ("aspirln",), ("ab",)], "clean string")
    terms = lexicons.of_terms(spark, ["abcdefgy", "abcdefgx", "aspirin", "heart failure"])
    assert {(r.clean, r.term, r.score) for r in lexicon.fuzzy(words, terms).collect()} == {("abcdefgh", "abcdefgy", 87), ("aspirln", "aspirin", 85)}


def test_correction_keeps_case_and_punctuation(spark):
    docs = spark.createDataFrame([(1, "(Metfornin,) x\n ASPIRLN aspirin metformin500mg"), (2, ""), (3, None)], "id long, text string")
    out = {r.id: r for r in lexicon.corrected(docs, lexicons.of_terms(spark, lexicons.DRUGS), "id", "drug").collect()}
    assert out[1].corrected_text == "(Metformin,) x ASPIRIN aspirin metformin"
    assert out[1].matched == ["aspirin", "metformin"] and len(out[1].corrections) == 3
    assert out[2].corrected_text == out[3].corrected_text == ""


def test_windows_find_near_phrases(spark):
    docs = spark.createDataFrame([(1, "had hart failure"), (2, "heart"), (3, "type 1 diabetes")], "id long, text string")
    terms = lexicons.of_terms(spark, ["heart failure", "type 1 diabetes", "type 2 diabetes"])
    assert {tuple(r) for r in lexicon.windows(docs, terms, "id").collect()} == {(1, "heart failure"), (3, "type 1 diabetes"), (3, "type 2 diabetes")}


@pytest.mark.parametrize(
    "text, medical, english, cutoffs, wanted",
    [
        ("Patient has diabete5 and takes asp1rin daily.", ["aspirin", "diabetes", "metformin", "hypertension"], lexicons.ENGLISH, {}, {"diabete5": "medical", "asp1rin": "medical"}),
        ("he11o wor1d te5t", ["aspirin"], ["hello", "world", "test"], {"english_cutoff": 0.8}, {"he11o": "english", "wor1d": "english", "te5t": "english"}),
    ],
)
def test_parser_corrects(spark, text, medical, english, cutoffs, wanted):
    r = lexicon.parsed(spark.createDataFrame([(1, text)], "id long, text string"), medical, english, "id", **cutoffs).first()
    assert {c["from"]: c["source"] for c in r.corrections} == wanted
    if "he11o" in wanted:
        assert r.corrected_text.lower() == "hello world test"


def test_parser_layers(spark):
    r = lexicon.parsed(spark.createDataFrame([(1, "Hypertens1on in Patient has diabetes daily")], "id long, text string"), ["diabetes", "hypertension"], ["patient", "daily"], "id").first()
    assert "hypertension" in r.dictionary_matches and r.medical_matches == ["diabetes", "hypertension"] and r.english_matches == ["daily", "patient"]


def test_difflib_column(spark):
    words, terms = ["aspirni", "xyz", "tesst"], ["aspirin", "test", "text"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict(df.select("w", similarity.close_match(F.col("w"), terms, 0.6)).collect())
    assert got == {w: (difflib.get_close_matches(w, terms, 1, 0.6) or [None])[0] for w in words}


HELLD = [[("H", 0.95)], [("E", 0.94)], [("L", 0.93)], [("L", 0.92)]]


def decoded(spark, words, terms, **t):
    from chartloom.sources.schemas import CANDIDATES

    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], f"id long, candidates {CANDIDATES}")
    return [r for r in sorted(decode.decoded(df, spark.createDataFrame(terms, "term string, is_primary boolean"), t=decode.Thresholds(**t)).collect(), key=lambda r: r.id)]


def test_decoder_decides_by_confidence(spark):
    terms = [("hello", False), ("name", False), ("nilesh", False)]
    low, high = HELLD + [[("D", 0.52), ("O", 0.48)]], [[("H", 0.99)], [("E", 0.99)], [("L", 0.99)], [("L", 0.99)], [("D", 0.99), ("O", 0.01)]]
    a, b, none = decoded(spark, [low, high, []], terms, non_primary=0.55)
    assert (a.raw_word, a.decoded_word, a.replacement_applied, a.replacement_reason) == ("HELLD", "HELLO", True, "low-confidence-lexicon-fallback")
    assert (b.raw_word, b.decoded_word, b.replacement_applied, b.replacement_reason) == ("HELLD", "HELLD", False, "high-confidence-kept-raw")
    assert (none.raw_word, none.decoded_word, none.score, none.raw_confidence, none.mean_confidence) == ("", "", -math.inf, 0.0, None)


def test_decoder_prefers_primary_words(spark):
    (r,) = decoded(spark, [[[("G", 0.5)], [("O", 0.5)], [("U", 0.5)], [("R", 0.5)]]], [("gour", False), ("gout", True)])
    assert (r.decoded_word, r.distance, r.replacement_reason) == ("GOUT", 1, "low-confidence-primary-fallback")


def test_best_beam_is_the_best_of_each_position(spark):
    rnd = random.Random(1)
    words = [[[(rnd.choice("ABC"), rnd.choice([0.0, 0.1, 0.5, 0.9])) for _ in range(rnd.randint(0, 3))] for _ in range(rnd.randint(1, 4))] for _ in range(30)]
    for r, w in zip(decoded(spark, words, [("zzzz", False)]), words):
        some = [p for p in w if p]
        best = max((sum(math.log(max(c, 1e-8)) for _, c in x) for x in itertools.product(*some)), default=0.0)
        assert r.score == pytest.approx(best)


NOTE = "Hospital : City Unit\nPatient Name : Jane Roe\nAge : 41\nSex: F\nDr. Lee\nOn 3/4/2026\nBP: 120 / 80\nTemp: 37.5 C\nHR: 70 bpm\nDiagnosis: asthma, osteoporosis and gout\n- fever\nRx:\n- omeprazole 20mg daily\n2. Ibuprofen 200 mg at bedtime\nPlan: rest\ncome back"


def test_record(spark):
    df = spark.createDataFrame([(1, NOTE), (2, " \n"), (3, None)], "id long, text string")
    out = {r.id: r.e for r in df.select("id", extract.record(F.col("text")).alias("e")).collect()}
    e = out[1]
    assert (e.patient_name, e.age, e.gender, e.date, e.doctor_name, e.hospital) == ("Jane Roe", "41", "Female", "3/4/2026", "Dr. Lee", "City Unit")
    assert tuple(e.vitals) == ("120/80", "37.5C", "70") and e.instructions == ["rest", "come back"]
    assert e.diagnosis == ["asthma", "osteoporosis", "gout", "fever"]
    assert [tuple(m) for m in e.medicines] == [("omeprazole", "20mg", "daily"), ("Ibuprofen", "200 mg", "at bedtime")]
    assert out[2] is None and out[3] is None
    plain = spark.createDataFrame([("Diagnosis: osteoporosis\nRx: omeprazole 20mg",)], "text string")
    for strict, cut in ((False, 0), (True, 1)):
        e = plain.select(extract.record(F.col("text"), strict).alias("e")).first().e
        assert e.diagnosis == ["osteoporosis"[cut:]] and e.medicines[0].name == "omeprazole"[cut:]


def test_dictionary_completes_the_record(spark):
    df = spark.createDataFrame([(1, "Diagnosis: mild asthma\nseen with gout. insulin 10 units daily; warfarin")], "id long, text string")
    e = pipeline.extracted(df, ["insulin", "warfarin"], ["asthma", "gout"]).first().extracted_data
    assert e.diagnosis == ["mild asthma", "Gout"]
    assert [tuple(m) for m in e.medicines] == [("Warfarin", None, None), ("Insulin", "10 units", "daily")]


def test_responses_fall_back_on_nothing(spark):
    df = spark.createDataFrame([(1, NOTE), (2, "")], "id long, text string")
    terms = [lexicons.of_terms(spark, x) for x in (lexicons.DRUGS, lexicons.DISEASES)]
    out = {r.id: r for r in pipeline.responses(df, *terms, "id").collect()}
    assert out[2].classification.document_type == "unknown" and out[2].extracted_data is None
    assert "ibuprofen" in out[1].matched_drugs and pipeline.envelopes(pipeline.responses(df, *terms, "id"), "id").count() == 2


def test_classification_ties_and_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "nothing here"), (4, "opinion surgery"), (5, "Discharge Summary")], "id long, text string")
    got = {r.id: r for r in classify.classified(df).collect()}
    assert [(got[k].document_type, got[k].confidence) for k in (1, 2, 3)] == [("unknown", 0.0), ("unknown", 0.0), ("general_medical", 0.3)]
    assert got[4].document_type == "consultation_note" and [tuple(s) for s in got[4].secondary_types] == [("operative_report", 0.5)]
    assert got[5].confidence == 0.95
    assert values(spark, [None, "stat", "stat trauma", "abnormal", "abnormal suspicious"], classify.urgency(F.col("text")).alias("u")) == [(("routine", 0.5),), (("urgent", 0.7),), (("urgent", 0.9),), (("high", 0.6),), (("high", 0.8),)]


def test_texts(spark):
    t = F.col("text")
    assert values(spark, ["take 500mg 10.5\n x1", None], T.fused(t)) == [("take 5OOmg 10.5 xl",), ("",)]
    assert values(spark, ["a" * 200, " a  b "], T.preview(t)) == [("a" * 180 + "...",), ("a b",)]
    assert values(spark, ["/x/a.PDF", "b.jpeg", "c", "d.bmp"], T.intake(t)) == [("pdf_pages",), ("image_and_block",), ("image",), ("image",)]
    assert values(spark, ["ABC", "Abc", "abc", "aBc", "1"], T.case_like(t, F.lit("teST"))) == [("TEST",), ("Test",), ("test",), ("teST",), ("teST",)]
    assert values(spark, ["``` Transcription: hi OCR: ```"], T.response_cleaned(t)) == [("hi",)]


def test_lines_and_islands(spark):
    df = spark.createDataFrame([(1, "Rx: a\r\n\n BP plan \nnothing")], "id long, text string")
    assert [(r.start_line, r.content, r.segment_type) for r in segments.segmented(df).orderBy("start_line").collect()] == [(0, "Rx: a", "medication"), (1, "BP plan", "plan"), (2, "nothing", "general")]
    ink = [(0, y, 9 if 3 <= y < 15 or y >= 18 else 0) for y in range(30)]
    assert sorted((r.top, r.bottom) for r in segments.islands(spark.createDataFrame(ink, "p int, y int, ink int"), "p", "y", "ink").collect()) == [(3, 15), (18, 30)]


def test_metrics(spark):
    df = spark.createDataFrame([("a", " kitten ", "sitting"), ("a", "", "")], "k string, t string, p string")
    r = metrics.cer_by_type(df, "k", "t", "p").first()
    assert r.mean_cer == pytest.approx(0.25) and r.accuracy == pytest.approx(75)
    rec = spark.createDataFrame([(NOTE,)], "text string").select(metrics.flattened(extract.record(F.col("text"))).alias("f")).first().f
    assert "vitals.bp:120/80" in rec and "medicines.name:Ibuprofen" in rec and len(rec) == len(set(rec))


def test_sources_and_stream(spark, tmp_path):
    scans = tmp_path / "in" / "A"
    scans.mkdir(parents=True)
    (scans / "x.txt").write_bytes(b"one\ftwo")
    (scans / "y.PNG").write_bytes(b"z")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in sources.recognised(sources.files(spark, str(tmp_path / "in")), sources.plain_text).collect()}
    assert got == {"x.txt": ("one\ntwo", None), "y.PNG": ("z", None)}
    broken = sources.recognised(sources.files(spark, str(tmp_path / "in")), lambda: lambda *a: 1 / 0)
    assert {r.error for r in broken.collect()} == {"ZeroDivisionError"}
    (tmp_path / "terms").write_text("Beta\n\nx\nalpha beta\nAlpha\n")
    terms = lexicons.from_file(spark, str(tmp_path / "terms"), ["f1"])
    assert [r.term for r in terms.orderBy("ord").collect()] == ["beta", "alpha beta", "alpha"]
    assert lexicons.from_file(spark, str(tmp_path / "terms"), ["f1"], alpha=True, most=1).first().term == "beta"
    q = ingest.run(ingest.arriving(spark, str(scans)), lambda b: sources.recognised(b, sources.plain_text), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_correction_keeps_white_space(spark):
    text = "  asprin and asprinol,\n\n\taspirln (ASPRIN)  "
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n"), (5, "none here \n")], "id long, text string")
    out = {r.id: r for r in lexicon.corrected(docs, lexicons.of_terms(spark, lexicons.DRUGS), "id", "drug", keep_lines=True).collect()}
    assert out[1].corrected_text == "  aspirin and asprinol,\n\n\taspirin (ASPIRIN)  "
    assert [(c["from"], c["to"]) for c in out[1].corrections] == [("asprin", "aspirin"), ("aspirln", "aspirin"), ("(ASPRIN)", "(ASPIRIN)")]
    assert [out[k].corrected_text for k in (3, 4, 5)] == ["", " \n", "none here \n"]


def test_both_ways_back_to_the_texts_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "asprin 20 mg, Hart failure and METFORNIN for diabetis"), (2, "nothing"), (3, None), (4, "aspirin insulin insulin")], "id long, text string")
    terms = lexicons.of_terms(spark, lexicons.DRUGS + lexicons.DISEASES)
    both = []
    for most in (500, 0):
        monkeypatch.setattr(lexicon, "IN_ROW", most)
        one = lexicon.corrected(docs, terms, "id", "drug").orderBy("id").collect()
        two = lexicon.parsed(docs, lexicons.DRUGS + lexicons.DISEASES, lexicons.ENGLISH, "id").orderBy("id").collect()
        both.append((one, two))
    assert both[0] == both[1]
    assert both[0][0][0].matched == ["aspirin", "diabetes", "heart failure", "metformin"]


def test_words_are_not_shuffled_to_meet_a_lexicon(spark):
    docs = spark.createDataFrame([(k, "asprin and metfornin for hart failure") for k in range(50)], "id long, text string")
    terms = lexicons.of_terms(spark, lexicons.DRUGS + ["heart failure"])
    single = lexicons.of_terms(spark, lexicons.DRUGS)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    for df in (lexicon.exact(docs, terms, "id"), lexicon.fuzzy(lexicon.spellings(docs), terms), lexicon.windows(docs, terms, "id"), lexicon.corrected(docs, terms, "id", "drug"), lexicon.parsed(docs, lexicons.DRUGS, lexicons.ENGLISH, "id")):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    for df in (lexicon.corrected(docs, single, "id", "drug"), lexicon.parsed(docs, lexicons.DRUGS, lexicons.ENGLISH, "id")):
        assert "Exchange" not in plan(df) and "Join" not in plan(df)
    assert "SortMergeJoin" not in plan(lexicon.exact(docs, terms, "id")) + plan(lexicon.windows(docs, terms, "id"))


def test_close_terms_against_all_pairs(spark):
    import random

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdeg") for _ in range(n))
    terms = sorted({word(rnd.randint(3, 9)) for _ in range(60)})
    forms = sorted({word(rnd.randint(3, 10)) for _ in range(300)} | {t[:2] + rnd.choice("abz") + t[2:] for t in terms})

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0] * (len(b) + 1)
            for k, y in enumerate(b):
                row[k + 1] = old[k] + 1 if x == y else max(old[k + 1], row[k])
        return 200 * row[-1], len(a) + len(b)

    for threshold in (60, 85):
        table = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, ord int")
        got = {(r.s, r.term) for r in lexicon.close(spark.createDataFrame([(f,) for f in forms], "s string"), table, threshold, "s", []).collect()}
        assert got == {(f, t) for f in forms for t in terms if (x := ratio(f, t))[0] >= threshold * x[1]}


def test_cascade_in_the_row_gives_what_joins_give(spark, monkeypatch):
    rng, breaks = random.Random(3), [" ", "  ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u200b"]
    words = "Metformin METFORNIN (Aspirrin) WARFARlN! heart Hart FAILURE, faliure asthma Asthme gout ÉAspirin İbuprofen ΑΣ ſtroke ßepsis co-trimoxazole type 1 2 diabetes diabetis -- x".split()
    made = [(k, "".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randrange(20)))) for k in range(300)]
    docs = spark.createDataFrame([*made, (300, None), (301, "\n heart  failure")], "id int, text string")
    drugs, diseases = lexicons.of_terms(spark, [*lexicons.DRUGS, "co-trimoxazole", "a\tb", "vitamin b twelve"]), lexicons.of_terms(spark, [*lexicons.DISEASES, "type 1 diabetes", "sepsis\tx"])
    ours = lexicon.cascade(docs, drugs, diseases, "id")
    assert "Exchange" not in ours._jdf.queryExecution().executedPlan().toString()  # no text is shuffled
    theirs = lexicon.joined_cascade(docs, drugs, diseases, "id").orderBy("id").collect()
    assert ours.orderBy("id").collect() == theirs
    monkeypatch.setattr(lexicon, "IN_ROW", 0)
    assert lexicon.cascade(docs, drugs, diseases, "id").orderBy("id").collect() == theirs


def test_medicines_are_found_without_the_rest_of_the_record(spark):
    made = ["Rx: \u2003- Metformin 5mg twice daily\x85\n\xa02. Ibuprofen 100 mg at bedtime\u3000\nPlan: insulin 10 units daily, tramadol", "warfarin", "Rx:", " ", None]
    docs = spark.createDataFrame(list(enumerate(made)), "id int, text string")
    whole = {r.id: r.m or [] for r in pipeline.extracted(docs, lexicons.DRUGS, lexicons.DISEASES).select("id", F.col("extracted_data.medicines").alias("m")).collect()}
    alone = docs.select("id", pipeline.merged_medicines(F.col("text"), lexicons.DRUGS).alias("m"))
    assert {r.id: r.m or [] for r in alone.collect()} == whole and [m.name for m in whole[0]] == ["Metformin", "Ibuprofen", "Tramadol", "Insulin"]
    assert extract.PULSE not in alone._jdf.queryExecution().executedPlan().toString()
    spaces = [chr(c) for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    one = spark.createDataFrame([(f"{c} a{c}b {c}",) for c in spaces], "t string")
    assert one.where(~extract.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?Ud)^\s+|\s+\z", ""))).count() == 0


def test_responses_read_each_text_in_the_row(spark, monkeypatch):
    made = ["Rx: Metfornin 5mg daily\nFOLLOW UP: stat. Follow-up İnsulin ſig: Proſgress  Note, tramadol 5 mg\x1cDr. Ö\xa0 Hart failure", "", None, " \x85", "Discharge summary: pre-operative RX: X-RAY  scan ımage qualıty, severe asthme; take 2 tablets twice daily"]
    docs = spark.createDataFrame(list(enumerate(made)), "id int, text string")
    drugs, diseases = lexicons.of_terms(spark, lexicons.DRUGS), lexicons.of_terms(spark, lexicons.DISEASES)
    for keep in (True, False):
        ours = pipeline.responses(docs, drugs, diseases, "id", preserve_newlines=keep)
        assert "Join" not in ours._jdf.queryExecution().executedPlan().toString()
        ours = ours.orderBy("id").collect()
        with monkeypatch.context() as m:
            m.setattr(lexicon, "cascaded", lambda *a, **b: None)  # joins, and each function by itself
            assert ours == pipeline.responses(docs, drugs, diseases, "id", preserve_newlines=keep).orderBy("id").collect()
    assert "Metformin" in [c["to"] for c in ours[0].corrections] and "heart failure" in ours[0].matched_diseases
