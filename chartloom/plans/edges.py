"""Queries at the edges of the engine: lexicon scans, adapters of recognition engines, named entities; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters as A
from ..functions import extract as E
from ..functions import text as T
from ..operators import lexicon
from ..sources import lexicons, sinks
from ..sources.lexicons import DISEASES, DRUGS, ENGLISH
from . import pipeline
from .catalogue import _FLAT, NOTES, _found_sql, listed, query, quoted
from .notes import notes

_STRIPPED = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- lexicon scans --------------------------------------------------------------------------------------------------

_LINES = "SELECT cast(p_partkey AS INT) AS ord, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN p_brand WHEN 2 THEN upper(translate(cast(p_partkey AS string), '0123456789', 'abcdefghij')) ELSE translate(cast(p_partkey * 7 AS string), '0123456789', 'klmnopqrst') END AS line FROM part"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINES.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


@query(f"SELECT lower(trim(line)) AS term, ord FROM ({_LINES}) WHERE length(trim(line)) >= 2")
def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.of_lines(_lines(spark, sf_dir))


@query(f"SELECT DISTINCT lower(trim(line)) AS term FROM ({_LINES}) WHERE length(trim(line)) >= 2 AND regexp_full_match(lower(trim(line)), '[a-z]+')")
def english_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.of_lines(_lines(spark, sf_dir), alpha=True).select("term").distinct()


@query(f"SELECT lower(trim(line)) AS term, ord FROM ({_LINES}) WHERE length(trim(line)) BETWEEN 3 AND 5 AND regexp_full_match(lower(trim(line)), '[a-z]+') ORDER BY ord LIMIT 20")
def decoder_english_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty in the order of the file, as the scan's own limit asks."""
    return lexicons.of_lines(_lines(spark, sf_dir), alpha=True, lengths=(3, 5), most=20)


@query(f"SELECT term, min(ord)::INT AS ord FROM (SELECT unnest(range(len(t))) AS ord, unnest(t) AS term FROM (SELECT {listed(DRUGS)} AS t UNION ALL SELECT {listed(DISEASES)} UNION ALL SELECT {listed([w for w in ENGLISH if len(w) > 1])})) GROUP BY term")
def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.union(*[lexicons.of_terms(spark, t) for t in (DRUGS, DISEASES, ENGLISH)])


# --- words and matches ----------------------------------------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, len(list_filter({_TOKENS}, lambda w: length(w) >= 3 AND regexp_matches(w, '[A-Za-z]')))::INT AS word_tokens FROM conversations")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(T.tokens(F.col("text")), T.is_word_token)).alias("word_tokens"))


_CASED = """CASE WHEN w <> lower(w) AND w = upper(w) THEN upper(t) WHEN w[1:1] <> lower(w[1:1]) AND w[2:] <> upper(w[2:]) AND w[2:] = lower(w[2:]) THEN upper(t[1:1]) || lower(t[2:])
 WHEN w <> upper(w) AND w = lower(w) THEN lower(t) ELSE t END"""


@query(f"SELECT DISTINCT w AS word, {_CASED} AS cased FROM (SELECT unnest({_TOKENS}) AS w, 'mcDonald' AS t FROM conversations)")
def case_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).distinct()
    return words.select("word", T.case_like(F.col("word"), F.lit("mcDonald")).alias("cased"))


@query(f"{NOTES} SELECT doc_id, text AS corrected_text, array_to_string(list_sort({_found_sql(DRUGS + DISEASES)}), '|') AS matched FROM notes")
def detect_without_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.detected(notes(spark, sf_dir), DRUGS + DISEASES)
    return out.select("doc_id", "corrected_text", F.array_join("matched", "|").alias("matched"))


_PHRASES = "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(text, '(?i)\\b{t}\\b')" for t in sorted(DRUGS + DISEASES)) + "])))"


@query(f"{NOTES} SELECT doc_id, array_to_string({_PHRASES}, '|') AS phrases FROM notes")
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.array_join(A.phrases(F.col("text"), DRUGS + DISEASES), "|").alias("phrases"))


_CUT = r"regexp_extract_all(c_address || ' te5t 7x y8 z', '[A-Za-z]\d?|\d+|[^A-Za-z\d\s]')"
_JOINS = r"(regexp_matches(x[i], '\d') AND regexp_full_match(x[i + 1], '\pL') AND i % 3 > 0)"


@query(f"""SELECT c_custkey, array_to_string(list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i > 1 AND {_JOINS.replace('[i + 1]', '[i ]').replace('x[i]', 'x[i - 1]').replace('i % 3', '(i - 1) % 3')} THEN NULL
 WHEN i < len(x) AND {_JOINS} THEN x[i] || x[i + 1] ELSE x[i] END), lambda t: t IS NOT NULL), '~') AS tokens FROM (SELECT c_custkey, {_CUT.replace('c_address', 'c_name')} AS x FROM customer)""")
def split_tokens_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.regexp_extract_all(F.concat("c_name", F.lit(" te5t 7x y8 z")), F.lit(r"[A-Za-z]\d?|\d+|[^A-Za-z\d\s]"), F.lit(0))
    tokens = F.transform(cut, lambda x, i: F.struct(x.alias("text"), F.when((i + 1) % 3 > 0, "").otherwise(" ").alias("space")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(A.split_merged(tokens), lambda t: t["text"]), "~").alias("tokens"))


# --- engines --------------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(regexp_replace(url, '[/\\]', ' ', 'g'), '\s+'), lambda x: x <> ''), '_'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS name FROM pages""")
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", A.safe_name(F.col("url")).alias("name"))


_LABEL = "CASE p_partkey % 5 WHEN 0 THEN chr((65 + p_partkey % 26)::INT) || '_block' WHEN 1 THEN '_block' WHEN 2 THEN chr((48 + p_partkey % 10)::INT) WHEN 3 THEN chr((97 + p_partkey % 26)::INT) ELSE 'AB' END"


@query(f"SELECT p_partkey, CASE WHEN ends_with(l, '_block') THEN CASE WHEN l = '_block' THEN '?' ELSE l[1:1] END ELSE l END AS label, regexp_full_match(l, '[0-9A-Z]') AS canonical FROM (SELECT p_partkey, {_LABEL} AS l FROM part)")
def label_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LABEL.replace("::INT", "")).alias("l"))
    return raw.select("p_partkey", A.label_normalised(F.col("l")).alias("label"), F.col("l").rlike(r"^[0-9A-Z]\z").alias("canonical"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN '  ```Transcription: ' || text || '```' WHEN 1 THEN 'OCR: ' || text || '  ' WHEN 2 THEN '`' || text ELSE text END"
_UNTICKED = "regexp_replace(a, '^`+|`+$', '', 'g')"
_UNFENCED = f"CASE WHEN starts_with(a, '```') AND ends_with(a, '```') THEN {_STRIPPED(_UNTICKED)} ELSE a END"


@query(f"SELECT conv_id, turn, {_STRIPPED(f'replace(replace({_UNFENCED}, {quoted('Transcription:')}, {quoted(str())}), {quoted('OCR:')}, {quoted(str())})')} AS answer FROM (SELECT conv_id, turn, {_STRIPPED(_ANSWER)} AS a FROM conversations)")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers come as JSON, some with a list of parts."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("a"))
    one = F.to_json(F.struct(F.struct(F.col("a").alias("content")).alias("message")))
    parts = F.to_json(F.struct(F.struct(F.array(F.substring("a", 1, 5), F.expr("substring(a, 6)")).alias("content")).alias("message")))
    answer = F.when(F.col("turn") % 3 == 0, parts).otherwise(one)
    return talk.select("conv_id", "turn", T.response_cleaned(A.response_text(answer)).alias("answer"))


_VARIANTS = "substring(text, 1, 40) AS p, substring(text, 41, (doc_id % 60)::INT) AS s, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE substring(text, 5, 9) END AS c"


@query(f"""SELECT doc_id, CASE WHEN contains(p, chr(10)) THEN p ELSE s END AS block_text, CASE WHEN length(trim(s, ' ')) > length(trim(p, ' ')) THEN s ELSE p END AS longest, coalesce(nullif(c, ''), nullif(p, ''), nullif(s, ''), '') AS shown
 FROM (SELECT doc_id, {_VARIANTS} FROM documents)""")
def text_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.substring("text", 1, 40), F.expr("substring(text, 41, cast(doc_id % 60 as int))")
    c = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.substring("text", 5, 9))
    parts = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"), s.alias("s"), c.alias("c"))
    p, s, c = F.col("p"), F.col("s"), F.col("c")
    return parts.select("doc_id", A.block_text(p, s).alias("block_text"), A.longest(F.array(p, s)).alias("longest"), T.first_of(c, p, s).alias("shown"))


@query("SELECT o_custkey, max(o_orderkey)::BIGINT AS newest FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last FROM orders) WHERE o_orderdate = last GROUP BY o_custkey")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("modificationTime"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"))
    return sinks.latest(files, ["o_custkey"]).select("o_custkey", F.col("path").cast("long").alias("newest"))


# --- named entities -------------------------------------------------------------------------------------------------

_TEXT = "CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Seen today. Tylenol 20 mg daily for gout, opd visit' END"
_FIRST = "CASE doc_id % 3 WHEN 0 THEN 'Dr. Grey' WHEN 1 THEN 'John Moss' ELSE 'Li MD' END"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, every other one a short text, with what a named-entity plug-in would say."""
    named = [("PERSON", _FIRST), ("PERSON", "'Ann Poe'"), ("PERSON", "'Roy, md'"), ("ORG", "'St. Anna'"), ("DATE", "'Monday'"), ("DATE", "'May'"), ("DISEASE", "'Lupus'"), ("DISEASE", "'gouty'"), ("CHEMICAL", "'Tylenol'"), ("ENTITY", "'OPD'"), ("ENTITY", "'zincum'")]
    tags = "array(" + ", ".join(f"named_struct('label', '{k}', 'entity', {v})" for k, v in named) + ")"
    return notes(spark, sf_dir).select("doc_id", F.expr(_TEXT).alias("text"), F.expr(tags).alias("entities"))


_RX = lambda field, p, flags="(?i)": f"nullif(regexp_extract(text, {quoted(flags + p)}, 1), '')"
_DOC = _STRIPPED(_RX("d", E.DOCTOR, "(?im)"))


@query(f"""{NOTES}, r AS (SELECT doc_id, {_RX('date', E.DATE)} AS date, {_STRIPPED(_RX('h', E.HOSPITAL))} AS hospital, CASE WHEN starts_with(lower({_DOC}), 'dr') THEN {_DOC} ELSE 'Dr. ' || {_DOC} END AS doctor, {_STRIPPED(_RX('p', E.PATIENT))} AS patient, {_FIRST} AS one
 FROM (SELECT doc_id, {_TEXT} AS text FROM notes))
 SELECT doc_id, coalesce(date, 'Monday') AS date, coalesce(hospital, 'St. Anna') AS hospital, coalesce(doctor, CASE WHEN one <> 'John Moss' THEN one ELSE 'Roy, md' END) AS doctor_name, coalesce(patient, CASE WHEN one = 'John Moss' THEN one ELSE 'Ann Poe' END) AS patient_name,
 CASE WHEN doc_id % 2 = 1 THEN 'Lupus; Gouty' END AS diagnosis, CASE WHEN doc_id % 2 = 1 THEN 'Tylenol|20 mg|daily' END AS medicines FROM r""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.extracted(_entities(spark, sf_dir), DRUGS, DISEASES, entities="entities").select("doc_id", "extracted_data.*")
    short = F.col("doc_id") % 2 == 1
    medicine = F.array_join(F.transform("medicines", lambda m: F.concat_ws("|", m["name"], m["dosage"], m["frequency"])), "; ")
    return out.select("doc_id", "date", "hospital", "doctor_name", "patient_name", F.when(short, F.array_join("diagnosis", "; ")).alias("diagnosis"), F.when(short, medicine).alias("medicines"))


_SOME = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'nothing of note' ELSE 'Temp: 37 C' END"


@query(f"{NOTES} SELECT doc_id, len({_FLAT}) > 0 AS useful FROM (SELECT doc_id, {_SOME} AS text FROM notes)")
def useful_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = notes(spark, sf_dir).select("doc_id", F.expr(_SOME).alias("text"))
    return some.select("doc_id", A.has_useful_data(E.record(F.col("text"))).alias("useful"))
