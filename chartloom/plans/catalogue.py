"""Every registered query of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import text as T
from ..operators import classify, decode, lexicon, metrics, segments
from ..sources.lexicons import DISEASES, DRUGS, ENGLISH, of_terms
from . import pipeline
from .notes import notes, rendered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOTES = f"WITH notes AS ({rendered(True)})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    # a small table may be one file that can't be split; a large one has files for all cores and stays as it is
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(terms: list[str]) -> str:
    return "[" + ", ".join(map(quoted, terms)) + "]"


# --- classification -------------------------------------------------------------------------------------------------


def _score_sql(words: list[str], patterns: list[str]) -> str:
    return " + ".join([f"contains(low, {quoted(w)})::INT" for w in words] + [f"2 * len(regexp_extract_all(text, {quoted('(?i)' + p)}))" for p in patterns])


def _ranked_sql(source: str) -> str:
    """Columns doc_id, text, r (structs by falling score) and total."""
    structs = ", ".join(f"{{'score': {_score_sql(*v)}, 'ord': {-k}, 'type': {quoted(n)}}}" for k, (n, v) in enumerate(classify.TYPES.items()))
    return f"SELECT *, list_sum(list_transform(r, lambda x: x.score)) AS total FROM (SELECT doc_id, text, list_reverse_sort([{structs}]) AS r FROM (SELECT doc_id, text, lower(text) AS low FROM {source}))"


_BLANK = r"regexp_full_match(text, '\s*')"
_CLASS = f"""CASE WHEN {_BLANK} THEN 'unknown' WHEN total = 0 THEN 'general_medical' ELSE r[1].type END AS document_type,
 CASE WHEN {_BLANK} THEN 0.0::DOUBLE WHEN total = 0 THEN 0.3::DOUBLE ELSE least(r[1].score::DOUBLE / total, 0.95::DOUBLE) END AS confidence"""


@query(f"SELECT doc_id, {_CLASS} FROM ({_ranked_sql('documents')})")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(documents(spark, sf_dir)).select("doc_id", "document_type", "confidence")


@query(f"{NOTES} SELECT doc_id, {_CLASS} FROM ({_ranked_sql('notes')})")
def classify_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classified(notes(spark, sf_dir)).select("doc_id", "document_type", "confidence")


@query(f"""{NOTES} SELECT doc_id, s.type AS type, s.score::DOUBLE / total AS score FROM
 (SELECT doc_id, total, unnest(list_filter(r[2:3], lambda x: x.score > 0)) AS s FROM ({_ranked_sql('notes')}) WHERE total > 0)""")
def secondary_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.classified(notes(spark, sf_dir))
    return out.select("doc_id", F.explode("secondary_types").alias("s")).select("doc_id", "s.type", "s.score")


def _count_sql(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in words)


@query(f"""SELECT doc_id, CASE WHEN u >= 1 THEN 'urgent' WHEN h >= 1 THEN 'high' ELSE 'routine' END AS urgency,
 CASE WHEN u >= 2 THEN 0.9 WHEN u >= 1 THEN 0.7 WHEN h >= 2 THEN 0.8 WHEN h >= 1 THEN 0.6 ELSE 0.5 END::DOUBLE AS urgency_confidence
 FROM (SELECT doc_id, {_count_sql(classify.URGENT)} AS u, {_count_sql(classify.HIGH)} AS h FROM documents)""")
def urgency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", classify.urgency(F.col("text")).alias("u")).select("doc_id", "u.*")


_ALL_WORDS = sorted({w for ws, _ in classify.TYPES.values() for w in ws})
_ALL_PATTERNS = [p for _, ps in classify.TYPES.values() for p in ps]


@query(f"""{NOTES} SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([list_filter({listed(_ALL_WORDS)}, lambda w: contains(lower(text), w)),
 {', '.join(f"regexp_extract_all(text, {quoted('(?i)' + p)})" for p in _ALL_PATTERNS)}]))), '|') AS keywords FROM notes""")
def keywords_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.array_join(classify.keywords_found(F.col("text")), "|").alias("keywords"))


@query(f"""{NOTES}, c AS (SELECT doc_id, {_CLASS} FROM ({_ranked_sql('notes')})),
 p AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'discharge_summary' WHEN 1 THEN 'lab_report' WHEN 2 THEN 'progress_note' ELSE 'prescription' END AS t, document_type AS p FROM c),
 l AS (SELECT t AS label, 1 AS support, 0 AS predicted, (t = p)::INT AS hit FROM p UNION ALL SELECT p, 0, 1, 0 FROM p),
 s AS (SELECT label, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted, sum(hit)::BIGINT AS hit FROM l GROUP BY label),
 r AS (SELECT label, support, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE hit::DOUBLE / predicted END AS precision, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hit::DOUBLE / support END AS recall FROM s)
 SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM r""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("doc_id") % 4 == 0, "discharge_summary").when(F.col("doc_id") % 4 == 1, "lab_report").when(F.col("doc_id") % 4 == 2, "progress_note").otherwise("prescription")
    return metrics.classification_report(classify.classified(notes(spark, sf_dir)).withColumn("truth", truth), "truth", "document_type")


# --- lines and single texts -----------------------------------------------------------------------------------------

_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SECTION = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(content), {quoted(w)})' for w in ws)} THEN {quoted(n)}" for n, ws in segments.SECTIONS.items()) + " ELSE 'general' END"


def _lines_sql(source: str) -> str:
    split = rf"list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: {_STRIP('x')}), lambda x: x <> '')"
    return f"SELECT doc_id, start_line, content, {_SECTION} AS segment_type, 0.8::DOUBLE AS confidence FROM (SELECT doc_id, unnest(range(len(l)))::INT AS start_line, unnest(l) AS content FROM (SELECT doc_id, {split} AS l FROM {source}))"


@query(_lines_sql("documents"))
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmented(documents(spark, sf_dir)).select("doc_id", "start_line", "content", "segment_type", "confidence")


@query(f"{NOTES} SELECT segment_type, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM ({_lines_sql('notes')}) GROUP BY segment_type")
def segment_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.segmented(notes(spark, sf_dir).drop("kind"))
    return out.groupBy("segment_type").agg(F.count("*").alias("lines"), F.countDistinct("doc_id").alias("documents"))


@query(f"""{NOTES}, l AS ({_lines_sql('notes')}), ranked AS ({_ranked_sql("(SELECT doc_id || '_' || segment_type || '_' || start_line AS doc_id, content AS text FROM l)")})
 SELECT doc_id AS segment, {_CLASS} FROM ranked""")
def classify_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.segmented(notes(spark, sf_dir).drop("kind"))
    return classify.classified(out.drop("confidence"), "content").select(F.concat_ws("_", "doc_id", "segment_type", "start_line").alias("segment"), "document_type", "confidence")


_TOKENS = lambda t: rf"list_filter(string_split_regex({t}, '\s+'), lambda x: x <> '')"


@query(rf"SELECT doc_id, array_to_string(list_transform({_TOKENS('text')}, lambda w: CASE WHEN regexp_full_match(w, '\d+(\.\d+)?') THEN w ELSE translate(w, '01', 'Ol') END), ' ') AS fused FROM documents")
def fusion_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.fused(F.col("text")).alias("fused"))


@query(f"{NOTES} SELECT doc_id, array_to_string(list_transform({_TOKENS('text')}, lambda w: lower(regexp_replace(translate(w, '013568', 'olesgb'), '[^A-Za-z]', '', 'g'))), ' ') AS normal FROM notes")
def ocr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = F.transform(T.tokens(F.col("text")), lambda w: T.alpha_lower(T.letters_for_digits(w)))
    return notes(spark, sf_dir).select("doc_id", F.array_join(normal, " ").alias("normal"))


@query(f"SELECT doc_id, CASE WHEN length(c) <= 180 THEN c ELSE substring(c, 1, 180) || '...' END AS preview FROM (SELECT doc_id, array_to_string({_TOKENS('text')}, ' ') AS c FROM documents)")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"""SELECT page_id, s AS suffix, CASE WHEN s = '.pdf' THEN 'pdf_pages' WHEN s IN ('.png', '.jpg', '.jpeg') THEN 'image_and_block' ELSE 'image' END AS intake
 FROM (SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS s FROM pages)""")
def type_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.suffix(F.col("url")).alias("suffix"), T.intake(F.col("url")).alias("intake"))


@query(rf"{NOTES} SELECT doc_id, array_to_string(regexp_extract_all(text, '(\s+|[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?|[^\w\s])', 1), '~') AS pieces FROM notes")
def regex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.array_join(T.pieces(F.col("text")), "~").alias("pieces"))


# --- field extraction -----------------------------------------------------------------------------------------------


def _x(pattern: str, flags: str = "(?i)", source: str = "text") -> str:
    return f"nullif(regexp_extract({source}, {quoted(flags + pattern)}, 1), '')"


_DOCTOR = _STRIP(_x(E.DOCTOR, "(?im)"))


@query(f"""{NOTES} SELECT doc_id, {_STRIP(_x(E.PATIENT))} AS patient_name, {_x(E.AGE)} AS age,
 CASE upper({_x(E.GENDER)}) WHEN 'MALE' THEN 'Male' WHEN 'M' THEN 'Male' WHEN 'FEMALE' THEN 'Female' WHEN 'F' THEN 'Female' END AS gender,
 CASE WHEN starts_with(lower({_DOCTOR}), 'dr') THEN {_DOCTOR} ELSE 'Dr. ' || {_DOCTOR} END AS doctor_name, {_STRIP(_x(E.HOSPITAL))} AS hospital FROM notes""")
def extract_patient_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [E.patient_name, E.age, E.gender, E.doctor_name, E.hospital]
    return notes(spark, sf_dir).select("doc_id", *[f(F.col("text")).alias(f.__name__) for f in fields])


@query(f"{NOTES} SELECT doc_id, replace({_x(E.BP)}, ' ', '') AS bp, replace({_x(E.TEMP)}, ' ', '') AS temp, {_x(E.PULSE)} AS pulse FROM notes")
def extract_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", E.vitals(F.col("text")).alias("v")).select("doc_id", "v.*")


@query(f"{NOTES} SELECT doc_id, {_x(E.DATE)} AS date FROM notes")
def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", E.date(F.col("text")).alias("date"))


_CLEAN = lambda bullet: f"lambda x: {_STRIP(f'regexp_replace(x, {quoted(bullet)}, {quoted(str())})')}"


def _diagnosis_sql(bullet: str = E.BULLET) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({_x(E.DIAGNOSIS)}, ''), ',| and |\\n'), {_CLEAN(bullet)}), lambda x: lower(x) NOT IN ('', 'diagnosis:', 'assessment:', 'impression:'))"


@query(f"{NOTES} SELECT doc_id, array_to_string({_diagnosis_sql()}, '; ') AS diagnosis, array_to_string({_diagnosis_sql(E.STRICT_BULLET)}, '; ') AS strict_diagnosis FROM notes")
def extract_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lambda strict: F.array_join(E.diagnosis(F.col("text"), strict), "; ")
    return notes(spark, sf_dir).select("doc_id", items(False).alias("diagnosis"), items(True).alias("strict_diagnosis"))


def _block_lines(pattern: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({_x(pattern, '(?is)')}, ''), chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '')"


@query(f"""{NOTES}, l AS (SELECT doc_id, unnest({_block_lines(E.MEDICINES)}) AS line FROM notes),
 m AS (SELECT doc_id, line, {_x(E.DOSAGE, source='line')} AS dosage, {_x(E.FREQUENCY, source='line')} AS frequency FROM l),
 n AS (SELECT doc_id, dosage, frequency, {_STRIP(f"regexp_replace({_STRIP('CASE WHEN dosage IS NOT NULL THEN substring(line, 1, instr(line, dosage) - 1) WHEN frequency IS NOT NULL THEN substring(line, 1, instr(line, frequency) - 1) ELSE line END')}, {quoted(E.BULLET)}, '')")} AS name FROM m)
 SELECT doc_id, name, dosage, frequency FROM n WHERE length(name) > 2""")
def extract_medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.explode(E.medicines(F.col("text"))).alias("m")).select("doc_id", "m.*")


@query(f"{NOTES} SELECT doc_id, array_to_string({_block_lines(E.INSTRUCTIONS)}, '; ') AS instructions FROM notes")
def extract_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.array_join(E.instructions(F.col("text")), "; ").alias("instructions"))


_ENTITY = lambda kind: "array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, {quoted(p)})" for p in E.ENTITIES[kind][:2]) + "))), '|')"


@query(f"{NOTES} SELECT doc_id, {', '.join(f'{_ENTITY(k)} AS {k}' for k in E.ENTITIES)} FROM notes")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", *[F.array_join(E.entities(F.col("text"), k), "|").alias(k) for k in E.ENTITIES])


_INITCAP = "array_to_string(list_transform(string_split(b[1], ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def _found_sql(terms: list[str]) -> str:
    order = sorted(terms, key=lambda t: (-len(t), t))
    hit = lambda t: f"contains(lower(text), {quoted(t)})" if " " in t else f"regexp_matches(lower(text), {quoted(chr(92) + 'b' + t + chr(92) + 'b')})"
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(t)} THEN {quoted(t)} END" for t in order) + "], lambda x: x IS NOT NULL)"


@query(f"""{NOTES} SELECT doc_id, array_to_string(list_reduce(list_transform(f, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda y: contains(lower(y), b[1]) OR contains(b[1], lower(y)))) > 0
 THEN a ELSE list_concat(a, [{_INITCAP}]) END, d), '; ') AS diagnosis FROM (SELECT doc_id, {_found_sql(DISEASES)} AS f, {_diagnosis_sql()} AS d FROM notes)""")
def dictionary_diagnosis_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = lexicon.merged_diagnoses(E.diagnosis(F.col("text")), lexicon.found_terms(F.col("text"), DISEASES))
    return notes(spark, sf_dir).select("doc_id", F.array_join(merged, "; ").alias("diagnosis"))


_MEDICINE_LINE = f"""list_filter(list_transform(list_transform({_block_lines(E.MEDICINES)}, lambda l: {{'line': l, 'dosage': {_x(E.DOSAGE, source='l')}, 'frequency': {_x(E.FREQUENCY, source='l')}}}),
 lambda m: {{'name': {_STRIP(f"regexp_replace({_STRIP('CASE WHEN m.dosage IS NOT NULL THEN substring(m.line, 1, instr(m.line, m.dosage) - 1) WHEN m.frequency IS NOT NULL THEN substring(m.line, 1, instr(m.line, m.frequency) - 1) ELSE m.line END')}, {quoted(E.BULLET)}, '')")}, 'dosage': m.dosage, 'frequency': m.frequency}}), lambda m: length(m.name) > 2)"""
_NEAR = lambda p: f"nullif(regexp_extract(regexp_extract(text, '(?i)\\b' || d || '\\b(.{{0,30}})', 1), {quoted('(?i)' + p)}, 1), '')"
#: Columns doc_id, text, m (regex medicines) and new (dictionary drugs that are in no name so far).
_MERGED_MEDICINES = f"""merged AS (SELECT doc_id, text, m, list_reduce(list_transform(f, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda y: contains(y, b[1]))) > 0 THEN a ELSE list_concat(a, b) END,
 list_transform(m, lambda x: lower(x.name)))[len(m) + 1:] AS new FROM (SELECT doc_id, text, {_MEDICINE_LINE} AS m, {_found_sql(DRUGS)} AS f FROM notes))"""


@query(f"""{NOTES}, {_MERGED_MEDICINES} SELECT doc_id, x.name AS name, x.dosage AS dosage, x.frequency AS frequency FROM (SELECT doc_id, unnest(m) AS x FROM merged)
 UNION ALL SELECT doc_id, upper(d[1:1]) || d[2:] AS name, {_NEAR(E.DOSAGE)} AS dosage, {_NEAR(E.NEAR_FREQUENCY)} AS frequency FROM (SELECT doc_id, text, unnest(new) AS d FROM merged)""")
def dictionary_medicine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.explode(pipeline.merged_medicines(F.col("text"), DRUGS)).alias("m")).select("doc_id", "m.*")


# --- dictionaries ---------------------------------------------------------------------------------------------------

_WORDS = rf"words AS (SELECT doc_id, pos, word, lower(regexp_replace(word, '[^A-Za-z]', '', 'g')) AS clean FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, {_TOKENS('text')} AS w FROM notes)))"
_DRUG_TABLE = "drugs AS (SELECT unnest(range(len(t))) AS ord, unnest(t) AS term FROM (SELECT " + listed(DRUGS) + " AS t))"


def _lcs_sql(pairs: str) -> str:
    """CTE lcs (a, b, n) for the CTE pairs (a, b): one row of the table after another; a cell is the running maximum
    of what a match or the row above gives."""
    cell = "CASE WHEN substring(a, i + 1, 1) = substring(b, k, 1) THEN p[k] + 1 ELSE p[k + 1] END"
    row = f"list_transform(range(0, length(b) + 1), lambda j: coalesce(list_max(list_transform(range(1, j + 1), lambda k: {cell})), 0))"
    return f"""folded AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: 0::BIGINT) AS p FROM {pairs}
 UNION ALL SELECT a, b, i + 1, list_transform({row}, lambda v: v::BIGINT) FROM folded WHERE i < length(a)),
 lcs AS (SELECT a, b, p[length(b) + 1] AS n FROM folded WHERE i = length(a))"""


_FUZZY = f"""pairs AS (SELECT DISTINCT clean AS a, term AS b FROM words, drugs WHERE length(clean) >= 3 AND NOT contains(term, ' ') AND clean NOT IN (SELECT term FROM drugs)
 AND 200 * least(length(clean), length(term)) >= 85 * (length(clean) + length(term))), {_lcs_sql('pairs')},
 near AS (SELECT a AS clean, b AS term, ratio FROM (SELECT a, b, 200.0 * n / (length(a) + length(b)) AS ratio, row_number() OVER (PARTITION BY a ORDER BY n::DOUBLE / (length(a) + length(b)) DESC, ord) AS k
 FROM lcs JOIN drugs ON b = term WHERE 200 * n >= 85 * (length(a) + length(b))) WHERE k = 1)"""
_RECURSIVE = NOTES.replace("WITH", "WITH RECURSIVE")


@query(f"{_RECURSIVE}, {_WORDS}, {_DRUG_TABLE}, {_FUZZY} SELECT clean, term, floor(ratio)::INT AS score FROM near")
def dict_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.fuzzy(lexicon.words(notes(spark, sf_dir), "doc_id"), of_terms(spark, DRUGS))


@query(f"{NOTES}, {_WORDS}, {_DRUG_TABLE} SELECT DISTINCT doc_id, term FROM words JOIN drugs ON clean = term WHERE length(clean) >= 3")
def dict_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.exact(notes(spark, sf_dir), of_terms(spark, DRUGS), "doc_id")


_CORE = r"regexp_extract(word, '(?s)^([^\pL]*)(.*?)([^\pL]*)$', {k})"
_PEELED = ", ".join(_CORE.format(k=k) + f" AS {n}" for k, n in ((1, "before"), (2, "core"), (3, "after")))
_CASED = "CASE WHEN core <> lower(core) AND core = upper(core) THEN upper(term) WHEN core[1:1] <> lower(core[1:1]) THEN upper(term[1:1]) || term[2:] ELSE term END"


@query(f"""{_RECURSIVE}, {_WORDS}, {_DRUG_TABLE}, {_FUZZY}, new AS (SELECT doc_id, pos, CASE WHEN term IS NULL THEN word ELSE before || {_CASED} || after END AS word
 FROM (SELECT doc_id, pos, word, term, {_PEELED} FROM words LEFT JOIN near USING (clean)))
 SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS corrected_text FROM new GROUP BY doc_id""")
def dict_correct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.corrected(notes(spark, sf_dir), of_terms(spark, DRUGS), "doc_id", "drug").select("doc_id", "corrected_text")


_GRAMS = rf"""grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT doc_id, {_TOKENS('lower(text)')} AS w FROM notes)),
 pairs AS (SELECT DISTINCT g AS a, 'heart failure' AS b FROM grams WHERE 200 * least(length(g), 13) >= 85 * (length(g) + 13))"""


@query(f"{_RECURSIVE}, {_GRAMS}, {_lcs_sql('pairs')} SELECT DISTINCT doc_id, b AS term FROM grams JOIN lcs ON g = a WHERE 200 * n >= 85 * (length(a) + length(b))")
def dict_ngram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.windows(notes(spark, sf_dir), of_terms(spark, DISEASES), "doc_id")


def _renamed(sql: str, ending: str, names: list[str]) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m[1] + ending, sql)


def _stage_sql(source: str, ending: str, terms: list[str], kind: str) -> str:
    """CTEs that end in out<ending> (doc_id, text, corrections, matched): one dictionary's say on source (doc_id, text)."""
    table = "drugs AS (SELECT unnest(range(len(t))) AS ord, unnest(t) AS term FROM (SELECT " + listed(terms) + " AS t))"
    several = [t for t in terms if " " in t]
    grams = f", list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT doc_id, {_TOKENS('lower(text)')} AS w FROM notes)" if several else ""
    parts = [_WORDS, table, _FUZZY, f"""new AS (SELECT doc_id, pos, word AS old, term, score, CASE WHEN term IS NULL THEN word ELSE before || {_CASED} || after END AS word
 FROM (SELECT doc_id, pos, word, term, floor(ratio)::INT AS score, {_PEELED} FROM words LEFT JOIN near USING (clean)))"""]
    found = "SELECT doc_id, term FROM words JOIN drugs ON clean = term WHERE length(clean) >= 3 UNION SELECT doc_id, term FROM new WHERE term IS NOT NULL"
    if several:
        two = _lcs_sql("twos").replace("folded", "foldeds").replace("lcs", "lcss")
        parts += [f"grams AS (SELECT doc_id, unnest(g) AS g FROM (SELECT doc_id{grams}))", f"twos AS (SELECT DISTINCT g AS a, term AS b FROM grams, drugs WHERE contains(term, ' ') AND 200 * least(length(g), length(term)) >= 85 * (length(g) + length(term)))", two]
        found += " UNION SELECT doc_id, b FROM grams JOIN lcss ON g = a WHERE 200 * n >= 85 * (length(a) + length(b))"
    parts.append(f"""found AS (SELECT doc_id, string_agg(term, '|' ORDER BY term) AS matched FROM ({found}) GROUP BY doc_id),
 out AS (SELECT doc_id, t AS text, coalesce(c, '') AS corrections, coalesce(matched, '') AS matched FROM (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t,
 string_agg(old || '>' || word || ':{kind}:' || score, '; ' ORDER BY pos) FILTER (WHERE term IS NOT NULL) AS c FROM new GROUP BY doc_id) LEFT JOIN found USING (doc_id))""")
    sql = _renamed(", ".join(parts), ending, ["words", "drugs", "pairs", "folded", "lcs", "near", "new", "grams", "twos", "foldeds", "lcss", "found", "out"])
    return re.sub(r"\bnotes\b", source, sql)


@query(f"""{_RECURSIVE}, {_stage_sql('notes', '_a', DRUGS, 'drug')}, {_stage_sql('out_a', '_b', DISEASES, 'disease')}
 SELECT doc_id, b.text AS corrected_text, concat_ws('; ', nullif(a.corrections, ''), nullif(b.corrections, '')) AS corrections, a.matched AS matched_drugs, b.matched AS matched_diseases FROM out_a a JOIN out_b b USING (doc_id)""")
def correction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.cascade(notes(spark, sf_dir), of_terms(spark, DRUGS), of_terms(spark, DISEASES), "doc_id")
    listed_ = F.array_join(F.transform("corrections", lambda c: F.concat(c["from"], F.lit(">"), c["to"], F.lit(":"), c["type"], F.lit(":"), c["score"].cast("string"))), "; ")
    return out.select("doc_id", "corrected_text", listed_.alias("corrections"), F.array_join("matched_drugs", "|").alias("matched_drugs"), F.array_join("matched_diseases", "|").alias("matched_diseases"))


@query(f"{NOTES} SELECT doc_id, array_to_string(list_filter({listed(sorted(DRUGS + DISEASES))}, lambda t: contains(lower(text), t)), '|') AS terms FROM notes")
def substring_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.array_join(lexicon.substring_matches(F.col("text"), DRUGS + DISEASES), "|").alias("terms"))


_LAYER = lambda terms: f"array_to_string(list_sort(list_intersect(regexp_extract_all(lower(text), '[A-Za-z]+'), {listed(sorted(terms))})), '|')"


@query(f"{NOTES} SELECT doc_id, {_LAYER(DRUGS + DISEASES)} AS medical, {_LAYER(ENGLISH)} AS english FROM notes")
def layered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = lambda terms: F.array_join(lexicon.layer_matches(F.col("text"), terms), "|")
    return notes(spark, sf_dir).select("doc_id", layer(DRUGS + DISEASES).alias("medical"), layer(ENGLISH).alias("english"))


@query()
def parser_layered_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.parsed(notes(spark, sf_dir).drop("kind"), DRUGS + DISEASES, ENGLISH, "doc_id").drop("text")


# --- words from characters ------------------------------------------------------------------------------------------

_SOURCE_WORD = "upper(CASE doc_id % 3 WHEN 0 THEN 'metformin' WHEN 1 THEN 'hello' ELSE 'gout' END)"
#: The character read and one it could be, with confidences that depend on the order and the place.
_PLACE = "(50 + (doc_id * 7 + i * 13) % 50) / 100.0"
_OTHER = "((doc_id * 11 + i * 17) % 90) / 100.0"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    one = f"""transform(sequence(1, length({_SOURCE_WORD})), i -> array(named_struct('character', substring({_SOURCE_WORD}, i, 1), 'confidence', cast({_PLACE} as double)),
 named_struct('character', 'Q', 'confidence', cast({_OTHER} as double))))"""
    return orders.select("doc_id", F.expr(one).alias("candidates"))


@query(f"""WITH c AS (SELECT doc_id, i, substring(w, i, 1) AS ch, ({_PLACE})::DOUBLE AS p, ({_OTHER})::DOUBLE AS q FROM (SELECT doc_id, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT o_orderkey AS doc_id, {_SOURCE_WORD.replace('doc_id', 'o_orderkey')} AS w FROM orders)))
 SELECT doc_id, string_agg(CASE WHEN q > p THEN 'Q' ELSE ch END, '' ORDER BY i) AS raw_word, round(avg(greatest(p, q)), 6) AS mean_confidence, min(greatest(p, q)) AS min_confidence,
 round(sum(ln(greatest(p, q))), 6) AS score FROM c GROUP BY doc_id""")
def decode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode.raw_words(candidates(spark, sf_dir))
    return out.select("doc_id", "raw_word", F.round("mean_confidence", 6).alias("mean_confidence"), "min_confidence", F.round("score", 6).alias("score"))


_TERMS = "terms AS (SELECT upper(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS term, max(p) AS prime FROM (" + " UNION ALL ".join(f"SELECT unnest({listed(ts)}) AS t, {p} AS p" for ts, p in ((DRUGS, 1), (DISEASES + ENGLISH, 0))) + ") GROUP BY 1)"
_NEAREST = lambda some: f"""(SELECT w, term, d, prime FROM (SELECT w, term, prime, levenshtein(w, term) AS d, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, term), term) AS k FROM (SELECT DISTINCT raw_word AS w FROM raw) JOIN terms
 ON abs(length(w) - length(term)) <= 1 AND w[1:1] = term[1:1] AND length(w) >= 2 AND length(term) >= 2 WHERE levenshtein(w, term) <= 2 AND {some}) WHERE k = 1)"""  # noqa: E731


@query(f"""WITH c AS (SELECT doc_id, i, substring(w, i, 1) AS ch, ({_PLACE})::DOUBLE AS p, ({_OTHER})::DOUBLE AS q FROM (SELECT doc_id, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT o_orderkey AS doc_id, {_SOURCE_WORD.replace('doc_id', 'o_orderkey')} AS w FROM orders))),
 raw AS (SELECT doc_id, string_agg(CASE WHEN q > p THEN 'Q' ELSE ch END, '' ORDER BY i) AS raw_word, avg(greatest(p, q)) AS m, min(greatest(p, q)) AS l FROM c GROUP BY doc_id), {_TERMS},
 x AS (SELECT doc_id, raw_word, k.term IS NOT NULL AS known, coalesce(k.prime, 0) AS known_prime, n.term AS near, n.d AS near_d, n.prime AS near_prime, f.term AS first, f.d AS first_d, (m <= 0.80 + 1e-12 OR l <= 0.60) AS low, l
 FROM raw LEFT JOIN terms k ON raw_word = k.term LEFT JOIN {_NEAREST('TRUE')} n ON n.w = raw_word LEFT JOIN {_NEAREST('prime = 1')} f ON f.w = raw_word),
 y AS (SELECT *, known AND known_prime = 0 AND first IS NOT NULL AND first_d <= 1 AND low AS o, NOT known AND near IS NOT NULL AND CASE WHEN near_prime = 1 THEN low ELSE near_d <= 1 AND l <= 0.45 END AS r FROM x)
 SELECT doc_id, raw_word, CASE WHEN o THEN first WHEN r THEN near ELSE raw_word END AS decoded_word, CASE WHEN o THEN first WHEN known THEN raw_word ELSE near END AS lexicon_word,
 coalesce(CASE WHEN o THEN first_d WHEN known THEN 0 ELSE near_d END, -1)::INT AS distance, coalesce(o OR r, FALSE) AS replacement_applied,
 CASE WHEN o THEN 'low-confidence-primary-fallback' WHEN r THEN 'low-confidence-lexicon-fallback' WHEN NOT known AND near IS NOT NULL THEN 'high-confidence-kept-raw' END AS replacement_reason FROM y""")
def decode_with_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t, t in DRUGS) for t in DRUGS + DISEASES + ENGLISH], "term string, is_primary boolean")
    return decode.decoded(candidates(spark, sf_dir), terms).select("doc_id", "raw_word", "decoded_word", "lexicon_word", F.coalesce("distance", F.lit(-1)).alias("distance"), "replacement_applied", "replacement_reason")


_UPPER = listed(sorted({"".join(c for c in t.upper() if c.isalpha()) for t in DRUGS + DISEASES}))


@query(f"""{NOTES}, {_WORDS}, w AS (SELECT DISTINCT upper(clean) AS word FROM words WHERE length(clean) >= 2), t AS (SELECT unnest({_UPPER}) AS term)
 SELECT word, near, distance FROM (SELECT word, term AS near, levenshtein(word, term)::INT AS distance, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), term) AS k
 FROM w JOIN t ON abs(length(word) - length(term)) <= 1 AND word[1:1] = term[1:1] WHERE levenshtein(word, term) <= 2) WHERE k = 1""")
def nearest_lexicon_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon.words(notes(spark, sf_dir), "doc_id").select(F.upper("clean").alias("word"))
    terms = of_terms(spark, DRUGS + DISEASES).select(T.alpha_upper(F.col("term")).alias("term"))
    return decode.nearest(words, terms, "word")


LABELS = [*"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


@query(f"""SELECT vec_id, k::INT AS rank, {listed(LABELS)}[i % 36 + 1] AS character, p::DOUBLE AS confidence FROM (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k
 FROM (SELECT vec_id, unnest(range(36)) AS i, unnest(embedding[1:36]) AS p FROM embeddings)) WHERE k <= 5""")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    top = decode.top_candidates(F.slice("embedding", 1, 36), LABELS, 5)
    out = vectors.select("vec_id", F.posexplode(top).alias("rank", "c"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), "c.character", F.col("c.confidence").cast("double").alias("confidence"))


# --- layout ---------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, sum(s)::BIGINT AS spaces, count(*) AS boxes FROM (SELECT l_orderkey, coalesce(lead(x) OVER o - (x + w) > avg(w) OVER (PARTITION BY l_orderkey), FALSE)::INT AS s
 FROM (SELECT l_orderkey, l_linenumber * 60 + l_partkey % 50 AS x, l_quantity AS w FROM lineitem) WINDOW o AS (PARTITION BY l_orderkey ORDER BY x, w)) GROUP BY l_orderkey""")
def gap_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") * 60 + F.col("l_partkey") % 50).alias("x"), F.col("l_quantity").alias("w"))
    out = segments.gaps(boxes, "l_orderkey", "x", "w")
    return out.groupBy("l_orderkey").agg(F.sum(F.col("space_after").cast("long")).alias("spaces"), F.count("*").alias("boxes"))


@query("""WITH r AS (SELECT p_partkey // 500 AS page, p_partkey AS y, p_size AS ink FROM part), o AS (SELECT page, y FROM (SELECT *, max(ink) OVER (PARTITION BY page) AS m FROM r) WHERE ink > 0.1 * m),
 g AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS run FROM o) SELECT page, min(y) AS top, max(y) + 1 AS bottom FROM g GROUP BY page, run HAVING max(y) + 1 - min(y) >= 10""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("p_partkey div 500").alias("page"), F.col("p_partkey").alias("y"), F.col("p_size").alias("ink"))
    return segments.islands(rows, "page", "y", "ink")


@query("SELECT l_suppkey, round(greatest(60.0, 0.6 * quantile_cont(l_extendedprice, 0.2)), 6)::DOUBLE AS min_area FROM lineitem GROUP BY l_suppkey")
def area_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.area_threshold(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_extendedprice")
    return out.select("l_suppkey", F.round("min_area", 6).alias("min_area"))


@query("""SELECT user_id, event_type AS strategy, score FROM (SELECT user_id, event_type, max(value) AS score, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, length(event_type), event_type) AS k
 FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type) WHERE k = 1""")
def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null").groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    kinds = rows.select("event_type").distinct()
    names = sorted((r.event_type for r in kinds.collect()), key=lambda t: (len(t), t))
    ordinal = F.array_position(F.array(*map(F.lit, names)), F.col("event_type"))
    return segments.best_strategy(rows.withColumn("ordinal", ordinal), "user_id", "event_type", "ordinal", "score")


# --- accuracy and the whole -----------------------------------------------------------------------------------------


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir, truth=True)


@query(f"""{NOTES}, truth AS ({rendered(False)}) SELECT kind, round(avg(levenshtein(t.text, n.text)::DOUBLE / greatest(length(t.text), 1)), 9) AS mean_cer, count(*) AS documents
 FROM notes n JOIN truth t USING (doc_id, kind) GROUP BY kind""")
def cer_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.cer_by_type(_truth(spark, sf_dir), "kind", "truth", "text")
    return out.select("kind", F.round("mean_cer", 9).alias("mean_cer"), "documents")


def _named_sql(name: str, value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') <> '' THEN '{name}:' || ({value}) END"


_SCALARS = {
    "patient_name": _STRIP(_x(E.PATIENT)), "age": _x(E.AGE), "gender": f"CASE upper({_x(E.GENDER)}) WHEN 'MALE' THEN 'Male' WHEN 'M' THEN 'Male' WHEN 'FEMALE' THEN 'Female' WHEN 'F' THEN 'Female' END", "date": _x(E.DATE),
    "doctor_name": f"CASE WHEN starts_with(lower({_DOCTOR}), 'dr') THEN {_DOCTOR} ELSE 'Dr. ' || {_DOCTOR} END", "hospital": _STRIP(_x(E.HOSPITAL)),
    "vitals.bp": f"replace({_x(E.BP)}, ' ', '')", "vitals.temp": f"replace({_x(E.TEMP)}, ' ', '')", "vitals.pulse": _x(E.PULSE),
}
_FLAT = f"""list_distinct(list_filter(list_concat([{', '.join(_named_sql(k, v) for k, v in _SCALARS.items())}], list_concat(list_transform({_diagnosis_sql()}, lambda x: 'diagnosis:' || x), list_concat(list_transform({_block_lines(E.INSTRUCTIONS)}, lambda x: 'instructions:' || x),
 list_concat(list_transform({_MEDICINE_LINE}, lambda x: 'medicines.name:' || x.name), list_concat(list_transform({_MEDICINE_LINE}, lambda x: 'medicines.dosage:' || x.dosage), list_transform({_MEDICINE_LINE}, lambda x: 'medicines.frequency:' || x.frequency)))))), lambda x: x IS NOT NULL))"""


@query(f"""{NOTES}, truth AS ({rendered(False)}), p AS (SELECT doc_id, kind, {_FLAT} AS p FROM notes), t AS (SELECT doc_id, {_FLAT} AS t FROM truth)
 SELECT kind, round(avg(len(list_intersect(t, p))::DOUBLE / greatest(len(t), 1)) * 100, 6) AS recall, count(*) AS documents FROM p JOIN t USING (doc_id) GROUP BY kind""")
def entity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _truth(spark, sf_dir).select("kind", metrics.flattened(E.record(F.col("truth"))).alias("t"), metrics.flattened(E.record(F.col("text"))).alias("p"))
    return both.groupBy("kind").agg(F.round(F.avg(metrics.recall(F.col("t"), F.col("p"))) * 100, 6).alias("recall"), F.count("*").alias("documents"))


@query()
def clinical_pipeline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.responses(notes(spark, sf_dir).drop("kind"), of_terms(spark, DRUGS), of_terms(spark, DISEASES), "doc_id")
    return pipeline.envelopes(rows, "doc_id")
