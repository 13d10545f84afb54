"""Lexicons as small tables (term, ord): one term a line, in the order of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lists that serve when no file is given.
DRUGS = [
    "acetaminophen", "amoxicillin", "aspirin", "atorvastatin", "azithromycin",
    "ciprofloxacin", "clopidogrel", "doxycycline", "furosemide", "gabapentin",
    "hydrochlorothiazide", "ibuprofen", "insulin", "levothyroxine", "lisinopril",
    "losartan", "metformin", "metoprolol", "omeprazole", "pantoprazole",
    "paracetamol", "prednisone", "rosuvastatin", "sertraline", "simvastatin",
    "tamsulosin", "tramadol", "trazodone", "venlafaxine", "warfarin",
]
DISEASES = [
    "anemia", "anxiety", "arthritis", "asthma", "bronchitis",
    "cancer", "cholesterol", "copd", "depression", "diabetes",
    "epilepsy", "fever", "gastritis", "gerd", "gout",
    "heart failure", "hepatitis", "hypertension", "hypothyroidism", "infection",
    "influenza", "insomnia", "migraine", "obesity", "osteoporosis",
    "pneumonia", "sepsis", "sinusitis", "stroke", "tuberculosis",
]
ENGLISH = [
    "a", "about", "after", "all", "also", "and", "any", "are", "as", "at",
    "be", "because", "but", "by", "can", "come", "day", "did", "do", "for",
    "from", "good", "has", "have", "he", "hello", "her", "him", "his", "how",
    "i", "if", "in", "is", "it", "its", "just", "know", "like", "man",
    "me", "more", "my", "name", "new", "no", "not", "now", "of", "on",
    "one", "or", "our", "out", "people", "say", "she", "so", "some", "test",
    "that", "the", "their", "them", "there", "they", "this", "time", "to", "up",
    "use", "was", "we", "well", "what", "when", "which", "who", "will", "with",
    "word", "work", "world", "would", "you", "your",
]


def of_terms(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(term, ord) of lower-cased terms of two characters or more, in their order."""
    kept = [t.strip().lower() for t in terms if len(t.strip()) >= 2]
    return spark.createDataFrame([(t, k) for k, t in enumerate(kept)], "term string, ord int")


def from_file(spark: SparkSession, path: str | None, fallback: list[str], alpha: bool = False, lengths: tuple[int, int] = (2, 1 << 30), most: int | None = None) -> DataFrame:
    """(term, ord) from a text file; the fallback if there is none or it holds no term.

    alpha keeps words of letters only. most keeps the first so many in file order. A lexicon is one small file, so its
    order is that of its lines.
    """
    if path is None:
        return of_terms(spark, fallback)
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    terms = of_lines(lines, alpha, lengths, most)
    return of_terms(spark, fallback) if terms.isEmpty() else terms


def of_lines(lines: DataFrame, alpha: bool = False, lengths: tuple[int, int] = (2, 1 << 30), most: int | None = None) -> DataFrame:
    """(term, ord) of lines (ord, line): stripped, lower-cased, of a length within bounds; see from_file."""
    terms = lines.select(F.lower(F.trim("line")).alias("term"), "ord").where(F.length("term").between(*lengths))
    if alpha:
        terms = terms.where(F.col("term").rlike("^[a-z]+$"))
    return terms if most is None else terms.orderBy("ord").limit(most)


def union(*lexicons: DataFrame) -> DataFrame:
    """Distinct terms of several lexicons; a term keeps its least position."""
    out = lexicons[0].select("term", "ord")
    for x in lexicons[1:]:
        out = out.union(x.select("term", "ord"))
    return out.groupBy("term").agg(F.min("ord").alias("ord"))
