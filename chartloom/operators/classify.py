"""Document classification and urgency by a rule table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

#: For each type, in the order that settles ties, its keywords (one point) and patterns (two points a match).
TYPES: dict[str, tuple[list[str], list[str]]] = {
    "discharge_summary": (
        ["discharge", "discharged", "admission", "admitted", "hospital stay", "length of stay", "discharge date", "admission date", "discharge diagnosis", "discharge instructions"],
        [r"discharge\s+(?:summary|report|note)", r"admission\s+(?:date|diagnosis)", r"hospital\s+course", r"condition\s+on\s+discharge"],
    ),
    "lab_report": (
        ["laboratory", "lab results", "blood test", "urine test", "hemoglobin", "glucose", "cholesterol", "creatinine", "normal range", "abnormal", "reference range"],
        [r"lab\s+(?:results?|report|findings)", r"laboratory\s+(?:results?|report)", r"reference\s+range", r"\d+\.\d+\s*(?:mg/dl|mmol/l|g/dl)"],
    ),
    "consultation_note": (
        ["consultation", "referred by", "consulting physician", "opinion", "recommendations", "specialist", "follow up", "follow-up"],
        [r"consultation\s+(?:note|report)", r"referred\s+(?:by|to)", r"consulting\s+physician", r"specialist\s+opinion"],
    ),
    "prescription": (
        ["prescription", "medication", "dosage", "frequency", "tablets", "capsules", "mg", "ml", "twice daily", "once daily", "pharmacy", "refill"],
        [r"(?:rx|prescription)[:.]", r"\d+\s*mg\s+(?:once|twice|three times)\s+daily", r"take\s+\d+\s+(?:tablet|capsule)", r"sig[:.]"],
    ),
    "radiology_report": (
        ["radiology", "x-ray", "ct scan", "mri", "ultrasound", "impression", "findings", "radiologist", "contrast", "image", "scan"],
        [r"(?:ct|mri|x-ray|ultrasound)\s+(?:scan|report)", r"radiological\s+(?:findings|impression)", r"contrast\s+(?:agent|medium)", r"image\s+quality"],
    ),
    "progress_note": (
        ["progress note", "daily note", "soap note", "assessment", "plan", "subjective", "objective", "today", "patient reports", "continues"],
        [r"progress\s+note", r"soap\s+note", r"(?:subjective|objective|assessment|plan)[:.]", r"patient\s+(?:reports|states|complains)"],
    ),
    "operative_report": (
        ["operative report", "surgery", "procedure", "operation", "anesthesia", "incision", "suture", "surgeon", "postoperative", "intraoperative"],
        [r"operative\s+(?:report|note)", r"surgical\s+procedure", r"(?:pre|post|intra)operative", r"anesthesia\s+type"],
    ),
}
URGENT = ["emergency", "urgent", "stat", "immediate", "critical", "severe", "acute", "emergency room", "er visit", "ambulance", "code blue", "trauma"]
HIGH = ["abnormal", "concerning", "suspicious", "significant", "requires attention", "follow up immediately", "contact physician"]
CAP = 0.95


def hits(lower_text: Column, words: list[str]) -> Column:
    """How many of words occur, as substrings."""
    return sum((lower_text.contains(w).cast("int") for w in words[1:]), lower_text.contains(words[0]).cast("int"))


def needed(pattern: str) -> list[str]:
    """Literals of which a match of the pattern holds one: its longest part outside groups, else its first alternatives."""
    outside = re.findall("[a-z-]{3,}", re.sub(r"\(\?:[^()]*\)\??|\[[^\]]*\]|\\[a-z.][+*?]?", " ", pattern))
    return [max(outside, key=len)] if outside else re.search(r"\(\?:([^()]*)\)", pattern).group(1).split("|")


def folded(text: Column) -> Column:
    """Lower case for literals: also of the signs that a pattern without regard to case takes for i and s."""
    some = text.contains("\u0130") | text.contains("\u0131") | text.contains("\u017f")
    return F.lower(F.when(some, F.translate(text, "\u0130\u0131\u017f", "iis")).otherwise(text))


def counted(text: Column, folded_text: Column, pattern: str) -> Column:
    """Matches of the pattern; the regular expression runs only over texts that hold a literal part of it."""
    parts = needed(pattern)
    some = sum((folded_text.contains(w).cast("int") for w in parts[1:]), folded_text.contains(parts[0]).cast("int")) > 0
    return F.when(some, F.regexp_count(text, F.lit("(?iU)" + pattern))).otherwise(0)


def scores(text: Column, lower_text: Column, folded_text: Column) -> Column:
    """Struct (score, ord, type) for each type."""
    out = []
    for k, (name, (words, patterns)) in enumerate(TYPES.items()):
        score = sum((2 * counted(text, folded_text, p) for p in patterns), hits(lower_text, words))
        out.append(F.struct(score.alias("score"), F.lit(-k).alias("ord"), F.lit(name).alias("type")))
    return F.array(*out)


def _blank(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0, F.lit(True))


def ranked(text: Column) -> Column:
    """Types by falling score; equal ones in the table's order. Scores of a type are computed once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.struct(F.lower(t).alias("low"), folded(t).alias("folded")), lambda x: F.reverse(F.array_sort(scores(t, x["low"], x["folded"])))))


def classification(ranking: Column, text: Column) -> Column:
    """Struct of document_type, confidence and secondary_types from ranked(text)."""
    return let(F.struct(ranking.alias("r"), F.aggregate(ranking, F.lit(0), lambda a, x: a + x["score"]).alias("total"), _blank(text).alias("blank")), _classification)


def _classification(x: Column) -> Column:
    ranking, total, blank = x["r"], x["total"], x["blank"]
    best = F.get(ranking, F.lit(0))
    secondary = F.transform(F.filter(F.slice(ranking, 2, 2), lambda x: x["score"] > 0), lambda x: F.struct(x["type"].alias("type"), (x["score"] / total).alias("score")))
    none = F.array().cast("array<struct<type:string,score:double>>")
    kind = F.when(blank, "unknown").when(total == 0, "general_medical").otherwise(best["type"])
    confidence = F.when(blank, 0.0).when(total == 0, 0.3).otherwise(F.least(best["score"] / total, F.lit(CAP)))
    return F.struct(kind.alias("document_type"), confidence.alias("confidence"), F.when(blank | (total == 0), none).otherwise(secondary).alias("secondary_types"))


def classified(df, text: str = "text"):
    """df with document_type, confidence and secondary_types. One pass, no shuffle; a blank text is unknown with 0."""
    found = let(ranked(F.col(text)), lambda r: classification(r, F.col(text)))
    return df.withColumn("_c", found).select("*", "_c.*").drop("_c")


def urgency(text: Column) -> Column:
    """Struct of urgency and urgency_confidence; null counts as empty, which is routine."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(F.struct(hits(low, URGENT).alias("u"), hits(low, HIGH).alias("h")), _urgency))


def _urgency(x: Column) -> Column:
    urgent, high = x["u"], x["h"]
    level = F.when(urgent >= 1, "urgent").when(high >= 1, "high").otherwise("routine")
    sure = F.when(urgent >= 2, 0.9).when(urgent >= 1, 0.7).when(high >= 2, 0.8).when(high >= 1, 0.6).otherwise(0.5)
    return F.struct(level.alias("urgency"), sure.alias("urgency_confidence"))


KEYWORDS = sorted({w for ws, _ in TYPES.values() for w in ws})
PATTERNS = [p for _, ps in TYPES.values() for p in ps]
#: Literals without which no pattern matches.
NEEDED = sorted({w for p in PATTERNS for w in needed(p)})


def _matches(text: Column, some: Column, pattern: str) -> Column:
    return F.when(some, F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def keywords_found(text: Column) -> Column:
    """Keywords that occur and texts that patterns match, distinct and sorted; empty for a blank text."""
    source = F.coalesce(text, F.lit(""))
    words = let(F.lower(source), lambda low: F.filter(F.array(*map(F.lit, KEYWORDS)), lambda w: F.contains(low, w)))
    holds = lambda f, p: sum((f.contains(w).cast("int") for w in needed(p)), F.lit(0)) > 0
    found = let(folded(source), lambda f: F.flatten(F.array(*[_matches(source, holds(f, p), p) for p in PATTERNS])))
    return F.array_sort(F.array_distinct(F.concat(words, found)))


def read(text: Column, words: Column, parts: Column) -> Column:
    """Struct (classification, urgency, keywords) as classification, urgency and keywords_found give them, from what a
    text holds: words, of KEYWORDS, URGENT and HIGH in lower case, and parts, of NEEDED in the folded text. Each pattern
    runs once."""
    source = F.coalesce(text, F.lit(""))
    has = lambda of, w: F.array_contains(of, F.lit(w))
    some = lambda p: F.arrays_overlap(parts, F.array(*map(F.lit, needed(p))))
    matches = F.array(*[_matches(source, some(p), p) for p in PATTERNS])

    def said(x: Column) -> Column:
        out = []
        for k, (name, (ws, ps)) in enumerate(TYPES.items()):
            score = F.lit(0)
            for p in ps:
                score = score + 2 * F.size(F.get(x["m"], F.lit(PATTERNS.index(p))))
            score = score + F.size(F.array_intersect(words, F.array(*map(F.lit, ws))))
            out.append(F.struct(score.alias("score"), F.lit(-k).alias("ord"), F.lit(name).alias("type")))
        kind = let(F.reverse(F.array_sort(F.array(*out))), lambda r: classification(r, source))
        count = lambda ws: sum((has(words, w).cast("int") for w in ws[1:]), has(words, ws[0]).cast("int"))
        urgent = let(F.struct(count(URGENT).alias("u"), count(HIGH).alias("h")), _urgency)
        keywords = F.filter(words, lambda w: w.isin(KEYWORDS))
        found = F.array_sort(F.array_distinct(F.concat(keywords, F.flatten(x["m"]))))
        return F.struct(kind.alias("classification"), urgent.alias("urgency"), found.alias("keywords"))

    return let(F.struct(matches.alias("m")), said)
