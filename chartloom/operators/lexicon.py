"""Dictionary joins: exact, fuzzy, windows of words, correction, layered parsing.

A lexicon is small: it is broadcast after a check of its size, and the words of the texts are not shuffled to meet it.
Spellings are made distinct before the costly comparison. What it finds, usually few spellings, goes back to the texts
in the row, as a literal dictionary; only where there are many are words joined and put back by document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import close_match, lcs, may_reach, reaches
from . import rows

THRESHOLD = 85
#: Rows of a lexicon, or of what was found in it, that a broadcast may hold; beyond that they are shuffled.
BROADCAST_ROWS = 200_000
#: Entries of a dictionary that is looked up in the row.
IN_ROW = 500
_CHANGE = "struct<pos:int,word:string,corrected:string,score:int,term:string>"


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as the smaller side of a join: its rows in hand and broadcast if there are at most so many, else as it is."""
    found = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if len(found) <= rows else df


def looked_up(word: Column, entries: dict[str, object], kind: str) -> Column:
    """The entry of a word, of the type kind; null for others. Whether there is one is a hash lookup and comes first."""
    if not entries:
        return F.lit(None).cast(kind)
    return F.when(word.isin(sorted(entries)), F.element_at(F.from_json(F.lit(json.dumps(entries)), f"map<string,{kind}>"), word))


def words(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, word, clean) of all words."""
    out = docs.select(key, F.posexplode(T.tokens(F.col(text))).alias("pos", "word"))
    return out.withColumn("clean", T.alpha_lower(F.col("word")))


def spellings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(clean) of the distinct words of at least three letters."""
    clean = F.array_distinct(F.transform(T.tokens(F.col(text)), T.alpha_lower))
    return docs.select(F.explode(clean).alias("clean")).where(F.length("clean") >= 3).distinct()


def single(lexicon: DataFrame) -> DataFrame:
    return lexicon.where(~F.col("term").contains(" "))


def exact(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term): terms that a word of at least three letters equals."""
    clean = F.array_distinct(F.transform(T.tokens(F.col(text)), T.alpha_lower))
    found = docs.select(key, F.explode(clean).alias("term")).where(F.length("term") >= 3)
    return found.join(sized(single(lexicon).select("term").distinct()), "term", "left_semi").select(key, "term").distinct()


def _letters(column: str) -> Column:
    """The letters a to z that a text has, as bits. Two texts differ in no more of them than their Indel distance."""
    return F.expr(" | ".join(f"if(contains({column}, '{chr(97 + k)}'), {1 << k}, 0)" for k in range(26)))


def close(forms: DataFrame, terms: DataFrame, threshold: int, column: str, also: list[str]) -> DataFrame:
    """forms (column, also, ...) with term and ord of each of terms (term, ord, also) whose Indel ratio reaches threshold.

    Terms stand under every length that a form can have, so that the join is one by length; letters and the edit
    distance bound the ratio before it is computed.
    """
    lengths = F.expr(f"filter(sequence(1, greatest(1, length(term) * {200 - threshold} div {threshold})), l -> 200 * least(l, length(term)) >= {threshold} * (l + length(term)))")
    dealt = sized(terms.select("term", "ord", *also, _letters("term").alias("_of_term"), F.explode(lengths).alias("_length")))
    near = forms.withColumns({"_length": F.length(column), "_of_form": _letters(column)}).join(dealt, ["_length", *also])
    allowed = F.floor((F.length(column) + F.length("term")) * (100 - threshold) / 100)
    near = near.where((F.bit_count(F.col("_of_form").bitwiseXOR(F.col("_of_term"))) <= allowed) & F.expr(may_reach(column, "term", threshold)))
    return near.where(reaches(F.col(column), F.col("term"), threshold)).drop("_length", "_of_form", "_of_term")


def fuzzy(spellings: DataFrame, lexicon: DataFrame, threshold: int = THRESHOLD, column: str = "clean") -> DataFrame:
    """(column, term, score): the best single-word term by Indel ratio at or above threshold, the first of equals.

    Exact spellings are left out, as they need no correction.
    """
    terms = single(lexicon)
    s = spellings.select(F.col(column).alias("s")).where(F.length("s") >= 3).distinct()
    s = s.join(sized(terms.select(F.col("term").alias("s")).distinct()), "s", "left_anti")
    near = close(s, terms, threshold, "s", [])
    near = near.withColumn("ratio", 200 * lcs(F.col("s"), F.col("term")) / (F.length("s") + F.length("term")))
    best = near.groupBy("s").agg(F.max(F.struct("ratio", -F.col("ord"), "term")).alias("b"))
    return best.select(F.col("s").alias(column), F.col("b.term").alias("term"), F.floor("b.ratio").cast("int").alias("score"))


def corrections(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, pos, word, corrected, term, score) of the words that the lexicon changes."""
    near = sized(fuzzy(spellings(docs, text), lexicon, threshold))
    return words(docs, key, text).join(near, "clean").select(key, "pos", "word", T.recased(F.col("word"), F.col("term")).alias("corrected"), "term", "score")


def window_forms(text: Column, sizes: list[int]) -> Column:
    """Distinct windows of words of each size, of the lower-cased text, as structs (n, g)."""
    of_size = lambda w, n: F.transform(F.array_distinct(T.ngrams(w, F.lit(n))), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    return T.let(T.tokens(F.lower(text)), lambda w: F.concat(*[of_size(w, n) for n in sizes]))


def windows(docs: DataFrame, lexicon: DataFrame, key: str, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, term) of terms of several words that some window of as many lower-cased words comes close to."""
    terms = lexicon.where(F.col("term").contains(" ")).select("term", "ord", F.size(T.tokens(F.col("term"))).alias("n"))
    sizes = sorted(r.n for r in terms.select("n").distinct().collect())
    if not sizes:
        return docs.select(key, F.lit("").alias("term")).limit(0)
    grams = docs.select(key, F.explode(window_forms(F.col(text), sizes)).alias("x")).select(key, "x.*")
    return close(grams, terms, threshold, "g", ["n"]).select(key, "term").distinct()


def _rebuilt(text: Column, changes: Column, keep_lines: bool) -> Column:
    """The text with words replaced by place: joined by one space, or with the white space that stood between them."""
    new = F.map_from_entries(F.transform(changes, lambda x: F.struct(x["pos"], x["corrected"])))
    put = lambda given: F.transform(given, lambda w, i: F.coalesce(F.try_element_at(new, i), w))
    if not keep_lines:
        return F.array_join(put(T.tokens(text)), " ")
    spaces = F.regexp_extract_all(text, F.lit(f"({T.SPACE})"), F.lit(1))
    led = F.coalesce(text.rlike(f"^{T.SPACE}"), F.lit(False)).cast("int")  # white space before the first word
    between = lambda w, i: F.concat(F.coalesce(F.get(spaces, i - 1 + led), F.lit("")), w)
    whole = F.array_join(F.transform(put(T.tokens(text)), between), "")
    return F.concat(whole, F.coalesce(F.get(spaces, F.size(T.tokens(text)) - 1 + led), F.lit("")))


def corrected(docs: DataFrame, lexicon: DataFrame, key: str, kind: str, text: str = "text", threshold: int = THRESHOLD, keep_lines: bool = False) -> DataFrame:
    """docs with corrected_text, corrections (from, to, type, score) and matched terms; keys must be unique and not null.

    Words are joined by one space, as the text is rebuilt from its words; keep_lines keeps the white space between them.
    """
    terms = single(lexicon).where(F.length("term") >= 3).select(F.col("term").alias("clean"), "term", F.lit(None).cast("int").alias("score"))
    known = terms.distinct().union(fuzzy(spellings(docs, text), lexicon, threshold))
    found = known.limit(IN_ROW + 1).collect()
    in_row = len(found) <= IN_ROW
    if in_row:
        entry = lambda w: looked_up(T.alpha_lower(w), {r.clean: {"term": r.term, "score": r.score} for r in found}, "struct<term:string,score:int>")
        hits = F.filter(F.transform(T.tokens(F.col(text)), lambda w, i: F.struct(i.alias("pos"), w.alias("word"), entry(w).alias("e"))), lambda x: x["e"].isNotNull())
        shaped = F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), F.when(x["e"]["score"].isNotNull(), T.recased(x["word"], x["e"]["term"])).alias("corrected"), x["e"]["score"].alias("score"), x["e"]["term"].alias("term")))
        out = docs.withColumn("_hits", shaped)
    else:
        w = words(docs, key, text).join(sized(known), "clean")
        w = w.withColumn("corrected", F.when(F.col("score").isNotNull(), T.recased(F.col("word"), F.col("term"))))
        out = docs.join(w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "corrected", "score", "term"))).alias("_hits")), key, "left")
    out = out.withColumn("_hits", F.coalesce("_hits", F.array().cast(f"array<{_CHANGE}>")))
    several = windows(docs, lexicon, key, text, threshold).groupBy(key).agg(F.collect_set("term").alias("_several"))
    none = lexicon.where(F.col("term").contains(" ")).isEmpty()
    out = out.withColumn("_several", F.array().cast("array<string>")) if none else out.join(several, key, "left")
    changes = F.filter("_hits", lambda x: x["score"].isNotNull())
    matched = F.array_sort(F.array_union(F.transform("_hits", lambda x: x["term"]), F.coalesce("_several", F.array().cast("array<string>"))))
    listed = F.transform(changes, lambda x: F.struct(x["word"].alias("from"), x["corrected"].alias("to"), F.lit(kind).alias("type"), x["score"].alias("score")))
    return out.select(*docs.columns, T.let(changes, lambda c: _rebuilt(F.col(text), c, keep_lines)).alias("corrected_text"), listed.alias("corrections"), matched.alias("matched"))


def _stage(spelled: DataFrame, lexicon: DataFrame, kind: str, threshold: int) -> rows.Stage | None:
    """What a lexicon says of spellings, in hand; None if that is too much to hold."""
    terms = single(lexicon).where(F.length("term") >= 3).select(F.col("term").alias("clean"), "term", F.lit(None).cast("int").alias("score"))
    known = terms.distinct().union(fuzzy(spelled, lexicon, threshold)).limit(BROADCAST_ROWS + 1).collect()
    several = lexicon.where(F.col("term").contains(" ")).select("term", F.size(T.tokens(F.col("term"))).alias("n")).distinct().limit(IN_ROW + 1).collect()
    if len(known) > BROADCAST_ROWS or len(several) > IN_ROW:
        return None
    return rows.Stage(kind, {r.clean: (r.term, r.score) for r in known}, [(r.term, r.n) for r in several], threshold)


def cascaded(docs: DataFrame, drugs: DataFrame, diseases: DataFrame, text: str = "text", threshold: int = THRESHOLD, held: list[rows.Held] = []) -> DataFrame | None:  # noqa: B006
    """docs with corrected_text, corrections, matched_drugs, matched_diseases and what is held; None if the lexicons or what they change
    are too large for the row. Two passes over the texts, and none is shuffled: one for the spellings, one that corrects.
    The second lexicon also gets the spellings that the first one brings in."""
    spelled = rows.spelled(docs, text).persist()
    try:
        one = _stage(spelled, drugs, "drug", threshold)
        if one is None:
            return None
        new = {t for t, score in one.known.values() if score is not None}
        brought = {rows.alpha_lower(w) for t in new for x in (t, t.upper(), rows.capitalized(t)) for w in rows.tokens(x)}
        more = docs.sparkSession.createDataFrame([(c,) for c in sorted(brought)], "clean string")
        two = _stage(spelled.union(more), diseases, "disease", threshold)
    finally:
        spelled.unpersist()
    return None if two is None else rows.corrected(docs, text, [one, two], ["matched_drugs", "matched_diseases"], held)


def cascade(docs: DataFrame, drugs: DataFrame, diseases: DataFrame, key: str, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(key, corrected_text, corrections, matched_drugs, matched_diseases): drugs first, then diseases on what came out."""
    out = cascaded(docs.select(key, text), drugs, diseases, text, threshold)
    return joined_cascade(docs, drugs, diseases, key, text, threshold) if out is None else out.drop(text)


def joined_cascade(docs: DataFrame, drugs: DataFrame, diseases: DataFrame, key: str, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """cascade for lexicons of any size; keys must be unique and not null."""
    one = corrected(docs.select(key, text), drugs, key, "drug", text, threshold).select(key, F.col("corrected_text").alias("_t"), F.col("corrections").alias("_first"), F.col("matched").alias("matched_drugs"))
    two = corrected(one, diseases, key, "disease", "_t", threshold)
    return two.select(key, "corrected_text", F.concat("_first", "corrections").alias("corrections"), "matched_drugs", F.col("matched").alias("matched_diseases"))


def whole_word(text: Column, term: str) -> Column:
    """Single words as whole words, others as substrings, of a lower-cased text."""
    return text.contains(term) if " " in term else text.rlike(rf"\b\Q{term}\E\b")


def found_terms(text: Column, terms: list[str]) -> Column:
    """Terms in a text, longest first, then by name. One contains for each term before its regular expression."""
    hits = lambda low: F.array_compact(F.array(*[F.when(low.contains(t) & whole_word(low, t), F.lit(t)) for t in longest_first(terms)]))
    return T.let(F.lower(F.coalesce(text, F.lit(""))), hits)


def whole_terms(text: Column, candidates: Column) -> Column:
    """found_terms from the terms that the lower-cased text holds, in their order."""
    whole = lambda low, t: F.contains(t, F.lit(" ")) | F.rlike(low, F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b")))
    return T.let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(candidates, lambda t: whole(low, t)))


def longest_first(terms: list[str]) -> list[str]:
    return sorted(set(terms), key=lambda t: (-len(t), t))


def detected(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """docs with corrected_text (the text as it is), no corrections and matched: what is left without a fuzzy matcher."""
    hits = T.let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda low: F.array_compact(F.array(*[F.when(low.contains(t) & whole_word(low, t), F.lit(t)) for t in sorted(set(terms))])))
    none = F.array().cast("array<struct<from:string,to:string,type:string,score:int>>")
    return docs.withColumns({"corrected_text": F.col(text), "corrections": none, "matched": hits})


def substring_matches(text: Column, terms: list[str]) -> Column:
    """Terms that occur anywhere in the lower-cased text, sorted."""
    return T.let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(F.array(*map(F.lit, sorted(set(terms)))), lambda t: F.contains(low, t)))


def layer_matches(text: Column, terms: list[str]) -> Column:
    """Terms that are a run of letters of the lower-cased text, sorted."""
    return F.array_sort(F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z]+"), F.lit(0)), F.array(*map(F.lit, sorted(set(terms))))))


def merged_diagnoses(given: Column, candidates: Column) -> Column:
    """given, and each candidate that neither holds nor is held by one of those so far (case aside), in title case."""
    return F.aggregate(candidates, given, lambda a, d: F.when(F.exists(a, lambda x: F.contains(F.lower(x), F.lower(d)) | F.contains(F.lower(d), F.lower(x))), a).otherwise(F.array_append(a, F.initcap(d))))


def new_medicines(names: Column, candidates: Column) -> Column:
    """Candidates that are in no name so far (case aside); each one kept counts for the next."""
    after = lambda taken: F.aggregate(candidates, taken, lambda a, d: F.when(F.exists(a, lambda x: F.contains(x, F.lower(d))), a).otherwise(F.array_append(a, F.lower(d))))
    return T.let(after(F.transform(names, lambda x: F.lower(x))), lambda a: F.slice(a, F.size(names) + 1, F.size(a)))


def token_corrections(spellings: DataFrame, medical: list[str], english: list[str], cutoff: float = 0.84, english_cutoff: float = 0.93, noise_only: bool = False) -> DataFrame:
    """(token, corrected, source) of distinct tokens that a layer takes: exact medical, exact English, close medical,
    close English. noise_only leaves tokens of letters alone in the last one."""
    t = spellings.select("token").distinct().where(T.is_word_token(F.col("token")))
    t = t.withColumn("clean", T.alpha_lower(T.letters_for_digits(F.col("token")))).where("clean <> ''")
    is_in = lambda terms: F.col("clean").isin(sorted({x.lower() for x in terms}))
    close = t.where(~is_in(medical) & ~is_in(english)).select("clean").distinct()
    close = close.withColumn("m", close_match(F.col("clean"), [x.lower() for x in medical], cutoff)).withColumn("e", close_match(F.col("clean"), [x.lower() for x in english], english_cutoff))
    t = t.join(close, "clean", "left")
    term = F.when(is_in(medical) | is_in(english), F.col("clean")).otherwise(F.coalesce("m", F.when(F.lit(noise_only) & F.col("token").rlike(r"^\p{L}+$"), F.lit(None)).otherwise(F.col("e"))))
    source = F.when(is_in(medical), "medical").when(is_in(english), "english").when(F.col("m").isNotNull(), "medical").otherwise("english")
    return t.select("token", T.case_like(F.col("token"), term).alias("corrected"), source.alias("source")).where("corrected is not null")


def parsed(docs: DataFrame, medical: list[str], english: list[str], key: str, text: str = "text", **cutoffs) -> DataFrame:
    """docs with corrected_text, corrections, dictionary_matches, medical_matches, english_matches; keys unique and not null."""
    distinct = docs.select(F.explode(F.array_distinct(T.pieces(F.col(text)))).alias("token")).distinct()
    known = token_corrections(distinct, medical, english, **cutoffs).where("corrected <> token")
    found = known.limit(IN_ROW + 1).collect()
    kind = "struct<pos:int,from:string,to:string,source:string>"
    if len(found) <= IN_ROW:
        entry = lambda w: looked_up(w, {r.token: {"to": r.corrected, "source": r.source} for r in found}, "struct<to:string,source:string>")
        hits = F.filter(F.transform(T.pieces(F.col(text)), lambda w, i: F.struct(i.alias("pos"), w.alias("from"), entry(w).alias("e"))), lambda x: x["e"].isNotNull())
        out = docs.withColumn("_changes", F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["from"].alias("from"), x["e"]["to"].alias("to"), x["e"]["source"].alias("source"))))
    else:
        split = docs.select(key, F.posexplode(T.pieces(F.col(text))).alias("pos", "token")).join(sized(known), "token")
        one = split.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("token").alias("from"), F.col("corrected").alias("to"), "source"))).alias("_changes"))
        out = docs.join(one, key, "left").withColumn("_changes", F.coalesce("_changes", F.array().cast(f"array<{kind}>")))
    new = F.map_from_entries(F.transform("_changes", lambda x: F.struct(x["pos"], x["to"])))
    final = T.let(new, lambda m: F.array_join(F.transform(T.pieces(F.col(text)), lambda w, i: F.coalesce(F.try_element_at(m, i), w)), ""))
    out = out.withColumn("corrected_text", F.trim(final))
    listed = F.transform("_changes", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["source"].alias("source")))
    final = F.col("corrected_text")
    return out.select(*docs.columns, "corrected_text", listed.alias("corrections"), substring_matches(final, medical + english).alias("dictionary_matches"), layer_matches(final, medical).alias("medical_matches"), layer_matches(final, english).alias("english_matches"))
