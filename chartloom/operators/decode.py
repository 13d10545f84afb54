"""Words from character candidates, and the lexicon's say in them.

Scores of positions add up without a language model, so the best beam is the best candidate of each position, whatever
the beam's width.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alpha_upper

LEAST = 1e-8


@dataclass(frozen=True)
class Thresholds:
    mean: float = 0.80
    least: float = 0.60
    non_primary: float = 0.45
    distance: int = 2


def _confidence(x: Column) -> Column:
    return F.coalesce(x["confidence"], F.lit(0.0))


def best_candidates(word: Column) -> Column:
    """The first best candidate of each position that has any."""
    some = F.filter(word, lambda p: F.size(p) > 0)
    return F.transform(some, lambda p: F.aggregate(p, F.get(p, F.lit(0)), lambda a, x: F.when(F.greatest(_confidence(x), F.lit(LEAST)) > F.greatest(_confidence(a), F.lit(LEAST)), x).otherwise(a)))


def raw_words(df: DataFrame, candidates: str = "candidates") -> DataFrame:
    """df with raw_word, score, raw_confidence, mean_confidence, min_confidence; score is -Infinity and the last two null without positions."""
    best = F.col("_best")
    conf = F.transform(best, _confidence)
    score = F.aggregate(conf, F.lit(0.0), lambda a, c: a + F.log(F.greatest(c, F.lit(LEAST))))
    out = df.withColumn("_best", best_candidates(F.coalesce(F.col(candidates), F.array().cast(df.schema[candidates].dataType))))
    empty = F.coalesce(F.size(F.col(candidates)), F.lit(0)) <= 0
    raw = F.array_join(F.transform(best, lambda x: x["character"]), "")
    out = out.withColumns({"raw_word": raw, "score": F.when(empty, F.lit(float("-inf"))).otherwise(score)})
    n = F.greatest(F.length(alpha_upper(F.col("raw_word"))), F.lit(1))
    mean = F.when(F.size(best) > 0, F.aggregate(conf, F.lit(0.0), lambda a, c: a + c) / F.size(best)).when(~empty, 0.0)
    return out.withColumns({"raw_confidence": F.when(empty, 0.0).otherwise(F.exp(F.col("score") / n)), "mean_confidence": mean, "min_confidence": F.when(F.size(best) > 0, F.array_min(conf)).when(~empty, 0.0)}).drop("_best")


def nearest(words: DataFrame, lexicon: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """(word, near, distance): the closest term with the same first letter and a length that differs by one at most.

    Equal distances: the first by name. words hold normalised words; terms of the lexicon (term) are normalised too.
    An equi-join on (length, first letter); only distinct words meet the lexicon.
    """
    w = words.select(F.col(word).alias("w")).where(F.length("w") >= 2).distinct()
    w = w.select("w", F.explode(F.array(*[F.length("w") + k for k in (-1, 0, 1)])).alias("_n"), F.substring("w", 1, 1).alias("_f"))
    terms = lexicon.where(F.length("term") >= 2).select("term", F.length("term").alias("_n"), F.substring("term", 1, 1).alias("_f")).distinct()
    near = w.join(terms, ["_n", "_f"]).withColumn("d", F.levenshtein("w", "term", distance)).where("d >= 0")
    return near.groupBy("w").agg(F.min(F.struct("d", "term")).alias("m")).select(F.col("w").alias(word), F.col("m.term").alias("near"), F.col("m.d").alias("distance"))


def decoded(df: DataFrame, lexicon: DataFrame, candidates: str = "candidates", t: Thresholds = Thresholds()) -> DataFrame:
    """df with the raw word's columns and decoded_word, lexicon_word, distance, replacement_applied, replacement_reason.

    lexicon: (term, is_primary). A term is primary if any of its rows is. Terms are normalised to upper-case letters.
    """
    terms = lexicon.select(alpha_upper(F.col("term")).alias("term"), "is_primary").where("term <> ''").groupBy("term").agg(F.max("is_primary").alias("is_primary"))
    out = raw_words(df, candidates).withColumn("normal", alpha_upper(F.col("raw_word")))
    near = nearest(out, terms, "normal", t.distance).withColumnsRenamed({"near": "_near", "distance": "_dist"})
    first = nearest(out, terms.where("is_primary"), "normal", t.distance).withColumnsRenamed({"near": "_prime", "distance": "_prime_dist"})
    near = near.join(terms.select(F.col("term").alias("_near"), F.col("is_primary").alias("_near_primary")), "_near")
    known = terms.select(F.col("term").alias("normal"), F.col("is_primary").alias("_known"))
    out = out.join(known, "normal", "left").join(near, "normal", "left").join(first, "normal", "left")
    low = (F.col("mean_confidence") <= t.mean) | (F.col("min_confidence") <= t.least)
    is_known, has_near = F.col("_known").isNotNull(), F.col("_near").isNotNull()
    override = is_known & ~F.col("_known") & F.col("_prime").isNotNull() & (F.col("_prime_dist") <= 1) & low
    allowed = F.when(F.col("_near_primary"), low).otherwise((F.col("_dist") <= 1) & (F.col("min_confidence") <= t.non_primary))
    kept = F.when(F.col("normal") != "", F.col("normal")).otherwise(F.col("raw_word"))
    replaced = override | (~is_known & has_near & allowed)
    return out.select(
        *df.columns, "raw_word", "score", "raw_confidence", "mean_confidence", "min_confidence",
        F.when(override, F.col("_prime")).when(~is_known & has_near & allowed, F.col("_near")).otherwise(kept).alias("decoded_word"),
        F.when(override, F.col("_prime")).when(is_known, F.col("normal")).otherwise(F.col("_near")).alias("lexicon_word"),
        F.when(override, F.col("_prime_dist")).when(is_known, 0).otherwise(F.col("_dist")).alias("distance"),
        F.coalesce(replaced, F.lit(False)).alias("replacement_applied"),
        F.when(override, "low-confidence-primary-fallback").when(~is_known & has_near & allowed, "low-confidence-lexicon-fallback").when(~is_known & has_near, "high-confidence-kept-raw").alias("replacement_reason"),
    )


def top_candidates(probabilities: Column, labels: list[str], k: int) -> Column:
    """The k most probable (character, confidence); equal characters (by their first one) are merged by the larger value."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("minus"), i.alias("at"), F.get(F.array(*map(F.lit, labels)), i).alias("character")))
    best = F.slice(F.array_sort(pairs), 1, k)
    names = F.array_distinct(F.transform(best, lambda x: x["character"]))
    merged = F.transform(names, lambda c: F.struct(c.alias("character"), F.array_max(F.transform(F.filter(best, lambda x: x["character"] == c), lambda x: -x["minus"])).alias("confidence")))
    return merged
