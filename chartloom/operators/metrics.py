"""Accuracy: character error rate, recall of extracted fields, classification report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def distance(a: Column, b: Column) -> Column:
    """The edit distance. Texts that are nearly alike need only a band of the table; a band too narrow says so."""
    within = lambda k: F.nullif(F.levenshtein(a, b, k), F.lit(-1))
    return F.coalesce(within(8), within(64), F.levenshtein(a, b))


def character_error_rate(truth: Column, prediction: Column) -> Column:
    return distance(F.trim(truth), F.trim(prediction)) / F.greatest(F.length(F.trim(truth)), F.lit(1))


def cer_by_type(df: DataFrame, kind: str, truth: str, prediction: str) -> DataFrame:
    out = df.groupBy(kind).agg(F.avg(character_error_rate(F.col(truth), F.col(prediction))).alias("mean_cer"), F.count("*").alias("documents"))
    return out.withColumn("accuracy", (1 - F.col("mean_cer")) * 100)


def flattened(record: Column) -> Column:
    """Set of key:value and key.sub:value for all values of an extraction record that are neither null nor empty."""
    return let(record, _flattened)


def _flattened(record: Column) -> Column:
    one = lambda name, c: F.array(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ":"), c)))
    scalars = [one(k, record[k]) for k in ("patient_name", "age", "gender", "date", "doctor_name", "hospital")]
    vitals = [one(f"vitals.{k}", record["vitals"][k]) for k in ("bp", "temp", "pulse")]


    def named(values: Column, name: str) -> Column:
        return F.transform(values, lambda x: F.when(x != "", F.concat(F.lit(name + ":"), x)))

    lists = [named(record[k], k) for k in ("diagnosis", "instructions")]
    meds = [named(record["medicines"][k], f"medicines.{k}") for k in ("name", "dosage", "frequency")]
    return F.array_distinct(F.array_compact(F.concat(*scalars, *vitals, *[F.coalesce(x, F.array().cast("array<string>")) for x in lists + meds])))


def recall(truth: Column, prediction: Column) -> Column:
    """Share of the truth's entries that the prediction has; 0 for an empty truth."""
    return F.size(F.array_intersect(truth, prediction)) / F.greatest(F.size(truth), F.lit(1))


def classification_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """label, precision, recall, f1, support for each label in the truth or the prediction."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    by = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    out = by.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    out = out.withColumns({"precision": ratio("hit", "predicted"), "recall": ratio("hit", "support")})
    both = F.col("precision") + F.col("recall")
    return out.select("label", "precision", "recall", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both).alias("f1"), "support")
