"""Lines of a document with the section each belongs to, and the numeric side of page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines

#: Sections in the order in which they are tried, each with the substrings that tell it.
SECTIONS = {
    "medication": ["rx", "prescription", "dosage", "tablet", "capsule"],
    "diagnosis": ["diagnosis", "impression", "assessment"],
    "plan": ["plan", "follow up", "follow-up", "recommendation"],
    "vitals": ["bp", "pulse", "temperature", "mmhg"],
}
CONFIDENCE = 0.8


def section(line: Column) -> Column:
    low, out = F.lower(line), None
    for name, words in SECTIONS.items():
        hit = F.greatest(*[low.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def segmented(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each non-blank line: start_line (its number among those lines), content, segment_type, confidence."""
    keep = [c for c in df.columns if c != text]
    out = df.select(*keep, F.posexplode(lines(F.col(text))).alias("start_line", "content"))
    return out.select("*", F.col("start_line").alias("end_line"), section(F.col("content")).alias("segment_type"), F.lit(CONFIDENCE).alias("confidence"))


def gaps(boxes: DataFrame, line: str, x: str, w: str, factor: float = 1.0) -> DataFrame:
    """boxes with space_after: the next box of the line begins more than factor mean widths beyond this one's end."""
    order = W.partitionBy(line).orderBy(x, w)
    mean = F.avg(w).over(W.partitionBy(line))
    return boxes.withColumn("space_after", F.coalesce(F.lead(x).over(order) - (F.col(x) + F.col(w)) > factor * mean, F.lit(False)))


def islands(rows: DataFrame, page: str, y: str, ink: str, share: float = 0.1, least: int = 10) -> DataFrame:
    """Runs of consecutive rows with more ink than share of the page's largest: (page, top, bottom) of those at least so high."""
    top = F.max(ink).over(W.partitionBy(page))
    inked = rows.withColumn("_on", F.col(ink) > share * top).where("_on")
    run = F.col(y) - F.row_number().over(W.partitionBy(page).orderBy(y))
    found = inked.withColumn("_run", run).groupBy(page, "_run").agg(F.min(y).alias("top"), (F.max(y) + 1).alias("bottom"))
    return found.where(F.col("bottom") - F.col("top") >= least).select(page, "top", "bottom")


def area_threshold(boxes: DataFrame, page: str, area: str, share: float = 0.6, floor: float = 60.0) -> DataFrame:
    """The least area of a character on each page: share of the twentieth percentile, at least floor."""
    return boxes.groupBy(page).agg(F.greatest(F.lit(floor), share * F.percentile(area, 0.2)).alias("min_area"))


def best_strategy(rows: DataFrame, line: str, strategy: str, ordinal: str, score: str) -> DataFrame:
    """The strategy with the best score for each line; the earliest of equals."""
    best = F.max_by(strategy, F.struct(F.col(score), -F.col(ordinal)))
    return rows.groupBy(line).agg(best.alias("strategy"), F.max(score).alias("score"))
