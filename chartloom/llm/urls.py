"""URL filter: rules by host and path first, then gradient-boosted trees on lexical features of the URL."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import lean, text_batches, written

#: (verdict, host, path)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct labelled URLs that the trees are fitted on, about; a hash of the URL decides which ones.
TRAIN_URLS = 20_000
#: Suffixes of at most 32 characters whose statistics a broadcast may hold (4 MB or so); others are joined.
SUFFIXES = 1 << 16
#: Parts that labelled URLs fall into: a URL's suffix statistics for the fit come from the other parts.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "host_entropy", "hyphens", "params", "fragment", "longest_part", "upper_ratio", "suffix_rate", "suffix_count")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path together) that fits, as text; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    return F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, longest)], F.lit(None).cast("string"))


def suffix_of(host: Column) -> Column:
    """The last label of a host, without user and port."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.substring(F.substring_index(bare, ".", -1), 1, 32)


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def features(url: str, host: str, path: str, n: float | None, blocked: float | None, prior: float) -> list[float]:
    """n, blocked: how many labelled URLs have this one's suffix, and how many of them are blocked; null for none."""
    tail = url[url.find("://") + 3 + len(host) + len(path) :] if "://" in url else ""
    query = tail.partition("#")[0].removeprefix("?")
    digits = sum(map(str.isdigit, url))
    rate, count = ((blocked or 0.0) + 10 * prior) / ((n or 0.0) + 10), n or 0.0
    return [
        len(url), len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + 1, digits / max(1, len(url)),
        sum(map(str.isdigit, host)), entropy(url), entropy(host), url.count("-"), sum(1 for p in query.split("&") if p), "#" in tail,
        max(map(len, re.split(r"[./?&=#_-]", url))), sum(map(str.isupper, url)) / max(1, len(url)), rate, math.log1p(count),
    ]


@dataclass
class Model:
    trees: gbt.Trees
    prior: float
    #: (suffix, n, blocked) of all labelled URLs, written to the shared folder.
    suffixes: DataFrame


def train(labelled: DataFrame, rows: int = TRAIN_URLS, fold: int | None = None) -> Model:
    """From columns url, host, path, blocked (0 to 1; none of them null). fold: a part to learn nothing from, for tests.

    Each distinct URL counts once, however often it stands there, with the mean of its labels. Suffix statistics count
    all of them; the trees are fitted on about rows of them, drawn by a hash of the URL against a threshold that follows
    from their number, so what reaches the driver doesn't grow with the input.
    """
    part = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(FOLDS)).cast("int")
    distinct = labelled.groupBy("url", "host", "path").agg(F.avg("blocked").alias("blocked")).withColumns({"suffix": suffix_of(F.col("host")), "fold": part})
    distinct = written(distinct if fold is None else distinct.where(F.col("fold") != fold), "labelled")
    n, blocked = distinct.agg(F.count("*"), F.sum("blocked")).first()
    prior = ((blocked or 0) + 1) / (n + 2)
    by_fold = distinct.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))
    totals = written(by_fold.groupBy("suffix").agg(F.sum("n").cast("double").alias("n"), F.sum("blocked").alias("blocked")), "suffixes")
    share = min(1.0, rows / max(1, n))
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = distinct.where(draw)
    own = by_fold.select("suffix", "fold", F.col("n").alias("_n"), F.col("blocked").alias("_b"))
    drawn = drawn.join(with_statistics(drawn.select("suffix").distinct(), totals), "suffix").join(own, ["suffix", "fold"]) if n else drawn.withColumns({"n": F.lit(0.0), "_b": F.lit(0.0), "_n": F.lit(0)}).limit(0)
    sample = drawn.select("url", "host", "path", drawn["blocked"].alias("y"), (F.col("n") - F.col("_n")).alias("n"), (F.col("all_blocked") - F.col("_b")).alias("b")).collect() if n else []
    sample = sorted(sample)
    x = np.array([features(r.url, r.host, r.path, r.n, r.b, prior) for r in sample], float).reshape(-1, len(FEATURES))
    return Model(gbt.fit(x, np.array([r.y for r in sample], float)), prior, totals)


def with_statistics(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """rows with n and all_blocked of their suffix, null for an unknown one. The most frequent suffixes are broadcast and
    only the others' rows are joined with the rest, so that no key of that join is hot."""
    totals = totals.select("suffix", "n", F.col("blocked").alias("all_blocked"))
    if totals.count() <= SUFFIXES:
        return rows.join(F.broadcast(totals), "suffix", "left")
    top = totals.orderBy(F.desc("n"), "suffix").limit(SUFFIXES)
    top = F.broadcast(totals.sparkSession.createDataFrame(top.collect(), top.schema))
    others = rows.join(top, "suffix", "left_anti").join(totals.join(top, "suffix", "left_anti"), "suffix", "left")
    return rows.join(top, "suffix").unionByName(others)


def held_out_error(labelled: DataFrame, threshold: float = 0.5) -> float:
    """The share of distinct labelled URLs (url, host, path, blocked) that a model gets wrong which has seen the other parts."""
    wrong = total = 0
    for fold in range(FOLDS):
        part = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(FOLDS)).cast("int") == fold
        held = labelled.where(part).groupBy("url", "host", "path").agg(F.avg("blocked").alias("blocked"))
        out = scored(held.withColumn("key", F.lit(0)), train(labelled, fold=fold), ["blocked"]).select((F.col("score") >= threshold).alias("p"), (F.col("blocked") >= 0.5).alias("y"))
        bad, n = out.agg(F.sum((F.col("p") != F.col("y")).cast("int")), F.count("*")).first()
        wrong, total = wrong + (bad or 0), total + n
    return wrong / max(1, total)


def scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of rows (url, host, path) and score, the trees' block probability."""
    known = rows.sparkSession.sparkContext.broadcast((model.trees, model.prior))
    source = with_statistics(rows.withColumn("suffix", suffix_of(F.col("host"))), model.suffixes).select("url", "host", "path", "n", "all_blocked", F.struct(*keep).alias("keep"))

    def run(batches):
        trees, prior = known.value
        for batch in batches:
            x = np.array([features(*r, prior) for r in zip(*(batch.column(k).to_pylist() for k in range(5)))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(trees.probability(x), pa.float64())], names=["keep", "score"])

    out = text_batches(source).mapInArrow(lean(run, 8192), f"keep {source.schema['keep'].dataType.simpleString()}, score double")
    return out.select("keep.*", "score")


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict, score (the trees' block probability) for each row of pages.

    A rule's verdict stands; URLs without a rule are blocked if the trees' probability reaches threshold. labelled
    (url, blocked) trains the trees; without it the URLs that a rule covers are the labelled ones. Repeated URLs count once. Null URLs and those
    without :// have an empty host and path, fit no rule and are scored as they are (null as empty). With no labels, or
    labels of one kind, the score is the smoothed base rate.
    """
    base = pages.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"))
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("by_rule", reduce(lambda c, r: c.when(F.col("rule") == r[1] + r[2], r[0]), rules, F.when(F.lit(False), "")))
    if labelled is None:
        train_on = ruled.where("rule is not null").withColumn("blocked", (F.col("by_rule") == "block").cast("int"))
    else:
        train_on = labelled.where("url is not null and blocked is not null").select("url", "blocked").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = ruled.withColumn("key", F.col(f"`{key}`")).select("key", "url", "host", "path", "rule", "by_rule")
    out = scored(rows.withColumn("page", F.struct("key", "host", "path", "rule", "by_rule")), train(train_on), ["page"])
    verdict = F.coalesce("page.by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("page.key").alias(key), "page.host", "page.path", "page.rule", verdict.alias("verdict"), "score")
