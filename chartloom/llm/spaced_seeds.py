"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask of span s keeps some of s neighbouring token positions and ignores the rest, so one substituted token leaves
the hashes of other positions and masks intact. Hashes of the benchmark are joined with those of the documents; each
hit names a diagonal (token position in the document less that in the item), and both texts are compared token by
token along it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Settings:
    #: For items of a window or more. One span for all masks; 1 keeps a token, 0 ignores it. With three of 13 tokens
    #: substituted, whichever they are, one of the masks still fits somewhere.
    masks: tuple[str, ...] = ("11000101", "10100011")
    #: For items of exact_below tokens up to a window, of any spans; they hold for a quarter of 8 to 12 tokens likewise.
    short_masks: tuple[str, ...] = ("11011", "1100011", "1111")
    #: Items under so many tokens are matched whole.
    exact_below: int = 8
    #: Tokens of the compared window (or the whole item, if shorter) and the share of them that must be equal.
    window: int = 13
    share: float = 0.75
    #: Seeds, and rows of ids, that a broadcast may hold (24 bytes each or so); beyond that both sides are shuffled.
    broadcast_seeds: int = 1_000_000
    broadcast_rows: int = 500_000
    #: Parts that each seed of a shuffled join is split into, so that a frequent one isn't one task's.
    salts: int = 16
    #: Hits, each with its item, that one row brings to a document, about.
    row_hits: int = 512


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for a null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: Column, mask: str) -> Column:
    """One hash for each position at which the whole mask fits."""
    at = [k for k, c in enumerate(mask) if c == "1"]
    last = F.size(hashes) - len(mask)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in at], F.lit(mask)))).otherwise(F.array().cast("array<bigint>"))


def masks_of(length: int, settings: Settings) -> tuple[str, ...]:
    """The masks for items of so many tokens."""
    if length < settings.exact_below:
        return ("1" * length,)
    return settings.short_masks if length < settings.window else settings.masks


def seeded(rows: DataFrame, id_name: str, at: str, masks: set[str]) -> DataFrame:
    """(id, position, seed) of rows (id, h); arrays of masks of one span stand one after another, so a position is a remainder."""

    def of_span(span):
        ours = [seeds(F.col("h"), m) for m in sorted(masks) if len(m) == span]
        out = rows.select(F.col(id_name), (F.size("h") - (span - 1)).alias("_n"), F.posexplode(F.concat(*ours)).alias("_k", "seed"))
        return out.select(id_name, (F.col("_k") % F.col("_n")).alias(at), "seed")

    return reduce(DataFrame.unionByName, [of_span(n) for n in sorted(set(map(len, masks)))])


def overlap(h: Column, g: Column, shift: Column, settings: Settings) -> Column:
    """The best window along a diagonal: struct of equal tokens, window length, and (negated) first token in the document."""
    low = F.greatest(F.lit(0), shift)
    length = F.least(F.size(h), shift + F.size(g)) - low
    window = F.least(F.lit(settings.window), F.size(g))
    equal = F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.when(F.get(h, low + k) == F.get(g, low + k - shift), 1).otherwise(0))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), length - window))
    best = lambda e: F.array_max(F.transform(starts, lambda s: F.struct(F.aggregate(F.slice(e, s + 1, window), F.lit(0), lambda a, x: a + x).alias("n_equal"), (-(low + s)).alias("back"))))
    return F.transform(F.array(equal), lambda e: F.struct(best(e).alias("best"), window.alias("window")))[0]


def row_of(docs: DataFrame, key: str, text: str) -> Column:
    """A row's key and a hash of its text, so that rows without a key, or with one of many, make no group."""
    return F.struct(docs[f"`{key}`"].alias("key"), F.xxhash64(docs[f"`{text}`"]).alias("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, settings: Settings) -> DataFrame:
    """(doc, item, window, n_equal, first_token): the best window along each diagonal that is an overlap. doc: see row_of."""
    if len({len(m) for m in settings.masks}) != 1 or any(m[0] != "1" or m[-1] != "1" for m in settings.masks):
        raise ValueError("masks must have one span and begin and end with 1")
    items = written(benchmark.select(F.col(f"`{item}`").alias("item"), token_hashes(F.col(f"`{item_text}`")).alias("g")).distinct(), "items")
    size = F.least(F.size("g"), F.lit(max(settings.window, settings.exact_below)))
    lengths = [r.n for r in items.select(size.alias("n")).where("n > 0").distinct().collect()]
    if not lengths:
        lengths = [settings.window]
    parts = [seeded(items.where(size == n).withColumnRenamed("g", "h"), "item", "q", set(masks_of(n, settings))) for n in lengths]
    known = written(reduce(DataFrame.unionByName, parts).distinct(), "seeds")
    row = row_of(docs, key, text)
    hashed = docs.select(row.alias("doc"), token_hashes(F.col(f"`{text}`")).alias("h"))
    small = known.count() <= settings.broadcast_seeds
    found = seeded(hashed, "doc", "p", {m for n in lengths for m in masks_of(n, settings)})
    if small:
        hits = found.join(F.broadcast(known), "seed")
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("doc", "p"), F.lit(settings.salts)).cast("int")).join(dealt, ["seed", "salt"])
    hits = written(hits.select("doc", "item", (F.col("p") - F.col("q")).alias("shift")).distinct(), "hits")
    # a document meets its hits in portions of bounded size
    portions = F.ceil(F.count("*").over(Window.partitionBy("doc")) / settings.row_hits)
    hits = hits.withColumn("portion", F.pmod(F.xxhash64("item", "shift"), portions))
    placed = hits.join(F.broadcast(items) if small else items, hits["item"].eqNullSafe(items["item"])).select("doc", "portion", F.struct(hits["item"].alias("item"), "shift", "g").alias("c"))
    placed = written(placed.groupBy("doc", "portion").agg(F.collect_list("c").alias("cs")), "placed")
    few = placed.count() <= settings.broadcast_rows
    wanted = placed.select(F.col("doc").alias("_doc"))
    source = docs.select(row.alias("doc"), F.col(f"`{text}`").alias("text"))
    source = source.join(F.broadcast(wanted) if few else wanted, source["doc"].eqNullSafe(wanted["_doc"]), "left_semi")
    found = source.select("doc", token_hashes(F.col("text")).alias("h")).join(placed.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")))
    found = found.select("doc", F.explode(F.transform("cs", lambda c: F.when((c["shift"] < F.size("h")) & (c["shift"] + F.size(c["g"]) > 0), F.struct(c["item"].alias("item"), overlap(F.col("h"), c["g"], c["shift"], settings).alias("o"))))).alias("f"))
    found = found.where("f is not null").select("doc", "f.item", "f.o.window", "f.o.best.n_equal", (-F.col("f.o.best.back")).alias("first_token"))
    least = F.when(F.col("window") < settings.exact_below, F.col("window")).otherwise(F.ceil(F.col("window") * settings.share))
    return found.where(F.col("n_equal") >= least)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, item_id, first_token, n_window, n_equal, similarity): the best overlap of each document and item that share one.

    An overlap is a window of 13 tokens along one diagonal (the whole item, if shorter) of which 75 % or more are
    equal. Items under 8 tokens must be found whole and unchanged. The masks miss none of these. Tokens are lower-cased
    runs of letters and digits; items without one are never reported. Null texts count as empty. Null keys are kept, null item
    ids as well; a key's repeated rows are reported once, by the best of them. An empty table gives an empty result.
    Seeds of the benchmark are broadcast when there are at most broadcast_seeds of them, else both sides are shuffled.
    """
    found = overlaps(docs, benchmark, key, text, item, item_text, settings)
    best = found.groupBy(F.col("doc.key").alias("doc"), "item").agg(F.max(F.struct((F.col("n_equal") / F.col("window")).alias("similarity"), "n_equal", (-F.col("first_token")).alias("back"), "window")).alias("b"))
    return best.select(
        F.col("doc").alias(key), F.col("item").alias(item), (-F.col("b.back")).cast("long").alias("first_token"), F.col("b.window").cast("long").alias("n_window"),
        F.col("b.n_equal").cast("long").alias("n_equal"), F.col("b.similarity").alias("similarity"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs without an overlap with the benchmark, unchanged; rows of one key, or none, are told apart by their texts."""
    bad = written(overlaps(docs, benchmark, key, text, "item_id", "text", settings).select(F.col("doc").alias("_bad")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= settings.broadcast_rows else bad
    return docs.join(bad, row_of(docs, key, text).eqNullSafe(bad["_bad"]), "left_anti")
