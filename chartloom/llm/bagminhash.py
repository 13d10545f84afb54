"""Near-duplicates by BagMinHash signatures of word-shingle bags.

Each (shingle, band of weights) has a Poisson process of its own over signature components: points arrive with a rate
of one per component and unit of weight, and each point is placed on a unit of weight by halving the band again and
again with further hash bits. A document sees the points below its weight of the shingle; each component keeps the
earliest. Two documents agree in a component with the probability of their weighted Jaccard similarity. A process is
followed only while its next point comes before the document's latest component, so long documents take about one
point a shingle.

Signatures are banded; documents of a bucket are candidates. A bucket's pairs are never listed: members are verified
against one leader, components are formed, and members whose components still differ are compared by their whole
signatures, block by block inside the workers. Only pairs whose signatures agree nearly enough get verified.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checked, fresh, lean, text_batches, texts, written
from .components import components

_G = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = tuple(np.uint64(2 * k + 1) for k in (0x4F1BBCDCBFA53E0B, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x369DEA0F31A53F85))


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    seed: int = 1
    #: Candidates agree in this share of signature components at least. At the similarity asked for, agreement is 0.80
    #: with a deviation of 0.04, so about one link in 100,000 falls below.
    agreement: float = 0.62
    #: Members of a bucket that one group compares with one another or with as many others; up to small members a
    #: bucket's likely pairs are listed, beyond that they are verified in place.
    block: int = 512
    small: int = 64
    #: Ids that a broadcast may hold; beyond that the tables are shuffled.
    broadcast_rows: int = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def bag(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and how often each occurs; fewer words than size make one shingle of all."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k % 5] ^ np.uint64(k + 1)
        s = s * _G ^ s >> np.uint64(29)
    return np.unique(mix(s), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int, seed: int = 1) -> np.ndarray:
    """A row of size arrival times for each bag; infinite for an empty one."""
    h = np.full((len(bags), size), np.inf)
    doc = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
    if not len(doc):
        return h
    element, weight = np.concatenate([x for x, _ in bags]), np.concatenate([w for _, w in bags])
    parts = []
    k = 0
    while len(element):  # band 0 holds the first unit of weight, band k those from 2^(k-1) to 2^k
        low, width = (0, 1) if k == 0 else (2 ** (k - 1), 2 ** (k - 1))
        start = mix(element + np.uint64((int(_G) * (seed * 64 + k)) % (1 << 64)))
        parts.append((doc, start, weight, np.full(len(doc), low), np.full(len(doc), width)))
        more = weight > low + width
        doc, element, weight, k = doc[more], element[more], weight[more], k + 1
    doc, start, weight, low, width = (np.concatenate(x) for x in zip(*parts))
    t, flat, point, step = np.zeros(len(doc)), h.reshape(-1), 0, 1
    while len(doc):
        at = np.arange(point + 1, point + 1 + step, dtype=np.uint64)
        a = mix(start[:, None] + _G * (np.uint64(2) * at))
        b = mix(start[:, None] + _G * (np.uint64(2) * at + np.uint64(1)))
        gap = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * width)[:, None]
        times = t[:, None] + np.cumsum(gap, 1)
        part = ((b >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        unit = low[:, None] + (b & (width - 1).astype(np.uint64)[:, None]).astype(np.int64)
        here = (unit < weight[:, None]) & (times < h.max(1)[doc][:, None])
        np.minimum.at(flat, (doc[:, None] * size + part)[here], times[here])
        t = times[:, -1]
        on = t < h.max(1)[doc]
        doc, start, weight, low, width, t = doc[on], start[on], weight[on], low[on], width[on], t[on]
        point += step
        step = 1 if point < 2 else 8
    return h


def band_hashes(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = np.ascontiguousarray(h).view(np.uint64).reshape(len(h), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, (len(h), bands)).copy()
    for k in range(rows):
        out = mix(out ^ v[:, :, k])
    return out.view(np.int64)


def short_signatures(h: np.ndarray) -> np.ndarray:
    """Two bytes of each component, for estimates."""
    return (mix(np.ascontiguousarray(h).view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Overlap of two bags: the sum of lesser counts by the sum of larger ones; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def fingerprint(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def signed(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(key, fp, n, bands, sig): the fingerprint of the word sequence, the number of shingles, the band hashes, the short signature."""

    def run(batches):
        for batch in batches:
            all_words = [words_of(t) for t in texts(batch.column(1))]
            bags = [bag(w, settings.words) for w in all_words]
            times = signatures(bags, settings.bands * settings.rows, settings.seed)
            hashes = band_hashes(times, settings.bands, settings.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(fingerprint, all_words), pa.binary()),
                    pa.array([int(c.sum()) for _, c in bags], pa.int64()),
                    pa.array([list(r) if len(c) else None for r, (_, c) in zip(hashes.tolist(), bags)], pa.list_(pa.int64())),
                    pa.array([r.tobytes() if len(c) else None for r, (_, c) in zip(short_signatures(times), bags)], pa.binary()),
                ],
                names=["key", "fp", "n", "bands", "sig"],
            )

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return text_batches(source).mapInArrow(lean(run, 128), f"key {source.schema[0].dataType.simpleString()}, fp binary, n long, bands array<long>, sig binary")


def overlap_of_sorted(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays with repeats."""
    merged = np.concatenate([x, y])
    if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
        merged.sort()
        both = int((merged[1:] == merged[:-1]).sum())
    else:
        both = int(np.minimum(*(np.bincount(np.searchsorted(u, z), minlength=len(u)) for u in [np.unique(merged)] for z in (x, y))).sum())
    return both / max(1, len(x) + len(y) - both)


def sources(docs: DataFrame, wanted: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """The texts of those rows of docs whose key is one of wanted (fp, key)."""
    wanted = written(wanted.select("key"), "wanted")
    keys = wanted.select(F.col("key").alias("_key")).distinct()
    if wanted.count() <= settings.broadcast_rows:
        keys = F.broadcast(keys)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return text_batches(source.join(keys, source["key"].eqNullSafe(keys["_key"]), "left_semi").select("text"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """Those of pairs (a, b: fingerprints) whose bags overlap enough, as a written table. nodes: (fp, key)."""
    ends = written(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct(), "ends")
    ends = checked(ends, settings.broadcast_rows)

    def prints(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(words_of(t)) for t in texts(batch.column(0))], pa.binary()), batch.column(0)], names=["fp", "text"])

    found = sources(docs, nodes.join(ends, "fp", "left_semi"), key, text, settings).mapInArrow(lean(prints), "fp binary, text string")
    found = written(found.join(ends, "fp", "left_semi"), "texts")
    one = pairs.join(found.withColumnsRenamed({"fp": "a", "text": "text_a"}), "a")
    two = one.join(found.withColumnsRenamed({"fp": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        last: tuple[str | None, tuple] = (None, ())
        for batch in batches:
            keep = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3))):
                if y != last[0]:
                    last = (y, bag(words_of(y), settings.words))
                keep.append(weighted_jaccard(bag(words_of(x), settings.words), last[1]) >= settings.similarity)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return written(text_batches(two).mapInArrow(lean(check), "a binary, b binary").distinct(), "links")


def likely(pairs: DataFrame, settings: Settings) -> DataFrame:
    """(a, b) of pairs (a, b, sig, sig_b) whose signatures agree nearly enough."""
    size = settings.bands * settings.rows

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, size) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= settings.agreement * size, pa.bool_()))

    return text_batches(pairs.select("a", "b", "sig", "sig_b")).mapInArrow(lean(agree, 4096), "a binary, b binary")


def across(unsettled: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """Candidate pairs (a, b) of one bucket and different components, from (bucket, fp, component, n, sig, bands).

    Only members of different components need to meet. The members of a bucket's largest component are dealt into
    blocks, and so are all others of the bucket; each block of the others meets each of the former, each of its own
    kind, and itself, in groups of bounded size. So a large component with a few others beside it costs rows in
    proportion to its members. Signatures are compared there; a pair is looked at in the first bucket it shares. In
    small buckets the likely pairs are the result. Members of large ones bring their bags (as 32-bit hashes, which can only add to
    an overlap), so that overlaps are counted in place, and pairs whose components have met already are passed over;
    the result is then one pair for each two components that meet.
    """
    size, least, ratio = settings.bands * settings.rows, settings.agreement * settings.bands * settings.rows, settings.similarity
    parts = unsettled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    blocks = parts.groupBy("bucket").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("most"))
    others = F.greatest(F.lit(1), F.ceil((F.col("members") - F.col("most.n")) / settings.block)).cast("int")
    blocks = blocks.select("bucket", F.col("most.component").alias("first"), F.ceil(F.col("most.n") / settings.block).cast("int").alias("of_first"), others.alias("of_others"), (F.col("members") > settings.small).alias("large"))
    blocks = checked(written(blocks, "blocks"), settings.broadcast_rows)
    placed = unsettled.join(blocks, "bucket").withColumn("is_first", F.col("component") == F.col("first")).drop("first")
    placed = written(placed, "placed")
    wanted = written(placed.where("large").select("fp").distinct(), "large")
    bags = placed.select(F.lit(b"").alias("fp"), F.lit(b"").alias("bag")).limit(0)
    if not wanted.isEmpty():

        def bag_rows(batches):
            for batch in batches:
                all_words = [words_of(t) for t in texts(batch.column(0))]
                found = [bag(w, settings.words) for w in all_words]
                data = [np.sort(np.repeat(e >> np.uint64(32), c).astype(np.uint32)).tobytes() for e, c in found]
                yield pa.RecordBatch.from_arrays([pa.array(map(fingerprint, all_words), pa.binary()), pa.array(data, pa.binary())], names=["fp", "bag"])

        wanted = checked(wanted, settings.broadcast_rows)
        bags = sources(docs, nodes.join(wanted, "fp", "left_semi"), key, text, settings).mapInArrow(lean(bag_rows), "fp binary, bag binary")
        bags = written(bags.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "bags")
    # blocks of the first component have numbers below 0
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("is_first"), F.col("of_first")).otherwise(F.col("of_others"))).cast("int")
    to_first, to_others = (F.sequence(F.lit(0), F.col(n) - 1) for n in ("of_first", "of_others"))
    met = F.when(F.col("is_first"), to_others).otherwise(F.concat(to_others, F.transform(to_first, lambda k: -k - 1)))
    dealt = placed.join(bags, "fp", "left").withColumn("own", F.when(F.col("is_first"), -own - 1).otherwise(own)).withColumn("other", F.explode(met))
    dealt = dealt.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"),
        "fp", "component", "n", "sig", "bands", F.when(F.col("large"), F.col("bag")).alias("bag"),
    )

    def compare(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        names = {c: k for k, c in enumerate(sorted({r[5] for r in rows}))}
        if len(names) < 2:
            return []
        above = list(range(len(names)))

        def top(k: int) -> int:
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        component = np.array([names[r[5]] for r in rows])
        n, second = np.array([r[6] for r in rows]), np.array([r[3] for r in rows])
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(-1, size)
        bands = np.array([r[8] for r in rows], np.int64)
        bucket, inner, out = rows[0][0], rows[0][1] == rows[0][2], []
        held = [np.frombuffer(r[9], np.uint32) if r[9] is not None else None for r in rows]
        for k in range(len(rows)):
            if not inner and second[k]:
                continue
            to = (component != component[k]) & (np.minimum(n, n[k]) >= ratio * np.maximum(n, n[k]))
            to &= (np.arange(len(rows)) > k) if inner else second
            at = np.flatnonzero(to)
            at = at[(sig[at] == sig[k]).sum(1) >= least]
            if len(at):
                same = bands[at] == bands[k]
                at = at[bands[k][same.argmax(1)] == bucket]
            for j in at:
                if held[k] is not None and held[j] is not None:
                    x, y = top(component[k]), top(component[j])
                    if x == y or overlap_of_sorted(held[k], held[j]) < ratio:
                        continue
                    above[x] = y
                out.append((rows[k][4], rows[j][4]))
        return out

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield from emit(compare(held))
                    held = []
                held.append(row)
        if held:
            yield from emit(compare(held))

    def emit(pairs):
        for k in range(0, len(pairs), 8192):
            a, b = zip(*pairs[k : k + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(map(max, a, b), pa.binary()), pa.array(map(min, a, b), pa.binary())], names=["a", "b"])

    groups = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return text_batches(groups).mapInArrow(lean(run), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, fp, class_id, class_size) for each row of docs; class_id is the least key of the class.

    Classes are connected components of the links: pairs of texts whose bags of word shingles overlap by similarity
    or more. Texts of the same words (case aside) are one node, so copies are not compared with one another. Texts
    with fewer words than a shingle make one shingle. Null texts and texts without a word have a null fp and are each
    a class of their own. Null keys are kept; a class without any key has a null class_id. Repeated rows come out
    once for each. No group is cut: members of buckets of any size are verified against a leader first, and all likely
    pairs whose components still differ after that are verified one by one.
    """
    rows = written(signed(docs, key, text, settings), "signed")
    nodes = rows.where("fp is not null").groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first(F.struct("n", "bands", "sig")).alias("s"))
    nodes = nodes.select("fp", "key", "copies", "s.*")
    nodes = written(nodes, "nodes")
    buckets = nodes.select("fp", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("fp").alias("leader"), F.max("fp").alias("other")).where("leader <> other").select("bucket", "leader")
    members = written(buckets.join(shared, "bucket"), "members")
    marks = written(nodes.join(checked(written(members.select("fp").distinct(), "in_buckets"), settings.broadcast_rows), "fp", "left_semi").select("fp", "n", "sig", "bands"), "marks")
    named = nodes.select("fp", "key")
    close = (F.least("n", "n_b") / F.greatest("n", "n_b")) >= settings.similarity
    marks_b = marks.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    tried = members.where("fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")).distinct()
    tried = written(likely(tried.join(marks.withColumnRenamed("fp", "a"), "a").join(marks_b, "b").where(close), settings), "pairs")
    stars = components(verified(tried, docs, named, key, text, settings), broadcast_rows=settings.broadcast_rows)
    stars = written(stars.withColumnRenamed("node", "fp"), "components")
    labelled = members.select("bucket", "fp").join(checked(stars, settings.broadcast_rows), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = written(labelled, "labelled")
    unsettled = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    unsettled = labelled.join(checked(written(unsettled, "open"), settings.broadcast_rows), "bucket")
    pairs = across(unsettled.join(marks, "fp"), docs, named, key, text, settings)
    done = written(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "done")
    pairs = written(pairs.join(checked(done, settings.broadcast_rows), ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        new = verified(pairs, docs, named, key, text, settings)
        if not new.isEmpty():
            stars = components(new.union(stars.select("fp", "component")), broadcast_rows=settings.broadcast_rows)
            stars = written(stars.withColumnRenamed("node", "fp"), "components")
    classes = nodes.select("fp", "key", "copies").join(checked(stars, settings.broadcast_rows), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = classes.groupBy("component").agg(F.min("key").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = classes.select("fp", "component").join(ids, "component").select("fp", "class_id", "class_size")
    out = rows.select("key", "fp").join(classes, "fp", "left")
    return out.select(F.col("key").alias(key), "fp", F.when(F.col("fp").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that stay, unchanged: the one with the least key of each class, and every text without a word.

    Of repeated rows (same key, same words) one stays. A class whose keys are all null keeps one row as well.
    """
    classes = written(near_duplicates(docs, key, text, settings), "classes")
    counted = classes.where("fp is not null").groupBy(F.col(key).alias("_key"), F.col("fp").alias("_fp")).agg(F.first("class_id").alias("_class"), F.count("*").alias("_n"))
    # of several texts with the class's least key, or with null keys only, the least fingerprint stays
    best = classes.where("fp is not null").where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("fp").alias("best"))
    out = counted.join(best, counted["_class"].eqNullSafe(best["class_id"]) & (counted["_fp"] == best["best"]) & counted["_key"].eqNullSafe(best["class_id"]), "left")
    out = written(out.select("_key", "_fp", "_n", F.col("best").isNotNull().alias("_stays")), "decisions")
    drop, again = out.where("not _stays").select("_key", "_fp"), out.where("_stays and _n > 1").select("_key", "_fp")
    at, mark = docs.columns.index(text), fresh("_fp", docs.columns)
    names = [*docs.columns, mark]

    def prints(batches):
        for batch in batches:
            fps = pa.array([fingerprint(words_of(t)) for t in texts(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=names)

    if drop.count() <= settings.broadcast_rows:
        drop = F.broadcast(drop)
    marked = text_batches(docs).mapInArrow(lean(prints), T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())]))
    same = lambda t: marked[key].eqNullSafe(t["_key"]) & (marked[mark] == t["_fp"])
    kept = marked.join(drop, same(drop), "left_anti")
    if again.isEmpty():
        return kept.drop(mark)
    kept = written(kept, "kept")
    few = F.broadcast(again) if again.count() <= settings.broadcast_rows else again
    same = lambda t: kept[key].eqNullSafe(t["_key"]) & (kept[mark] == t["_fp"])
    return kept.join(few, same(few), "left_anti").drop(mark).union(kept.join(few, same(few), "left_semi").dropDuplicates([key, mark]).drop(mark))
