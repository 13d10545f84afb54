"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed byte n-grams (one to three bytes of the lower-cased text, all that is
not a letter turned into spaces). Each language has several centroids, found by spherical k-means. The nearest one by
cosine gives the language; texts farther from it than that language's limit are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches, texts

DIMENSIONS = 4096
#: Bytes below 128 that are not letters become spaces; the lead and trail bytes of other characters stay.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    centroids: int = 4
    #: Labelled rows that centroids are fitted on: so many a language, and so many in all, about (a hash of key and text
    #: decides, so rows that repeat both come together); each language has twice its centroids in any case.
    per_language: int = 500
    rows: int = 4000
    rounds: int = 8
    #: A text is rejected below this share of its language's lowest thousandth of training cosines; texts shorter than
    #: full_bytes have sparse vectors, so the limit falls in proportion to their length.
    reject: float = 0.6
    full_bytes: int = 500


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """n-gram counts by hashed dimension."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + a[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - 12)
    mixed = [x * np.uint32(0x2C1B3C6D) >> shift for x in (a + np.uint32(7), two ^ two >> np.uint32(15), three ^ three >> np.uint32(15))]
    return sum(np.bincount(x, minlength=DIMENSIONS) for x in mixed)


def weighted(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array(rows, np.float32).reshape(-1, DIMENSIONS)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limit: np.ndarray
    full_bytes: int = 500

    def predict(self, all_texts: list[str]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, cosine and whether the text is rejected. A text without a letter is und, 0 and rejected."""
        lettered = [k for k, t in enumerate(all_texts) if has_letter(t)]
        lang, score, out = ["und"] * len(all_texts), np.zeros(len(all_texts)), [True] * len(all_texts)
        if not lettered or not self.languages:
            return lang, score, out
        cosine = weighted([counts(all_texts[k]) for k in lettered], self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        for k, b, c in zip(lettered, best, cosine[np.arange(len(best)), best]):
            own = self.owner[b]
            lang[k], score[k], out[k] = self.languages[own], min(1.0, max(0.0, float(c))), bool(c < self.limit[own] * min(1.0, len(all_texts[k].encode("utf-8", "replace")) / self.full_bytes))
        return lang, score, out


def clustered(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from rows far apart, so it is deterministic."""
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def learn(labelled: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Document frequencies over all labelled rows; centroids from a bounded sample of them for each language.

    Rows with a null text or language, or without a letter, teach nothing. Without any other the model knows no
    language and rejects all.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def frequencies(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for t in texts(batch.column(0)):
                if has_letter(t):
                    seen += counts(t) > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[at], n], pa.int64())], names=["dim", "n"])

    df = {r.dim: r.n for r in text_batches(rows.select("text")).mapInArrow(lean(frequencies), "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    n_docs = df.pop(-1, 0)
    idf = np.array([np.log((n_docs + 1) / (df.get(d, 0) + 1)) + 0.1 for d in range(DIMENSIONS)], np.float32)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    each = min(settings.per_language, max(2 * settings.centroids, settings.rows // len(sizes)))
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(each / n)) for name, n in sizes.items()])
    sample = rows.where(draw < share).select("lang", "text")

    def vectors(batches):
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if has_letter(t):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([weighted([counts(t)], idf)[0].astype(np.float16).tobytes()], pa.binary())], names=["lang", "vector"])

    by: dict[str, list[np.ndarray]] = {}
    for r in sorted(sample.mapInArrow(lean(vectors), "lang string, vector binary").collect()):
        by.setdefault(r.lang, []).append(np.frombuffer(r.vector, np.float16).astype(np.float32))
    if not by:
        return Model([], idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    names, centroids, owner, limit = sorted(by), [], [], []
    for k, name in enumerate(names):
        x = np.stack(by[name])
        c = clustered(x, settings.centroids, settings.rounds)
        centroids.append(c)
        owner += [k] * len(c)
        limit.append(settings.reject * float(np.quantile((x @ c.T).max(1), 0.001)))
    return Model(names, idf, np.concatenate(centroids), np.array(owner), np.array(limit), settings.full_bytes)


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, rejected for each row; only the text is an input. Null texts and those without a letter are und."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))

    def run(batches):
        for batch in batches:
            lang, score, out = known.value.predict(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[key, "lang_pred", "score", "rejected"])

    return text_batches(source).mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def kept_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose text is not rejected, unchanged."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([not x for x in known.value.predict(texts(batch.column(at)))[2]], pa.bool_()))

    return text_batches(docs).mapInArrow(lean(keep), docs.schema)
