"""Language-model scores of whole documents: a smoothed unigram base and a gated recurrent model.

Counts are taken over all training documents, and the recurrent model learns from each of them once. A round takes the
share of the documents that a hash of the text deals it: every input partition trains on its own from one common start,
and the weights are averaged by tokens in a tree; that mean is the start of the next round. So the work grows with the
corpus and a few models reach the driver. Words frequent in all texts (a bounded table) are looked up in the workers;
the rest are joined with the counts. As the table ranks words by all texts, held-out ones included, a joined word has
at most the share of one in table_words of all rows, and no key of the join is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches, written
from .gru import Gru

#: No word holds white space, so this stands for the end of a text.
END = b"\n"
#: Words that a worker counts at a time.
COUNT_WORDS = 4_000_000


@dataclass(frozen=True)
class Settings:
    #: Words with a number of their own in the recurrent model; the others share one and are told apart by their counts.
    vocabulary: int = 8192
    hidden: int = 24
    #: Rounds of training between which weights are averaged; each training text goes through backpropagation in one.
    rounds: int = 4
    #: Words whose counts the workers hold, at most.
    table_words: int = 1 << 19
    #: Bytes of texts that a worker gathers before it scores them together; one text is never cut.
    chunk_bytes: int = 8 << 20
    train_tokens: int = 2_000_000
    seed: int = 5


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text of an Arrow column has, and all of them one after another, A-Z lower-cased."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = parts.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy())
    return np.bincount(row[there.to_numpy(zero_copy_only=False)], minlength=len(column)), flat.filter(there)


def found_at(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among the known ones; -1 for others."""
    return pc.fill_null(pc.index_in(words.cast(pa.binary()), value_set=known), -1).to_numpy()


def gathered(batches, size: int):
    """Batches put together up to about so many bytes, so that words need to be told apart less often."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def word_counts(source: DataFrame) -> DataFrame:
    """(word, c, seen) over (text, held_out): how often the word stands in training texts, and in all. Each row also
    counts one end. Partial sums leave the workers."""

    def count(batches):
        held: dict[bool, list] = {False: [], True: []}
        size, ends = 0, {False: 0, True: 0}

        def flush():
            for out, parts in held.items():
                if parts:
                    found = pc.value_counts(pa.chunked_array(parts))
                    words, n = found.field(0).cast(pa.binary()), found.field(1)
                    for k in range(0, len(n), 65536):
                        yield pa.RecordBatch.from_arrays([words[k : k + 65536], n[k : k + 65536], pa.array([out] * len(n[k : k + 65536]))], names=["word", "n", "held_out"])
                parts.clear()

        for batch in batches:
            texts, out = pc.fill_null(batch.column(0), ""), batch.column(1)
            for side in (False, True):
                some = texts.filter(out if side else pc.invert(out))
                ends[side] += len(some)
                if len(flat := words_of(some)[1]):
                    held[side].append(flat)
                    size += len(flat)
            if size > COUNT_WORDS:
                yield from flush()
                size = 0
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([END, END], pa.binary()), pa.array([ends[False], ends[True]], pa.int64()), pa.array([False, True])], names=["word", "n", "held_out"])

    found = text_batches(source.select("text", "held_out")).mapInArrow(lean(count), "word binary, n long, held_out boolean")
    found = found.groupBy("word").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("n"))).alias("c"), F.sum("n").alias("seen"))
    return written(found.where("seen > 0"), "counts")


def frequent(counts: DataFrame, most: int) -> tuple[pa.Table, int]:
    """(word, c) of all words from the least number seen on at which there are no more than most, by falling c, and that
    number. END is left out.

    Numbers are taken together in steps of about a hundredth, which leaves those below 64 apart and some thousand steps
    at any size of the corpus.
    """
    own = counts.where(F.col("word") != F.lit(END))
    step = F.floor(F.log2(F.col("seen")) * 64)
    sizes = sorted(((r.s, r.n) for r in own.groupBy(step).agg(F.min("seen").alias("s"), F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for s, n in sizes:
        if (total := total + n) > most:
            break
        least = s
    return own.where(F.col("seen") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")]), least


@dataclass
class Tables:
    """What workers need. words: (word, c) of the table by falling c; the first of them have numbers in the model."""

    words: pa.Table
    ends: int
    total: int
    distinct: int
    settings: Settings

    def __post_init__(self):
        count = self.words.column("c").to_numpy()
        n = int((count[: self.settings.vocabulary - 2] > 0).sum())
        self.own = self.words.column("word").cast(pa.binary()).combine_chunks()
        self.end, self.unknown, self.n_vocabulary = 0, 1, n + 2
        rest = self.total - self.ends - int(count[:n].sum())
        self.start = np.array([max(1, self.ends), max(1, rest), *count[:n]], float)
        self.base_log = math.log10(self.total + self.distinct + 1)
        self.rare_log = math.log10(rest + max(0, self.distinct - n - 1) + 1)
        # by place in the table, the last for a word outside: log10 of c and one, whether c > 0, the number in the model
        count = np.append(count, 0)
        self.log_count, self.known = np.log10(count + 1.0), count > 0
        self.number = np.full(len(count), self.unknown, np.int32)
        self.number[:n] = np.arange(2, n + 2)


def trained(training: DataFrame, tables: Tables) -> Gru:
    """The model after all rounds. Weights are averaged by tokens, sixteen rows at a time."""
    s = tables.settings
    model = Gru(tables.start, s.hidden, s.seed)
    known = (tables.start, tables.own[: tables.n_vocabulary - 2], tables.end, tables.unknown)
    for k in range(s.rounds):
        mean = averaged(training, known, model.pack(), k, s)
        if mean is not None:
            model.unpack(mean)
    return model


def with_ends(n: np.ndarray, numbers: np.ndarray, end: int) -> np.ndarray:
    """The numbers of rows of n words each, with end after each row."""
    out = np.full(len(numbers) + len(n), end, np.int32)
    there = np.ones(len(out), bool)
    there[np.cumsum(n + 1) - 1] = False
    out[there] = numbers
    return out


def averaged(training: DataFrame, vocabulary: tuple, start: bytes, k: int, s: Settings) -> np.ndarray | None:
    """The mean of the weights that the partitions reach from start over the texts of round k; None without any."""
    known = training.sparkSession.sparkContext.broadcast((vocabulary, start))

    def fit(batches):
        (counts, own, end, unknown), flat = known.value
        model, done, held, size = Gru(counts, s.hidden, s.seed).unpack(np.frombuffer(flat, np.float32)), 0, [], 0
        for batch in batches:
            n, found = words_of(batch.column(0))
            at = found_at(found, own)
            held.append(with_ends(n, np.where(at < 0, unknown, at + 2), end))
            size += len(held[-1])
            if size > s.train_tokens:
                done += model.train(np.concatenate(held), end)
                held, size = [], 0
        if held:
            done += model.train(np.concatenate(held), end)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([done], pa.int64()), pa.array([model.pack() if done else None], pa.binary())], names=["part", "n", "weights"])

    rows = text_batches(training.where(F.pmod(F.xxhash64("text"), F.lit(s.rounds)) == k).select("text"))
    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(lean(fit), "part long, n long, weights binary").where("n > 0")

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n"].sum())
        total = sum(np.frombuffer(w, np.float32) * (k / n) for w, k in zip(group["weights"], group["n"]))
        return pd.DataFrame({"part": [group["part"].iloc[0] // 16], "n": [n], "weights": [total.astype(np.float32).tobytes()]})

    found = written(found, "weights")
    while parts > 16:
        found = written(found.groupBy(F.floor(F.col("part") / 16)).applyInPandas(mean, "part long, n long, weights binary"), "weights")
        parts = -(-parts // 16)
    last = sorted(found.collect(), key=lambda r: r.part)
    n = sum(r.n for r in last)
    return sum(np.frombuffer(r.weights, np.float32) * (r.n / n) for r in last) if last else None


def scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learns where held_out is false.

    A text's tokens are its words, A-Z lower-cased, and one end; a null text is empty and has the end alone. Logarithms
    are decimal. base_score is the sum of log10((c + 1) / (N + V + 1)). score is the recurrent model's: words outside
    its vocabulary get the probability of the unknown word times (c + 1) / (their tokens + their words + 1). As weights
    are averaged over partitions, it depends a little on how the input is split; base_score and the counts do not.
    Repeated rows, null keys and further columns are of no consequence. A null held_out counts as false. Without
    training rows N and V are 0 and all words are unknown. Very long texts take memory in proportion to their own
    length (a few dozen bytes a word).
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = word_counts(source)
    n, v = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0]
    words, least = frequent(counts, settings.table_words)
    tables = Tables(words, ends or 0, n or 0, v or 0, settings)
    model = trained(source.where("not held_out").select("text"), tables)
    weights = docs.sparkSession.sparkContext.broadcast((tables, model.pack()))
    key_type = source.schema["key"].dataType

    def score(batches):
        t, flat = weights.value
        net = Gru(t.start, settings.hidden, settings.seed).unpack(np.frombuffer(flat, np.float32))
        uid = TaskContext.get().partitionId() << 40
        for group in gathered(batches, settings.chunk_bytes):
            keys, held, texts = (group.column(k).combine_chunks() for k in (0, 2, 1))
            n, flat = words_of(texts)
            m, flat = len(n), flat.dictionary_encode()
            words, at = flat.dictionary, flat.indices.to_numpy()
            of = found_at(words, t.own)[at]
            row = np.repeat(np.arange(m), n)
            log, number = t.log_count[of], t.number[of]
            outside, missing = number == t.unknown, of < 0
            base = np.bincount(row, log, m) + math.log10(t.ends + 1) - (n + 1) * t.base_log
            lm = np.bincount(row[outside], log[outside], m) - np.bincount(row[outside], minlength=m) * t.rare_log
            known = np.bincount(row[t.known[of]], minlength=m) + (t.ends > 0)
            docs = np.split(with_ends(n, number, t.end), np.cumsum(n + 1)[:-1])
            lm += net.score(docs, t.end) / math.log(10)
            for k in range(0, m, 4096):
                a, b = k, min(m, k + 4096)
                arrays = [pa.array(uid + np.arange(a, b)), keys[a:b], held[a:b], pa.array(n[a:b] + 1), pa.array(base[a:b]), pa.array(lm[a:b]), pa.array(known[a:b])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.int64())], names=names)
            pair, tf = np.unique(row[missing] * len(words) + at[missing], return_counts=True)
            for k in range(0, len(tf), 65536):
                some, times = pair[k : k + 65536], tf[k : k + 65536]
                nothing = [pa.nulls(len(some), a.type) for a in arrays[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(uid + some // len(words)), *nothing, words.take(pa.array(some % len(words))).cast(pa.binary()), pa.array(times)], names=names)
            uid += m

    names = ["uid", "key", "held_out", "n_tokens", "base", "lm", "n_known", "word", "tf"]
    stream = text_batches(source).mapInArrow(lean(score), f"uid long, key {key_type.simpleString()}, held_out boolean, n_tokens long, base double, lm double, n_known long, word binary, tf long")
    stream = written(stream, "stream")
    rest = counts.where((F.col("seen") < least) & (F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c")
    rare = stream.where("word is not null").select("uid", "word", "tf").join(rest, "word")
    rare = rare.groupBy("uid").agg(F.sum("tf").alias("found"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("logs"))
    rows = stream.where("word is null").join(rare, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tables.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("lm") + logs).alias("score"),
    )
