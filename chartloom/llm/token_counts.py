"""Token counts by a map-side two-tier lookup.

The vocabulary's merges never cross from a character other than a space to a space, nor a line feed, so the number of
tokens of a text is the sum over its pre-tokens (spaces and the run after them, or a line feed). Tier one is a
broadcast hash table with the lengths of frequent pre-tokens; tier two a cache in each worker, which encodes what it
has not seen. The table comes from a bounded summary of each task's texts; no pre-token is a shuffle's key.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches, texts, written

SPLIT = re.compile(r" *[^ \n]+|\n| +").findall
TABLE_SIZE = 1 << 16
TASK_PIECES = 1 << 14
CACHE_PIECES = 200_000
#: Longer pre-tokens are neither counted for the table nor remembered.
PIECE_CHARS = 64


def pretokens(text: str) -> list[str]:
    """A space goes before the text as the model does it; its own sign for a space counts as one."""
    return SPLIT(" " + text.replace("▁", " ")) if text else []


class Lengths(dict):
    """Tier one in the dict itself; misses go to the cache, then to the encoder."""

    def __init__(self, model: bytes, table: dict[str, int], limit: int = CACHE_PIECES):
        super().__init__(table)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cache: dict[str, int] = {}
        self.limit = limit

    def encode(self, piece: str) -> int:
        """A line feed beside the piece keeps the encoder from adding or dropping a space; its own tokens are taken off."""
        if piece[0] == " ":
            return len(self.processor.encode(piece[1:] + "\n")) - 1
        return len(self.processor.encode("\n" + piece)) - 2

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.encode(piece)
            if len(piece) <= PIECE_CHARS:
                if len(self.cache) >= self.limit:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pretokens(text)))


def frequent_lengths(docs: DataFrame, model: bytes, text: str = "text", size: int = TABLE_SIZE, each: int = TASK_PIECES) -> dict[str, int]:
    """Lengths of the size most frequent pre-tokens, counted over all texts.

    A task counts its own texts (the rarer half goes whenever CACHE_PIECES are held) and hands on one row with its each
    most frequent pre-tokens; sixteen rows at a time are added up, and size entries of the sum are kept. So the counts
    are estimates. They decide which tier answers, never the answer.
    """

    def count(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in texts(batch.column(0)):
                seen.update([p for p in pretokens(t) if len(p) <= PIECE_CHARS])
                if len(seen) > CACHE_PIECES:
                    seen = Counter(dict(seen.most_common(CACHE_PIECES // 2)))
        top = seen.most_common(each)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([[p for p, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], names=["part", "pieces", "ns"]
        )

    def added(rows) -> list[tuple[str, int]]:
        total: Counter[str] = Counter()
        for pieces, ns in rows:
            for p, n in zip(pieces, ns):
                total[p] += int(n)
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        top = added(zip(group["pieces"], group["ns"]))
        return pd.DataFrame({"part": [group["part"].iloc[0] // 16], "pieces": [[p for p, _ in top]], "ns": [[n for _, n in top]]})

    schema = "part long, pieces array<string>, ns array<long>"
    rows = text_batches(docs.select(F.col(f"`{text}`")))
    parts = rows.rdd.getNumPartitions()
    found = written(rows.mapInArrow(lean(count), schema), "pieces")
    while parts > 16:
        found = written(found.groupBy(F.floor(F.col("part") / 16)).applyInPandas(merge, schema), "pieces")
        parts = -(-parts // 16)
    lengths = Lengths(model, {})
    return {p: lengths.encode(p) for p, _ in added((r.pieces, r.ns) for r in found.collect())}


def token_counts(docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text", table: dict[str, int] | None = None) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (more tokens than limit) for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, null keys and further columns are of no
    consequence. The broadcast holds the model file (0.5 MB) and at most TABLE_SIZE pre-tokens of at most 64
    characters; the cache of a worker is emptied when it holds CACHE_PIECES.
    """
    model = open(path, "rb").read()
    tiers = docs.sparkSession.sparkContext.broadcast((model, frequent_lengths(docs, model, text) if table is None else table))
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))

    def run(batches):
        lengths = Lengths(*tiers.value)
        for batch in batches:
            all_texts = texts(batch.column(1))
            counts = list(map(lengths.count, all_texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in all_texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return text_batches(source).mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
