"""Byte-level BPE with tree concatenation.

A text longer than a leaf is cut in halves, without regard to words, down to leaves. Leaves are encoded each for
itself, and neighbours are joined up the tree: a window around the seam is encoded again and grows until it agrees with
either side at a place between two tokens. A leaf is encoded by splitting it into pieces and looking these up.

The tokenizer splits a text into pieces by a pattern that reads on from where the last piece ended, and no merge
crosses a piece. So once the window and the right side both have a piece ending at one place, they agree from there
on; what ends before the window's own end, by the length of a special token, doesn't depend on what follows. Ordinary
pieces are encoded once and remembered. A piece longer than a leaf is encoded by halves as well: neighbours are
joined by windows of tokens, which grow until they begin with the left side's token and end with the right side's.
Then every pair of neighbouring tokens lies within one encoding, and since a sequence of BPE tokens is the encoding of
its text exactly when each neighbouring pair is, the joined sequence is exact.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import lean, text_batches, texts

#: The split pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 1024
CACHE_PIECES = 100_000
#: Longer pieces are not remembered.
CACHED_CHARS = 64
OUTPUT = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long"


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Remembered(dict):
    """What pieces give: their ids as text and the bytes that these decode to. When as many as the limit are held, they
    become the old ones, from which those still in use are taken over."""

    def __init__(self, bpe: "ByteBpe"):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        out = self.old.get(piece)
        if out is None:
            ids = self.bpe.ids_of_piece(piece)
            out = ",".join(map(str, ids)), self.bpe.decode_bytes(ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= self.bpe.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


class ByteBpe:
    """Encodes and decodes as the tokenizer file's library does, without added, begin or end tokens."""

    def __init__(self, spec: str, leaf: int = LEAF_CHARS, cache: int = CACHE_PIECES):
        parsed = json.loads(spec)
        symbols = byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.bytes = {i: bytes(symbols[c] for c in token) for token, i in parsed["model"]["vocab"].items() if token not in self.special}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        parsed["added_tokens"], parsed["truncation"], parsed["padding"], parsed["post_processor"] = [], None, None, None
        parsed["pre_tokenizer"]["use_regex"] = False  # pieces come split
        self.tokenizer = Tokenizer.from_str(json.dumps(parsed))
        self.split = regex.compile(PATTERN).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        # the library's threads keep to the cores of a Spark task, which Spark names in OMP_NUM_THREADS
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        self.margin = max(map(len, self.special), default=1)
        self.leaf, self.limit = leaf, cache
        self.cache = Remembered(self)

    def pieces(self, text: str) -> list[str]:
        if not self.apart or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.apart(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def _plain(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def ids_of_piece(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return self._plain(piece) if len(piece) <= self.leaf else self.tree(piece)

    def tree(self, piece: str) -> list[int]:
        """Halves down to leaves, leaves in parallel, then joins up the tree."""
        parts = [piece]
        while max(map(len, parts)) > self.leaf:
            parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        level = [x.ids for x in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated texts of two exact encodings, which meet between characters."""
        if not left or not right:
            return left or right
        size = 2
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            while a < len(left) and self.bytes[left[-a]][0] & 0xC0 == 0x80:  # begins inside a character
                a += 1
            while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
                b += 1
            window = self._plain((b"".join(self.bytes[i] for i in left[-a:]) + b"".join(self.bytes[i] for i in right[:b])).decode())
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            size *= 2

    def leaves(self, text: str) -> list[str]:
        """The text cut in halves until none is longer than a leaf."""
        parts = [text]
        while len(parts[0]) > self.leaf:  # halves differ by one character at most, and the last is the longest
            parts = [h for p in parts for h in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
        return parts

    def concatenated(self, left: list[str], right: list[str]) -> list[str]:
        """The pieces of the concatenated texts of two encodings, from a window around the seam."""
        if not left or not right:
            return left or right
        size = 1
        while True:
            a, before = 0, 0
            while a < len(left) and (a < size or before < self.margin):
                a += 1
                before += len(left[-a])
            b, after = 0, 0
            ends = {before: 0}
            while b < len(right) and (b <= size or after <= self.margin):
                after += len(right[b])
                b += 1
                ends[before + after] = b
            window = self.pieces("".join(left[-a:]) + "".join(right[:b]))
            last = before + after - (self.margin if b < len(right) else 0)
            at = 0
            for k, piece in enumerate(window):
                at += len(piece)
                if at > last:
                    break
                if at >= before and at in ends:
                    return left[: len(left) - a] + window[: k + 1] + right[ends[at] :]
            size *= 2

    def grown(self, level: list[list[str]]) -> list[str]:
        """The pieces of a text from those of its leaves, joined two by two."""
        while len(level) > 1:
            level = [self.concatenated(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [i for p in self.grown([self.pieces(x) for x in self.leaves(text)]) for i in self.ids_of_piece(p)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str, int]:
        """OUTPUT of the text: leaves are encoded, then joined up the tree."""
        leaves = [self.pieces(x) for x in self.leaves(text)]
        found = list(map(self.cache.__getitem__, self.grown(leaves)))
        ids = ",".join([x for x, _ in found])
        decoded = b"".join([x for _, x in found]).decode("utf-8", "replace").encode()
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(leaves) - 1


def encoded(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """docs with a column ids (array of int): the encoding of each whole text. Null and empty texts give no ids."""
    out = [c for c in docs.columns if c != "ids"]
    schema = docs.select(*[F.col(f"`{c}`") for c in out]).schema.add("ids", T.ArrayType(T.IntegerType()))
    spec = docs.sparkSession.sparkContext.broadcast(open(path).read())

    def run(batches):
        bpe = ByteBpe(spec.value, leaf)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in texts(batch.column(out.index(text)))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*out, "ids"])

    return text_batches(docs.select(*[F.col(f"`{c}`") for c in out])).mapInArrow(lean(run), schema)


def decoded(frame: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """frame with a column decoded: the text of its ids; null ids give an empty text."""
    schema = frame.drop("decoded").schema.add("decoded", "string")
    spec = frame.sparkSession.sparkContext.broadcast(open(path).read())
    names = [f.name for f in schema.fields][:-1]

    def run(batches):
        bpe = ByteBpe(spec.value)
        for batch in batches:
            out = pa.array([bpe.decode(x or []) for x in batch.column(names.index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, "decoded"])

    return text_batches(frame.drop("decoded")).mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """key and OUTPUT for each row of docs: the number of ids, digests of the ids and of their decoded text, and the
    number of joins that put the text's leaves together.

    A null text counts as empty: no ids, digests of the empty text. Very long texts, with or without places to split,
    take time in proportion to their length times its logarithm at most. Repeated rows, null keys and further columns
    are of no consequence. One pass without a shuffle; the vocabulary file (about 1.5 MB) is broadcast as it is.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(path).read())
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))

    def run(batches):
        bpe = ByteBpe(spec.value, leaf)
        for batch in batches:
            found = list(map(bpe.digests, texts(batch.column(1))))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], names=[key, *(c.split()[0] for c in OUTPUT.split(", "))])

    return text_batches(source).mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, {OUTPUT}")
