"""Compression bands: zstandard ratios of whole documents and of fixed chunks against limits that depend on length.

Natural text compresses within a narrow band that rises slowly with its length. Repetitive text lies above the
band, random or encoded text below it. A document is judged as a whole and chunk by chunk, so that a long clean
document with a long repetitive stretch is found too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, raw, text_batches

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """whole: (bytes from, least ratio, largest ratio), by rising length. chunk: the same two limits for chunks.

    The lower limits lie between junk and natural text of that length. Junk: base64 and words of random letters and
    digits reach 1.30 at 800 bytes, 1.35 at 1.5 kB and 1.39 from 20 kB on, words of random small letters 1.70 at 4 kB.
    Natural text: Chinese, the densest, has 1.20, 1.39, 1.63 and 1.86 at least at 500, 1,000, 2,000 and 4,096 bytes,
    English 1.44, 1.68 and 1.76 from 800, 2,000 and 4,096, the test tables 1.43, 1.69, 1.92 and 2.05. Below 800 bytes
    junk and Chinese overlap, and the limits stay with natural text.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.90, 2.6),
        (500, 1.18, 2.8),
        (800, 1.30, 2.8),
        (900, 1.33, 2.8),
        (1000, 1.36, 3.0),
        (1500, 1.45, 3.0),
        (2000, 1.55, 3.2),
        (3000, 1.65, 3.2),
        (4096, 1.72, 3.2),
        (5000, 1.72, 3.4),
        (20000, 1.75, 3.8),
    )
    chunk: tuple[float, float] = (1.72, 3.4)
    chunk_bytes: int = 4096
    #: What is left after the whole chunks is judged by the limits of its length, with bytes before it up to so many.
    least_rest: int = 1024
    #: Share of the bytes that bad chunks may hold.
    bad_chunks: float = 0.2
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


#: The place of kept in OUTPUT.
KEPT = 6
OUTPUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "zstd_ratio double, n_chunks long, n_bad_chunks long"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 2, bool)
    again = counts[inverse] > 1
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def limits(size: int, bands: Bands) -> tuple[float, float]:
    return next((a, b) for n, a, b in reversed(bands.whole) if size >= n)


def measures(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """All columns of OUTPUT for one text in UTF-8."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    text = data.decode()
    n_repeat = repeated_words(words)
    base_failed = len(words) < bands.min_words or 100 * n_repeat > bands.repeat_percent * len(words)
    ratio = len(data) / len(packer.compress(data)) if data else 0.0
    low, high = limits(len(data), bands)
    size, bad, bad_bytes, n_chunks = bands.chunk_bytes, 0, 0, 0
    if len(data) >= size:
        for at in range(0, len(data), size):
            new = min(size, len(data) - at)
            part = data[at : at + size] if new == size else data[-max(new, bands.least_rest) :]
            least, most = bands.chunk if new == size else limits(len(part), bands)
            outside = not least <= len(part) / len(packer.compress(part)) <= most
            n_chunks, bad, bad_bytes = n_chunks + 1, bad + outside, bad_bytes + outside * new
    kept = not base_failed and low <= ratio <= high and bad_bytes <= bands.bad_chunks * len(data)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(data.count(c) for c in SYMBOLS)
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), n_repeat, base_failed, kept, ratio, n_chunks, bad


def compression_bands(docs: DataFrame, bands: Bands = Bands(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the columns named in keep (all but the text, if None) and those of OUTPUT.

    A null text counts as empty. Empty texts and those under min_words fail the base rules; texts of one repeated
    word fail by n_repeat_words. The ratio of an empty text is 0. Chunks are those of chunk_bytes and what is left after
    them, so every byte is judged; texts shorter than one are judged as a whole only and have none. Columns of docs whose names clash with OUTPUT's are left out.
    Repeated rows are judged one by one. One pass, no shuffle.
    """
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in names]

    def judge(batches):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            found = [measures(x, bands, packer) for x in raw(batch.column(0))]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*keep, *names])

    source = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return text_batches(source).mapInArrow(lean(judge), f"{kept}, {OUTPUT}" if kept else OUTPUT)


def kept_documents(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of docs that pass, unchanged: the verdict is computed next to the whole rows, so nothing is joined.

    Null and empty texts are rejected.
    """

    at = docs.columns.index(text)

    def keep(batches):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            yield batch.filter(pa.array([measures(x, bands, packer)[KEPT] for x in raw(batch.column(at))], pa.bool_()))

    return text_batches(docs).mapInArrow(lean(keep), docs.schema)
