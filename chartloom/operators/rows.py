"""What dictionary correction does in the row, in Python workers over Arrow batches: a split and a lookup for each word.

Words are those of functions.text.tokens, their case that of functions.text.recased; tests compare both.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes of one Arrow batch, and entries that a worker remembers.
BATCH_BYTES = 4 << 20
REMEMBERED = 1 << 17
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: White space as functions.text.SPACE has it. Python's split() takes the four separators as well.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_FOLDED = str.maketrans("\u0130\u0131\u017f", "iis")
_NO_LETTER = re.compile("[^A-Za-z]")
CORRECTIONS = "array<struct<from:string,to:string,type:string,score:int>>"


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _SPACE.split(text) if w] if any(c in text for c in _SEPARATORS) else text.split()


def alpha_lower(word: str) -> str:
    return _NO_LETTER.sub("", word).lower()


def _is_upper(word: str) -> bool:
    return word != word.lower() and word == word.upper()


def capitalized(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def recased(word: str, term: str) -> str:
    """The term in the word's case, inside the word's punctuation."""
    letters = [k for k, c in enumerate(word) if c.isalpha()]
    a, b = (letters[0], letters[-1] + 1) if letters else (len(word), len(word))
    core = word[a:b]
    return word[:a] + (term.upper() if _is_upper(core) else capitalized(term) if _is_upper(core[:1]) else term) + word[b:]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit for each character of a that is in no match yet."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    whole = (1 << len(a)) - 1
    free = whole
    for c in b:
        hit = free & at.get(c, 0)
        free = (free + hit | free - hit) & whole
    return len(a) - free.bit_count()


@dataclass(frozen=True)
class Stage:
    """One dictionary's say. known: by spelling the term, and the score of a spelling that is changed. several: terms of
    more than one word, with their number of words."""

    kind: str
    known: dict[str, tuple[str, int | None]]
    several: list[tuple[str, int]]
    threshold: int


class Entries(dict):
    """By word: None, or the word that stands for it, its correction as a row (None if it has none) and the term."""

    def __init__(self, stage: Stage):
        self.stage = stage

    def __missing__(self, word: str):
        found = self.stage.known.get(alpha_lower(word))
        if found:
            term, score = found
            new = word if score is None else recased(word, term)
            found = new, None if score is None else {"from": word, "to": new, "type": self.stage.kind, "score": score}, term
        self[word] = found
        return found


class Worth(dict):
    """By word, what it does for a window that is to reach the threshold: 200 for each letter that a term may share with
    it, less the threshold for each of its letters."""

    def __init__(self, terms: list[str], threshold: int):
        self.threshold, self.most = threshold, Counter()
        for t in terms:
            self.most |= Counter(t)

    def __missing__(self, word: str):
        low = word.lower()
        self[word] = worth = 200 * (Counter(low) & self.most).total() - self.threshold * len(low)
        return worth


class Windows:
    """Terms of several words that windows of so many lower-cased words come close to."""

    def __init__(self, stage: Stage):
        self.threshold, self.by_size = stage.threshold, {}
        for term, n in stage.several:
            self.by_size.setdefault(n, []).append(term)
        self.worth = Worth([t for t, _ in stage.several], stage.threshold)
        # the spaces inside a window may all be shared
        self.least = {n: stage.threshold * min(map(len, terms)) - (200 - stage.threshold) * (n - 1) for n, terms in self.by_size.items()}

    def of(self, words: list[str]) -> list[str]:
        if not self.by_size:
            return []
        found, ends = [], [0, *itertools.accumulate(map(self.worth.__getitem__, words))]
        for n, least in self.least.items():
            for k in [k for k, worth in enumerate(map(operator.sub, ends[n:], ends)) if worth >= least]:
                g = " ".join(words[k : k + n]).lower()
                found += [t for t in self.by_size[n] if t not in found and 200 * lcs(t, g) >= self.threshold * (len(t) + len(g))]
        return found


def _bounded(df: DataFrame) -> DataFrame:
    """Arrow batches bounded by bytes, unless the session names a bound of its own."""
    if df.sparkSession.conf.get(_BYTES, None) is None:
        df.sparkSession.conf.set(_BYTES, str(BATCH_BYTES))
    return df


def spelled(docs: DataFrame, text: str) -> DataFrame:
    """(clean) of the distinct words of at least three letters, as lexicon.spellings; a worker tells most apart."""

    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            new: set[str] = set()
            for x in batch.column(0).to_pylist():
                new.update(tokens(x))
            new -= seen
            seen |= new
            clean = {c for c in map(alpha_lower, new) if len(c) >= 3}
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string())], names=["clean"])

    return _bounded(docs.select(F.col(text))).mapInArrow(run, "clean string").distinct()


def lower(text: str | None) -> str:
    return (text or "").lower()


def folded(text: str | None) -> str:
    """As classify.folded."""
    return lower(text if not text or text.isascii() else text.translate(_FOLDED))


@dataclass(frozen=True)
class Held:
    """A column of those of the literals, in their order, that a text holds once form has changed it."""

    name: str
    literals: list[str]
    form: Callable[[str | None], str]
    corrected: bool


def corrected(docs: DataFrame, text: str, stages: list[Stage], matched: list[str], held: list[Held] = []) -> DataFrame:  # noqa: B006
    """docs with corrected_text, corrections, the terms that each stage matched under its name, and what is held; a stage
    works on the text that the one before it left, whose words are joined by one space."""
    kinds = docs.sparkSession.createDataFrame([], f"corrections {CORRECTIONS}, matched array<string>").schema
    more = [StructField("corrected_text", docs.schema[text].dataType), StructField("corrections", kinds["corrections"].dataType), *[StructField(m, kinds["matched"].dataType) for m in [*matched, *[h.name for h in held]]]]
    arrow = [to_arrow_type(f.dataType) for f in more]
    at, names = docs.columns.index(text), [*docs.columns, *[f.name for f in more]]

    spaced = any(len(tokens(t)) > 1 for s in stages[:-1] for t, _ in s.known.values())  # by white space other than a blank

    def run(batches):
        tables = [(Entries(s), Windows(s)) for s in stages]
        for batch in batches:
            out: list[list] = [[] for _ in more]
            for x in batch.column(at).to_pylist():
                words, changes = tokens(x), []
                for column, (entries, windows) in zip(out[2:], tables):
                    if spaced:
                        words = tokens(" ".join(words))
                    terms = set(windows.of(words))
                    for k, e in [(k, e) for k, e in enumerate(map(entries.__getitem__, words)) if e]:
                        words[k], change, term = e
                        terms.add(term)
                        if change:
                            changes.append(change)
                    column.append(sorted(terms))
                new = " ".join(words)
                out[0].append(new)
                out[1].append(changes)
                for column, h in zip(out[2 + len(stages) :], held):
                    low = h.form(new if h.corrected else x)
                    column.append([t for t in h.literals if t in low])
            for memo in (m for entries, windows in tables for m in (entries, windows.worth)):
                if len(memo) > REMEMBERED:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, t) for v, t in zip(out, arrow)]], names=names)

    return _bounded(docs).mapInArrow(run, StructType([*docs.schema.fields, *more]))
