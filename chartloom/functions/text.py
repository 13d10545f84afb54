"""Column expressions over one text: tokens, cleaning, case, previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it and wherever the optimiser copies the expression to."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: White space as Python's str.split() sees it.
SPACE = r"(?U)\s+"


def tokens(text: Column) -> Column:
    """Runs of non-space; no empty ones."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def compact(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.array_join(tokens(text), " ")


def preview(text: Column, size: int = 180) -> Column:
    """The compacted text, cut at size characters with an ellipsis."""
    c = compact(text)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size), F.lit("...")))


def fused(text: Column) -> Column:
    """Digits read for letters are turned back (0 to O, 1 to l) in every token that is not a number; one space between tokens."""
    return F.array_join(F.transform(tokens(text), lambda w: F.when(w.rlike(r"^\d+(\.\d+)?$"), w).otherwise(F.translate(w, "01", "Ol"))), " ")


def letters_for_digits(word: Column) -> Column:
    """The letters that 0 1 3 5 6 8 are commonly misread from."""
    return F.translate(word, "013568", "olesgb")


def alpha_lower(word: Column) -> Column:
    """ASCII letters only, lower-cased."""
    return F.lower(F.regexp_replace(word, "[^A-Za-z]", ""))


def alpha_upper(word: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(word, F.lit("")), "[^A-Za-z]", ""))


def is_upper(word: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (word != F.lower(word)) & (word == F.upper(word))


def is_lower(word: Column) -> Column:
    return (word != F.upper(word)) & (word == F.lower(word))


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def case_like(source: Column, target: Column) -> Column:
    """All upper, capitalised or all lower as the source is; else the target as it stands."""
    first, rest = F.substring(source, 1, 1), F.substring(source, 2, 1 << 30)
    return F.when(is_upper(source), F.upper(target)).when(is_upper(first) & is_lower(rest), capitalized(target)).when(is_lower(source), F.lower(target)).otherwise(target)


def case_of_core(core: Column, term: Column) -> Column:
    """The simpler rule of dictionary correction: upper, else capitalised by the first letter, else the term."""
    return F.when(is_upper(core), F.upper(term)).when(is_upper(F.substring(core, 1, 1)), capitalized(term)).otherwise(term)


def peeled(word: Column) -> tuple[Column, Column, Column]:
    """Leading non-letters, core, trailing non-letters."""
    pattern = r"(?s)^([^\p{L}]*)(.*?)([^\p{L}]*)$"
    return tuple(F.regexp_extract(word, pattern, k) for k in (1, 2, 3))  # type: ignore[return-value]


def recased(word: Column, term: Column) -> Column:
    """The term in the word's case, inside the word's punctuation."""
    before, core, after = peeled(word)
    return F.concat(before, case_of_core(core, term), after)


def is_word_token(word: Column) -> Column:
    return (F.length(word) >= 3) & word.rlike("[A-Za-z]")


def pieces(text: Column) -> Column:
    """White space, words (with one inner hyphen or apostrophe) and single signs; underscores and other letters fall out."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?U)\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?|[^\w\s])"), F.lit(1))


def response_cleaned(text: Column) -> Column:
    """A model's answer without a fence around it and its usual headings."""
    bare = lambda c: F.regexp_replace(c, r"(?Ud)^\s+|\s+\z", "")
    fenced = lambda c: c.startswith("```") & c.endswith("```")
    opened = let(bare(text), lambda c: F.when(fenced(c), bare(F.regexp_replace(c, "^`+|`+$", ""))).otherwise(c))
    return bare(F.replace(F.replace(opened, F.lit("Transcription:"), F.lit("")), F.lit("OCR:"), F.lit("")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def intake(path: Column) -> Column:
    """Which reader a file goes to: pages for PDF, image with block reading for the usual image types, else image alone."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf_pages").when(s.isin(".png", ".jpg", ".jpeg"), "image_and_block").otherwise("image")


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty; else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def lines(text: Column) -> Column:
    """Stripped, non-blank lines in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def ngrams(words: Column, n: Column) -> Column:
    """All windows of n words joined by a space; none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
