import random

import pytest

WORDS = "the of and to in that was his with for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "ing", "ed", "s"]) for _ in range(n))


#: Names clash with columns that operators make.
AWKWARD = "doc_id long, text string, lang string, kept string, score int, word string, fp int, ids string, n_tokens string"


@pytest.fixture(scope="session")
def awkward_rows():
    rnd = random.Random(11)
    base = prose(rnd, 300)
    near = base.replace(" the", " teh", 3)
    long = prose(rnd, 30_000)
    texts = [
        (1, base, "en"), (2, base, "en"), (3, near, None), (3, near, None), (4, "", "en"), (5, None, "en"), (None, base, "en"), (None, None, None), (6, long, "en"), (7, "one two", "en"),
        (8, "one two", "en"), (9, " \n\t ", "en"), (10, "x" * 20_000, "en"), (11, "na " * 5_000, "en"), (12, "日本語 " * 80, "ja"), (13, "<|endoftext|> ▁a\u00a0b <s>\r\n\n  c", "en"), (14, "123 456 !!", "en"), (15, prose(rnd, 60), "en"),
    ]
    return [(k, t, lang, "a", 1, "w", 2, "i", "n") for k, t, lang in texts]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, AWKWARD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], AWKWARD)
