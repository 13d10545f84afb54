"""Quality bands, BPE, token counts and languages against plain versions."""

import base64
import hashlib
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartloom.llm import bpe, compression, langid, queries, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SPEC = open(P.path(queries.BPE_FILE)).read()


def same(frame, wanted, key="doc_id"):
    got = Counter(map(tuple, frame.collect()))
    assert got == Counter(wanted)


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = len(covered)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def plain_kept(text, bands=compression.Bands()):
    data = (text or "").encode()
    if plain_base(text)[-1]:
        return False
    size = lambda b: len(zstandard.ZstdCompressor(level=bands.level).compress(b))
    low, high = [(a, b) for n, a, b in bands.whole if n <= len(data)][-1]
    parts = [data[k : k + bands.chunk_bytes] for k in range(0, len(data) - bands.chunk_bytes + 1, bands.chunk_bytes)]
    bad = sum(not bands.chunk[0] <= len(p) / size(p) <= bands.chunk[1] for p in parts)
    return low <= len(data) / size(data) <= high and bad <= bands.bad_chunks * len(parts)


def test_bands(awkward, awkward_rows, empty):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    same(compression.compression_bands(awkward, keep=["doc_id"]).select(names), [(r[0], *plain_base(r[1]), plain_kept(r[1])) for r in awkward_rows])
    assert compression.compression_bands(empty).count() == 0
    out = compression.compression_bands(awkward)
    assert out.columns[:5] == ["doc_id", "lang", "score", "word", "fp"] and out.columns.count("kept") == 1


def test_bands_query_keeps_good_documents(spark):
    rows = queries.op1_compression_bands(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: (*plain_base(t), plain_kept(t)) for k, t in texts.items()}
    good = {x[0] for x in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1").fetchall()}
    assert all(r.kept or r.base_failed for r in rows if r.doc_id in good)


def test_bands_reject_both_sides(spark):
    rnd = random.Random(4)
    noise = " ".join("".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(8)) for _ in range(400))
    lines = "\n".join(f"{k} the same long line of words over and over again {k}" for k in range(300))
    kept = compression.compression_bands(spark.createDataFrame([(1, noise), (2, lines)], "doc_id long, text string")).collect()
    assert [(r.base_failed, r.kept) for r in sorted(kept)][1][1] is False
    tight = compression.Bands(whole=((0, 50.0, 60.0),))
    assert not any(r.kept for r in compression.compression_bands(spark.createDataFrame([(1, noise)], "doc_id long, text string"), tight).collect())


@pytest.mark.parametrize("size", [800, 1000, 2000, 4000, 4500, 8000, 19_000, 40_000])
def test_production_bands_reject_encoded_and_random_text(size):
    rnd = random.Random(size)
    words = lambda letters: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 10))) for _ in range(size))[:size].encode()
    base64_words = b" ".join(base64.b64encode(rnd.randbytes(6)) for _ in range(size))[:size]
    junk = [base64_words, words(string.ascii_letters + string.digits), words(string.printable[:94])]
    if size >= 4500:  # 50 lines of 76 bytes are words enough, and small letters are told apart
        junk += [base64.encodebytes(rnd.randbytes(size))[:size], words(string.ascii_lowercase)]
    packer = zstandard.ZstdCompressor(level=compression.Bands().level)
    found = [compression.measures(x, compression.Bands(), packer) for x in junk]
    assert not any(x[5] for x in found) and not any(x[compression.KEPT] for x in found)


@pytest.mark.parametrize("chunks, size", [(1, 1500), (1, 4090), (2, 2500), (2, 4090), (3, 4090)])
def test_the_rest_after_whole_chunks_is_judged(chunks, size):
    rnd, bands = random.Random(7), compression.Bands()
    packer = zstandard.ZstdCompressor(level=bands.level)
    long = [t.encode() for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where n_chars > 13000 order by doc_id").fetchall()]
    clean = [t for t in long if compression.measures(t, bands, packer)[compression.KEPT] and t.isascii()][:8]
    assert len(clean) >= 5
    for t in clean:
        head = t[: chunks * bands.chunk_bytes]
        noise = bytes(rnd.choice(string.printable[:94].encode() + b"      ") for _ in range(size))
        phrase = (b"one long phrase again " * size)[:size]
        whole, rest = compression.measures(head, bands, packer), compression.measures(t[: len(head) + size], bands, packer)
        assert whole[6] and rest[6] and (whole[8], rest[8], rest[9]) == (chunks, chunks + 1, 0)
        for junk in (noise, phrase):
            found = compression.measures(head + junk, bands, packer)
            assert (found[8], found[9], found[6]) == (chunks + 1, 1, False)


def test_production_bands_keep_clean_documents():
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) where quality = 1").fetchall()
    packer = zstandard.ZstdCompressor(level=compression.Bands().level)
    found = [compression.measures(t.encode(), compression.Bands(), packer) for (t,) in rows]
    assert len(found) > 300 and all(x[6] or x[5] for x in found)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_str(SPEC)
    t.no_truncation(), t.no_padding()
    return t


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_rows(awkward, awkward_rows, empty, library):
    same(bpe.round_trip(awkward, P.path(queries.BPE_FILE), leaf=64).drop("n_joins"), [(r[0], *digests(library, r[1])) for r in awkward_rows])
    assert bpe.round_trip(empty, P.path(queries.BPE_FILE)).count() == 0


def test_bpe_query(spark, library):
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    out = queries.op3_tree_bpe(spark, SF)
    same(out.drop("n_joins"), [(k, *digests(library, t)) for k, t in texts])
    joins = {r.doc_id: r.n_joins for r in out.collect()}
    halved = lambda n: 0 if n <= bpe.LEAF_CHARS else 1 + 2 * halved((n + 1) // 2)
    assert joins == {k: halved(len(t)) for k, t in texts} and sum(joins.values()) > len(texts)


def test_bpe_frames(awkward, library):
    back = bpe.decoded(bpe.encoded(awkward, P.path(queries.BPE_FILE)), P.path(queries.BPE_FILE))
    for r in back.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")


def test_joins_are_made_of_windows():
    """Neighbours meet in few pieces round the seam; the rest of either side is taken as it is."""
    tree = bpe.ByteBpe(SPEC, leaf=256)
    read, pieces = [], tree.pieces
    tree.pieces = lambda text: read.append(len(text)) or pieces(text)
    text = " ".join(f"word{k} isn't it," for k in range(4000))
    assert tree.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    leaves = len(tree.leaves(text))
    assert 2 * leaves - 1 <= len(read) < 3 * leaves and max(read[leaves:]) < 200


def test_special_tokens_at_every_seam():
    for leaf in (2, 3, 8, 20):
        tree = bpe.ByteBpe(SPEC, leaf=leaf)
        for k in range(40):
            text = "x" * k + " a<|endoftext|>  b<|endoftext|><|endof 'll" + "<|endoftext|>" * 3
            assert tree.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


TREE = bpe.ByteBpe(SPEC, leaf=4)
LIBRARY = Tokenizer.from_str(SPEC)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*"abetionsh éß日  \n\t'.-", "<|endoftext|>", "<|end", "text|>"]), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_tree_concatenation_is_exact(parts):
    text = "".join(parts)
    assert TREE.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdehinorst", min_size=5, max_size=400))
def test_tree_concatenation_of_unsplit_text(text):
    assert TREE.tree(text) == LIBRARY.encode(text, add_special_tokens=False).ids


PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECE_FILE))


def test_counts(awkward, awkward_rows, empty, spark):
    wanted = [(r[0], len((r[1] or "").encode()), n := len(PIECES.encode(r[1] or "")), n > 4096) for r in awkward_rows]
    same(token_counts.token_counts(awkward, P.path(queries.PIECE_FILE)), wanted)
    same(token_counts.token_counts(awkward, P.path(queries.PIECE_FILE), table={}), wanted)
    assert token_counts.token_counts(empty, P.path(queries.PIECE_FILE)).count() == 0
    texts = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    same(queries.op10_token_counts(spark, SF), [(k, len(t.encode()), n := len(PIECES.encode(t)), n > 4096) for k, t in texts])


def test_table_holds_the_most_frequent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(None,), ("",), ("z" * 100,)], "text string"))
    seen = Counter(p for r in docs.where("text is not null").collect() for p in token_counts.pretokens(r.text) if len(p) <= token_counts.PIECE_CHARS)
    model = open(P.path(queries.PIECE_FILE), "rb").read()
    table = token_counts.frequent_lengths(docs.repartition(20), model, size=50)
    assert len(table) == 50 and len(set(table) & {p for p, _ in seen.most_common(50)}) >= 40  # sums of the tasks' fifty most frequent
    assert all(n == LENGTHS.encode(p) for p, n in table.items())
    assert len(token_counts.frequent_lengths(docs.repartition(20), model)) == len(seen)


LENGTHS = token_counts.Lengths(open(P.path(queries.PIECE_FILE), "rb").read(), {}, limit=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abetionsh ▁\n\r\t<s>/"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_add_up(text):
    assert LENGTHS.count(text) == len(PIECES.encode(text))


def test_languages(spark, awkward, awkward_rows, empty):
    out = queries.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) == 0
    model = langid.learn(awkward)
    got = {r.doc_id: r for r in langid.predicted(awkward, model).collect()}
    for k in (4, 5, 9, 14):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert got[12].lang_pred == "ja" and got[15].lang_pred == "en"
    assert langid.kept_documents(awkward, model).columns == awkward.columns
    assert langid.predicted(empty, model).count() == 0
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.predicted(awkward, nothing).collect()} == {"und"}
    assert langid.learn(awkward.where("doc_id in (4, 9, 14)")).languages == []


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where("lang = 'en'"))
    _, _, out = model.predict(["Щ" * 30 + " ЖЖЖ ЫЫЫ " * 100, "the and of that with " * 20])
    assert out == [True, False]


def test_prediction_is_the_nearest_centroid(spark):
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    text = "the of and with that"
    v = langid.weighted([langid.counts(text)], model.idf)[0]
    cosines = [float(np.dot(v, c) / np.linalg.norm(v)) for c in model.centroids]
    lang, score, _ = model.predict([text])
    assert lang == [model.languages[model.owner[int(np.argmax(cosines))]]] and score[0] == pytest.approx(max(cosines), abs=1e-5)
