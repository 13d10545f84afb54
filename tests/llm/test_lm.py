"""The language model against plain counts, numeric gradients and step-by-step scores."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import lm, queries
from chartloom.llm.gru import Gru

SF = "/root/testdata/sf0.001"


def plain_base(rows, held):
    words = [[*(x or "").encode().lower().split(), None] for _, x in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(k, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (k, _), ws, h in zip(rows, words, held)]


def check(frame, rows, held):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, wanted = sorted((tuple(r) for r in frame.collect()), key=key), sorted(plain_base(rows, held), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in wanted], rel=1e-9)
    return got


@pytest.mark.parametrize("some", [lm.Settings(), lm.Settings(table_words=40, vocabulary=20, chunk_bytes=3000, rounds=2, train_tokens=300)])
def test_scores(spark, some):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from chartloom.llm.common import crc32_mod

    got = check(lm.scores(docs, crc32_mod(F.col("doc_id"), 7) == 2, settings=some), rows, held)
    assert sum(r[6] for r in got) > sum(r[5] for r in got) if some.vocabulary > 20 else True


def test_query_beats_the_base_on_held_out_texts(spark):
    out = queries.op9_gru_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_awkward(spark, awkward, awkward_rows, empty):
    rows = [r[:2] for r in awkward_rows]
    held = [k == 15 for k, _ in rows]
    got = check(lm.scores(awkward, F.coalesce(F.col("doc_id") == 15, F.lit(False))), rows, held)
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)
    assert lm.scores(empty, F.lit(False)).count() == 0
    alone = lm.scores(awkward, F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0}


def test_frequent_words_are_whole_steps(spark):
    counts = spark.createDataFrame([(f"w{k}".encode(), c, c) for k, c in enumerate([1, 1, 2, 40, 41, 10**9, 10**9 + 1])], "word binary, c long, seen long")
    for most, found in ((7, 7), (6, 5), (5, 5), (4, 4), (3, 3), (2, 2), (1, 0), (0, 0)):
        assert len(lm.frequent(counts, most)[0]) == found
    words, least = lm.frequent(counts, 4)
    assert least == 40 and words.column("c").to_pylist() == [10**9 + 1, 10**9, 41, 40]


def test_ends_count_whatever_the_table_holds(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(300))), (2, "w1 w2 unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(lm.scores(docs, F.col("doc_id") == 2, settings=lm.Settings(table_words=40)), rows, [False, True])


def test_words_common_in_held_out_texts_alone(spark):
    """They fill the table, so that no key of the join is hot, and are unknown all the same."""
    rows = [(1, "a b b c d"), (2, "x x x x x x y y y y z a"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (0, 1, 2, 3, 100):
        check(lm.scores(docs, F.col("doc_id") >= 2, settings=lm.Settings(table_words=table)), rows, [False, True, True])


def test_two_words_in_the_table(spark):
    rows = [(1, "a a a b b b c c c"), (2, "a b c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(lm.scores(docs, F.lit(None).cast("boolean"), settings=lm.Settings(table_words=2)), rows, [False] * 3)


def test_one_very_long_text_takes_memory_by_its_own_length():
    import tracemalloc

    g = small()
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 7, n), 0).astype(np.int32) for n in [100_000, *[30] * 300]]
    tracemalloc.start()
    out = g.score(docs, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6 and out[5] == pytest.approx(plain_score(g, docs[5], 0), rel=1e-4)


def small(seed=1):
    return Gru(np.array([9.0, 8, 7, 6, 5, 4, 3]), hidden=5, seed=seed)


def test_untrained_model_is_the_unigram_model():
    g = small()
    p = np.exp(g.outputs(np.zeros((7, 5), np.float32), np.arange(7)))
    assert p.sum() == pytest.approx(1, abs=1e-5) and p == pytest.approx(np.array([9, 8, 7, 6, 5, 4, 3]) / 42, abs=1e-5)


def plain_score(g, doc, end):
    h, x, total = np.zeros((1, 5), np.float32), end, 0.0
    for y in doc:
        h = g.step(g.p["embed"][[x]] @ g.p["wx"] + g.p["bx"], h)[0]
        total += float(g.outputs(h, np.array([y]))[0])
        x = y
    return total


def test_lanes_and_windows_do_not_change_scores():
    rng = np.random.default_rng(2)
    g = small()
    g.p["wc"], g.p["wo"] = (rng.standard_normal(g.p[k].shape).astype(np.float32) for k in ("wc", "wo"))
    docs = [np.append(rng.integers(1, 7, n), 0).astype(np.int32) for n in (0, 3, 40, 7, 1, 19)]
    wanted = [plain_score(g, d, 0) for d in docs]
    for lanes, window in ((1, 5), (2, 64), (50, 3)):
        assert g.score(docs, 0, lanes, window) == pytest.approx(wanted, rel=1e-4)
    assert len(g.score([], 0)) == 0


def test_gradient_of_the_outputs():
    g = small()
    rng = np.random.default_rng(4)
    for k in ("wc", "wo"):
        g.p[k] = g.p[k].astype(np.float64) * 0.5 + rng.standard_normal(g.p[k].shape) * 0.3
    h, y = rng.standard_normal((6, 5)), np.array([0, 1, 2, 4, 6, 6])
    _, grads, dh = g.outputs(h, y, grad=True)
    loss = lambda: -g.outputs(h, y).sum()
    for a, d in ((h, dh), (g.p["wc"], grads["wc"]), (g.p["wo"], grads["wo"])):
        for at in list(np.ndindex(a.shape)):
            was = a[at]
            a[at] = was + 1e-5
            up = loss()
            a[at] = was - 1e-5
            down = loss()
            a[at] = was
            assert (up - down) / 2e-5 == pytest.approx(d[at], abs=1e-5)


def test_gradient_through_time():
    """Numeric gradients of every parameter over a window with an end of a text inside."""
    g = small()
    rng = np.random.default_rng(6)
    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64) + rng.standard_normal(g.p[k].shape) * 0.3
    x, y, h = rng.integers(0, 7, (5, 3)), rng.integers(0, 7, (5, 3)), rng.standard_normal((3, 5)) * 0.5
    x[2, 1] = 0

    def loss():
        state, total = h.copy(), 0.0
        for t in range(5):
            state[x[t] == 0] = 0
            state = g.step(g.p["embed"][x[t]] @ g.p["wx"] + g.p["bx"], state)[0]
            total -= g.outputs(state, y[t]).sum()
        return total

    grads, _ = g.gradients(x, y, h, 0)
    ids, rows = grads.pop("embed")
    grads["embed"] = np.zeros(g.p["embed"].shape)
    grads["embed"][ids] = rows
    for k, d in grads.items():
        a = g.p[k]
        for at in np.ndindex(a.shape):
            was = a[at]
            a[at] = was + 1e-5
            up = loss()
            a[at] = was - 1e-5
            down = loss()
            a[at] = was
            assert (up - down) / 2e-5 == pytest.approx(d[at], abs=1e-5), (k, at)


def test_classes_are_runs_by_falling_count():
    counts = np.random.default_rng(1).integers(1, 10_000, 3000).astype(float)
    g = Gru(counts, 4)
    assert (np.diff(counts[np.argsort(g.slot)]) <= 0).all() and g.edges[0] == 0 and g.edges[-1] == 3000 and (np.diff(g.edges) > 0).all()
    assert (g.cls == np.repeat(np.arange(g.classes), np.diff(g.edges))).all()


def test_training_learns_an_order():
    g = small()
    stream = np.tile(np.array([1, 2, 3, 4, 5, 6, 0], np.int32), 4000)
    before = g.score([stream[:700]], 0)[0]
    for _ in range(3):
        g.train(stream, 0, lanes=8, window=16)
    assert g.score([stream[:700]], 0)[0] > before / 4
    assert small().unpack(np.frombuffer(g.pack(), np.float32)).score([stream[:70]], 0) == pytest.approx(g.score([stream[:70]], 0))


def test_windows_of_few_lanes_share_their_outputs(monkeypatch):
    net, calls = Gru(np.array([5.0, 4.0, 3.0, 2.0, 1.0]), 4), []
    docs = [np.append(np.arange(3000) % 4 + 1, 0), *[np.array([k % 4 + 1, 0]) for k in range(99)]]
    alone = np.array([net.score([d], 0)[0] for d in docs])
    whole = Gru.outputs
    monkeypatch.setattr(Gru, "outputs", lambda self, h, y, grad=False: calls.append(len(y)) or whole(self, h, y, grad))
    assert np.allclose(net.score(docs, 0), alone, rtol=1e-5)
    assert len(calls) <= 2 and sum(calls) == sum(map(len, docs)) and max(calls) <= 64 * 100
