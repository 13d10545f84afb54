"""The pipeline against its stages' plain versions, and each stage on awkward tables."""

import duckdb
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from chartloom.llm import langid, queries
from tests.llm.test_pairs import plain_classes, plain_overlaps, tokens
from tests.llm.test_texts import digests, plain_kept

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    rows = [r for r in rows if plain_kept(r[1])]
    docs = spark.createDataFrame(duckdb.sql(f"select * from '{SF}/documents.parquet'").df()).where(f"doc_id in ({','.join(str(k) for k, _ in rows)})")
    from chartloom.llm.common import crc32_mod

    model = langid.learn(docs.where(crc32_mod(docs["doc_id"], 4) != 2))
    rows = [r for r, out in zip(rows, model.predict([t for _, t in rows])[2]) if not out]
    rows = [rows[min(c)] for c in plain_classes(rows)]
    items = [(k, tokens(t)) for k, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    bad = {x[0] for x in plain_overlaps([(k, tokens(t)) for k, t in rows], items)}
    library = Tokenizer.from_file(P.path(queries.BPE_FILE))
    wanted = sorted((k, *digests(library, t)) for k, t in rows if k not in bad)
    assert sorted(map(tuple, queries.pipeline(spark, SF).collect())) == wanted


def test_stages_bear_awkward_tables(spark, awkward, empty):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        assert out.count() <= awkward.count() and stage(spark, empty, SF).count() == 0
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == awkward.columns
