import zlib

import corpus_pipeline
from codexmill.llm import pii
from codexmill.llm.shared import materialize

from ..conftest import DATA
from . import helpers as H


def test_stages_by_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(now) == {i for i, r in before.items() if any(c.isalpha() for c in r.text)}
        elif name == "exact_dedup":
            last = {}
            for i, r in before.items():
                last[r.text] = max(i, last.get(r.text, i))
            assert set(now) == set(last.values())
        elif name == "ngram_jaccard_join":
            assert set(now) == {c for _, c in H.jaccard_components([(i, r.text) for i, r in before.items()]).values()}
        elif name == "pii":
            assert set(now) == set(before)
            changed = [i for i in now if now[i].text != before[i].text]
            assert changed and all(any(c.isdigit() for c in before[i].text) for i in changed)
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == set(before)
    whole = {}
    for p in pieces:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert all(whole[p.doc_id] == p.doc_tokens for p in pieces)
    key = lambda rows: sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in rows)
    assert key(corpus_pipeline.run(spark, DATA).collect()) == key(pieces)
    assert [n for n, _ in corpus_pipeline.STAGES][3] == "pii" and pii.DEMO_KEY and zlib


def test_pii_stage_keeps_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "call 1-555-234-4567", "mine"), (2, None, None), (1, "", "x"), (1, "call 1-555-234-4567", "mine")], "doc_id bigint, text string, pii string")
    out = corpus_pipeline.hide_pii(spark, docs, DATA)
    rows = sorted((r.doc_id, r.text or "", r.pii or "") for r in out.collect())
    assert out.columns == docs.columns and [r[0] for r in rows] == [1, 1, 1, 2] and rows[1] == rows[2] and rows[1][2] == "mine" and "234-4567" not in rows[1][1]
