"""The pipeline against a plain version of its stages."""

import os

import pytest

import corpus_pipeline
from millrace.llm import pieces, pii, quality
from millrace.llm.common import documents, table

from .edge import SF, edge_docs, empty_docs
from .test_decontaminate import normal
from .test_simhash import plain_dedup

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")


def test_stages_against_plain_python(spark):
    spm = pytest.importorskip("sentencepiece")
    rows = {r["doc_id"]: r for r in documents(spark, SF).collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(documents(spark, SF)).collect()}
    left = sorted(i for i in rows if verdicts[i])
    assert 0 < len(left) < len(rows)
    left = plain_dedup(left, {i: rows[i]["text"] for i in left})
    grams = {tuple(w[k : k + 13]) for r in table(spark, SF, "benchmark").collect() for w in [normal(r["text"])] for k in range(len(w) - 12)}
    left = [i for i in left if not any(tuple(w[k : k + 13]) in grams for w in [normal(rows[i]["text"])] for k in range(len(w) - 12))]
    library = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {i: pii.redact(rows[i]["text"]) for i in left}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(left)
    for i, r in out.items():
        assert r["text"] == want[i] and r["n_chars"] == len(want[i]) and r["piece_ids"] == library.encode(want[i])


def test_every_stage_takes_edges(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge_docs(spark), empty_docs(spark)):
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert sorted(out.columns) == sorted(docs.columns), name
            assert out.count() <= docs.count()
