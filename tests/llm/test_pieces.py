"""Piece encoding against the library, and exact round trips."""

import hashlib
import os
import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces

from .edge import SF, edge_docs, empty_docs

spm = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")
LIBRARY = spm.SentencePieceProcessor(model_file=pieces.MODEL) if os.path.exists(pieces.MODEL) else None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehinort  \n\t▁éüß中日\U0001f600012.,'THE"), max_size=50))
def test_same_ids_as_the_library(text):
    encoder, decoder = pieces.compiled(pieces.read_model())
    ids = encoder.encode(text)
    assert ids == LIBRARY.encode(text)
    assert decoder.decode(ids) == text.replace("▁", " ")


def test_unigram_lattice_takes_the_cheapest_path():
    model = pieces.Model([" ", "a", "b", "ab", "abc", "c"], [0.0, -1.0, -1.0, -1.5, -9.0, -1.0], [2, 1, 1, 1, 1, 1], False, "identity", False, False)
    model.ids = {p: i for i, p in enumerate(model.pieces) if i}
    model.longest = 3
    assert pieces.Encoder(model).encode("abc") == [3, 5]


def test_the_library_s_character_map():
    if not hasattr(spm, "SentencePieceNormalizer"):
        pytest.skip("no normaliser in this library")
    rnd = random.Random(4)
    pool = [chr(k) for k in (*range(1, 0x3000), *range(0xFB00, 0x10000)) if unicodedata.category(chr(k)) != "Cs"]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = spm.SentencePieceNormalizer(rule_name=rule)
        spec = next(dict(pieces._fields(v)) for k, v in pieces._fields(library.serialized_model_proto()) if k == 3)
        model = pieces.Model([], [], [], True, rule, True, True, pieces.CharMap(spec[2]))
        for _ in range(300):
            text = "".join(rnd.choice(pool) for _ in range(30))
            assert model.normalise(text) == library.normalize(text)


def plain_paths(encoder, text):
    """Every way to cut a text into pieces that follow each other."""

    def walk(at, last):
        if at == len(text):
            yield []
        for end in range(at + 1, len(text) + 1):
            k = encoder.model.ids.get(text[at:end], -1 - ord(text[at]) if end == at + 1 else None)
            if k is not None and (k < 0 or encoder._edges(text[at:end]) is not None) and (last is None or encoder._may_follow(last, k)):
                yield from ([k, *rest] for rest in walk(end, k))

    return list(walk(0, None))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("▁aehinorstTéß中"), min_size=1, max_size=14))
def test_pairs_leave_one_path_and_the_search_finds_it(text):
    encoder, _ = pieces.compiled(pieces.read_model())
    assert plain_paths(encoder, text) == [encoder._path(text)]


def test_long_parts():
    rnd = random.Random(6)
    encoder, decoder = pieces.compiled(pieces.read_model())
    for text in ("".join(rnd.choice("abcdehinorst") for _ in range(1_000_000)), "a" * 100_000, "中日本\U0001f600" * 5_000):
        ids = encoder.encode(text)
        assert ids == LIBRARY.encode(text) and decoder.decode(ids) == text


def test_columns_like_texts(monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", 60)
    encoder, decoder = pieces.compiled(pieces.read_model())
    texts = ["the hill", None, "", " ", "a  b", " lead", "trail ", "▁", "the old man, the sea.\n\nAnd", "x" * 100, "the hill", "\n", "é 中 \U0001f600", None]
    for some in (texts, texts[:1], [None], ["", ""], []):
        got = encoder.encode_column(pa.array(some, pa.string()))
        assert got.to_pylist() == [None if t is None else LIBRARY.encode(t) for t in some]
        assert decoder.decode_lists(got).to_pylist() == [None if t is None else t.replace("▁", " ") for t in some]


def test_memos_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 50)
    encoder = pieces.Encoder(pieces.compiled(pieces.read_model())[0].model)
    encoder.words, encoder.memo = pieces.Memo(20), pieces.Memo(20)
    for text in (f"{a}{b} over the {b}{a} hill" for a in ("wind", "rain", "snow", "sun") for b in ("ward", "fall", "shine", "storm", "s")):
        assert encoder.encode(text * 3) == LIBRARY.encode(text * 3)
        assert all(len(m.young) <= 20 and len(m.old) <= 20 for m in (encoder.words, encoder.memo)) and sum(map(len, encoder.follows.values())) <= 50


def test_a_bad_pair_is_taken_where_nothing_else_passes(monkeypatch):
    encoder = pieces.Encoder(pieces.compiled(pieces.read_model())[0].model)
    monkeypatch.setattr(encoder, "_may_follow", lambda a, b: False)
    assert "".join(map(encoder._text, encoder._path("▁thehill"))) == "▁thehill"


def test_query_columns(spark):
    rows = {r["doc_id"]: r["text"] for r in pieces.documents(spark, SF).collect()}
    for r in pieces.op2_pieces(spark, SF).collect():
        ids = LIBRARY.encode(rows[r["doc_id"]] or "")
        assert r["piece_ids"] == ids and r["n_pieces"] == len(ids) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_edges(spark):
    out = pieces.decode_documents(pieces.encode_documents(edge_docs(spark)))
    rows = out.select("doc_id", "text", "decoded", "piece_ids").collect()
    assert all(r["decoded"] == r["text"] for r in rows)
    assert [r["piece_ids"] for r in rows if r["text"] is None] == [None, None]
    assert [r["piece_ids"] for r in rows if r["text"] == ""] == [[]]
    assert pieces.encode_documents(empty_docs(spark)).count() == 0
