"""Substring dedup against a plain version."""

import hashlib
import random

import pytest

from millrace.llm import common, passages

from ..compare import connect, same
from .edge import SF, edge_docs, empty_docs


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)


def test_edges(spark):
    docs = edge_docs(spark)
    assert got(passages.remove_repeats(docs, digest=True)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert passages.remove_repeats(empty_docs(spark)).count() == 0


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        passages.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_random_overlaps(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    passages_ = [[rnd.choice(vocabulary) for _ in range(n)] for n in (13, 14, 12, 30, 60)]
    rows = []
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 4)):
            at = rnd.randrange(0, len(words) + 1)
            words[at:at] = rnd.choice(passages_)
        rows.append((rnd.randrange(1000), " ".join(words)))
    assert got(passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)) == brute(rows)


def test_kept_text(spark):
    text = " ".join(f"a{k}" for k in range(20))
    df = spark.createDataFrame([(1, text), (2, f"x {text}  y")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in passages.remove_repeats(df).collect()} == {1: text, 2: "x y"}


def test_cover_takes_any_two_positions_to_a_shared_anchor():
    d = set(passages.COVER)
    for i in range(passages.PERIOD):
        for j in range(passages.PERIOD):
            assert any((i + s) % passages.PERIOD in d and (j + s) % passages.PERIOD in d for s in range(passages.PERIOD))
    assert passages.PERIOD + passages.ANCHOR - 1 == passages.WINDOW


def test_matches_sql(spark):
    assert same(passages.op4_passages(spark, SF), connect(SF), passages.ORACLE) == ""


def test_word_spans_follow_the_byte_split():
    import pyarrow as pa

    texts = ["a  b", None, "", "\tx\n", "é\x0bü", "tail "]
    _, counts = common.hashed_words(pa.array(texts))
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
