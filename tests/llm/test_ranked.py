"""Ranked search against a plain scorer that visits every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ranked

from ..compare import connect, same
from .edge import SF, edge_docs, empty_docs


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


ITEMS = [(1, "The hill, the FIRE and the house"), (2, None), (3, ""), (4, "?!"), (5, "wind wind WIND three é\U0001f600"), (5, "old"), (None, "hill"), (6, "nowhere-found"), (7, "the " * 500)]


def items_frame(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS doc_id", "'clash' AS row", "'clash' AS item")


def test_edges(spark):
    docs = edge_docs(spark)
    assert got(ranked.search(docs, items_frame(spark))) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert ranked.search(empty_docs(spark), items_frame(spark)).count() == 0
    assert ranked.search(docs, items_frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1, 2000, 1 << 30])
def test_random_texts_in_any_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(ranked, "SHARD_BYTES", shard)
    rnd = random.Random(shard)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(rnd.randrange(10**6), " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(0, 60)))) for _ in range(400)]
    docs += [(rnd.randrange(10**6), docs[0][1]) for _ in range(30)]  # ties at every place
    items = [(n, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 20)))) for n in range(25)] + [(99, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(ranked.search(frame, items_frame(spark, items))) == brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 1200)
    docs = edge_docs(spark)
    assert got(ranked.search(docs, items_frame(spark))) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)


def test_accumulators_stop_and_survivors_stay_exact():
    """Two rare terms fill the k places; a frequent term after them makes no new accumulator, but updates the old ones."""
    docs = np.concatenate([np.arange(10), np.arange(10), np.arange(2000)]).astype(np.int32)
    row = {"ids": None, "sizes": np.full(2000, 50), "docs": docs, "times": np.ones(2020, np.int32), "terms": np.array([0, 1, 2], np.int32), "starts": np.array([0, 10, 20])}
    shard = ranked.Shard(row, np.array([5000, 4000, 300]), 2000, 100_000)
    item = [(0, 1), (1, 1), (2, 1)]
    added = []
    shard.sums = Watched(shard.sums, added)
    found, scores = shard.best(item, 10)
    assert sorted(found.tolist()) == list(range(10)) and len(set(scores.tolist())) == 1
    assert scores[0] == shard.adds[0] + shard.adds[10] + shard.adds[20]
    assert max(added) == 10  # never more than the survivors were written


class Watched:
    """An array that notes how many places each write touches."""

    def __init__(self, data, added):
        self.data, self.added = data, added

    def __getitem__(self, at):
        return self.data[at]

    def __setitem__(self, at, value):
        self.added.append(len(at))
        self.data[at] = value


def test_query_against_sql(spark):
    assert same(ranked.op11_ranked(spark, SF), connect(SF), ranked.ORACLE) == ""
