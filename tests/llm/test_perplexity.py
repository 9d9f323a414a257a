"""Language-model scores: the base against plain counts; the model is a distribution and beats the base on its own texts."""

import math
import random
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import perplexity
from millrace.llm.common import documents
from millrace.llm.language import held_out

from .edge import SF, edge_docs, empty_docs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def run(docs):
    counts, model, total = perplexity.train(docs.filter(~held_out("doc_id", 5, 1)))
    return perplexity.score(docs, counts, model, total), model


def brute(rows):
    tokens = [(i, (t or "").translate(LOWER).encode().split() + [None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(t for i, ts in tokens if not out(i) for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 5)) for i, ts in tokens), key=str)


@pytest.mark.parametrize("edge", [False, True])
def test_base_follows_plain_counts(spark, edge):
    docs = edge_docs(spark) if edge else documents(spark, SF)
    scored, _ = run(docs)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in scored.collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_probabilities_sum_to_one(spark):
    docs = documents(spark, SF)
    counts, model, _ = perplexity.train(docs)
    rows = counts.collect()
    assert abs((10**model.transition).sum(1) - 1).max() < 1e-9
    n, v = sum(r["c"] for r in rows), len(rows)
    assert (n, v) == (model.total, model.distinct)
    # emissions: known words and one unseen slot per class
    assert abs((10**model.emission).sum() - (n + 0.5 * (v + perplexity.CLASSES))) < 1e-3 * n


def test_model_beats_the_unigram_on_what_it_learnt(spark):
    scored, _ = run(documents(spark, SF))
    r = scored.filter("NOT held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r["s"] > r["b"]


def test_empty(spark):
    scored, _ = run(empty_docs(spark))
    assert scored.count() == 0


def test_scores_follow_the_formula(spark):
    """Every token's class transition and emission, taken one by one from the model's parts."""
    docs = documents(spark, SF)
    scored, model = run(docs)
    texts = {r["doc_id"]: (r["text"] or "").translate(LOWER).encode().split() for r in docs.collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in texts.items() if not out(i) for w in [*ws, None])

    def unit(w):
        if w is None:
            return int(model.units.of(np.array([perplexity.END]), np.zeros(1, np.int32))[0])
        h, e, _ = perplexity.tokens(pa.array([w.decode()]))
        return int(model.units.of(h, e)[0])

    classes = {w: int(model.classes[unit(w)]) for w in {w for ws in texts.values() for w in ws} | {None}}
    n, v = Counter(), Counter()
    for w, k in c.items():
        n[classes[w]] += k
        v[classes[w]] += 1
    for r in scored.collect():
        total, before = 0.0, classes[None]
        for w in [*texts[r["doc_id"]], None]:
            k = classes[w]
            total += model.transition[before, k] + math.log10((c[w] + 0.5) / (n[k] + 0.5 * (v[k] + 1)))
            before = k
        assert abs(total - r["score"]) < 1e-6 * max(1, abs(total))


def test_exchange_finds_the_classes_of_made_pairs(spark):
    """Two kinds of words that only follow each other end in different classes, and the likelihood is the best that was seen."""
    rnd = random.Random(1)
    words = [[f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]]
    rows = [(i, " ".join(rnd.choice(words[k % 2]) for k in range(60))) for i in range(80)]
    _, model, _ = perplexity.train(spark.createDataFrame(rows, "doc_id long, text string"))
    of = lambda w: int(model.classes[int(model.units.of(*perplexity.tokens(pa.array([w]))[:2])[0])])
    assert not {of(w) for w in words[0]} & {of(w) for w in words[1]}


def rare_rows():
    """Two common words and two kinds of words that occur three times each and end alike."""
    rnd = random.Random(2)
    kinds = [[f"{kind}{a}{b}zzz" for a in "abcdefghij" for b in "klmnopqr"] for kind in "xy"]
    rows = []
    for k in range(3):
        order = [rnd.sample(kind, len(kind)) for kind in kinds]
        rows += [(k, " ".join(f"one {x} two {y}" for x, y in zip(*order)))]
    return kinds, rows


def test_every_rare_word_is_moved_by_itself(spark):
    """Words far below the share that the driver moves, with one ending, get the class of their own neighbours."""
    kinds, rows = rare_rows()
    words, _, _ = perplexity.train(spark.createDataFrame(rows, "doc_id long, text string"), units=8, held=1)
    of = {r["h"]: r["class"] for r in words.collect()}
    x, y = ({of[int(perplexity.tokens(pa.array([w]))[0].view(np.int64)[0])] for w in kind} for kind in kinds)
    assert len(x) == len(y) == 1 and x != y


@pytest.mark.parametrize("held", [0, 50])
def test_scores_do_not_depend_on_what_is_held(spark, held):
    docs = documents(spark, SF)
    learnt = docs.filter(~held_out("doc_id", 5, 1))
    rows = []
    for most in (held, perplexity.HELD):
        words, model, total = perplexity.train(learnt, held=most)
        rows.append({r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in perplexity.score(docs, words, model, total).collect()})
    assert rows[0] == rows[1]
