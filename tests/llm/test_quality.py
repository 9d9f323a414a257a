"""Quality counts against a plain version, verdicts on made texts, edges."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import documents

from .edge import PROSE, SF, edge_docs, empty_docs


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = len(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def check(docs):
    rows = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
    assert sorted(map(tuple, rows), key=str) == want


def test_counts(spark):
    check(documents(spark, SF))
    check(edge_docs(spark))


def test_verdicts(spark):
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    words = [f"{a}{b}" for a in ("ring", "stone", "water", "light", "tall", "green", "house") for b in "abcdefghijkl"]
    clean = " ".join(w if k % 3 else "the" for k, w in enumerate(words)) + " of it and that was for a man in it."
    junk = " ".join(f"{w}&&&%%%###$$$***" for w in words)
    spam = " ".join(f"the {w[0]} the" for w in words)
    made = spark.createDataFrame([(-1, clean, None), (-2, junk, "en"), (-3, spam, "en"), (-4, "too short", "en")], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs.union(made)).filter("doc_id < 0").collect()}
    assert kept[-1] and not kept[-2] and not kept[-4]


def test_edges(spark):
    assert quality.judge(empty_docs(spark)).count() == 0
    kept = [r["doc_id"] for r in quality.keep_documents(edge_docs(spark)).select("doc_id").collect()]
    assert set(kept) <= {1, 5, 6, None}
    good = " ".join(f"{w}{k}" for k, w in enumerate((PROSE * 3).split()))
    one = spark.createDataFrame([(1, good, "en"), (1, "bad", "en"), (None, good, None)], "doc_id long, text string, lang string")
    assert quality.keep_documents(one).count() == 2


def test_repeats_in_a_long_text_without_any(spark):
    """So many words that hashes of different windows clash above the place's bits."""
    words = spark.range(4_100_000, numPartitions=1).agg(F.transform(F.sequence(F.lit(0), F.lit(4_100_000 - 1)), lambda k: F.concat(F.lit("w"), k.cast("string"))).alias("w"))
    assert quality._repeats(words).select("n_repeat_words").first()[0] == 0


@pytest.mark.parametrize("spare", [0, 20, 40, 50])
def test_clashing_windows_are_told_apart(spark, spare):
    rnd = random.Random(spare)
    texts = [[rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randrange(0, 300))] for _ in range(30)] + [[], ["a"], ["a"] * 40, [f"w{k}" for k in range(3000)]]
    rows = quality._repeats(spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "id int, w array<string>"), spare=spare).select("id", "n_repeat_words").collect()
    for k, n in rows:
        w = texts[k]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(w) < 2000 else set()
        assert n == len(covered), k


def test_rare_labels_are_judged(spark):
    """A document of a label with few words is held to the references, its own among them."""
    docs = documents(spark, SF).select("doc_id", "text", "lang")
    words = [f"{a}{b}" for a in ("ring", "stone", "water", "light", "tall", "green", "house") for b in "abcdefghijkl"]
    clean = " ".join(w if k % 3 else "the" for k, w in enumerate(words)) + " of it and that was for a man in it."
    junk = " ".join(f"{w}&&&%%%###$$$***" for w in words)
    other = " ".join(f"ñçß{k}éèà" if k % 2 else "øå" for k in range(120))
    made = [*((-k, clean, "rare") for k in range(10, 30)), (-4, junk, "rare"), (-5, other, "far")]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs.union(spark.createDataFrame(made, docs.schema))).filter("doc_id < 0").collect()}
    assert not kept[-4] and all(kept[k] for k in kept if k != -4)


@pytest.mark.parametrize("edge", [False, True])
def test_rare_and_common_labels_give_the_same_distances(spark, edge):
    """All references as a table against all as literals: every row, smallest distances and verdicts."""
    docs = edge_docs(spark) if edge else documents(spark, SF).withColumn("lang", F.expr("concat('l', doc_id % 40)"))
    of = lambda n: sorted(map(tuple, quality.judge(docs, languages=n).collect()), key=str)
    table, literal = of(1), of(10**9)
    assert [r[:-2] for r in table] == [r[:-2] for r in literal]
    for a, b in zip(table, literal):
        assert a[-2:] == pytest.approx(b[-2:], abs=1e-7)
