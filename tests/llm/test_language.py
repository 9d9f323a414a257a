"""Language identification: held-out accuracy, the parse against a plain one, edges."""

import zlib

import numpy as np

from millrace.llm import language
from millrace.llm.common import documents

from .edge import SF, edge_docs, empty_docs


def plain_phrases(text, sample):
    """Greedy longest matches, an unmatched symbol being a phrase of its own."""
    at = n = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_parse_counts_phrases():
    texts = {"a": ["the cat sat on the mat and the rat"], "b": ["der hund und die katze sind im haus"]}
    model = language.Model(texts)
    for text in ("the cat and the hat", "die katze und der hund", "zzz", "cat", "mat the"):
        s = model.symbols(text)
        found = model.phrases(s[None, :], np.array([len(s)]))
        for k, lang in enumerate(texts):
            assert found[k, 0] == plain_phrases(text, texts[lang][0]), (text, lang, found)


def plain_predict(text, samples):
    """Fewest phrases over lanes of the normalised text; the score is by how much the second best needs more."""
    line = language.normalise(text or "")
    if not any(c.isalpha() for c in line):
        return "und", 0.0
    lanes = [line[k : k + language.LANE] for k in range(0, len(line), language.LANE)]
    need = {lang: sum(plain_phrases(x, " ".join(ts)) for x in lanes) for lang, ts in samples.items()}
    best = min(need, key=lambda lang: (need[lang], lang))
    rest = min((n for lang, n in need.items() if lang != best), default=None)
    return best, 1.0 if rest is None else 1 - need[best] / rest


def test_the_query_follows_a_plain_parse(spark):
    docs = documents(spark, SF)
    samples = language.sample(docs.filter(~language.held_out("doc_id")))
    assert sum(len(x) for ts in samples.values() for x in ts) < 4 * language.SAMPLE_SYMBOLS * len(samples)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.op6_language(spark, SF).collect():
        text = texts[r["doc_id"]]
        if text is None or len(text) < 6000:
            lang, score = plain_predict(text, samples)
            assert (r["lang_pred"], round(r["score"], 9)) == (lang, round(score, 9))
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_long_texts_and_ties():
    model = language.Model({"a": ["abc"], "b": ["abd"]})
    text = "ab " * 2000 + "zz"
    names, scores = model.predict([text, "ab", "abd", None, "12 3", "abd abd"])
    plain = [plain_predict(t, {"a": ["abc"], "b": ["abd"]}) for t in (text, "ab", "abd", None, "12 3", "abd abd")]
    assert list(zip(names, [round(x, 9) for x in scores], strict=True)) == [(n, round(x, 9)) for n, x in plain]


def test_held_out_accuracy(spark):
    docs = documents(spark, SF)
    rows = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = language.identify(docs, language.train(docs)).select("doc_id", "lang_pred", "score").collect()
    assert len(rows) == 11
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    none = language.identify(docs, language.train(empty_docs(spark))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.identify(empty_docs(spark), language.train(docs)).count() == 0


def test_signs_that_are_not_letters():
    model = language.Model({"a": ["abc"], "b": ["abd"]})
    names, scores = model.predict(["½ ² ①", "Ⅷ 12 _", "½ ab", "ª"])
    assert names[:2] == ["und", "und"] and scores[0] == 0 and names[2] != "und" and names[3] != "und"
    assert language.normalise("A½b²①C") == "a b c"


def test_scripts_of_many_signs_are_told_apart():
    """Two languages over 6,000 signs each, which share none of their frequent pairs."""
    rnd = np.random.default_rng(1)
    signs = [chr(0x4E00 + k) for k in range(6000)]
    learn = {k: ["".join(signs[i] for i in np.roll(rnd.permutation(6000), 0))] for k in ("a", "b")}
    model = language.Model(learn)
    assert len(set(map(tuple, (model.symbols(c).tolist() for c in signs)))) == 6000
    tests = [learn[k][0][at : at + 300] for k in ("a", "b") for at in (0, 1000, 5000)]
    assert model.predict(tests)[0] == ["a"] * 3 + ["b"] * 3


def test_every_label_is_learnt(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 20, f"l{k:03d}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.Model(language.sample(docs))
    assert model.languages == [r[2] for r in rows]
    assert model.predict([r[1] for r in rows])[0] == [r[2] for r in rows]


def test_long_rows_are_not_cut_while_others_are_there(spark, monkeypatch):
    monkeypatch.setattr(language, "LONGEST", 50)
    docs = spark.createDataFrame([(1, "abc " * 40, "a"), (2, "short text", "a"), (3, "xyz " * 40, "b"), (4, "xyz " * 30, "b")], "doc_id long, text string, lang string")
    assert language.sample(docs) == {"a": ["short text"], "b": [("xyz " * 30)[:50]]}
