"""Operator 6: language identification by cross-parsing.

A suffix automaton is built over labelled text of each language.  A text is parsed greedily against each automaton:
every phrase is the longest match that begins where the last one ended.  The language that needs fewest phrases for
the text's length wins.  Texts are lower-cased and what is not a letter counts as one space.

Parsing walks many texts at once over dense transition tables.  Texts are dealt into lanes of LANE symbols; a lane's
end also ends a phrase, for all languages alike, so whole texts are read whatever their length.

Letters are what Unicode counts as such (``str.isalpha``).  The LETTERS commonest letters of the sample have a symbol each;
all others of it are written as two or three symbols, so that every letter is told apart, in scripts of many signs too,
while tables stay as wide as an alphabet.  A letter that no sample has matches nothing.

Learning reads whole texts of a bounded sample of labelled rows: at most SAMPLE_ROWS rows a language (one from each of as
many hash buckets) and TOTAL_ROWS together, first one row of every language, then a second of every, and so on; so every
label is learnt while there are fewer than TOTAL_ROWS of them (beyond that those that sort first).  Of its rows a
language takes those up to LONGEST letters, in hash order, until it has its share of symbols: SAMPLE_SYMBOLS, or less
where there are more than TOTAL_SYMBOLS / SAMPLE_SYMBOLS languages.  If all its rows are longer, it learns from the first LONGEST
letters of the shortest.  Predictions read whole texts.

A null or empty text, or one without a letter, is ``und`` with score 0; ties go to the language that sorts first; without
any labelled row (an empty table, too) all is ``und``.  Repeated rows are judged alike, each by itself; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import documents

SAMPLE_ROWS, SAMPLE_SYMBOLS, LONGEST = 32, 24_000, 96_000
#: Bounds of what is learnt over all languages.
TOTAL_ROWS, TOTAL_SYMBOLS = 2048, 400_000
#: Letters with a symbol of their own, and symbols that lead the others'.
LETTERS, LEADS = 234, 14
LANE = 1024
UNKNOWN = "und"
_RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
_OTHER = re.compile(r"[\W\d_]+")
#: Word characters that are neither decimal digits nor letters, as fractions and numbers in circles: a large class, so slow.
_NUMBERS = re.compile(f"[ {''.join(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]+")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row's id falls into the fold that learning leaves out; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def normalise(text: str) -> str:
    """Lower case; runs of other characters than letters become one space."""
    line = _OTHER.sub(" ", text.lower())
    if not line.replace(" ", "").isalpha():
        line = _NUMBERS.sub(" ", line)
    return line.strip()


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Dense transitions (state by symbol, -1 where there is none) of the automaton of all substrings."""
    following, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(following), alphabet), -1, np.int32)
    for state, arcs in enumerate(following):
        for c, to in arcs.items():
            table[state, c] = to
    return table


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, list[str]]:
    """Texts to learn from: a row from each hash bucket of each language, by least hash; hot languages pre-aggregate.

    The languages' rows are picked in turns, the first of each before the second of any.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"), F.pmod(h, F.lit(SAMPLE_ROWS)).alias("bucket"))
    kept = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # over SAMPLE_ROWS rows a language
    picked = kept.withColumn("turn", turn).orderBy("turn", "lang").limit(TOTAL_ROWS).drop("turn")
    texts = rows.join(F.broadcast(picked), ["lang", "bucket", "h"]).dropDuplicates(["lang", "bucket", "h"])
    rows_of: dict[str, list[str]] = {}
    for r in texts.orderBy("lang", "h").collect():
        if t := normalise(r["text"]):
            rows_of.setdefault(r["lang"], []).append(t)
    share = min(SAMPLE_SYMBOLS, TOTAL_SYMBOLS // max(1, len(rows_of)))
    found: dict[str, list[str]] = {}
    for lang, own in sorted(rows_of.items()):
        have = found.setdefault(lang, [])
        for t in own:
            if len(t) <= LONGEST and sum(map(len, have)) < share:
                have.append(t)
        if not have:
            have.append(min(own, key=len)[:LONGEST])
    return found


class Model:
    """Automata of the learned languages over one alphabet; symbol 0 is what no sample has, 1 is the space."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = list(texts)
        counts: dict[str, int] = {}
        for c in "".join(t for ts in texts.values() for t in ts):
            counts[c] = counts.get(c, 0) + 1
        counts.pop(" ", None)
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.codes = {" ": (1,)} | {c: (k,) for k, c in enumerate(letters[:LETTERS], 2)}
        size, rare = min(len(letters), LETTERS) + 2, letters[LETTERS:]
        if rare:
            lead, size = size, size + LEADS
            for k, c in enumerate(rare):  # two symbols for the first, three for the rest
                high, low = divmod(k, size - 1)
                self.codes[c] = (lead + high, low + 1) if high < LEADS - 1 else (lead + LEADS - 1, (high - LEADS + 1) % (size - 1) + 1, low + 1)
        self.tables, self.roots, at = [], [], 0
        for ts in texts.values():
            t = suffix_automaton([k for c in " ".join(ts) for k in self.codes.get(c, (0,))], size)
            t[:, 0] = -1
            self.tables.append(np.where(t >= 0, t + at, -1).astype(np.int32))
            self.roots.append(at)
            at += len(t)
        self.arcs = np.concatenate(self.tables) if self.tables else np.zeros((0, size), np.int32)
        del self.tables

        self.code = np.zeros((3, 0x110000) if rare else (1, 0x110000), np.uint8)
        for c, own in self.codes.items():
            self.code[: len(own), ord(c)] = own
        del self.codes

    def symbols(self, text: str) -> np.ndarray:
        """A text's symbols, up to three a letter; 0 is a letter that no sample has."""
        letters = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        if len(self.code) == 1:
            return self.code[0][letters]
        each = self.code[:, letters]
        there = each > 0
        there[0] = True
        return each.T[there.T]

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of phrases of each lane (rows, sorted by length downwards) against each language."""
        n, roots = len(lanes), np.array(self.roots, np.int32)
        count = np.ones((len(roots), n), np.int32)
        state = np.repeat(roots[:, None], n, 1)
        step = np.ascontiguousarray(lanes.T)
        active = n
        for t in range(int(lengths[0]) if n else 0):
            active = int(np.searchsorted(-lengths[:active], -t, "left"))
            c = step[t, :active]
            now = state[:, :active]
            to = self.arcs[now, c]
            dead = to < 0
            if dead.any():
                # A phrase ends here; the next begins with this symbol.  At a root the symbol itself is the phrase.
                count[:, :active] += dead & (now != roots[:, None])
                again = self.arcs[np.broadcast_to(roots[:, None], now.shape)[dead], np.broadcast_to(c, now.shape)[dead]]
                alone = again < 0
                to[dead] = np.where(alone, np.broadcast_to(roots[:, None], now.shape)[dead], again)
                extra = np.zeros(now.shape, np.int32)
                extra[dead] = alone
                count[:, :active] += extra
            state[:, :active] = to
        return count - (state == roots[:, None])  # at a root no phrase has begun

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and, as its score, by how much the second best needs more phrases."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        pieces, owner = [], []
        for k, t in enumerate(texts):
            if t and self.languages and any(map(str.isalpha, t)):
                s = self.symbols(normalise(t))
                for at in range(0, len(s), LANE):
                    pieces.append(s[at : at + LANE])
                    owner.append(k)
        if not pieces:
            return names, scores
        lengths = np.array([len(p) for p in pieces])
        order = np.argsort(-lengths, kind="stable")
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        owner = np.array(owner)
        for at in range(0, len(order), 2048):
            part = order[at : at + 2048]
            lanes = np.zeros((len(part), int(lengths[part[0]])), np.uint8)
            for row, k in enumerate(part):
                lanes[row, : lengths[k]] = pieces[k]
            for lang, found in enumerate(self.phrases(lanes, lengths[part])):
                np.add.at(total[lang], owner[part], found)
        for k in np.unique(owner):
            best = int(np.argmin(total[:, k]))
            rest = np.delete(total[:, k], best)
            names[k] = self.languages[best]
            scores[k] = 1 - total[best, k] / rest.min() if len(rest) else 1.0
        return names, scores


def predictor(model) -> object:
    """A column function over texts for a broadcast model."""

    @arrow_udf(_RESULT)
    def predict(text: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(text), 512):
            n, s = model.value.predict(text.slice(at, 512).to_pylist())
            names += n
            scores.append(s)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    return predict


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled rows outside the held-out fold."""
    return Model(sample(docs.filter(~held_out(id_col)), text_col, lang_col, id_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the held-out flag, the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.select(F.col(id_col), F.col(text_col).alias("t")).withColumn("p", predictor(shared)(F.col("t")))
    return found.select(id_col, held_out(id_col).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``."""
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
