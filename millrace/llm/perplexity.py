"""Operator 7: language-model scoring with Brown classes.

The model is p(word | previous) = p(class | previous class) * p(word | class).  Classes come from exchange clustering, in
two steps.  First the frequent words (1/UNITS of all tokens or more each) are moved one by one on the driver; all other
words stand together by ending there, so that what the driver holds is bounded.  Then every other word that training saw,
however rare, is moved by itself: its neighbours' classes are counted over all its occurrences and it goes where they are
most likely, from the class of its ending.  Those words are grouped by hash, so their number has no bound.  Only words that
training did not see keep the class of their ending.  Class bigrams are counted anew under the final classes.

Class transitions mix add-half bigrams with the class unigram; emissions are add-half within the class, with one more slot
for words that training did not see.

Counts cover all training documents.  What goes to the driver or is broadcast is bounded by parameters, however large
the corpus: at most UNITS frequent words (each has 1/UNITS of the tokens, so there cannot be more), ENDINGS endings,
the counts and classes of the HELD commonest words and a CLASSES by CLASSES matrix.  All other counts and classes are
joined: documents are dealt into chunks, a chunk asks once for each distinct word that is not held, so no word is hot, and
reads its texts again with the answers beside them.

Text is lower-cased in A-Z; words are what white space parts; an end follows each text and counts as a token.  A null
text is an empty one: its only token is the end.  A null id is in no fold, so its text is learnt from.  An empty
table gives no rows.  Repeated rows are learnt from and scored each by itself; texts are read whole.  A word of two classes
that gain alike goes to the first.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunk_count, cut, documents, positions, signed, text_buffer, with_chunk, word_hashes, word_spans
from .common import blocks as text_blocks
from .language import held_out

UNITS, ENDINGS, CLASSES, ROUNDS = 4096, 1024, 48, 6
#: Words whose counts and classes go with the model; the others are joined.
HELD = 1 << 16
#: Rare words that are moved in one group.
GROUP_WORDS = 1 << 16
FOLD = 1
#: Share of the class bigram in a transition; the rest is the class unigram.
MIX = 0.95
END = np.uint64(0x9E3779B97F4A7C15)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, ending units, number of words of each document) of the lower-cased texts."""
    values, offsets = text_buffer(column)
    hashes, endings, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in text_blocks(offsets):
        lo, hi = offsets[i], offsets[j]
        part = values[lo:hi]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        doc, start, end = word_spans(part, offsets[i : j + 1] - lo)
        hashes.append(word_hashes(part, start, end))
        # The last three bytes (fewer in short words) and whether the word is long name its ending.
        tail = [np.where(end - start >= k, part[end - np.minimum(k, end - start)], 0).astype(np.int64) for k in (1, 2, 3)] if len(start) else [np.zeros(0, np.int64)] * 3
        long = (end - start > 6).astype(np.int64)
        endings.append(((tail[0] * 31 + tail[1] * 17 + tail[2] * 5 + long * 509) % ENDINGS).astype(np.int32))
        counts.append(np.bincount(doc, minlength=j - i))
    return np.concatenate(hashes), np.concatenate(endings), np.concatenate(counts)


def _with_ends(hashes: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with an end behind each document's words."""
    doc, at = positions(counts)
    place = np.arange(len(hashes)) + doc
    n = len(hashes) + len(counts)
    h, e = np.full(n, END, np.uint64), np.zeros(n, np.int32)
    h[place], e[place] = hashes, endings
    return h, e, counts + 1


def _count_words(batches):
    """(word, number) of each batch of training texts."""
    for batch in batches:
        words, n = np.unique(_with_ends(*tokens(batch.column(0)))[0], return_counts=True)
        yield pa.record_batch({"h": pa.array(signed(words)), "n": pa.array(n.astype(np.int64))})


class Units:
    """Sorted words that are told apart, then endings for all others."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent.view(np.uint64))
        self.size = len(self.frequent) + ENDINGS

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return endings.astype(np.int64)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, at, len(self.frequent) + endings)


def _count_pairs(shared):
    """(first unit, second unit, number) of each batch; a document begins behind an end."""

    def run(batches):
        units = shared.value
        end = int(units.of(np.array([END]), np.zeros(1, np.int32))[0])
        for batch in batches:
            h, e, counts = _with_ends(*tokens(batch.column(0)))
            unit = units.of(h, e)
            before = np.concatenate([[end], unit[:-1]])
            pair, n = np.unique(before * units.size + unit, return_counts=True)
            yield pa.record_batch({"a": pa.array((pair // units.size).astype(np.int32)), "b": pa.array((pair % units.size).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    return run


def _contexts(pairs: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit, how often each class stands before it and behind it: two bounded matrices."""
    spark = pairs.sparkSession
    of = spark.createDataFrame(pa.table({"unit": pa.array(np.arange(len(classes), dtype=np.int32)), "class": pa.array(classes.astype(np.int32))}))
    before = pairs.join(F.broadcast(of), F.col("a") == F.col("unit")).groupBy(F.col("b").alias("u"), "class").agg(F.sum("n").alias("n"), F.lit(0).alias("side"))
    behind = pairs.join(F.broadcast(of), F.col("b") == F.col("unit")).groupBy(F.col("a").alias("u"), "class").agg(F.sum("n").alias("n"), F.lit(1).alias("side"))
    out = np.zeros((2, len(classes), CLASSES))
    rows = before.union(behind).toArrow()
    out[rows.column("side").to_numpy(), rows.column("u").to_numpy(), rows.column("class").to_numpy()] = rows.column("n").to_numpy()
    return out[0], out[1]


def exchange(pairs: DataFrame, totals: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering: (class of each unit, class bigram counts).

    Each round counts every unit's neighbour classes over all pairs, then moves half of the units (alternating, so that
    two neighbours do not swap for ever) to the class under which their neighbours are most likely.  The likelihood of all
    pairs under the classes is held against the best so far: two rounds without a rise end the search, and the best classes
    are returned.
    """
    order = np.argsort(-totals, kind="stable")
    classes = np.zeros(len(totals), np.int64)
    classes[order] = np.arange(len(order)) % CLASSES
    best, stale = (-np.inf, classes, np.zeros((CLASSES, CLASSES))), 0
    for k in range(rounds + 1):
        left, right = _contexts(pairs, classes)
        bigram = np.zeros((CLASSES, CLASSES))
        np.add.at(bigram.T, classes, left)
        likely = likelihood(bigram)
        stale = 0 if likely > best[0] else stale + 1
        if likely > best[0]:
            best = likely, classes, bigram
        if k == rounds or stale == 2:
            break
        into, out = _gains(bigram)
        gain = left @ into + right @ out.T
        to = np.argmax(gain, 1)
        movable = (np.arange(len(classes)) % 2 == k % 2) & (totals > 0) & (gain[np.arange(len(classes)), to] > gain[np.arange(len(classes)), classes])
        classes = np.where(movable, to, classes)
    return best[1], best[2]


def likelihood(bigram: np.ndarray) -> float:
    """What classes add to the log likelihood of all pairs: the sum of n log n over pairs less that over both margins."""
    entropy = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return entropy(bigram) - entropy(bigram.sum(0)) - entropy(bigram.sum(1))


def _gains(bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each class (column of the first, row of the second) behind and before each other class."""
    size = bigram.sum(0) + 1.0
    return np.log((bigram + 0.5) / size[None, :]), np.log((bigram + 0.5) / size[:, None])


def _near_rare(shared):
    """Of each batch: each rare word with its ending and, by occurrence, the classes before and behind it as one number."""

    def run(batches):
        units, classes = shared.value
        for batch in batches:
            h, e, _ = _with_ends(*tokens(batch.column(0)))
            unit = units.of(h, e)
            cls = classes[unit].astype(np.uint16)
            # A document begins behind an end, and each batch ends with one.
            near = np.roll(cls, 1) * np.uint16(CLASSES) + np.roll(cls, -1)
            rare = np.flatnonzero(unit >= len(units.frequent))
            order = rare[np.argsort(h[rare], kind="stable")]
            words, first = np.unique(h[order], return_index=True)
            offsets = np.append(first, len(order)).astype(np.int32) * 2
            packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(near[order].tobytes())])
            yield pa.record_batch({"h": pa.array(signed(words)), "ending": pa.array(e[order][first].astype(np.int32)), "near": packed})

    return run


def _move_rare(shared):
    """(word, number, class) of a group of rare words: the class under which their neighbours are most likely."""

    def run(rows: pa.Table) -> pa.Table:
        starts, into, out = shared.value
        words, first, word = np.unique(rows.column("h").to_numpy(), return_index=True, return_inverse=True)
        values, offsets = text_buffer(rows.column("near"))
        near = values[offsets[0] : offsets[-1]].view(np.uint16)
        word = np.repeat(word, np.diff(offsets) // 2)
        count = lambda cls: np.bincount(word * CLASSES + cls, minlength=len(words) * CLASSES).reshape(len(words), CLASSES)
        ending = rows.column("ending").to_numpy()[first]
        gain = count(near // CLASSES) @ into + count(near % CLASSES) @ out.T
        own, to, each = starts[ending], np.argmax(gain, 1), np.arange(len(words))
        classes = np.where(gain[each, to] > gain[each, own], to, own)
        return pa.table({"h": pa.array(words), "c": pa.array(np.bincount(word, minlength=len(words)).astype(np.int64)), "class": pa.array(classes.astype(np.int32))})

    return run


def _rows(found: pa.Table, *names: str) -> list[np.ndarray]:
    return [found.column(name).to_numpy() for name in names]


class Model:
    """What scoring needs besides the words that are not held: all of it bounded."""

    def __init__(self, units: Units, classes: np.ndarray, held: np.ndarray, n: np.ndarray, v: np.ndarray):
        self.units, self.classes, self.held, self.n = units, classes, held, n
        self.total, self.distinct = float(n.sum()), float(v.sum())
        self.emission = np.log10(n + 0.5 * (v + 1))
        self.end = int(classes[units.of(np.array([END]), np.zeros(1, np.int32))[0]])
        self.transition = np.zeros((CLASSES, CLASSES))

    def follow(self, bigram: np.ndarray) -> Model:
        """Take the transitions from counts of class bigrams."""
        unigram = (self.n + 0.5) / (self.n.sum() + 0.5 * CLASSES)
        given = (bigram + 0.5) / (bigram.sum(1, keepdims=True) + 0.5 * CLASSES)
        self.transition = np.log10(MIX * given + (1 - MIX) * unigram[None, :])
        return self

    def asked(self, hashes: np.ndarray) -> np.ndarray:
        """The distinct words that are not held."""
        found = np.unique(hashes)
        return found[self.units.of(found, np.zeros(len(found), np.int32)) >= len(self.units.frequent)]

    def tag(self, column, words: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, log10 emissions) of each text and all tokens' classes; words: sorted, those
        asked for that training saw, with their counts and classes."""
        h, e, n = _with_ends(*tokens(column))
        unit = self.units.of(h, e)
        held = unit < len(self.units.frequent)
        c = np.where(held, np.append(self.held, 0)[np.minimum(unit, len(self.held))], 0)
        cls = self.classes[unit]
        if len(words) and len(h):
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            told = words[at] == h
            c, cls = np.where(told, counts[at], c), np.where(told, classes[at], cls)
        first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        own = np.log10(c + 0.5) - self.emission[cls]
        return n, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(own, first), cls.astype(np.uint8)


def _ask(shared):
    """Each distinct word of a chunk that is not held, once."""

    def run(rows: pa.Table) -> pa.Table:
        found = shared.value.asked(tokens(rows.column("text"))[0])
        number = rows.column("chunk")[0].as_py() if rows.num_rows else 0
        return pa.table({"chunk": pa.array(np.full(len(found), number, np.int32)), "h": pa.array(signed(found))})

    return run


def _tag(shared):
    def run(rows: pa.Table, reply: pa.Table) -> pa.Table:
        words, counts, classes = _rows(reply, "h", "c", "class")
        words = words.view(np.uint64)
        order = np.argsort(words)
        if rows.num_rows:
            n, known, base, own, cls = shared.value.tag(rows.column("text"), words[order], counts[order], classes[order])
        else:
            n, known, base, own, cls = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2 + (np.zeros(0, np.uint8),)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        tags = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(cls.tobytes())])
        return pa.table({"id": rows.column("id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base.astype(float)), "own": pa.array(own.astype(float)), "tags": tags})

    return run


def _followed(column, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair of classes of each token and the one before it, first token of each text); each text ends with an end."""
    values, offsets = text_buffer(column)
    cls = values[offsets[0] : offsets[-1]].astype(np.int64)
    return np.concatenate([[end], cls[:-1]])[: len(cls)] * CLASSES + cls, offsets[:-1] - offsets[0]


def _count_tags(end: int):
    def run(batches):
        for batch in batches:
            pair, n = np.unique(_followed(batch.column(0), end)[0], return_counts=True)
            yield pa.record_batch({"pair": pa.array(pair.astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    return run


def _add_transitions(shared, names: list[str]):
    def run(batches):
        transition, end = shared.value
        flat = transition.ravel()
        for batch in batches:
            pair, first = _followed(batch.column("tags"), end)
            own = batch.column("own").to_numpy() + (np.add.reduceat(flat[pair], first) if len(first) else np.zeros(0))
            yield pa.record_batch([batch.column(x) for x in names] + [pa.array(own)], names=[*names, "score"])

    return run


def words_and_classes(docs: DataFrame, text: str = "text", units: int = UNITS, held: int = HELD) -> tuple[DataFrame, Model, int]:
    """(words (h, c, class), the model without its transitions, number of training tokens) of a table of training texts."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = cut(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter(F.col("c") * units >= max(total, 1)).toArrow()
    table = Units(np.ascontiguousarray(frequent.column("h").to_numpy()))
    pairs = cut(texts.mapInArrow(_count_pairs(spark.sparkContext.broadcast(table)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    tokens_in = np.zeros(table.size)
    unit, n = _rows(pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow(), "b", "n")
    tokens_in[unit] = n
    classes, bigram = exchange(pairs, tokens_in)

    # The other words, each by itself.
    endings = classes[len(table.frequent) :]
    moved = spark.sparkContext.broadcast((endings, *_gains(bigram)))
    near = texts.mapInArrow(_near_rare(spark.sparkContext.broadcast((table, classes))), "h long, ending int, near binary")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(distinct / GROUP_WORDS))
    rare = near.withColumn("group", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int")).groupBy("group").applyInArrow(_move_rare(moved), "h long, c long, class int")
    h, c = _rows(frequent, "h", "c")
    of = table.of(np.ascontiguousarray(h).view(np.uint64), np.zeros(len(h), np.int32))
    words = spark.createDataFrame(pa.table({"h": pa.array(h), "c": pa.array(c), "class": pa.array(classes[of].astype(np.int32))}), "h long, c long, class int")
    words = cut(words.union(rare))

    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    k, tokens_of, words_of = _rows(words.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow(), "class", "n", "v")
    n[k], v[k] = tokens_of, words_of
    # the end of a text is always held
    first = F.col("h") != F.lit(int(END.view(np.int64)))
    h, c, k = _rows(words.orderBy(first, F.desc("c"), "h").limit(held + 1).toArrow(), "h", "c", "class")
    order = np.argsort(np.ascontiguousarray(h).view(np.uint64))
    return words, Model(Units(np.ascontiguousarray(h)), np.concatenate([k[order].astype(np.int64), endings]), c[order], n, v), int(total)


def tag(docs: DataFrame, words: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per input row: token counts, the base score, the sum of log emissions and the tokens' classes."""
    columns = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds, FOLD).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = with_chunk(columns, chunk_count(columns), "id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = placed.groupBy("chunk").applyInArrow(_ask(shared), "chunk int, h long")
    answered = asked.join(words, "h").select("chunk", "h", "c", "class")
    kind = dict(columns.dtypes)["id"]
    return placed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_tag(shared), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, own double, tags binary")


def transitions(tagged: DataFrame, model: Model) -> Model:
    """The model with the transitions of tagged training texts."""
    bigram = np.zeros(CLASSES * CLASSES)
    pair, n = _rows(tagged.select("tags").mapInArrow(_count_tags(model.end), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow(), "pair", "n")
    bigram[pair] = n
    return model.follow(bigram.reshape(CLASSES, CLASSES))


def train(docs: DataFrame, text: str = "text", units: int = UNITS, held: int = HELD) -> tuple[DataFrame, Model, int]:
    """(words (h, c, class), the model, number of training tokens) of a table of training texts."""
    words, model, total = words_and_classes(docs, text, units, held)
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return words, transitions(tag(texts, words, model), model), total


def scored(tagged: DataFrame, model: Model, total: int, id_col: str = "doc_id") -> DataFrame:
    """Tagged texts with the model's score."""
    names = ["id", "held_out", "n_tokens", "n_known", "base_score"]
    shared = tagged.sparkSession.sparkContext.broadcast((model.transition, model.end))
    kind = dict(tagged.dtypes)["id"]
    out = tagged.mapInArrow(_add_transitions(shared, names), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, words: DataFrame, model: Model, total: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per input row: token counts, the base score and the model's score."""
    return scored(tag(docs, words, model, id_col, text_col, folds), model, total, id_col)


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of ``documents`` under a model of those outside the held-out fold."""
    docs = documents(spark, sf_dir)
    words, model, total = words_and_classes(docs.filter(~held_out("doc_id", 5, FOLD)))
    # All texts are tagged once: those learnt from give the transitions, then all are scored.
    tagged = cut(tag(docs, words, model))
    return scored(tagged, transitions(tagged.filter("NOT held_out"), model), total)
