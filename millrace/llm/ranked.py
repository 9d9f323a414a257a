"""Operator 11: ranked lexical search, term at a time with limited accumulators.

Documents are read once.  A task turns its documents into shards of about SHARD_BYTES of text: the postings of the asked
terms and nothing else, written as one row a shard.  The documents holding each asked term and the corpus' figures are
summed over shards; then every shard answers all items and only its TOP best documents of an item leave it.  They are
ranked over all shards, limited again before the shuffle.

Within a shard an item's terms are taken rarest (heaviest) first.  What terms still to come can add at most is known from their best
posting in the shard.  Documents get an accumulator while that sum reaches the k-th best partial score; once it is below,
no document without an accumulator can be among the k best, as partial scores only grow.  From then on the remaining
terms only update documents that have one, so their scores are exact.

Items are answered in blocks of BLOCK_BYTES of text, so what is sent to all tasks (a block's terms and their weights) has
a bound however many items there are; each block reads the documents again.

Each row of items is a query of its own and carries its id.  Null or empty texts and items have no terms: they take no
part in the counts, and such an item has no rows.  Very long texts are counted whole and are a shard of their own.  Equal
scores rank by document id, null ids last; repeated documents are ranked each, in any order.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, table

TOP = 10
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 8 << 20
#: Fixed values of the measure: scale of weights and parts, and how much length counts of 100.
WEIGHT_SCALE, PART_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 75
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    """A text's terms in order: runs of ASCII letters, digits and of all characters beyond ASCII; only A-Z are lowered."""
    return TERMS.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


def _shards(asked: list[str]):
    """Rows of a shard's postings, by term in order of documents: ids, lengths, and (term, place, count) of each posting."""
    place = {t: k for k, t in enumerate(asked)}

    def emit(ids: list, sizes: list[int], found: list[Counter]) -> pa.RecordBatch:
        counts = np.array([len(x) for x in found], np.int64)
        term = np.array([k for x in found for k in x], np.int32)
        times = np.array([n for x in found for n in x.values()], np.int32)
        doc = np.repeat(np.arange(len(found), dtype=np.int32), counts)
        order = np.argsort(term, kind="stable")
        term, times, doc = term[order], times[order], doc[order]
        names, starts = np.unique(term, return_index=True)
        columns = {"ids": pa.array(ids, pa.int64()), "sizes": pa.array(sizes, pa.int64()), "terms": pa.array(names, pa.int32()), "starts": pa.array(starts, pa.int64()), "docs": pa.array(doc), "times": pa.array(times)}
        return pa.record_batch({name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in columns.items()})

    def run(batches):
        ids, sizes, found, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if words:
                    known = Counter(k for k in map(place.get, words) if k is not None)
                    ids.append(key)
                    sizes.append(len(words))
                    found.append(known)
                    held += text.as_buffer().size
                if held >= SHARD_BYTES:
                    yield emit(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield emit(ids, sizes, found)

    return run


_SHARD = "ids array<long>, sizes array<long>, terms array<int>, starts array<long>, docs array<int>, times array<int>"


class Shard:
    """The postings of one shard, with what each adds to a document's score for one occurrence of its term in an item."""

    def __init__(self, row: dict, weight: np.ndarray, total: int, words: int):
        self.ids, sizes, self.docs = row["ids"], row["sizes"], row["docs"]
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * total) // words
        times = row["times"].astype(np.int64)
        starts = row["starts"]
        ends = np.append(starts, len(times))[1:]
        self.span = dict(zip(row["terms"].tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        self.adds = np.repeat(weight[row["terms"]], ends - starts) * ((PART_SCALE * times) // (1000 * times + 8 * m[self.docs]))
        self.most = dict(zip(row["terms"].tolist(), np.maximum.reduceat(self.adds, starts).tolist() if len(starts) else [], strict=True))
        self.sums = np.zeros(len(sizes), np.int64)

    def best(self, item: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of an item's k best; item: (term, repeats), rarest first.  Of documents that tie at the k-th
        place all may be among those returned."""
        lists = [(*self.span[t], r, self.most[t]) for t, r in item if t in self.span]
        left = sum(r * most for _, _, r, most in lists)
        alive = np.zeros(0, np.int64)
        closed = False
        for start, end, repeats, most in lists:
            docs, adds = self.docs[start:end], self.adds[start:end]
            if not closed and len(alive) >= k:
                partial = self.sums[alive]
                closed = left < np.partition(partial, len(partial) - k)[len(partial) - k]
            if closed:
                has = self.sums[docs] > 0
                docs, adds = docs[has], adds[has]
            else:
                alive = np.concatenate([alive, docs[(self.sums[docs] == 0) & (adds > 0)]])
            self.sums[docs] += repeats * adds
            left -= repeats * most
        scores = self.sums[alive]
        self.sums[alive] = 0
        if len(alive) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[keep], scores[keep]
        return alive, scores


def _answers(items: list[tuple[int | None, int, list[tuple[int, int]]]], weight: np.ndarray, total: int, words: int, k: int):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].values.to_numpy(zero_copy_only=False) for name in batch.schema.names if name != "ids"}
                keys = batch.column("ids")[at].values
                shard = Shard(row | {"ids": keys}, weight, total, words)
                places, scores, owner = [], [], []
                for n, (_, _, asked) in enumerate(items):
                    found, score = shard.best(asked, k)
                    if len(found) > k:  # more tie than there is room for: least ids first, null last
                        ids = np.array([(x is None, x or 0) for x in keys.take(pa.array(found)).to_pylist()], [("none", bool), ("id", np.int64)])
                        order = np.lexsort((ids["id"], ids["none"], -score))[:k]
                        found, score = found[order], score[order]
                    places.append(found)
                    scores.append(score)
                    owner.append(np.full(len(found), n))
                own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
                yield pa.record_batch(
                    {
                        "row": pa.array([items[n][1] for n in own.tolist()], pa.int64()),
                        "item": pa.array([items[n][0] for n in own.tolist()], pa.int64()),
                        "doc": keys.take(pa.array(np.concatenate(places).astype(np.int64) if places else [], pa.int64())),
                        "score": pa.array(np.concatenate(scores).astype(np.int64) if scores else [], pa.int64()),
                    }
                )

    return run


def _block(docs: DataFrame, items: list[tuple[int | None, int, str]], k: int) -> DataFrame:
    """Ranked documents of one block of items (id, row, text)."""
    counted = [(key, row, Counter(terms(text))) for key, row, text in items]
    asked = sorted({t for _, _, c in counted for t in c})
    shards = cut(docs.mapInArrow(_shards(asked), _SHARD))
    figures = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()
    total, words = int(figures[0]), int(figures[1])
    # documents of a term in a shard: the distance to the next term's first posting
    spans = F.transform("terms", lambda t, n: F.struct(t.alias("term"), (F.coalesce(F.get("starts", n + 1), F.size("docs").cast("long")) - F.get("starts", n)).alias("n")))
    held = shards.select(F.explode(spans).alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("df")).toArrow()
    holding = np.zeros(len(asked), np.int64)
    holding[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weight = np.array([math.floor(WEIGHT_SCALE * math.log((2 * total + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)
    place = {t: n for n, t in enumerate(asked)}
    order = lambda c: sorted(((place[t], r) for t, r in c.items()), key=lambda x: (holding[x[0]], x[0]))
    queries = [(key, row, order(c)) for key, row, c in counted]
    best = shards.mapInArrow(_answers(queries, weight, total, max(1, words), k), "row long, item long, doc long, score long")
    # first within (row, part), so that a group that all shards feed is cut down before it meets in one task
    some = Window.partitionBy("row", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    whole = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    parted = best.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64)))
    few = parted.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k best documents of every item: item id, rank, document id and score."""
    asked = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).filter("text <> ''")
    bytes_ = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(bytes_ / BLOCK_BYTES))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = None
    for block in range(blocks):
        some = [(r["item"], n, r["text"]) for n, r in enumerate(dealt.filter(F.col("block") == block).orderBy("item", "text").collect())]
        found = _block(rows, some, k)
        done = found if done is None else done.union(found)
    return done.select(F.col("item").alias(item_id_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of ``documents`` for every item of ``benchmark``."""
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
ORACLE = rf"""
WITH word AS (SELECT doc_id, {_TERMS.format(text="text")} AS term FROM documents),
tally AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tally GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM len),
asked AS (SELECT item_id, {_TERMS.format(text="text")} AS term FROM benchmark),
query AS (SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tally WHERE term IN (SELECT term FROM query) GROUP BY term), total),
scored AS (SELECT item_id, doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM query JOIN weight USING (term) JOIN tally USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
