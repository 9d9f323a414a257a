"""Operator 4: substring dedup with difference-cover anchors.

A window is WINDOW consecutive words of a document.  It is removed if its words also start in a document with a
smaller id, together with every word that it covers.

Anchors are hashes of ANCHOR words at positions whose remainder modulo PERIOD is in COVER.  COVER is a difference
cover: for any two positions there is a shift below PERIOD that takes both to cover positions.  As
PERIOD + ANCHOR - 1 = WINDOW, two equal windows share an anchor at one and the same place inside them.  So only anchors
are compared between all documents (48 bits of hash: a chance meeting costs a few windows more to compare, nothing
else); where one is shared, it is extended to the windows around it, and these are compared in full (80 bits of hash).

Documents are dealt into chunks by the hash of their id.  A chunk sends every distinct anchor or window once, so a
passage that a third of all documents hold costs one row a chunk.  Chunks read their texts again instead of sending
positions; the texts' exchange is the same in all passes and is reused.

Ids are integers (others are an error, as no order of theirs is told).  Null or empty text: no words.  Equal ids count as one document: neither removes from the other.  A row whose id is
null removes nothing and loses nothing.  A text of any length is one row of its chunk and read whole; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunk_count, documents, hashed_words, positions, signed, window_hashes, with_chunk

WINDOW, PERIOD, ANCHOR = 13, 7, 7
COVER = (0, 1, 3)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class Chunk:
    """Word arrays of a chunk's documents, in order of their ids."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(np.argsort(rows.column("doc_id").to_numpy(), kind="stable"))
        self.ids, self.texts = rows.column("doc_id").to_numpy(), rows.column("text")
        self.words, self.counts = hashed_words(self.texts)
        self.doc, self.at = positions(self.counts)

    def _whole(self, size: int) -> np.ndarray:
        """Of each position, whether ``size`` words of its document start there."""
        n = max(0, len(self.words) - size + 1)
        return self.at[:n] + size <= self.counts[self.doc[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the anchors."""
        where = np.flatnonzero(self._whole(ANCHOR) & _IN_COVER[self.at[: max(0, len(self.words) - ANCHOR + 1)] % PERIOD])
        return where, window_hashes(self.words, ANCHOR)[where] >> np.uint64(16)

    def windows(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, two hashes) of the windows that hold a marked anchor; marked: positions of anchors."""
        flags = np.zeros(len(self.words) + 1, np.int32)
        flags[marked] = 1
        before = np.concatenate([[0], np.cumsum(flags)])
        n = max(0, len(self.words) - WINDOW + 1)
        start = np.flatnonzero(self._whole(WINDOW) & (before[PERIOD : n + PERIOD] > before[:n]))
        return start, window_hashes(self.words, WINDOW, 1)[start], window_hashes(self.words, WINDOW, 2)[start] >> np.uint64(48)


def _groups(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each ordered row, least id of each group); rows come in order of their ids."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, ids[order][first] if len(order) else ids[:0]


def _shared_inside(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each row, whether its hash occurs in another document of the chunk."""
    order, group, least = _groups(ids, hashes)
    differs = np.zeros(len(least), bool)
    np.logical_or.at(differs, group, ids[order] != least[group])
    out = np.zeros(len(ids), bool)
    out[order] = differs[group]
    return out


def _send_anchors(rows: pa.Table) -> pa.Table:
    _, hashes = Chunk(rows).anchors()
    found = np.unique(hashes)
    return pa.table({"chunk": pa.array(np.full(len(found), rows.column("chunk")[0].as_py() if rows.num_rows else 0, np.int32)), "h": pa.array(signed(found))})


def _known(reply: pa.Table, name: str) -> np.ndarray:
    return np.sort(reply.column(name).to_numpy().view(np.uint64))


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether values are among sorted ones."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    return among[np.minimum(at, len(among) - 1)] == x


def _send_windows(rows: pa.Table, reply: pa.Table) -> pa.Table:
    """Each distinct window around an anchor that other chunks have too, with the least id that has it here."""
    chunk = Chunk(rows)
    where, hashes = chunk.anchors()
    start, h, x = chunk.windows(where[_member(hashes, _known(reply, "h"))])
    ids = chunk.ids[chunk.doc[start]]
    order, group, least = _groups(ids, h, x)
    first = order[np.searchsorted(group, np.arange(len(least)))]
    return pa.table({"h": pa.array(signed(h[first])), "x": pa.array(x[first].astype(np.int32)), "least": pa.array(least.astype(np.int64))})


def _remove(rows: pa.Table, reply: pa.Table) -> pa.Table:
    """The documents without the words of windows that an earlier document has, here or by the reply."""
    chunk = Chunk(rows)
    where, hashes = chunk.anchors()
    anchor_ids = chunk.ids[chunk.doc[where]]
    rh, rx = reply.column("h").to_numpy().view(np.uint64), reply.column("x").to_numpy().astype(np.uint64)
    # Windows to judge: around anchors shared inside the chunk, and all that the reply may name.
    here, h1, x1 = chunk.windows(where[_shared_inside(anchor_ids, hashes)])
    order, group, least = _groups(chunk.ids[chunk.doc[here]], h1, x1)
    gone = [here[order][chunk.ids[chunk.doc[here[order]]] > least[group]]]
    if len(rh):
        every = np.flatnonzero(chunk._whole(WINDOW))
        h = window_hashes(chunk.words, WINDOW, 1)[every]
        maybe = _member(h, np.sort(rh))
        every, h = every[maybe], h[maybe]
        x = window_hashes(chunk.words, WINDOW, 2)[every] >> np.uint64(48)
        mixed = lambda a, b: a ^ (b * np.uint64(0x9E3779B97F4A7C15))
        gone.append(every[_member(mixed(h, x), np.sort(mixed(rh, rx)))])
    starts = np.concatenate(gone)
    edge = np.zeros(len(chunk.words) + WINDOW + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    kept = np.cumsum(edge)[: len(chunk.words)] == 0
    removed = np.bincount(chunk.doc[~kept], minlength=len(chunk.ids))
    texts, at = [], 0
    for text, n, k in zip(chunk.texts, chunk.counts, removed, strict=True):
        words = (text.as_py() or "").encode("utf-8", "replace").split()
        texts.append(b" ".join(compress(words, kept[at : at + n].tolist()) if k else words).decode("utf-8", "replace"))
        at += n
    return pa.table({"doc_id": pa.array(chunk.ids.astype(np.int64)), "n_words": pa.array(chunk.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(texts, pa.large_string()).cast(pa.string())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: id, number of words, number removed, and the kept words joined by one space
    (``kept``, or with ``digest`` its SHA-256 ``kept_sha256``, made where the words are)."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column")
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = chunk_count(columns)
    placed = with_chunk(columns.filter("doc_id IS NOT NULL"), chunks)
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string")
    finish = _digested(_remove) if digest else _remove

    anchors = placed.groupBy("chunk").applyInArrow(_send_anchors, "chunk int, h long")
    shared = anchors.withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1").select("chunk", "h")
    windows = placed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_send_windows, "h long, x int, least long")
    earlier = windows.withColumn("first", F.min("least").over(Window.partitionBy("h", "x"))).filter("first < least")
    earlier = with_chunk(earlier, chunks, "least").select("chunk", "h", "x")  # the sender's: it holds that id
    out = placed.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(finish, schema)

    alone = columns.filter("doc_id IS NULL").withColumn("w", F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    kept = F.array_join("w", " ")
    alone = alone.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256") if digest else kept.alias("kept"))
    return out.union(alone).withColumnRenamed("doc_id", id_col)


def _digested(finish):
    def run(rows: pa.Table, reply: pa.Table) -> pa.Table:
        out = finish(rows, reply)
        hashes = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in out.column("kept")]
        return out.drop_columns(["kept"]).append_column("kept_sha256", pa.array(hashes, pa.string()))

    return run


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the passages that an earlier one has."""
    return remove_repeats(documents(spark, sf_dir), digest=True)


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS k FROM m WHERE first < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM w),
r AS (SELECT t.doc_id, coalesce(string_agg(x, ' ' ORDER BY t.k) FILTER (WHERE c.k IS NULL), '') AS kept, count(c.k) AS gone
      FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.k = c.k GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
