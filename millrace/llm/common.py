"""Helpers shared by the corpus operators: table access, lineage cuts, chunk keys and word arrays."""

from __future__ import annotations

import math
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk of documents should hold.
CHUNK_BYTES = 8 << 20
#: Bytes of text that a vectorised pass handles at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that the cluster names and read it from there.

    A folder of our own is set only on one machine; on a cluster that names none this is an error, as executors could not
    read it.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return df.checkpoint()


def chunk_count(docs: DataFrame, text: str = "text") -> int:
    """Number of chunks so that each holds about CHUNK_BYTES of text, and as many as shuffle partitions at least."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / CHUNK_BYTES))


def with_chunk(docs: DataFrame, chunks: int, *keys: str) -> DataFrame:
    """Add ``chunk``: documents are dealt by the hash of their keys, so copies and hot sources spread evenly."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64(*(keys or ("doc_id",))), F.lit(chunks)).cast("int"))


# --- words as arrays -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_RNG.integers(1, 2**62)) * 8 + 5) % 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_COEF = _RNG.integers(1, 2**63, (4, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of documents that hold about ``most`` bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, first byte and end byte of each word of a block; offsets start at 0."""
    ink = ~_SPACE[values]
    if not len(ink):
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty_like(ink), np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    after[-1], after[:-1] = False, ink[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def word_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: a polynomial from prefix sums, then mixed with the length."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE[values] * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def hashed_words(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each document)."""
    values, offsets = text_buffer(column)
    hashes, counts = [], []
    for i, j in blocks(offsets):
        lo, hi = offsets[i], offsets[j]
        doc, start, end = word_spans(values[lo:hi], offsets[i : j + 1] - lo)
        hashes.append(word_hashes(values[lo:hi], start, end))
        counts.append(np.bincount(doc, minlength=j - i))
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each position on; windows that cross a document's end are the caller's to drop."""
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words[k : k + n] * _COEF[seed, k]
    return mix(h)


def positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its document's index, its position in it."""
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return doc, np.arange(len(doc)) - first[doc]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
