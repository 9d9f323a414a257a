"""Operator 13: which tokens of two tokenizers cover the same bytes of a text.

Both encode a space and the text: A by byte-level BPE, B by a piece model that adds the space itself.  The ends of the
tokens' bytes are two growing arrays; where both have an end, a group of tokens closes.  Diagonal run skipping finds the
groups: at the current index shift between the arrays, stretches of ends are compared with doubling length, so that
one-to-one stretches are jumped; at a difference the probe is halved down to it, the irregular group there is resolved
by moving whichever side is behind, and the shift is that of the two places after it.

In a group every elementary range between neighbouring ends is one link, a pair of tokens that overlap.  Corpus-wide
counts of id pairs are made per chunk of documents first: a chunk is at most CHUNK_BYTES of text (or one text), sends
each distinct pair once, and gets its pairs' counts back beside its documents' links, which were written meanwhile.  So
nothing is encoded twice, and a pair that all documents hold costs one row a chunk.

Null or empty texts, and texts whose tokens do not give back the bytes (the piece model maps or drops some characters), have
no tokens: zeros and an empty hash.  Special tokens' strings are plain text.  Texts may have any length.  Repeated rows
stay rows, and all of them count; null ids stay null.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
CHUNK_BYTES = 8 << 20
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE, _BLANKS = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s{5000}")
_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, file_a: str, file_b: str):
        with open(file_a, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        special = {x["content"] for x in told.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in t): k for t, k in told["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.bytes_a[k] = t
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(k) else t.replace("▁", " ").encode() for k, t in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # how each token is written in a group: followed by its side's comma, or by what closes its side
        n = len(self.bytes_a), len(self.bytes_b)
        self.written = [f"{k}{end}" for count, ends in zip(n, (",|", ",;"), strict=True) for end in ends for k in range(count)]
        self.base = np.cumsum([0, n[0], n[0], n[1]])
        self.file_a = file_a
        crossing = any(re.search("[^▁]▁", t) for t in self.b.id_to_piece(list(range(self.b.get_piece_size()))))
        self.split = (lambda text: [text]) if crossing else _SPACE.split

    def parts(self, texts: list[str]) -> tuple[list[list[int] | None], Ragged, Ragged]:
        """Each text as places of its parts, and the ids of both for every part that gives back its bytes.

        A single space between other characters starts a token of both, so that the parts between are encoded once each.
        A text without a part, or with one that does not give back its bytes, has no places.
        """
        places: dict[str, int] = {}
        told: list[list[int] | None] = [[places.setdefault(w, len(places)) for w in (self.split(t) if t else ())] or None for t in texts]
        words = list(places)
        ids_a = [self.letters(w) for w in words]
        ids_b = self.b.encode(words, num_threads=1) if words else []
        of_a, of_b = Ragged.of(ids_a), Ragged.of(ids_b)
        same = self.given_back(words, ids_a, ids_b, of_a, of_b)
        if not same.all():
            bad, good = set(np.flatnonzero(~same).tolist()), np.flatnonzero(same).tolist()
            moved = (np.cumsum(same) - 1).tolist()
            told = [None if at is None or not bad.isdisjoint(at) else [moved[k] for k in at] for at in told]
            of_a, of_b = Ragged.of([ids_a[k] for k in good]), Ragged.of([ids_b[k] for k in good])
        return told, of_a, of_b

    def given_back(self, words: list[str], ids_a, ids_b, of_a: Ragged, of_b: Ragged) -> np.ndarray:
        """Of each part, whether both sides' bytes are a space and the part."""
        wholes = [b" " + w.encode() for w in words]
        sizes = np.array([len(w) for w in wholes], np.int64)
        all_a, all_b = b"".join(map(self.bytes_a.__getitem__, of_a.flat.tolist())), b"".join(map(self.bytes_b.__getitem__, of_b.flat.tolist()))
        if all_a == all_b == b"".join(wholes) and np.array_equal(of_a.sums(self.size_a), sizes) and np.array_equal(of_b.sums(self.size_b), sizes):
            return np.ones(len(words), bool)
        joined = lambda table, x: b"".join(map(table.__getitem__, x))
        return np.array([joined(self.bytes_a, x) == w == joined(self.bytes_b, y) for w, x, y in zip(wholes, ids_a, ids_b, strict=True)], bool)

    def letters(self, part: str) -> list[int]:
        """Ids of A for a space and the part; the fast library's pattern overflows its stack on very long blank runs."""
        if _BLANKS.search(part):
            return self.slow.encode(" " + part, add_special_tokens=False).ids
        return self.a.encode_ordinary(" " + part)

    @functools.cached_property
    def slow(self) -> tokenizers.Tokenizer:
        made = tokenizers.Tokenizer.from_file(self.file_a)
        made.encode_special_tokens = True
        return made


class Ragged:
    """Lists of ids as one array."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat, self.starts = sizes, flat, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ragged:
        return cls(np.array([len(x) for x in lists], np.int64), np.array(list(itertools.chain.from_iterable(lists)), np.int64))

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """The lists at the given places, joined."""
        n = self.sizes[at]
        return self.flat[np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)]

    def sums(self, of: np.ndarray) -> np.ndarray:
        """Of each list, the sum of its ids' values."""
        run = np.concatenate([[0], np.cumsum(of[self.flat])])
        return run[self.starts + self.sizes] - run[self.starts]


@functools.lru_cache(4)
def pair(file_a: str, file_b: str) -> Pair:
    return Pair(file_a, file_b)


def irregular(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups that are not one to one, as (first, end) in a and in b; both lists of ends close with the same one."""
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        if a[i] == b[j]:
            k = 1  # probe on the current diagonal, twice as far each time
            while i < n and a[i : i + k] == b[j : j + k]:
                i, j, k = i + k, j + k, 2 * k
            while k > 1:  # the difference lies within the last probe
                k >>= 1
                if i < n and a[i : i + k] == b[j : j + k]:
                    i, j = i + k, j + k
            if i >= n:
                break
        i0, j0, x, y = i, j, a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        out.append((i0, i, j0, j))
    return out


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each token of a and of b."""
    odd = np.array(irregular(ends_a.tolist(), ends_b.tolist()), np.int64).reshape(-1, 4)
    inner_a, inner_b = np.zeros(len(ends_a), np.int64), np.zeros(len(ends_b), np.int64)
    for inner, first, end in ((inner_a, odd[:, 0], odd[:, 1]), (inner_b, odd[:, 2], odd[:, 3])):
        inner[:] = 1  # a token opens a group unless it follows another one of an irregular group
        size = end - first - 1
        inner[np.repeat(first + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = 0
    return np.cumsum(inner_a) - 1, np.cumsum(inner_b) - 1


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in a, place in b) of all overlapping tokens: in a group of p and q tokens these are p + q - 1."""
    ends = np.concatenate([ends_a, ends_b])
    side = np.concatenate([np.zeros(len(ends_a), np.int64), np.ones(len(ends_b), np.int64)])
    order = np.argsort(ends, kind="stable")  # two sorted runs: a merge
    side, ends = side[order], ends[order]
    keep = np.append(ends[1:] != ends[:-1], True)
    at_a, at_b = np.cumsum(side == 0), np.cumsum(side)
    # up to an end, a token counts as done if it ends there; the last of equal ends closes both
    closes = np.append(False, ends[1:] == ends[:-1])
    x = np.where(closes | (side == 0), at_a - 1, at_a)
    y = np.where(closes | (side == 1), at_b - 1, at_b)
    return x[keep], y[keep]


def written(p: Pair, a: Ragged, b: Ragged, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` for each part: the ids of its groups in order."""
    last = lambda g: np.append(g[1:] != g[:-1], True).astype(np.int64) if len(g) else g
    codes = np.concatenate([a.flat + p.base[last(group_a)], b.flat + p.base[2 + last(group_b)]])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    tokens = list(map(p.written.__getitem__, codes[order].tolist()))
    ends = np.cumsum(a.sizes + b.sizes).tolist()
    return ["".join(tokens[s:e]) for s, e in zip([0, *ends], ends, strict=False)]


def aligned(p: Pair, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray]]:
    """Of each text: tokens of a and of b, groups, links, the hash of its groups, and the links as pairs of ids.

    The different parts of all texts are aligned as one pair of arrays, whose ends meet at every part's end; a text's
    groups are those of its parts in order.
    """
    told, a, b = p.parts(texts)
    ends_a, ends_b = np.cumsum(p.size_a[a.flat]), np.cumsum(p.size_b[b.flat])
    group_a, group_b = groups(ends_a, ends_b)
    x, y = links(ends_a, ends_b)
    part = np.repeat(np.arange(len(a.sizes)), a.sizes)
    of_links = Ragged(np.bincount(part[x], minlength=len(a.sizes)), a.flat[x] << 32 | b.flat[y])
    n_groups = np.diff(group_a[np.cumsum(a.sizes) - 1], prepend=-1)
    strings = written(p, a, b, group_a, group_b)
    out = []
    for places in told:
        if places is None:
            out.append((0, 0, 0, 0, "", of_links.flat[:0]))
            continue
        at = np.array(places, np.int64)
        digest = hashlib.sha256("".join(map(strings.__getitem__, places)).encode()[:-1]).hexdigest()
        out.append((int(a.sizes[at].sum()), int(b.sizes[at].sum()), int(n_groups[at].sum()), int(of_links.sizes[at].sum()), digest, of_links(at)))
    return out


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes and their counts, as compressed differences."""
    both = np.concatenate([np.diff(codes, prepend=0), counts]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


_ROW = "chunk string, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


def _aligned(file_a: str, file_b: str):
    """For each document a row with its figures and its links as places among the chunk's pairs; for each pair of a chunk a row."""

    def emit(chunk: str, ids: list, found: list[tuple]):
        flat = [x[5] for x in found]
        pairs, place = np.unique(np.concatenate(flat), return_inverse=True)
        owner, base = np.repeat(np.arange(len(flat)), [len(x) for x in flat]), max(1, len(pairs))
        own, times = np.unique(owner * base + place, return_counts=True)
        cuts = np.searchsorted(own, np.arange(len(flat) + 1) * base)
        blobs = [packed(own[s:e] % base, times[s:e]) if e > s else None for s, e in zip(cuts, cuts[1:], strict=False)]
        text, number = (lambda x: pa.array(x, pa.string())), (lambda x: pa.array(x, pa.int64()))
        n, m, none = len(ids), len(pairs), pa.nulls
        columns = list(zip(*(x[:5] for x in found), strict=True))
        yield pa.record_batch([text([chunk] * n), number(ids), *map(number, columns[:4]), text(columns[4]), pa.array(blobs, pa.binary()), none(n, pa.int64()), none(n, pa.int64())], _ROW_NAMES)
        yield pa.record_batch([text([chunk] * m), *(none(m, pa.int64()) for _ in range(5)), none(m, pa.string()), none(m, pa.binary()), number(pairs), number(np.bincount(place, minlength=m).astype(np.int64))], _ROW_NAMES)

    def chunks(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield ids, texts
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts

    def run(batches):
        p, part = pair(file_a, file_b), TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(chunks(batches)):
            yield from emit(f"{part}-{number}", ids, aligned(p, texts))

    return run


_ROW_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Best links and sums of counts of a chunk's documents."""
    order = np.argsort(pairs.column("pair").to_numpy(), kind="stable")
    count, best = pairs.column("count").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, total = [], []
    for blob in docs.column("links"):
        if blob.is_valid:
            place, times = unpacked(blob.as_py())
            n_best.append(int(times[best[place]].sum()))
            total.append(int((times * count[place]).sum()))
        else:
            n_best.append(0)
            total.append(0)
    return docs.select(["id", *_SUMS]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, folder: str = FOLDER, file_a: str = "byte_bpe_50k.json", file_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its tokens, groups, links and how its links' pairs count in the whole corpus."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = cut(rows.mapInArrow(_aligned(f"{folder}/{file_a}", f"{folder}/{file_b}"), _ROW))
    pairs = found.filter("pair IS NOT NULL").select("chunk", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    # ids of b are fewer than 2^32 and stand in a pair's lower half
    token = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(token.alias("b")).agg(F.max("count").alias("most"))
    judged = counts.withColumn("b", token).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    told = pairs.select("chunk", "pair").join(judged, "pair").select("chunk", "pair", "count", "best")
    texts = found.filter("pair IS NULL").select(F.col("chunk").alias("dealt"), "id", *_SUMS, "groups_sha256", "links")
    done = texts.groupBy("dealt").cogroup(told.groupBy("chunk"))
    schema = "id long, " + ", ".join(f"{x} long" for x in (*_SUMS, "n_best", "count_sum")) + ", groups_sha256 string"
    return done.applyInArrow(_scored, schema).withColumnRenamed("id", id_col)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers over every text of ``documents``."""
    return align(documents(spark, sf_dir))
