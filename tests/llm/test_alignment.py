"""Alignment against a plain version made with the tokenizers' own libraries, byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from millrace.llm import alignment as al

from .edge import SF, edge_docs, empty_docs

A, B = f"{al.FOLDER}/byte_bpe_50k.json", f"{al.FOLDER}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letter(c):
    """The byte of a byte-level letter, by the published rule."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return ord(c) if ord(c) in own else [x for x in range(256) if x not in own][ord(c) - 256]


def plain_tokens(libraries, text):
    """[(ids, bytes)] of both, or None."""
    if not text:
        return None
    a, b = libraries
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letter(c) for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    whole = b" " + text.encode()
    return ((ids_a, bytes_a), (ids_b, bytes_b)) if b"".join(bytes_a) == whole == b"".join(bytes_b) else None


def owners(parts):
    return [k for k, x in enumerate(parts) for _ in x]


def brute(libraries, rows):
    found, total = [], Counter()
    for key, text in rows:
        both = plain_tokens(libraries, text)
        if both is None:
            found.append((key, None))
            continue
        (ids_a, bytes_a), (ids_b, bytes_b) = both
        pairs = sorted(set(zip(owners(bytes_a), owners(bytes_b), strict=True)))
        total.update((ids_a[x], ids_b[y]) for x, y in pairs)
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = [], []
            while i < len(ends_a) and ends_a[i] <= end:
                x.append(str(ids_a[i]))
                i += 1
            while j < len(ends_b) and ends_b[j] <= end:
                y.append(str(ids_b[j]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        found.append((key, (ids_a, ids_b, groups, pairs)))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for key, x in found:
        if x is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, ids_b, groups, pairs = x
        counts = [(total[ids_a[p], ids_b[q]], best[ids_b[q]]) for p, q in pairs]
        out.append((key, len(ids_a), len(ids_b), len(groups), len(pairs), sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()], key=str)


HARD = [" ", "  a", "a  b", "a \n b", "\n\n  x", "<|endoftext|> x", "<s></s> <0x41>", "日本語 ça vaß▁ x", "\x00\x01", "👩‍👩‍👧 ok", "tab\t\tx ", "don't I'LL we'Re 'S", "ﬁ ½ ①", "á ́x", " x　y", "x\r\ny\x1cz \x85 w", "٣٤ ४५ 12", "z" * 3000, " " * 6000 + "end", "ab " * 2000]


def test_edges(spark, libraries):
    rnd = random.Random(7)
    wild = ["".join(chr(rnd.choice([rnd.randrange(1, 0x3000), 32, rnd.randrange(97, 123)])) for _ in range(400)) for _ in range(5)]
    docs = edge_docs(spark).select("doc_id", "text", "id", "key").union(spark.createDataFrame([(100 + k, t, "c", "c") for k, t in enumerate(HARD + wild)], "doc_id long, text string, id string, key string"))
    assert got(al.align(docs)) == brute(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert al.align(empty_docs(spark)).count() == 0


def test_chunks_do_not_matter(spark, libraries, monkeypatch):
    monkeypatch.setattr(al, "CHUNK_BYTES", 3000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).repartition(3)
    assert got(al.align(docs)) == brute(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_diagonal_runs_against_common_ends():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        n = int(rnd.integers(1, 200))
        share = rnd.uniform(0, 1)
        a = np.flatnonzero(np.append(rnd.random(n) < share, True)) + 1
        b = np.where(rnd.random() < 0.3, True, rnd.random(n + 1) < rnd.uniform(0, 1))
        b = a if rnd.random() < 0.2 else np.flatnonzero(np.append(np.atleast_1d(b)[:n] if np.ndim(b) else np.ones(n, bool), True)) + 1
        b = b[b <= a[-1]]
        b = np.unique(np.append(b, a[-1]))
        group_a, group_b = al.groups(a, b)
        common = np.intersect1d(a, b)
        assert np.array_equal(group_a, np.searchsorted(common, a)) and np.array_equal(group_b, np.searchsorted(common, b))
        x, y = al.links(a, b)
        ends = np.union1d(a, b)
        assert np.array_equal(x, np.searchsorted(a, ends)) and np.array_equal(y, np.searchsorted(b, ends))


def test_one_run_is_jumped():
    ends = list(range(1, 5001))
    assert al.irregular(ends, ends) == []
    assert al.irregular([1, 2, 4, 5], [1, 3, 4, 5]) == [(1, 3, 1, 3)]


def test_whole_query(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(al.op13_alignment(spark, SF)) == brute(libraries, rows)
