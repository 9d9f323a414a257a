"""Near duplicates: fingerprints and components against plain versions, the code's keys, block-wise comparison, edges."""

import random
from collections import Counter

import numpy as np
import xxhash

from millrace.llm import simhash
from millrace.llm.common import documents

from .edge import SF, edge_docs, empty_docs


def plain_print(text, size=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints, ids, bits=4):
    f, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits) + i + 1:
            parent[find(j)] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(f))]


def plain_shingles(text):
    """Five-word shingles and how often each occurs; fewer words are one shingle."""
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def plain_similarity(x, y):
    return (x & y).total() / (x | y).total() if x or y else 1.0


def plain_groups(texts):
    """Label of each text: the least place of the component of pairs with a similarity of 0.8 or more."""
    sets, label = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sizes = [s.total() for s in sets]
    for i, x in enumerate(sets):
        for j in range(i):
            if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and find(i) != find(j) and plain_similarity(x, sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(k) for k in range(len(texts))]


def plain_dedup(ids, texts):
    """Ids that stay: the least of each group."""
    return [d for k, (d, g) in enumerate(zip(ids, plain_groups([texts[i] for i in ids]), strict=True)) if g == k]


def check(docs):
    rows = docs.collect()
    prints = [plain_print(r["text"]) for r in rows]
    want = sorted(((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components(prints, [r["doc_id"] for r in rows]), strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_groups(docs).collect()), key=str) == want


def test_components(spark):
    check(documents(spark, SF))
    check(edge_docs(spark))
    assert simhash.near_groups(empty_docs(spark)).count() == 0


def test_keys_meet_whenever_four_bits_differ():
    rnd = random.Random(7)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for k in rnd.sample(range(64), rnd.randrange(0, 5)):
            b ^= 1 << k
        keys, owner = simhash.pair_keys(np.array([a, b], np.uint64))
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_code_is_perfect():
    code = simhash.golay()
    assert sorted(set(code.count.tolist())) == [1, 6]


def family(n):
    """Fingerprints along a path and around a centre, each few bits from some other."""
    rnd = random.Random(11)
    out = [rnd.getrandbits(64)]
    while len(out) < n:
        x = out[-1] if len(out) % 3 else out[0]
        for k in rnd.sample(range(64), 3):
            x ^= 1 << k
        out.append(x)
    return out + [rnd.getrandbits(64) for _ in range(50)]


def test_large_keys_go_block_by_block(spark, monkeypatch):
    prints = sorted(set(family(120)))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(s, 0, s, 0) for s in signed], "print long, more int, node long, salt int")
    want = plain_components(prints, list(range(len(prints))))
    found = simhash._links
    for most in (2048, 4):
        monkeypatch.setattr(simhash, "MOST", most)

        def run(batches, most=most):
            simhash.MOST = most
            yield from found(4)(batches)

        monkeypatch.setattr(simhash, "_links", lambda bits, run=run: run)
        labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, 4)).collect()}
        by = {}
        for s, c in zip(signed, want, strict=True):
            by.setdefault(c, set()).add(labels.get(s, s))
        assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
        monkeypatch.setattr(simhash, "_links", found)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_copies_go_and_others_stay(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == plain_dedup(sorted(rows), rows)
    rnd = random.Random(2)
    made = []
    for k in range(30):
        words = [f"t{rnd.randrange(5000)}" for _ in range(300)]
        made.append((3 * k, " ".join(words)))
        near = list(words)
        for at in rnd.sample(range(300), 5):
            near[at] = "edit" + near[at]
        made += [(3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(f"t{rnd.randrange(5000)}" for _ in range(300)))]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in made if d % 3 != 1}


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark)
    kept = sorted([r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()], key=str)
    assert kept.count(1) == 1 and 5 not in kept and 3 not in kept and kept.count(2) == 1


def edited(n=24):
    """(kind, text): each text, then copies with words added, cut, replaced in a block, moved, or replaced all over."""
    rnd, out = random.Random(8), []

    def words(k):
        return [f"t{rnd.randrange(20000)}" for _ in range(k)]

    for k in range(n):
        size = (300, 1000)[k % 2]
        base, part, at = words(size), size * 9 // 100, rnd.randrange(size // 2)
        out += [("base", base), ("added", base + words(2 * part)), ("cut", base[2 * part :]), ("block", base[:at] + words(part) + base[at + part :])]
        base = words(size)
        parts = [base[i : i + 10] for i in range(0, size, 10)]
        out += [("base", base), ("moved", sum(rnd.sample(parts, len(parts)), []))]
        base = words(size)
        out += [("base", base), ("far", base + words(size))]
    return [(kind, " ".join(w)) for kind, w in out]


def test_added_cut_and_replaced_passages_go(spark):
    made = edited()
    near = {k for k, (kind, _) in enumerate(made) if kind in ("added", "cut", "block")}
    last = 0
    for k, (kind, text) in enumerate(made):
        last = k if kind == "base" else last
        if k in near:
            assert plain_similarity(plain_shingles(text), plain_shingles(made[last][1])) >= 0.8
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(made)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert not kept & near
    assert {k for k, (kind, _) in enumerate(made) if kind in ("base", "far")} <= kept


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["doc_id"] for r in simhash.drop_near_duplicates(docs).orderBy("doc_id").collect()]


def test_shuffled_and_repeated_words_stay(spark):
    words = [f"w{k}" for k in range(200)]
    shuffled = random.Random(1).sample(words, 200)
    assert kept_of(spark, [" ".join(w) for w in (words, shuffled, words * 3)]) == [0, 1, 2]


def drifting():
    """Texts along a chain, and copies of one text with ever more edits: some near each other, some near the first only."""
    rnd, texts = random.Random(4), [t for _, t in edited(6)]
    chain = [f"c{k}" for k in range(400)]
    for _ in range(12):
        chain = chain[18:] + [f"c{rnd.randrange(10**6)}" for _ in range(18)]
        texts.append(" ".join(chain))
    base = [f"b{k}" for k in range(200)]
    for _ in range(120):
        words = list(base)
        for at in rnd.sample(range(200), rnd.randrange(1, 12)):
            words[at] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_groups_follow_every_pair(spark, monkeypatch):
    texts = drifting()
    label = plain_groups(texts)
    assert len(set(label[-120:])) > 3
    want = [k for k, g in enumerate(label) if g == k]
    assert kept_of(spark, texts) == want
    monkeypatch.setattr(simhash, "NEAR_BYTES", 20_000)  # candidates of several blocks, held against a hub first
    assert kept_of(spark, texts) == want


def test_similarity_is_exact():
    texts = [*drifting()[-10:], "a b c", "a b c d e", "a b c d e a b c d e", "a b c d e " * 9, "", "x"]
    for x in texts:
        for y in texts:
            assert abs(simhash.similarity(simhash.shingles(x), simhash.shingles(y)) - plain_similarity(plain_shingles(x), plain_shingles(y))) < 1e-12


def test_candidates_meet_at_the_threshold():
    """Of random pairs that differ in one bit of ten, as at a similarity of 0.8, nearly all meet under some fingerprint."""
    rng, n = np.random.default_rng(3), 600
    flips = np.packbits(rng.random((n, simhash.PRINTS, 64)) < (1 - simhash.NEAR) / 2, axis=2, bitorder="little").view("<u8")[:, :, 0]
    prints = rng.integers(0, 2**64, (n, simhash.PRINTS), dtype=np.uint64)
    met = np.zeros(n, bool)
    for k in range(simhash.PRINTS):
        tagged = [np.unique(owner.astype(np.int64) << 27 | keys) for keys, owner in map(simhash.pair_keys, (prints[:, k], prints[:, k] ^ flips[:, k]))]
        bits = np.bitwise_count(flips[:, k]) + np.bitwise_count(flips[:, (k + 1) % simhash.PRINTS] >> np.uint64(32))
        met |= np.isin(np.arange(n), np.intersect1d(*tagged) >> 27) & (bits <= simhash.CANDIDATE_BITS)
    assert met.mean() > 0.99


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "a b c", "x", "y"), (None, "a b c", "x", "y")], "doc_id long, text string, key__ string, id__ string")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.filter("doc_id = 1 OR doc_id IS NULL").collect()))
