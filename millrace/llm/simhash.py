"""Operator 10: near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits: segments of 23, 23 and 18 bits.  A segment's keys are the nearest codeword of the perfect
(23,12) Golay code and, if that is 3 bits away, the five codewords at 4 bits as well.  Two segments that differ in
2 bits or fewer always share a key: if one has a single key c (within 2 bits), the other is within 4 bits of c; if
both are 3 bits off, a codeword that corrects one of the differing bits is within 4 bits of both.  With 4 errors over
three segments, two segments have 2 errors or fewer each, so fingerprints that link always share a key of some pair of
segments.  Fingerprints meet under these pair keys and every meeting is verified by counting bits.

Equal fingerprints are one row before keys are made, so groups of copies cost one row each.  A key whose fingerprints
outgrow MOST is compared block by block in a second pass; nothing is dropped.  Of the verified links a task keeps a
spanning forest; connected components then follow from alternating star contractions, without a driver loop over rows.

To drop near duplicates, the same keys only find candidates, and texts decide (see near_duplicates).  One fingerprint of
sign sums within 4 bits holds copies that are nearly exact: at a similarity of 0.8 such bits differ in 15 of 100.  The
candidates' fingerprints are one bit of a least shingle hash each, which differ in 10 of 100 wherever the edits are, and
there are PRINTS of them.

Null or empty text: fingerprint zero, which links like any other.  A null id takes part, but names no component while
the component has another id.  Repeated rows link to each other and keep their rows.  Texts are
read whole, whatever their length; an empty table gives no rows; of other columns only drop_near_duplicates takes notice,
which hands them on, whatever their names.  As all texts without a word are equal, it keeps one of them.
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType

from .common import cut, documents, hashed_words, mix, window_hashes

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Words of a shingle, and the share of common shingles (repeats counted) from which two texts are near duplicates.
NEAR_SHINGLE, NEAR = 5, 0.8
#: Fingerprints of a text for candidates.  At NEAR two of them are within 4 bits with probability
#: 0.7; as keys often meet beyond that, all of some 1,400 simulated pairs at NEAR or above were candidates.
PRINTS = 3
#: Of the 96 bits that a key's rows carry, most that candidates differ in: 2.2 deviations above the mean at NEAR.
CANDIDATE_BITS = 16
#: Of the bytes of least hashes that are compared before shingles are, fewest equal ones: 3 deviations below the mean at NEAR.
SKETCH = 64 * PRINTS
SKETCH_EQUAL = int(SKETCH * NEAR - 3 * (SKETCH * NEAR * (1 - NEAR)) ** 0.5)
#: Parts that the rows of a large component are dealt to where they are joined by their label.
SALT = 64
#: Bytes of text that one side of a verifying task holds.
NEAR_BYTES = 4 << 20
#: Nodes that are broadcast to pick the texts that are candidates; more are joined by a shuffle.
MAX_BROADCAST = 200_000
_RNG = np.random.Generator(np.random.PCG64(0xBA4D))
_FLIP = _RNG.integers(0, 2**64, SKETCH, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fingerprints under one key that one task compares at once; more go block by block.
MOST = 2048
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; fewer words than a shingle has are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, SEED)
    hashes = np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, starts[size:], strict=False)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(size: int = SHINGLE):
    @arrow_udf(LongType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), size) for t in text], np.uint64).view(np.int64))

    return run


class Golay:
    """Keys of 23-bit words: by syndrome, the error patterns that lead to the codewords close by."""

    GENERATOR = 0xAE3

    def __init__(self) -> None:
        def remainder(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= self.GENERATOR << (k - 11)
            return x

        one = [remainder(1 << k) for k in range(23)]
        self.low, self.high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
        for table, at, bits in ((self.low, 0, 12), (self.high, 12, 11)):
            for k in range(bits):
                table[1 << k : 2 << k] = table[: 1 << k] ^ one[at + k]
        near: list[list[int]] = [[] for _ in range(2048)]
        for errors in self._patterns(3):
            near[self._of(errors)].append(errors)
        far = [s for s in range(2048) if near[s][0].bit_count() == 3]
        wanted = set(far)
        for errors in self._patterns(4, 4):
            if (s := self._of(errors)) in wanted:
                near[s].append(errors)
        self.count = np.array([len(x) for x in near], np.int64)
        self.errors = np.zeros((2048, 6), np.int32)
        for s, x in enumerate(near):
            self.errors[s, : len(x)] = x

    def _of(self, word: int) -> int:
        return int(self.low[word & 4095] ^ self.high[word >> 12])

    @staticmethod
    def _patterns(most: int, least: int = 0):
        from itertools import combinations

        for n in range(least, most + 1):
            for bits in combinations(range(23), n):
                yield sum(1 << b for b in bits)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(six codeword indices of each word, how many of them count)."""
        words = words.astype(np.int32)
        s = self.low[words & 4095] ^ self.high[words >> 12]
        return (words[:, None] ^ self.errors[s]) >> 11, self.count[s]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def pair_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the fingerprint) for every pair of segments and every pair of their keys."""
    code, n = golay(), len(prints)
    parts = [code.keys((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)) for at, bits in SEGMENTS]
    keys, owner = [], []
    for p, (a, b) in enumerate(PAIRS):
        both = (np.int32(p) << 24) | (parts[a][0][:, :, None] << 12) | parts[b][0][:, None, :]
        six = np.arange(6)
        real = (six[None, :, None] < parts[a][1][:, None, None]) & (six[None, None, :] < parts[b][1][:, None, None])
        keys.append(both[real])
        owner.append(np.repeat(np.arange(n), real.reshape(n, -1).sum(1)))
    return np.concatenate(keys), np.concatenate(owner)


def _keyed(batches):
    """Under every key of a fingerprint a row (key, print, more, node); more: further bits to compare, node: what links name.

    Input: (print, more, node, salt), the salt telling kinds of fingerprints apart.
    """
    for batch in batches:
        prints, more, node, salt = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for at in range(0, len(prints), 2000):
            part = slice(at, at + 2000)
            keys, owner = pair_keys(prints[part].view(np.uint64))
            keys = keys | (salt[part][owner].astype(np.int32) << 26)
            yield pa.record_batch({"key": pa.array(keys), "print": pa.array(prints[part][owner]), "more": pa.array(more[part][owner]), "node": pa.array(node[part][owner])})


class Keyed:
    """Rows under keys: fingerprints, further bits and nodes."""

    def __init__(self, prints: np.ndarray, more: np.ndarray, nodes: np.ndarray):
        self.prints, self.more, self.nodes = prints, more, nodes

    def __getitem__(self, where) -> Keyed:
        return Keyed(self.prints[where], self.more[where], self.nodes[where])

    def __len__(self) -> int:
        return len(self.prints)

    def __add__(self, other: Keyed) -> Keyed:
        return Keyed(*(np.concatenate(x) for x in ((self.prints, other.prints), (self.more, other.more), (self.nodes, other.nodes))))

    def near(self, i: np.ndarray, d: int, max_bits: int) -> np.ndarray:
        """Of places, whether the row ``d`` further on differs in max_bits or fewer."""
        bits = np.bitwise_count(self.prints[i] ^ self.prints[i + d]) + np.bitwise_count(self.more[i] ^ self.more[i + d])
        return bits <= max_bits

    @classmethod
    def of(cls, table) -> Keyed:
        column = lambda name: table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name).to_numpy(zero_copy_only=False)
        return cls(column("print").view(np.uint64), column("more").view(np.uint32), column("node"))


def forest(group: np.ndarray, rows: Keyed, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the pairs of equal group that differ in max_bits or fewer; rows sorted by group."""
    n, left, right = len(rows), [], []
    i, d = np.arange(n - 1 if n else 0), 1
    while True:
        i = i[i + d < n]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        near = i[rows.near(i, d, max_bits)]
        left.append(near)
        right.append(near + d)
        d += 1
    if not left:
        return rows.nodes[:0], rows.nodes[:0]
    label = joined(n, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(n))
    return rows.nodes[moved], rows.nodes[label[moved]]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component under links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


_LINKS = "kind int, a long, b long, print long, more int"


def _links(max_bits: int):
    """Links within each key of sorted rows; of a key with more than MOST rows, the rows themselves (kind 1)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, rows: Keyed | None = None) -> pa.RecordBatch:
        n = len(a)
        prints, more = (rows.prints.view(np.int64), rows.more.view(np.int32)) if rows else (np.zeros(n, np.int64), np.zeros(n, np.int32))
        return pa.record_batch({"kind": pa.array(np.full(n, kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "print": pa.array(prints), "more": pa.array(more)})

    def run(batches):
        keys, rows, over = np.zeros(0, np.int32), Keyed(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
            rows = rows + Keyed.of(batch)
            if not len(keys):
                continue
            cut_at = int(np.searchsorted(keys, keys[-1], "left"))
            if len(keys) - cut_at > MOST:
                over, cut_at = keys[-1], len(keys)
            yield from emit(keys[:cut_at], rows[:cut_at], over)
            keys, rows = keys[cut_at:], rows[cut_at:]
        yield from emit(keys, rows, over)

    def emit(keys: np.ndarray, rows: Keyed, over):
        if not len(keys):
            return
        values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        large = (counts > MOST) | (values == over if over is not None else False)
        later = large[inverse]
        if later.any():
            yield out(1, keys[later].astype(np.int64), rows.nodes[later], rows[later])
        a, b = forest(keys[~later], rows[~later], max_bits)
        if len(a):
            yield out(0, a, b)

    return run


def _block_links(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        a, b = forest(np.zeros(table.num_rows, np.int8), Keyed.of(table), max_bits)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between nodes that connect whatever fingerprints that share a key and differ in max_bits or fewer connect.

    rows: (print, more, node, salt); bits of ``print`` and ``more`` count, and only equal salts (0 to 31) meet.  With
    more = 0, fingerprints that differ in 4 bits or fewer always share a key.
    """
    keyed = rows.select("print", "more", "node", "salt").mapInArrow(_keyed, "key int, print long, more int, node long")
    found = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(max_bits), _LINKS))
    late = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "print", "more")
    sized = late.join(late.groupBy("key").agg(F.ceil(F.count("*") / (MOST // 2)).alias("n")), "key")
    own = F.pmod(F.xxhash64("node"), F.col("n"))
    pairs = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "print", "more", "node")
    slow = pairs.groupBy("key", "p", "q").applyInArrow(_block_links(max_bits), "a long, b long")
    # Under every key a node hangs on some root, and it has 108 keys at most.  Its roots hang on the least of them, which
    # the nodes of a large group share, so that group has about one link a node.
    roots = found.filter("kind = 0").select("a", "b").union(slow).groupBy("a").agg(F.collect_set("b").alias("roots")).withColumn("b", F.array_min("roots"))
    return roots.select("a", "b").union(roots.select(F.explode("roots").alias("a"), "b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the least node of each component; nodes without a link are not in it.

    Alternating star contractions over (a, b): every round joins each node to the least of its neighbours, and stops
    when all nodes hang on their label.  Each round is written, so lineage stays short.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: every node and its smaller neighbours hang on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: its id, its fingerprint (16 hex digits) and the least id of its component."""
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprints(size)(F.col(text_col)).alias("print")))
    first = rows.groupBy("print").agg(F.min("id").alias("first"))
    if not 0 <= max_bits <= 4:
        raise ValueError("the key scheme holds for 4 bits or fewer")
    nodes = first.select("print", F.lit(0).alias("more"), F.col("print").alias("node"), F.lit(0).alias("salt"))
    labels = components(links(nodes, max_bits))
    placed = first.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = cut(placed.join(least, "label").select("print", "component_id"))
    return rows.join(by_print, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by their texts -----------------------------------------------------------------------------


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's shingles, the n-th occurrence of one being an element of its own; a text with fewer words
    than a shingle has is one shingle."""
    words = hashed_words(pa.array([(text or "").lower()]))[0]
    found = np.sort(window_hashes(words, min(len(words), NEAR_SHINGLE)) if len(words) else words)
    first = np.searchsorted(found, found)
    nth = (np.arange(len(found)) - first).astype(np.uint64)
    return np.sort(np.where(nth > 0, mix(found + nth * np.uint64(0x9E3779B97F4A7C15)), found))


def sketch(elements: np.ndarray) -> np.ndarray:
    """A byte of the least hash of the elements under each of SKETCH hash functions."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 2048):
        np.minimum(least, ((elements[at : at + 2048, None] ^ _FLIP) * _ODD).min(0), out=least)
    return (mix(least) >> np.uint64(56)).astype(np.uint8)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Common elements of two texts' shingles as a share of all; two texts without a word are equal."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


@arrow_udf(ArrayType(LongType()))
def _signatures(text: pa.Array) -> pa.Array:
    """PRINTS fingerprints of 64 bits, then two sums that stand for the shingles."""
    out = np.zeros((len(text), PRINTS + 2), np.uint64)
    for row, t in enumerate(text):
        found = shingles(t.as_py())
        bits = (sketch(found) & 1).reshape(PRINTS, 64)
        out[row, :PRINTS] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        out[row, PRINTS:] = found.sum(dtype=np.uint64), mix(found ^ _FLIP[0]).sum(dtype=np.uint64)
    flat = pa.array(out.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, PRINTS + 2, dtype=np.int32)), flat)


def _verified(table: pa.Table) -> pa.Table:
    """Links of a spanning forest of the near duplicates between asking rows and all rows of a task."""
    sets = [shingles(t.as_py()) for t in table.column("text")]
    nodes, asks = table.column("node").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
    order = np.argsort(~asks, kind="stable")  # those that ask come first
    sets, nodes, n_ask = [sets[k] for k in order], nodes[order], int(asks.sum())
    linked = np.flatnonzero(table.column("linked").to_numpy(zero_copy_only=False)[order])
    sketches, sizes = np.array([sketch(x) for x in sets], np.uint8).reshape(-1, SKETCH), np.array([len(x) for x in sets])
    label, left, right = np.arange(len(sets)), [], []
    label[linked] = linked.min(initial=len(sets))  # all near the hub, so one component already
    for i in range(n_ask):
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        maybe = (label[i + 1 :] != label[i]) & (small >= NEAR * large)
        places = np.flatnonzero(maybe) + i + 1
        places = places[(sketches[places] == sketches[i]).sum(1) >= SKETCH_EQUAL]
        for j in places.tolist():
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= NEAR:
                left.append(nodes[i])
                right.append(nodes[j])
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


@arrow_udf(BooleanType())
def _near(a: pa.Array, b: pa.Array) -> pa.Array:
    memo: dict = {}
    out = []
    for x, y in zip(a, b, strict=True):
        y = y.as_py()
        if y not in memo:
            memo = {y: shingles(y)}
        out.append(similarity(shingles(x.as_py()), memo[y]) >= NEAR)
    return pa.array(out, pa.bool_())


def verified_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the near duplicates within each candidate component.

    texts: (node, label, text).  A component whose texts fill one task is compared there.  In a larger one all texts are
    first held against the text of its least node; those that are not near it are then compared with all, block by block.
    """
    sizes = texts.groupBy("label").agg(F.ceil(F.sum(F.octet_length("text") + 64) / NEAR_BYTES).cast("int").alias("blocks"), F.min("node").alias("hub"))
    # Large components are few (each has more than NEAR_BYTES); their rows are dealt to SALT parts at every join by label.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    sizes = cut(sizes.filter("blocks > 1"))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    of_large = sizes.select("label", "hub", "blocks", salts)
    small = salted.join(of_large.select("label", "salt"), ["label", "salt"], "left_anti")
    small = small.select("label", F.lit(0).alias("p"), F.lit(0).alias("q"), "node", "text", F.lit(True).alias("asks"), F.lit(False).alias("linked"))
    large = salted.join(of_large, ["label", "salt"])
    hubs = large.filter("node = hub").select("label", F.col("text").alias("hub_text"), salts)
    held = large.join(hubs, ["label", "salt"])
    held = cut(held.select("label", "node", "hub", "blocks", "text", ((F.col("node") == F.col("hub")) | _near("text", "hub_text")).alias("near")))
    near_hub = held.filter("near AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    asking = held.filter("NOT near").groupBy("label").agg(F.ceil(F.sum(F.octet_length("text") + 64) / NEAR_BYTES).cast("int").alias("askers"))
    spread = held.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(asking.select("label", "askers", salts), ["label", "salt"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = spread.filter("NOT near").select("label", own("askers").alias("p"), others("blocks").alias("q"), "node", "text", F.lit(True).alias("asks"), F.lit(False).alias("linked"))
    all_ = spread.select("label", others("askers").alias("p"), own("blocks").alias("q"), "node", "text", F.lit(False).alias("asks"), F.col("near").alias("linked"))
    return small.union(ask).union(all_).groupBy("label", "p", "q").applyInArrow(_verified, "a long, b long").union(near_hub)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key): of each group of near duplicates the row with the least id (then key).

    Texts are near duplicates if they share NEAR of their shingles of NEAR_SHINGLE words or more, repeats counted; groups
    are the components of such pairs.  Texts of equal shingles are one node.  Nodes whose fingerprints share a Golay key
    and differ little are candidates; within each component of candidates the texts themselves are compared.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = named.select(F.struct("id", "text_key").alias("at"), _signatures("text").alias("sig"))
    nodes = cut(signed.groupBy("sig").agg(F.min("at").alias("at")).select(F.xxhash64("sig").alias("node"), "at", "sig"))
    prints = nodes.select("node", F.posexplode(F.slice("sig", 1, PRINTS)).alias("salt", "print"), "sig")
    following = F.get("sig", (F.col("salt") + 1) % PRINTS)
    candidates = links(prints.select("print", F.shiftright(following, 32).cast("int").alias("more"), "node", "salt"), CANDIDATE_BITS)
    labels = cut(nodes.select("node", "at").join(components(candidates), "node"))
    few = labels.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    wanted = labels.select("at.id", "at.text_key", "node", "label")
    texts = cut(named.join(F.broadcast(wanted) if few else wanted, ["id", "text_key"]).select("node", "label", "text").dropDuplicates(["node"]))
    groups = components(verified_links(texts))
    return nodes.join(groups, "node", "left").groupBy(F.coalesce("label", "node").alias("group")).agg(F.min("at").alias("at")).select("at.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates the document with the least id; repeated rows of it count once.  Of rows
    with one id and one text that differ in other columns any one stays.  Rows without an id have no part in it and stay."""
    first, second = (functools.reduce(lambda name, _: f"{name}_" if name in docs.columns else name, range(len(docs.columns)), x) for x in ("id__", "key__"))
    kept = near_duplicates(docs, id_col, text_col).toDF(first, second)
    keyed = docs.filter(F.col(id_col).isNotNull()).withColumn(first, F.col(id_col)).withColumn(second, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    named = keyed.join(kept, [first, second], "left_semi").dropDuplicates([first, second])
    return named.select(*docs.columns).union(docs.filter(F.col(id_col).isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of ``documents``."""
    return near_groups(documents(spark, sf_dir))
