"""Operator 12: near duplicates among embeddings by a forest of random-projection trees.

Every tree splits the vectors again and again at the median of a random projection (a direction for each level, a
threshold for each node).  The SPILL share of rows around a median goes to both sides.  Only vectors that share a leaf of
some tree are compared, in double precision; a pair counts in the first leaf that its vectors share, so leaves emit
counts and a spanning forest of their links, never pairs.

Thresholds come from a sample of about SAMPLE vectors.  A node with fewer than NODE of them hands its thresholds down: a
further projection is nearly independent of those before, so its median hardly changes and depth has no bound.  The
number of trees follows from the sample too: sample vectors are turned to the least cosine that links, both are sent
down trees until the share of turned pairs that meet, counted over trees, reaches RECALL.  Nearer pairs meet more often.

Hot groups.  Equal vectors are one row with a count.  A ball is a set of vectors within half the linking angle of a hub,
so all its pairs link without being compared; hubs are sample vectors with HUB_MIN neighbours or more.  A leaf with more
than MOST rows is compared block by block, all blocks with all but those of one ball; nothing is dropped.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
length do not link.  Rows without an id take part; they name a component only if no row of it has one.  Repeated rows
link to each other and are all kept if their id is the component's.  Very large and very small components are scaled
first.  An empty table gives no rows.  Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .simhash import components, joined

COSINE = 0.9
#: Vectors that fit thresholds, hubs and the number of trees; about so many, picked by hash.
SAMPLE = 16384
#: Rows that a leaf should hold, and most that one task compares at once.
LEAF, MOST = 4096, 8192
SPILL, NODE, RECALL, HUB_MIN = 0.1, 64, 0.98, 16
#: Turned pairs that measure recall.
PAIRS = 2000
#: Leaves compared block by block that are broadcast; more are joined by a shuffle.
FULL_BROADCAST = 2000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def matrix(column) -> np.ndarray:
    """The vectors of a column whose rows all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Forest:
    """Trees over vectors of one length, with the hubs of its balls."""

    def __init__(self, sample: np.ndarray, nodes: np.ndarray, rows: int, cosine: float, recall: float = RECALL, leaf: int = LEAF):
        self.cosine, sample = cosine, unit(sample)
        self.depth = max(0, math.ceil(math.log(max(1, rows / leaf)) / math.log(2 / (1 + SPILL))))
        self._hubs(sample, nodes)
        rng = np.random.Generator(np.random.PCG64([0xF0E5, sample.shape[1]]))
        pick = sample[rng.integers(0, len(sample), PAIRS)]
        noise = rng.standard_normal(pick.shape)
        noise -= (noise * pick).sum(1, keepdims=True) * pick
        length = np.sqrt((noise * noise).sum(1, keepdims=True))
        turned = cosine * pick + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)
        self.trees: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]] = []
        met = np.zeros(PAIRS, bool)
        while met.mean() < recall:
            self.trees.append(self._tree(sample, rng))
            row, node = self._down(len(self.trees) - 1, np.concatenate([pick, turned]))
            code = node * PAIRS + row % PAIRS
            met[np.intersect1d(code[row < PAIRS], code[row >= PAIRS]) % PAIRS] = True

    def _hubs(self, sample: np.ndarray, nodes: np.ndarray) -> None:
        """Greedy: the vector with most neighbours that are in no ball yet is a hub, until fewer than HUB_MIN are left to it."""
        self.half = math.sqrt((1 + self.cosine) / 2) + 1e-9
        near = [np.flatnonzero(x) for at in range(0, len(sample), 512) for x in sample[at : at + 512] @ sample.T >= self.half]
        free, hubs = np.ones(len(sample), bool), []
        left = np.array([len(x) for x in near])
        while len(left) and left.max() >= HUB_MIN:
            k = int(left.argmax())
            left[k] = int(free[near[k]].sum())  # counts only shrink, so a stale one is an upper bound
            if left[k] == (left.max() if left[k] >= HUB_MIN else -1):
                hubs.append(k)
                free[near[k]] = False
                left[k] = 0
        self.hubs, self.hub_nodes = sample[hubs], nodes[hubs]

    def _tree(self, sample: np.ndarray, rng) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        directions = rng.standard_normal((sample.shape[1], self.depth))
        projected, node, fitted = sample @ directions, np.zeros(len(sample), np.int64), 0
        lows, highs = [], []
        for level in range(self.depth):
            low, high = np.zeros(1 << fitted), np.zeros(1 << fitted)
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange((1 << fitted) + 1))
            for k in range(1 << fitted):
                mine = projected[order[cuts[k] : cuts[k + 1]], level]
                if len(mine):
                    low[k], high[k] = np.quantile(mine, [0.5 - SPILL / 2, 0.5 + SPILL / 2])
            lows.append(low)
            highs.append(high)
            if len(sample) >> fitted >= 2 * NODE:  # halves of a node still hold enough of the sample
                node = 2 * node + (projected[:, level] >= (low + high)[node] / 2)
                fitted += 1
        return directions, lows, highs

    def _down(self, tree: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the vectors reach."""
        directions, lows, highs = self.trees[tree]
        projected, row, node = vectors @ directions, np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for level, (low, high) in enumerate(zip(lows, highs, strict=True)):
            at = node >> (level - (len(low).bit_length() - 1))
            p = projected[row, level]
            left, right = p < high[at], (p >= low[at]) | (p >= high[at])
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) over all trees, by row, codes ascending; a code tells tree and leaf."""
        parts = [self._down(t, vectors) for t in range(len(self.trees))]
        row = np.concatenate([r for r, _ in parts] or [np.zeros(0, np.int64)])
        code = np.concatenate([n + (t << 48) for t, (_, n) in enumerate(parts)] or [np.zeros(0, np.int64)])
        order = np.lexsort((code, row))
        return row[order], code[order]

    def balls(self, vectors: np.ndarray) -> np.ndarray:
        """Node of the hub whose ball each vector is in, 0 for none; row by row the nearest hub."""
        out = np.zeros(len(vectors), np.int64)
        if len(self.hubs):
            cosines = vectors @ self.hubs.T
            best = cosines.argmax(1)
            inside = cosines[np.arange(len(vectors)), best] >= self.half
            out[inside] = self.hub_nodes[best[inside]]
        return out


def _balls(forests: dict[int, Forest]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                width = batch.column("width").to_numpy()
                ball = np.zeros(batch.num_rows, np.int64)
                for w in np.unique(width):
                    mine = np.flatnonzero(width == w)
                    if int(w) in forests:
                        ball[mine] = forests[int(w)].balls(unit(matrix(batch.column("embedding").take(pa.array(mine)))))
                yield pa.record_batch({"node": batch.column("node"), "copies": batch.column("copies"), "ball": pa.array(ball), "width": batch.column("width"), "embedding": batch.column("embedding")})

    return run


def _routed(forests: dict[int, Forest], vectors: bool):
    """A row for each leaf of each vector, with the vector, and the codes of its leaves before this one."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                width = batch.column("width").to_numpy()
                for w in np.unique(width):
                    mine = batch.take(pa.array(np.flatnonzero(width == w)))
                    if int(w) in forests:
                        row, code = forests[int(w)].leaves(unit(matrix(mine.column("embedding"))))
                    else:
                        row, code = np.arange(mine.num_rows), np.zeros(mine.num_rows, np.int64)
                    out = mine.select(["node", "copies", "ball", "width"] + ["embedding"] * vectors).take(pa.array(row))
                    columns = {"code": pa.array(code)} | {name: out.column(name) for name in out.schema.names}
                    if vectors:
                        first = np.searchsorted(row, row)
                        nth = np.arange(len(row)) - first
                        ends = np.concatenate([[0], np.cumsum(nth)]).astype(np.int32)
                        flat = code[np.repeat(first, nth) + np.arange(ends[-1]) - np.repeat(ends[:-1], nth)]
                        columns["before"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                    yield pa.record_batch(columns)

    return run


def _met_before(before: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows, whether they share an earlier leaf."""
    width = max((len(x) for x in before), default=0)
    padded = np.full((len(before), width), -1, np.int64)
    for k, x in enumerate(before):
        padded[k, : len(x)] = x
    out = np.zeros(len(a), bool)
    for i in range(width):
        x = padded[a, i]
        for j in range(width):
            out |= (x == padded[b, j]) & (x >= 0)
    return out


def _compared(cosine: float):
    """Of the rows of a block pair: new partners of each row (kind 0: node, count) and links that connect them (kind 1)."""

    def run(rows: pa.Table) -> pa.Table:
        block, p, q = (rows.column(x).to_numpy() for x in ("block", "p", "q"))
        order = np.argsort(block, kind="stable")
        rows, block = rows.take(pa.array(order)), block[order]
        nodes, copies, balls = (rows.column(x).to_numpy() for x in ("node", "copies", "ball"))
        vectors, before = unit(matrix(rows.column("embedding"))), [np.asarray(x, np.int64) for x in rows.column("before").to_pylist()]
        n, within = len(nodes), p[0] == q[0]
        split = n if within else int(np.searchsorted(block, q[0]))
        count, label = np.zeros(n, np.int64), np.arange(n)
        for at in range(0, split, 512):
            to = min(at + 512, split)
            base = at + 1 if within else split
            near = vectors[at:to] @ vectors[base:].T >= cosine
            near &= (balls[at:to, None] != balls[None, base:]) | (balls[at:to, None] == 0)
            if within:
                near &= np.arange(base, n)[None, :] > np.arange(at, to)[:, None]
            a, b = np.nonzero(near)
            a, b = a + at, b + base
            for part in range(0, len(a), 1 << 18):
                x, y = a[part : part + (1 << 18)], b[part : part + (1 << 18)]
                new = ~_met_before([before[k] for k in range(n)], x, y) if len(x) else np.zeros(0, bool)
                count += np.bincount(x[new], copies[y[new]], n).astype(np.int64) + np.bincount(y[new], copies[x[new]], n).astype(np.int64)
                label = joined(n, np.concatenate([x[new], np.arange(n)]), np.concatenate([y[new], label]))
        counted, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(n))
        kind = np.repeat(np.array([0, 1], np.int32), [len(counted), len(moved)])
        return pa.table({"kind": pa.array(kind), "node": pa.array(np.concatenate([nodes[counted], nodes[moved]])), "other": pa.array(np.concatenate([count[counted], nodes[label[moved]]]))})

    return run


def fitted(nodes: DataFrame, cosine: float = COSINE, recall: float = RECALL, leaf: int = LEAF, size: int = SAMPLE) -> dict[int, Forest]:
    """A forest for each length of vectors that the sample holds, from (node, width, embedding).  What comes to the driver
    are about ``size`` vectors."""
    total = nodes.count()
    share = F.pmod(F.xxhash64("node", F.lit(12)), F.lit(max(1, math.ceil(total / size)))) == 0
    sample = nodes.filter(share).select("node", "width", "embedding").toArrow()
    sample = sample.take(np.argsort(sample.column("node").to_numpy(), kind="stable"))
    width = sample.column("width").to_numpy()
    out = {}
    for w, count in zip(*np.unique(width, return_counts=True), strict=True):
        mine = sample.filter(pa.array(width == w))
        out[int(w)] = Forest(matrix(mine.column("embedding")), mine.column("node").to_numpy(), int(total * count / len(width)), cosine, recall, leaf)
    return out


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, leaf: int = LEAF, most: int = MOST, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: its id, n_links, component_id and kept.  See the module's text for the method and the edges."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    vector = F.col(vector_col)
    good = F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.when(good, F.xxhash64(vector)).alias("node"), F.when(good, vector).alias("embedding"))
    nodes = cut(rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.min("id").alias("least")).withColumn("width", F.size("embedding")))
    forests = fitted(nodes, cosine, recall, leaf, sample)
    kind = nodes.schema["embedding"].dataType.simpleString()
    schema = f"node long, copies long, ball long, width int, embedding {kind}"
    placed = cut(nodes.select("node", "copies", "width", "embedding").mapInArrow(_balls(forests), schema))
    # leaves with more than ``most`` rows: how many blocks, those of large balls apart (block 0.. of the rest first)
    codes = placed.select("node", "copies", "ball", "width", "embedding").mapInArrow(_routed(forests, False), "code long, node long, copies long, ball long, width int")
    apart = codes.groupBy("width", "code", "ball").agg(F.count("*").alias("n"))
    apart = apart.withColumn("set", F.when((F.col("ball") != 0) & (F.col("n") >= most // 2), F.col("ball")).otherwise(0))
    sets = apart.groupBy("width", "code", "set").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / (most // 2)).cast("int"))
    full = sets.groupBy("width", "code").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("set", "blocks"))).alias("sets")).filter(F.col("n") > most).select("width", "code", "sets")
    full = cut(full)
    few = full.limit(FULL_BROADCAST + 1).count() <= FULL_BROADCAST
    routed = placed.mapInArrow(_routed(forests, True), f"code long, {schema}, before array<long>")
    met = routed.join(F.broadcast(full) if few else full, ["width", "code"], "left")
    own_set = F.when(F.exists("sets", lambda s: s["set"] == F.col("ball")), F.col("ball")).otherwise(F.lit(0))
    first = lambda s: F.aggregate("sets", F.lit(0), lambda at, x: at + F.when(x["set"] < s, x["blocks"]).otherwise(0))
    total = F.aggregate("sets", F.lit(0), lambda at, x: at + x["blocks"])
    here = F.when(F.col("sets").isNull(), 0).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("mine")).cast("int"))
    met = met.withColumn("set", own_set).withColumn("first", first(F.col("set"))).withColumn("mine", F.aggregate("sets", F.lit(0), lambda at, x: at + F.when(x["set"] == F.col("set"), x["blocks"]).otherwise(0)))
    met = met.withColumn("block", here)
    others = F.filter(F.sequence(F.lit(0), total - 1), lambda k: (F.col("set") == 0) | (k < F.col("first")) | (k >= F.col("first") + F.col("mine")))
    met = met.withColumn("with", F.explode(F.when(F.col("sets").isNull(), F.array(F.lit(0))).otherwise(others)))
    met = met.select("width", "code", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "node", "copies", "ball", "embedding", "before")
    found = cut(met.groupBy("width", "code", "p", "q").applyInArrow(_compared(cosine), "kind int, node long, other long"))
    counts = found.filter("kind = 0").groupBy("node").agg(F.sum("other").alias("others"))
    edges = found.filter("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b"))
    labels = components(edges.union(placed.filter("ball <> 0 AND ball <> node").select(F.col("node").alias("a"), F.col("ball").alias("b"))))
    in_ball = placed.filter("ball <> 0").groupBy("ball").agg(F.sum("copies").alias("ball_copies"))
    counted = placed.select("node", "copies", "ball").join(F.broadcast(in_ball), "ball", "left").join(counts, "node", "left")
    counted = counted.select("node", (F.coalesce("ball_copies", "copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    result = rows.select("id", "node").join(cut(counted.join(named, "node")), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    result = result.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector of ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
