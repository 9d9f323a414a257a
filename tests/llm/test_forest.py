"""The forest against a comparison of all pairs."""

import numpy as np
import pytest

from millrace.llm import forest

from .edge import SF


def brute(rows, cosine=0.9):
    """{row place: (id, links, component, kept)} by all pairs."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    label = np.arange(n)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    least = {k: min((rows[i][0] for i in range(n) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    return sorted(((rows[i][0], int(near[i].sum()), least[label[i]], rows[i][0] == least[label[i]]) for i in range(n)), key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'clash' AS node", "'clash' AS code", "'clash' AS label", "'clash' AS id")


def clusters(rng, groups=12, each=8, alone=60, width=24):
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(width)
        for _ in range(each):
            rows.append(centre * rng.uniform(0.5, 2) + rng.standard_normal(width) * rng.uniform(0, 0.4))
    rows += [rng.standard_normal(width) for _ in range(alone)]
    return [(int(k), [float(x) for x in v]) for k, v in zip(rng.permutation(len(rows)), rows)]


def test_edges(spark):
    one = [1.0, 2.0, -1.0]
    rows = [(1, one), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0])]
    rows += [(8, one), (8, one), (None, one), (None, [9.0, -9.0, 1.0]), (9, [1e200, 2e200, -1e200]), (10, [1e-200, 2e-200, -1e-200]), (11, [1.0, 2.0]), (12, [2.0, 4.0]), (13, [-1.0, -2.0, 1.0]), (None, None)]
    assert got(forest.near_vectors(frame(spark, rows))) == brute(rows)
    assert forest.near_vectors(frame(spark, rows).limit(0)).count() == 0
    assert got(forest.near_vectors(frame(spark, [(4, [0.0]), (2, None)]))) == [(2, 0, 2, True), (4, 0, 4, True)]
    with pytest.raises(ValueError):
        forest.near_vectors(frame(spark, rows), cosine=0.0)


@pytest.mark.parametrize("leaf, most", [(4096, 8192), (4096, 20), (40, 8192), (30, 16)])
def test_small_leaves_and_blocks_find_the_links(spark, leaf, most):
    rows = clusters(np.random.default_rng(leaf + most))
    true, found = brute(rows), got(forest.near_vectors(frame(spark, rows), leaf=leaf, most=most, recall=0.9999))
    assert [x[0] for x in true] == [x[0] for x in found]
    links, all_ = sum(x[1] for x in found), sum(x[1] for x in true)
    assert links <= all_ and links >= 0.98 * all_
    if leaf == 4096:
        assert found == true


def test_a_ball_needs_no_comparison(spark):
    """A group of near copies wider than a block, beside a chain that hangs on it."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(k, [float(x) for x in centre + rng.standard_normal(16) * 0.02]) for k in range(80)]
    away = rng.standard_normal(16)
    away -= away @ centre / (centre @ centre) * centre
    away *= np.linalg.norm(centre) / np.linalg.norm(away)
    rows += [(100 + k, [float(x) for x in np.cos(t) * centre + np.sin(t) * away]) for k, t in enumerate((0.42, 0.46, 0.85, 1.25))]
    assert got(forest.near_vectors(frame(spark, rows), most=16)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs a hair above the least cosine, in trees that are several levels deep."""
    rng = np.random.default_rng(5)
    n, width = 1500, 48
    a = forest.unit(rng.standard_normal((n, width)))
    b = rng.standard_normal((n, width))
    b = forest.unit(b - (b * a).sum(1, keepdims=True) * a)
    c = 0.9005
    pairs = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    found = forest.near_vectors(frame(spark, [(k, [float(x) for x in v]) for k, v in enumerate(pairs)]), leaf=100).toPandas()
    true = sum(((pairs[k : k + 500] @ pairs.T >= 0.9).sum() - len(pairs[k : k + 500])) for k in range(0, 2 * n, 500))
    assert true >= 2 * n and 0.95 * true <= found.n_links.sum() <= true


def test_query_against_all_pairs(spark):
    frame_ = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame_.toPandas().sort_values("vec_id")
    unit = forest.unit(np.array(rows.embedding.tolist()))
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = forest.op12_forest(spark, SF).toPandas().sort_values("vec_id")
    assert found.vec_id.tolist() == rows.vec_id.tolist() and found.n_links.tolist() == links.tolist()
