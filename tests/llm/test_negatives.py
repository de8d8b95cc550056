import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score string, rank string"


def brute(rows, positives, negatives, low, high, scale=256, every=10):
    good = [(i, g, [math.floor(scale * x) for x in v]) for i, g, v in rows if None not in (i, g, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, g) for i, g, w in good if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def clusters(seed, n, dim=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    own = rng.integers(0, 5, n)
    vectors = (centres[own] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, int(c if rng.random() < 0.7 else rng.integers(0, 5)), [float(x) for x in v]) for i, (c, v) in enumerate(zip(own, vectors))]


def awkward():
    rows = clusters(1, 300)
    rows += [(10, 1, rows[10][2]), (20, 3, rows[21][2]), (301, 2, rows[7][2]), (301, 2, rows[7][2]), (302, 2, rows[7][2])]
    rows += [(310, None, rows[0][2]), (320, 1, None), (None, 1, rows[0][2]), (330, 1, [math.nan] * 8), (340, 1, [math.inf] * 8), (350, 1, [None] * 8)]
    rows += [(360, 1, [0.0] * 8), (361, 2, [0.0] * 8), (370, 1, [1.0, 2.0]), (371, 1, [0.5, 1.0]), (372, 2, [0.3, 0.6]), (380, 1, []), (381, 1, []), (382, 2, []), (-10, 2, rows[3][2])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("trees, each_pass", [(256, 16 << 20), (4, 12_000)])
@pytest.mark.parametrize("positives, negatives, low, high", [(5, 10, 30, 90), (2, 3, 95, 100)])
def test_mining_against_all_pairs(spark, trees, each_pass, positives, negatives, low, high):
    rows = awkward()
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, positives, negatives, low, high, tree_anchors=trees, pass_bytes=each_pass)
    assert sorted(map(tuple, got.collect())) == brute(rows, positives, negatives, low, high)


def test_scores_of_any_size_are_exact(spark):
    rows = [(i, i % 2, [x * 10.0**6 for x in v]) for i, _, v in clusters(3, 60)] + [(100 + i, i % 2, v) for i, _, v in clusters(4, 40)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10, 30, 90)


def test_no_rows(spark):
    assert hard_negatives.mine(frame(spark, []).limit(0), F.lit(True)).collect() == []
    assert hard_negatives.mine(frame(spark, awkward()), F.lit(False)).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(frame(spark, awkward()), F.lit(True), positives=0)


def test_spanning_tree_is_least_and_puts_parents_first():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 3)).round(1)
    order, parents, edges = hard_negatives.spanning_tree(vectors)
    assert sorted(order) == list(range(40)) and all(parents[k] < k for k in range(1, 40))
    assert np.allclose(edges[1:], [np.linalg.norm(vectors[order[k]] - vectors[order[parents[k]]]) for k in range(1, 40)])
    pairs = sorted((float(np.linalg.norm(vectors[i] - vectors[j])), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for d, i, j in pairs:  # Kruskal
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i], total = j, total + d
    assert math.isclose(total, float(edges.sum()))


def test_bounds_spare_most_scores_of_clustered_rows():
    rows = clusters(5, 4000, spread=0.01)
    vectors = np.floor(256 * np.array([v for _, _, v in rows]))
    ids, labels = np.array([i for i, _, _ in rows]), np.array([g for _, g, _ in rows])
    anchors = np.flatnonzero(ids % 20 == 0)
    order, parents, edges = hard_negatives.spanning_tree(vectors[anchors])
    own = anchors[order]
    blobs = {"ids": ids[own].astype("<i8"), "labels": labels[own].astype("<i8"), "vectors": vectors[own].astype("<f8"), "parents": parents, "edges": edges}
    tree = hard_negatives.Tree({"tree": 1, "dim": 8, **{k: b.tobytes() for k, b in blobs.items()}})
    search = hard_negatives.Search([tree], {(1, k): [(0, -np.inf, np.inf)] for k in range(len(own))}, 5, False)
    for at in range(0, 4000, 500):
        search.feed(ids[at : at + 500], labels[at : at + 500], vectors[at : at + 500])
    assert search.scored < 0.5 * search.bounded
    for k in (0, 50, 199):
        other = labels != labels[own[k]]
        expected = sorted(zip(-(vectors[other] @ vectors[own[k]]), ids[other]))[:5]
        assert [(-s, i) for s, i in zip(*search.best[1, k, 0])] == expected
