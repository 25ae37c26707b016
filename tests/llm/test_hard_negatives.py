import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn
from tessera.llm import queries


def brute_force(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """All (anchor, positive, rank, negative, scores) by comparing each anchor row with all rows, in whole numbers."""
    dim = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, [*v, *[0] * (dim - len(v))]) for i, label, v in rows]
    out = []
    for at, (ident, label, vector) in enumerate(rows):
        if not anchor(ident):
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, other) for k, (i, other, v) in enumerate(rows) if k != at)
        for p in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:negatives]
            out += [(ident, p[1], rank + 1, n[1], -p[0], -n[0]) for rank, n in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, "id long, label long, vector array<long>").repartition(3)
    found = hn.hard_negatives(table, F.col("id") % 10 == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def vectors(seed, n, dim=6, spread=40, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(0, labels)), rng.integers(-spread, spread, dim).tolist()) for i in range(n)]


def test_mined_rows_equal_sql(same):
    assert len(same(queries.op12_hard_negatives, queries.OP12_SQL)) > 100


@pytest.mark.parametrize("seed, n", [(1, 7), (2, 300), (3, 900)])
def test_mined_rows_equal_brute_force(spark, monkeypatch, seed, n):
    monkeypatch.setattr(hn, "LEAF", 16)
    monkeypatch.setattr(hn.Index.__init__, "__defaults__", (64, 100))  # many tiles, oversized ones too
    rows = vectors(seed, n)
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0)


def test_ties_repeats_and_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(hn.Index.__init__, "__defaults__", (64, 50))
    rows = [(i, i % 3, [10, 5, -3]) for i in range(300)] + vectors(5, 100, dim=3, spread=12) + [(0, 1, [9, 9, 9]), (0, 1, [9, 9, 9])]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0)


def test_very_large_components_are_exact(spark):
    rows = [(i, i % 2, [hn.LARGEST - 3 * i, hn.LARGEST - 5 * i * i, -i]) for i in range(40)]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    good = [(0, 1, [3, 4]), (1, 1, [3]), (2, 2, [1, 1]), (3, 2, []), (4, 1, [5, 5]), (10, 7, [1, 2])]
    odd = [(None, 1, [1, 1]), (5, None, [1, 1]), (6, 1, None), (7, 1, [None, 1]), (8, 1, [hn.LARGEST + 1, 1])]
    assert mined(spark, good + odd) == brute_force(good, lambda i: i % 10 == 0)
    assert mined(spark, [(i, 0, [1, i]) for i in range(20)]) == []  # no other label
    table = spark.createDataFrame([], "id long, label long, vector array<long>, shard int, row long, q long, windows string")
    assert hn.hard_negatives(table, F.col("id") % 10 == 0).collect() == []


def test_non_finite_components_take_no_part(spark, tmp_path):
    rows = [(k, k % 3, [0.1 * k, -0.05 * k, 1.0]) for k in range(250)]
    rows += [(1000, 1, [float("nan"), 1.0, 1.0]), (1100, 1, [float("inf"), 0.0, 1.0]), (1200, 1, None), (1300, None, [1.0, 1.0, 1.0]), (1400, 1, [None, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    floor = lambda x: int(np.floor(256 * float(np.float32(x))))
    usable = [(i, (label + 1) % 10 if i % 7 == 0 else label, [floor(x) for x in v]) for i, label, v in rows[:250]]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, str(tmp_path)).collect())) == brute_force(usable, lambda i: i % 100 == 0)


def test_tree_leaves_nodes_out():
    """Boxes outside the window, or below the k-th score, are not opened, and the result is whole."""
    rng = np.random.default_rng(9)
    points = np.repeat(rng.integers(-100, 100, (20, 2)) * 50, 200, axis=0) + rng.integers(-5, 5, (4000, 2))
    tree = hn.RTree(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), points)
    opened = []
    bounds = tree._bounds
    tree._bounds = lambda level, some, *a: opened.append(some.stop - some.start) or bounds(level, some, *a)
    query = np.array([7, -3])
    found = tree.search(query, 1, -1, [(10, -(10**9), 10**9, False, -(2**62))])[0]
    score = points @ query
    best = sorted(zip((-score).tolist(), range(4000), strict=True))[:10]
    assert [(s, i) for s, i, _ in found] == [(-s, i) for s, i in best]
    assert sum(opened) < 0.7 * sum(len(level[0]) for level in tree.levels)
    assert tree.search(query, 1, -1, [(10, 10**8, 10**9, False, -(2**62))]) == [[]]
    again = hn.RTree.from_bytes(tree.to_bytes())
    assert again.search(query, 1, -1, [(10, -(10**9), 10**9, False, -(2**62))])[0] == found


def test_tiles_hold_about_as_many_rows():
    points = np.column_stack([np.zeros(5000, np.int64), np.random.default_rng(4).normal(0, 100, (5000, 3)).astype(np.int64)])
    tile = hn.tile_of(points, hn.fitted_cuts(points[::5], 16))
    sizes = np.bincount(tile)
    assert len(sizes) >= 12 and sizes.max() < 4 * 5000 / len(sizes)
