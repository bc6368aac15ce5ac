"""Clusters against Lloyd's rounds in plain whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroid_clusters as cc


def plain(rows, size, k, rounds, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cents = [[sum(x) // own.count(j) for x in zip(*(v for (_, v), o in zip(kept, own) if o == j))] if j in own else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i if i is not None else -1, c, d, sum(e for _, e, o in found if o == c), sum(e for _, e, _ in found), sha[c]) for i, d, c in found))


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def result(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("seed, size, k, block, leaf, spread", [(1, 5, 8, 2048, 16, 0.05), (2, 64, 8, 100, 4, 1.0), (3, 2, 3, 64, 1, 0.3), (4, 3, 20, 50, 2, 0.0), (5, 8, 1, 2048, 16, 1.0)])
def test_equals_plain_rounds(spark, monkeypatch, seed, size, k, block, leaf, spread):
    monkeypatch.setattr(cc, "BLOCK", block)
    monkeypatch.setattr(cc, "LEAF", leaf)
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, size))
    rows = single([(i * 7 - 300, (middles[i % 6] + spread * rng.normal(size=size)).tolist()) for i in range(400)])
    got = cc.centroid_clusters(table(spark, rows).repartition(3), size=size, k=k)
    assert result(got) == plain(rows, size, k, 10)


def test_odd_vectors_repeated_ids_ties_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = single([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [3.0, -4.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [0.0, -inf]), (7, [0.0, 0.0]), (8, [1.0, 2.0]), (None, [9.0, 9.0]), (9, [0.0004, -0.0004]), (10, [])])
    df = table(spark, rows).withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(None)).withColumn("id", F.lit(1))
    for k in (1, 2, 3, 50):
        assert result(cc.centroid_clusters(df, size=2, k=k, rounds=3)) == plain(rows, 2, k, 3)
    empty = cc.centroid_clusters(df.filter("vec_id = 2"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_are_exact_or_refused(spark):
    rng = np.random.default_rng(4)
    rows = single([(i, (rng.normal(size=3) * 2.0**15).tolist()) for i in range(200)])
    assert result(cc.centroid_clusters(table(spark, rows), size=3, k=4)) == plain(rows, 3, 4, 10)
    with pytest.raises(ValueError, match="beyond"):
        cc.centroid_clusters(table(spark, [(1, [1e30, 0.0])]), size=2)


def test_cover_tree_covers_and_separates():
    v = np.random.default_rng(7).integers(-500, 500, (900, 3))
    order, t = cc.cover_tree(v, 5)
    x = v[order]
    assert sorted(order) == list(range(900))
    for n in range(len(t["first"])):
        own = x[t["first"][n] : t["past"][n]]
        far = np.sqrt(((own - x[t["middle"][n]]) ** 2).sum(1))
        assert np.isclose(far.max(), t["radius"][n])
        kids = range(t["kid"][n], t["kid"][n] + t["kids"][n])
        if not kids:
            assert len(own) <= 5 or t["radius"][n] == 0
            continue
        assert t["middle"][kids[0]] == t["middle"][n] and sum(t["past"][c] - t["first"][c] for c in kids) == len(own)
        reach = 2.0 ** (np.ceil(np.log2(t["radius"][n])) - 1)
        middles = x[t["middle"][list(kids)]]
        apart = np.sqrt(((middles[:, None] - middles[None]) ** 2).sum(2)) + np.eye(len(middles)) * 1e9
        assert apart.min() > reach >= max(t["radius"][c] for c in kids)


def test_trees_spare_most_comparisons():
    rng = np.random.default_rng(8)
    middles = rng.integers(-50_000, 50_000, (64, 8))
    v = middles[rng.integers(0, 64, 2000)] + rng.integers(-300, 300, (2000, 8))
    order, tree = cc.cover_tree(v, 16)
    c_order, c_tree = cc.cover_tree(middles, 1)
    owner, compared = cc.nearest(v[order], tree, middles, c_order, c_tree)
    want = ((v[order][:, None] - middles[None]) ** 2).sum(2).argmin(1)
    assert (owner == want).all() and compared < 0.2 * 2000 * 64
