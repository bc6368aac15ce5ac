"""Nearest neighbours: recall and exact scores against brute force."""

import numpy as np
import pytest

from weftline.llm import vector_search


def brute(ids, x, k):
    score = x.astype(np.float64) @ x.astype(np.float64).T
    out = {}
    for i, v in enumerate(ids):
        if v % 20 == 0:
            order = np.lexsort((ids, -score[i]))
            out[v] = [(int(ids[j]), score[i, j]) for j in order if ids[j] != v][:k]
    return out


def recall(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert set(got) == set(want)
    hit = total = 0
    for q, hits in got.items():
        assert [h[2] for h in hits] == list(range(1, len(hits) + 1)) and len(hits) == len(want[q])
        assert q not in [h[0] for h in hits]
        assert sorted(hits, key=lambda h: (-h[1], h[0])) == hits
        hit += len({h[0] for h in hits} & {w[0] for w in want[q]})
        total += len(want[q])
    return hit / total


@pytest.mark.parametrize("kind", ["unit", "lengths", "copies", "tight"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_search, "PART", 700)
    monkeypatch.setattr(vector_search.build_index, "__defaults__", (700, 1_000_000))
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    if kind == "lengths":
        x *= rng.uniform(0.2, 3, (3000, 1)).astype(np.float32)
    elif kind == "copies":
        x[500:1500] = x[0]
    elif kind == "tight":
        x[1000:2000] = x[0] + 1e-3 * rng.normal(size=(1000, 16))
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, rank int")
    rows = vector_search.nearest(df).collect()
    assert recall(rows, brute(ids, x, 20)) >= 0.95


def test_unusable_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (20, [0.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.nearest(df).collect())
    assert got == [(0, 1, 6, 2.0), (0, 2, 7, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 6, 0.0), (20, 3, 7, 0.0)]
    assert vector_search.nearest(df.filter("false")).count() == 0


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.orderBy("vec_id").toPandas()
    want = brute(p["vec_id"].to_numpy(), np.stack(p["embedding"].to_numpy()).astype(np.float32), 20)
    assert recall(vector_search.nearest(df).collect(), want) >= 0.9


@pytest.mark.parametrize("norm, k", [(1e4, 20), (1e20, 20), (1.0, 200)])
def test_one_long_vector_and_many_hits(spark, norm, k):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[777] *= norm
    x = x.astype(np.float32)
    ids = np.arange(2000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    assert recall(vector_search.nearest(df, k=k).collect(), brute(ids, x, k)) >= 0.95


def test_blocks_of_queries(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = vector_search.nearest(df).collect()
    monkeypatch.setattr(vector_search, "BLOCK", 9)
    assert sorted(whole) == sorted(vector_search.nearest(df).collect())


def test_doubles_are_scored_as_doubles(spark):
    x = np.random.default_rng(5).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.nearest(df).collect()
    assert len(got) == 30 * 20
    for r in got:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-14, abs=1e-15)
    near = {r.vec_id for r in got if r.query_id == 0}
    others = [i for i in np.argsort(-(x @ x[0])) if i]
    assert len(near & set(others[:20])) >= 18
    whole = vector_search.nearest(spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, embedding array<int>"))
    assert [tuple(r) for r in whole.collect()] == [(0, 1, 1, 11.0)]


def test_ids_with_different_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [2.0, 0.5])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 3, 0.5), (20, 1, 3, 2.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]
