"""Signatures against a plain SuperMinHash, components against brute force."""

import numpy as np
import pytest

from weftline.llm import jaccard_join, minhash_dedup
from weftline.llm.words import mix

from .test_jaccard_join import brute, corpus


def plain(s, m, seed):
    """One set, one shingle at a time, without stopping early."""
    h = [None] * m
    for x in mix(s ^ np.uint64(seed)):
        p = list(range(m))
        for j in range(m):
            offer, place = (int(v[0]) for v in minhash_dedup._draw(np.array([x]), j, m))
            p[j], p[place] = p[place], p[j]
            h[p[j]] = offer if h[p[j]] is None else min(h[p[j]], offer)
    return h


@pytest.mark.parametrize("m", [1, 5, 24, 60])
def test_signatures_equal_plain_ones(m):
    rng = np.random.default_rng(m)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 3, 17, 0, 90, 400)]
    got = minhash_dedup.signatures(sets, m, 5)
    for s, row in zip(sets, got.tolist()):
        assert row == plain(s, m, 5) if len(s) else set(row) == {2**64 - 1}


def test_registers_agree_like_the_sets_and_vary_less():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 30, dtype=np.uint64)
        a, b = minhash_dedup.signatures([x[:25], x[5:]], 60, 9)
        errors.append((a == b).mean() - 20 / 30)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.9 * (20 / 30 * 10 / 30 / 60) ** 0.5  # independent minima have this


def test_band_counts():
    assert minhash_dedup.band_count(100, 6, 1e-8) == 1
    for percent in (51, 80, 85, 99):
        b = minhash_dedup.band_count(percent, 6, 1e-8)
        assert (1 - (percent / 100) ** 6) ** b <= 1e-8 < (1 - (percent / 100) ** 6) ** (b - 1)


@pytest.mark.parametrize("k, percent, block", [(3, 85, 512), (3, 85, 16), (5, 80, 8), (3, 100, 512), (1, 60, 8)])
def test_equals_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = corpus(k + block)
    want = brute(docs, k, percent)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeated_rows_extra_columns_and_no_rows(spark):
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(5, x, 1), (5, y, 2), (5, y, 2), (3, y + " z", 3), (7, x.upper() + " z", 4), (None, y, 5), (None, None, 6), (9, " \n", 7), (10, "two words", None), (11, "Two\twords", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long").selectExpr("*", "1 as sig", "2 as key", "'a' as bands")
    got = sorted(((r.n_shingles, r.component_id or -1, r.doc_id or -1, r.kept) for r in minhash_dedup.near_duplicates(docs, 3, 85).collect()))
    assert got == [(0, -1, -1, True), (0, 9, 9, True), (1, 10, 10, True), (1, 10, 11, False), (58, 3, -1, False), (58, 3, 5, False), (58, 3, 5, False), (58, 5, 5, True), (59, 3, 3, True), (59, 5, 7, False)]
    empty = minhash_dedup.near_duplicates(docs.filter("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    only_null = minhash_dedup.near_duplicates(docs.filter("doc_id is null and text is not null"))
    assert [tuple(r) for r in only_null.collect()] == [(None, 56, None, True)]
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(docs, percent=50)


def test_very_long_texts_and_a_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:i % 200] + [f"n{i}"] + base[i % 200 + 1 :])) for i in range(600)]
    docs += [(1000, "a " * 1_000_000), (1001, "A " * 999_999 + "b"), (1002, " ".join(map(str, range(300_000))))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    assert all(got[i][1] == 0 for i in range(600))
    assert (got[1000], got[1001], got[1002]) == ((1, 1000), (2, 1001), (299_998, 1002))
