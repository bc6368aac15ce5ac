"""Copy groups: every kind of edit is found, nothing else is linked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import media_copies as mc


def frame(spark, pictures):
    return spark.createDataFrame([(i, None if a is None else bytearray(mc.encode_pgm(a)), 7) for i, a in pictures], "pic_id long, image binary, group_id int")


def groups(df):
    return {r.pic_id: r.group_id for r in mc.copy_groups(df).collect()}


@pytest.mark.parametrize("kind", range(5))
def test_edits_are_found(spark, kind):
    n = 60
    pictures = [(2 * i, mc.draw(i)) for i in range(n)] + [(2 * i + 1, mc.edit(mc.draw(i), kind)) for i in range(n)]
    got = groups(frame(spark, pictures))
    found = sum(got[2 * i + 1] == 2 * i for i in range(n))
    assert found >= 0.95 * n
    assert all(got[2 * i] == 2 * i for i in range(n))


def test_large_group_and_odd_pictures(spark, monkeypatch):
    monkeypatch.setattr(mc, "CROWD", 4)
    same = mc.draw(1)
    pictures = [(i, same) for i in range(40)] + [(100, mc.edit(same, 1)), (200, None), (201, np.zeros((3, 3))), (202, np.full((80, 80), 9))]
    df = frame(spark, pictures).unionByName(spark.createDataFrame([(203, bytearray(b"GIF89a"), 1), (203, bytearray(b""), 1)], "pic_id long, image binary, group_id int"))
    got = mc.copy_groups(df).collect()
    assert len(got) == df.count()
    assert {r.pic_id: r.group_id for r in got} == {i: 0 for i in range(40)} | {100: 0, 200: 200, 201: 201, 202: 202, 203: 203}
    assert mc.copy_groups(df.filter("false")).count() == 0


def test_descriptors_survive_a_quarter_turn():
    a = mc.draw(5).astype(float)
    x, y = mc.describe_stack(a[None]), mc.describe_stack(np.rot90(a)[None])
    apart = sum(np.bitwise_count(y[k][:, None] ^ x[k][None, :]).astype(int) for k in (5, 6))
    near = (apart.min(1) <= mc.NEAR).sum()
    assert near >= 0.8 * len(y[5])


def test_pictures_of_vectors(spark):
    v = spark.createDataFrame([(3, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [1.0]), (11, None)], "vec_id long, embedding array<float>")
    got = {r.pic_id: bytes(r.image) for r in mc.pictures_of(v).collect()}
    assert set(got) == {6, 7, 8, 22, 23} and got[6] != got[8]


def noisy(a, seed, spread):
    return (a + np.random.default_rng(seed).normal(0, spread, a.shape)).clip(0, 255).astype(np.uint8)


def test_noisy_copies_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(mc, "CROWD", 8)
    same, other = mc.draw(1), mc.draw(2)
    small = [(0, same)] + [(500 + i, noisy(same, i, 2)) for i in range(6)]
    assert set(groups(frame(spark, small)).values()) == {0}
    large = [(i, same) for i in range(60)] + small[1:] + [(600 + i, other) for i in range(30)]
    assert groups(frame(spark, large)) == {i: 0 if i < 600 else 600 for i, _ in large}


def test_crowds_change_no_result(spark, monkeypatch):
    pictures = [(100 * i + j, noisy(mc.draw(i), j, 3)) for i in range(3) for j in range(25)]
    whole = groups(frame(spark, pictures))
    monkeypatch.setattr(mc, "CROWD", 2)
    monkeypatch.setattr(mc, "SQUARE", 8)
    assert groups(frame(spark, pictures)) == whole


def recompressed(a, step):
    """Through rounded cosine coefficients of squares of 8 by 8 pixels."""
    k = np.arange(8)
    m = np.cos((2 * k + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None], 0.5, 0.125**0.5)
    t = a.astype(float).reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    q = step * (1 + (k[:, None] + k) / 4)
    t = m.T @ (np.rint(m @ t @ m.T / q) * q) @ m
    return t.transpose(0, 2, 1, 3).reshape(a.shape).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("change", [lambda a, i: noisy(a, i, 8), lambda a, i: recompressed(a, 16)], ids=["noise", "recompressed"])
def test_noise_and_recompression_are_found(spark, change):
    n = 60
    grain = [np.kron(np.random.default_rng([i, 1]).uniform(-25, 25, (40, 40)), np.ones((2, 2))) for i in range(n)]
    originals = [(mc.draw(i) + g).clip(0, 255).astype(np.uint8) for i, g in enumerate(grain)]
    got = groups(frame(spark, [(2 * i, a) for i, a in enumerate(originals)] + [(2 * i + 1, change(a, i)) for i, a in enumerate(originals)]))
    assert sum(got[2 * i + 1] == 2 * i for i in range(n)) >= 0.95 * n
    assert all(got[2 * i] == 2 * i for i in range(n))


def test_six_flipped_bits_always_meet(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        d = rng.integers(0, 2, 128, np.uint8)
        e = d.copy()
        e[rng.choice(128, 6, replace=False)] ^= 1
        for k, bits in enumerate((d, e)):
            d0, d1 = np.packbits(bits).view("<i8").tolist()
            rows.append((2 * i + k, 2 * i + k, d0, d1))
    corners = spark.createDataFrame(rows, "corner long, pic_id long, d0 long, d1 long")
    assert {(r.i, r.j) for r in mc._compared(corners).collect()} >= {(2 * i, 2 * i + 1) for i in range(200)}


def test_small_crops_and_slight_turns_of_large_pictures(spark):
    def large(seed):
        return np.block([[mc.draw(1000 * seed + 8 * i + j) for j in range(8)] for i in range(8)])

    def turned(a, degrees):
        t = np.radians(degrees)
        y, x = np.indices(a.shape) - np.array([a.shape[0], a.shape[1]]).reshape(2, 1, 1) / 2
        u, v = np.cos(t) * x - np.sin(t) * y + a.shape[1] / 2, np.sin(t) * x + np.cos(t) * y + a.shape[0] / 2
        i, j = v.astype(int).clip(0, a.shape[0] - 2), u.astype(int).clip(0, a.shape[1] - 2)
        f, g = (v - i).clip(0, 1), (u - j).clip(0, 1)
        return ((1 - f) * ((1 - g) * a[i, j] + g * a[i, j + 1]) + f * ((1 - g) * a[i + 1, j] + g * a[i + 1, j + 1])).astype(np.uint8)

    pictures = []
    for n in range(6):
        a = large(n)
        corner = [(10, 20), (300, 90), (500, 480), (77, 501), (410, 230), (200, 333)][n]
        crop = a[corner[0] : corner[0] + 110, corner[1] : corner[1] + 110]
        pictures += [(3 * n, a), (3 * n + 1, crop), (3 * n + 2, turned(a, [3, 8, 15, 20, 30, 45][n]))]
    assert groups(frame(spark, pictures)) == {i: i // 3 * 3 for i, _ in pictures}


def near_pairs(rows):
    """All pairs of corners of different pictures within NEAR bits, by comparing all."""
    d = np.array([(r.d0, r.d1) for r in rows], np.int64).view(np.uint64)
    pic, corner = np.array([r.pic_id for r in rows]), np.array([r.corner for r in rows])
    out = {}
    for k in range(len(rows)):
        apart = np.bitwise_count(d ^ d[k]).sum(1, dtype=int)
        for m in np.flatnonzero((apart <= mc.NEAR) & (pic != pic[k])).tolist():
            if corner[k] < corner[m]:
                out[int(corner[k]), int(corner[m])] = int(apart[m])
    return out


def test_pairs_against_comparing_all(spark):
    pictures = [(2 * i, mc.draw(i)) for i in range(40)] + [(2 * i + 1, noisy(mc.draw(i), i, 4)) for i in range(40)]
    corners = mc.describe(frame(spark, pictures)).withColumn("corner", F.monotonically_increasing_id()).persist()
    want = near_pairs(corners.collect())
    got = {(r.i, r.j) for r in mc._compared(corners).collect()}
    assert got <= set(want) and {p for p, apart in want.items() if apart <= 6} <= got
    assert len(got) >= 0.5 * len(want)
    corners.unpersist()


@pytest.mark.parametrize("n", [200, 1000])
def test_many_noisy_copies(spark, n):
    got = groups(frame(spark, [(i, noisy(mc.draw(1), i, 4)) for i in range(n)]))
    assert sum(g == 0 for g in got.values()) >= 0.95 * n


def test_other_sizes_and_strips(spark, monkeypatch):
    large = [np.block([[mc.draw(100 * n + 3 * i + j) for j in range(3)] for i in range(2)]) for n in range(8)]
    halves = [np.round(a.reshape(80, 2, 120, 2).mean((1, 3))).astype(np.uint8) for a in large]
    df = frame(spark, [(2 * i, a) for i, a in enumerate(large)] + [(2 * i + 1, a) for i, a in enumerate(halves)])
    got = groups(df)
    assert sum(got[2 * i + 1] == 2 * i for i in range(8)) >= 7 and all(got[2 * i] == 2 * i for i in range(8))
    rows = lambda: {(r.pic_id, r.x, r.y, r.scale) for r in mc.describe(df).collect()}
    whole = rows()
    monkeypatch.setattr(mc, "PIXELS", 240 * 40)
    assert len(whole & rows()) >= 0.99 * len(whole | rows())


def test_hot_values_are_dealt_on(spark, monkeypatch):
    pictures = [(i, noisy(mc.draw(1), i, 3 * (i % 2))) for i in range(120)] + [(1000 + i, mc.draw(i // 2 + 5)) for i in range(40)]
    whole = groups(frame(spark, pictures))
    corners = mc.describe(frame(spark, pictures)).withColumn("corner", F.monotonically_increasing_id()).persist()
    assert mc._dealt(corners)[1] is None
    monkeypatch.setattr(mc, "HOT", 20)
    cool, hot = mc._dealt(corners)
    entry = [F.col("block"), mc._value(F.col("block")).alias("v")]
    assert cool.groupBy(*entry).count().agg(F.max("count")).first()[0] <= 20
    assert hot.groupBy(*entry, "other", mc._value(F.col("other")).alias("w")).count().agg(F.max("count")).first()[0] > 60
    assert hot.groupBy(*entry, "other", mc._value(F.col("other")).alias("w"), "part").count().agg(F.max("count")).first()[0] <= 45
    want = near_pairs(corners.collect())
    got = {(r.i, r.j) for r in mc._compared(corners).filter("j >= 0").collect()}
    assert got <= set(want)
    assert groups(frame(spark, pictures)) == whole
    corners.unpersist()
