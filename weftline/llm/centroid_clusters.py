"""Dual-tree Lloyd: exact centroid clustering of whole-numbered vectors.

Every component x becomes floor(scale * x), x as double, so sums, centroids and
squared distances are whole numbers and equal at any partitioning.

1. Vectors go to blocks of ``BLOCK`` where they lie, without a shuffle.  A block
   holds a cover tree: the members of a node lie within its radius of its centre,
   children are centred on members more than a power of two apart that covers all
   members, the first on the node's own centre, and leaves hold few vectors or
   equal ones.  Blocks are stored once, in arrays, and read every round.
2. A round sends the k centroids to the tasks, which build a tree over them and
   walk pairs of nodes, all pairs of a step at once: a centroid node goes when its
   least possible distance exceeds the largest possible of another one, a node
   of vectors with one centroid left is assigned whole, and pairs of leaves are
   compared exactly (ties: the smaller number).  Which side descends is decided
   by the wider one.
3. A task adds its blocks up to one row a centroid; sums over tasks are taken in
   DataFrames, and k centroids, never vectors, reach the driver.

Rounds end early once no centroid moves, as all later ones give the same.

Defined results: vectors that are null, of another length, or with a null or
non-finite component take no part; fewer kept vectors than k give as many
centroids; a repeated vec_id gives a row for each of its vectors; among equal
starting hashes the smaller vector comes first, null ids come last; an empty
cluster keeps its centroid; other columns are ignored; an empty table gives an
empty result.  Distances are longs: components beyond 2**27 fail with an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Vectors of a tree, and of a leaf.
BLOCK = 2048
LEAF = 16
#: Below this size all distances are exact in double precision.
_DOUBLE = 2.0**22
_MOST = 2.0**27
_TREE = {"middle": np.int32, "radius": np.float64, "first": np.int32, "past": np.int32, "kid": np.int32, "kids": np.int32}


def cover_tree(v: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows of ``v`` and nodes over it: ``middle`` (a place in the
    order), ``radius``, members first .. past - 1, and ``kids`` nodes from ``kid`` on."""
    x = v.astype(np.float64)
    order = np.arange(len(x))
    nodes = [[0, 0, len(x)]]  # middle's row, first, past
    radius, kid, kids = [], [], []
    at = 0
    while at < len(nodes):
        middle, first, past = nodes[at]
        own = order[first:past]
        far = np.sqrt(np.square(x[own] - x[middle]).sum(1))
        radius.append(float(far.max(initial=0)))
        kid.append(len(nodes))
        if len(own) > leaf and radius[at] > 0:
            reach = 2.0 ** (np.ceil(np.log2(radius[at])) - 1)
            parts, rest, place = [], own, first
            while len(rest):
                near = far <= reach
                parts.append(rest[near])
                nodes.append([middle, place, place + len(parts[-1])])
                place += len(parts[-1])
                rest = rest[~near]
                if len(rest):
                    middle = int(rest[0])
                    far = np.sqrt(np.square(x[rest] - x[middle]).sum(1))
            order[first:past] = np.concatenate(parts)
        kids.append(len(nodes) - kid[at])
        at += 1
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    row, first, past = np.array(nodes).T
    return order, {k: np.asarray(c, t) for (k, t), c in zip(_TREE.items(), (where[row], radius, first, past, kid, kids))}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry its own number, ``sizes`` times, and starts, starts + 1, .."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


def _squares(v: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, whole numbers."""
    exact = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _DOUBLE
    v, c = (v.astype(np.float64), c.astype(np.float64)) if exact else (v.astype(np.int64), c.astype(np.int64))
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 15):
        b = slice(a, a + (1 << 15))
        out[b] = np.square(v[i[b]] - c[j[b]]).sum(1)
    return out


def nearest(v: np.ndarray, tree: dict, c: np.ndarray, c_order: np.ndarray, c_tree: dict) -> tuple[np.ndarray, int]:
    """The number of each vector's nearest centroid, and how many pairs were
    compared.  ``v`` is in its tree's order, ``c`` by number."""
    owner = np.full(len(v), -1)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    x, y = v.astype(np.float64), c[c_order].astype(np.float64)
    compared = 0
    while len(a):
        far = np.sqrt(np.square(x[tree["middle"][a]] - y[c_tree["middle"][b]]).sum(1))
        wide_a, wide_b = tree["radius"][a], c_tree["radius"][b]
        start = np.flatnonzero(np.diff(a, prepend=-1))  # pairs of one node stand together
        group = np.cumsum(np.diff(a, prepend=-1) != 0) - 1
        least = np.minimum.reduceat(far + wide_a + wide_b, start)[group]
        stay = far - wide_a - wide_b <= least * (1 + 1e-9) + 1e-6  # rounding never loses a tie
        compared += len(a)
        a, b, wide_b = a[stay], b[stay], wide_b[stay]
        start = np.flatnonzero(np.diff(a, prepend=-1))
        group = np.cumsum(np.diff(a, prepend=-1) != 0) - 1
        count = np.bincount(group)
        single = c_tree["past"][b] - c_tree["first"][b] == 1
        sole = (count[group] == 1) & single
        for n, m in zip(a[sole].tolist(), b[sole].tolist()):
            owner[tree["first"][n] : tree["past"][n]] = c_order[c_tree["first"][m]]
        leaf_a, leaf_b = tree["kids"][a] == 0, c_tree["kids"][b] == 0
        ready = leaf_a & np.logical_and.reduceat(leaf_b, start)[group] & ~sole
        if ready.any():
            n, m = a[ready], b[ready]
            # a pair of leaves: all its members by all its centroids
            of, i = _spread(tree["first"][n].astype(np.int64), (tree["past"][n] - tree["first"][n]).astype(np.int64))
            of_c, j = _spread(c_tree["first"][m[of]].astype(np.int64), (c_tree["past"][m[of]] - c_tree["first"][m[of]]).astype(np.int64))
            i, j = i[of_c], c_order[j]
            d = _squares(v, c, i, j)
            compared += len(i)
            rank = np.lexsort((j, d, i))
            i, j = i[rank], j[rank]
            head = np.diff(i, prepend=-1) != 0
            owner[i[head]] = j[head]
        left = ~(sole | ready)
        a, b, group, leaf_a, leaf_b, wide_b = (s[left] for s in (a, b, group, leaf_a, leaf_b, wide_b))
        if not len(a):
            break
        start = np.flatnonzero(np.diff(a, prepend=-1))
        group = np.cumsum(np.diff(a, prepend=-1) != 0) - 1
        down_b = leaf_a | (np.maximum.reduceat(np.where(leaf_b, -1.0, wide_b), start)[group] > tree["radius"][a])
        of, b2 = _spread(np.where(leaf_b, b, c_tree["kid"][b])[down_b], np.where(leaf_b, 1, c_tree["kids"][b])[down_b])
        a2 = a[down_b][of]
        of, a1 = _spread(tree["kid"][a][~down_b].astype(np.int64), tree["kids"][a][~down_b].astype(np.int64))
        a, b = np.concatenate([a1, a2]), np.concatenate([b[~down_b][of], b2])
        rank = np.lexsort((b, a))
        a, b = a[rank], b[rank]
    return owner, compared


_BLOCKS = "ids array<long>, vectors binary, kind string, " + ", ".join(f"{k} binary" for k in _TREE)


def kept_vectors(df: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """(id, vector): the vectors that take part, as doubles that are whole numbers."""
    x = F.col("vector")
    fine = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))

    def floor(y):  # as double: Spark's floor() of a double is a long, and may not fit one
        return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)

    return rows.filter(F.coalesce(fine, F.lit(False))).withColumn("vector", F.transform("vector", lambda v: floor(v * float(scale))))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose seeded ids hash least (k rows reach the driver)."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(hashed.alias("hash"), "vector").orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.float64)


def _whole(v: np.ndarray) -> np.ndarray:
    if np.abs(v).max(initial=0) > _MOST:
        raise ValueError("a component lies beyond 2**27; distances would not fit a long")
    return v.astype(np.int64)


def blocks(kept: DataFrame) -> DataFrame:
    """A row a block: ids, vectors in the order of the tree, and its arrays."""
    size, leaf = BLOCK, LEAF

    def packed(ids, vectors):
        order, tree = cover_tree(vectors, leaf)
        vectors = _whole(vectors[order])
        kind = next(t for t in ("<i2", "<i4") if np.abs(vectors).max(initial=0) < np.iinfo(t).max)
        row = [[ids[i] for i in order], vectors.astype(kind).tobytes(), kind, *(tree[k].tobytes() for k in _TREE)]
        types = [pa.list_(pa.int64()), pa.binary(), pa.string(), *[pa.binary()] * len(_TREE)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["ids", "vectors", "kind", *_TREE])

    def run(batches):
        ids, rows = [], []
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            own = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)
            for at in range(0, batch.num_rows, size):
                ids += batch.column(0).slice(at, size).to_pylist()
                rows.append(own[at : at + size])
                if len(ids) >= size:
                    every = np.concatenate(rows)
                    yield packed(ids[:size], every[:size])
                    ids, rows = ids[size:], [every[size:]]
        if ids:
            yield packed(ids, np.concatenate(rows))

    return kept.mapInArrow(run, _BLOCKS)


def _unpacked(batches, dim: int):
    """ids, vectors and tree of every block."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, raw, kind, *arrays = (batch.column(c)[r] for c in range(3 + len(_TREE)))
            vectors = np.frombuffer(raw.as_buffer(), kind.as_py()).reshape(-1, dim).astype(np.int64)
            yield ids.values, vectors, {k: np.frombuffer(x.as_buffer(), t) for (k, t), x in zip(_TREE.items(), arrays)}


def _sums(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, place, total, n): what every centroid's vectors add up to."""
    k, dim = centroids.shape

    def run(batches):
        c_order, c_tree = cover_tree(centroids, 1)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, v, tree in _unpacked(batches, dim):
            owner, _ = nearest(v, tree, centroids, c_order, c_tree)
            for c in np.unique(owner):
                total[c] += v[owner == c].sum(0)
            count += np.bincount(owner, minlength=k)
        had = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(had, dim)), pa.array(np.tile(np.arange(dim), len(had))), pa.array(total[had].ravel()), pa.array(np.repeat(count[had], dim))], ["cluster", "place", "total", "n"])

    return stored.mapInArrow(run, "cluster long, place long, total long, n long").groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches):
        c_order, c_tree = cover_tree(centroids, 1)
        for ids, v, tree in _unpacked(batches, dim):
            owner, _ = nearest(v, tree, centroids, c_order, c_tree)
            yield pa.RecordBatch.from_arrays([ids, pa.array(owner.astype(np.int32)), pa.array(_squares(v, centroids, np.arange(len(v)), owner))], ["id", "cluster", "distance"])

    return stored.mapInArrow(run, "id long, cluster int, distance long")


def centroid_clusters(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, and
    centroid_sha256 (of the final centroid's components, joined by commas)."""
    if min(size, k, scale) < 1:
        raise ValueError("size, k and scale are 1 or more")
    kept = kept_vectors(df, id_column, vector_column, size, scale)
    centroids = _whole(first_centroids(kept, k, seed)).reshape(-1, size)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"{id_column} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = cut(blocks(kept), "blocks")
    for _ in range(rounds):
        new = centroids.copy()
        for r in _sums(stored, centroids).collect():  # k times size rows
            new[r.cluster, r.place] = r.total // r.n
        if (new == centroids).all():
            break
        centroids = new
    found = cut(_assigned(stored, centroids), "assigned")
    drop(stored)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).crossJoin(found.agg(F.sum("distance").alias("inertia")))
    totals = totals.join(df.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")
    return found.withColumnRenamed("id", id_column).join(F.broadcast(totals), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
