"""Approximate nearest neighbours: one navigable small-world graph a shard.

Rows are dealt to shards by a hash of vec_id.  A shard keeps each distinct
vector once (with all its ids, ascending) and orders them by falling level, so
layer l of the hierarchy is the first n_l vectors and its links one flat array
of positions, ``cap`` a vector, -1 where there is none.  Layers are built from
the top: a layer starts from the links of the one above and takes in the rest
in batches, each batch searching the graph so far in lock-step (numpy over all
its vectors) and choosing diverse links.  An index is a table of such arrays in
parts of bounded size; a search brings the queries, in blocks of ``BLOCK``, to
every shard and merges the shards' results.  How many shards there are follows
from the number of rows alone.

Nearness is the largest inner product.  Vectors get one more component that
makes them equally long, queries a zero there, so that the nearest by distance
is the one with the largest inner product.  Vectors are held as a direction in
single and a length and that component in double precision, and distances are
put together from differences of these, so vectors of very different lengths
keep their places.  Scores are computed in double precision on the original
vectors.

Defined results: vectors that are null, zero, of another dimension than most,
or hold null or non-finite components take no part; rows that repeat vec_id
and vector count once; a vec_id with different vectors is a row for each of them:
as a query each has its own ranking, and the others are candidates in it; equal
scores go to the smaller vec_id; doubles are kept and scored as doubles; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .words import mix

LINKS = 24  # a vector's links on the lowest layer; half as many above
BUILD_BEAM = 64
SEARCH_BEAM = 128  # at least twice the hits asked for
BLOCK = 262_144  # queries that meet a shard in one task
BATCH = 512
PART = 16_384
INDEX = "shard int, part int, levels binary, ids binary, id_counts binary, vectors binary, links binary"


class Points:
    """Vectors as direction, length and lift."""

    def __init__(self, way: np.ndarray, length: np.ndarray, lift: np.ndarray):
        self.way, self.length, self.lift = way, length, lift

    @staticmethod
    def of(raw: np.ndarray, longest: float) -> Points:
        wide = raw.astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        way = (wide / np.where(length > 0, length, 1)[:, None]).astype(np.float32)
        return Points(way, length, np.sqrt(np.maximum(longest * longest - length * length, 0)))

    def __getitem__(self, at) -> Points:
        return Points(self.way[at], self.length[at], self.lift[at])


def _apart(p: Points, q: Points, cosine: np.ndarray) -> np.ndarray:
    """Squared distances of lifted points, of which the cosines are given."""
    more = np.divide(p.length**2 - q.length**2, p.lift + q.lift, out=np.zeros(np.broadcast(p.lift, q.lift).shape), where=p.lift + q.lift > 0)
    return (p.length - q.length) ** 2 + p.length * q.length * np.maximum(2 - 2 * cosine, 0) + more**2


class Graph:
    """Vectors in order of falling level, and the links of each layer."""

    def __init__(self, points: Points, layers: list[np.ndarray]):
        self.points, self.layers = points, layers  # layers[0] is the lowest

    def _beam(self, links, queries, entries, width, expand=2):
        """Lock-step best-first search of one layer: positions and what ``queries``
        measure to them, nearest first.  Vectors that are asked for (plain arrays)
        measure the negative inner product, points of the graph their distance."""
        n, k = entries.shape
        ids = np.full((n, width), -1, np.int64)
        dist = np.full((n, width), np.inf)
        ids[:, :k] = entries
        dist[:, :k] = self._distance(queries, entries)
        order = np.argsort(dist, 1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        seen = ids < 0
        live = np.arange(n)
        while len(live):
            own, far, old = ids[live], dist[live], seen[live]
            pick = np.argsort(old, 1, kind="stable")[:, :expand]
            rows = np.arange(len(live))[:, None]
            from_ = np.where(np.take_along_axis(old, pick, 1), -1, np.take_along_axis(own, pick, 1))
            old[rows, pick] = True
            near = np.where(from_[:, :, None] >= 0, links[from_], -1).reshape(len(live), -1)
            both = np.concatenate([own, near], 1)
            reach = np.concatenate([far, self._distance(queries[live], near)], 1)
            flag = np.concatenate([old, np.zeros(near.shape, bool)], 1)
            # the same position again, or none: out (a stable sort leaves the beam's own first)
            order = np.argsort(both, 1, kind="stable")
            sorted_ = np.take_along_axis(both, order, 1)
            again = np.zeros(both.shape, bool)
            again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
            again |= sorted_ < 0
            np.put_along_axis(reach, order, np.where(again, np.inf, np.take_along_axis(reach, order, 1)), 1)
            best = np.argpartition(reach, width - 1, 1)[:, :width]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(reach, best, 1), 1, kind="stable"), 1)
            own, far, old = (np.take_along_axis(x, best, 1) for x in (both, reach, flag))
            gone = np.isinf(far)
            own[gone], old[gone] = -1, True
            ids[live], dist[live], seen[live] = own, far, old
            live = live[~old.all(1)]
        return ids, dist

    def _distance(self, queries, at):
        got = self.points[at]
        if isinstance(queries, Points):
            cosine = np.matmul(got.way, queries.way[:, :, None])[:, :, 0]
            return _apart(Points(queries.way, queries.length[:, None], queries.lift[:, None]), got, cosine)
        return -got.length * np.matmul(got.way, queries[:, :, None])[:, :, 0]

    def descend(self, queries, down_to=0, width=8):
        """Entry positions for layer ``down_to``, from the layers above it."""
        n = len(queries.length if isinstance(queries, Points) else queries)
        at = np.zeros((n, 1), np.int64)
        for links in self.layers[:down_to:-1]:
            at = self._beam(links, queries, at, width)[0]
            at = np.where(at < 0, at[:, :1], at)[:, : width // 2]
            at = _unlike(at)
        return at

    def search(self, queries, width):
        return self._beam(self.layers[0], queries, self.descend(queries), width)

    def select(self, ids, dist, most):
        """Diverse links: a candidate stays if it is nearer to the vector than to
        every one chosen before it; free places go to the nearest left over."""
        got = self.points[ids]
        cosine = np.matmul(got.way, got.way.transpose(0, 2, 1))
        one, two = (Points(got.way, got.length[side], got.lift[side]) for side in (np.s_[:, :, None], np.s_[:, None, :]))
        between = _apart(one, two, cosine)
        ok = (ids >= 0) & np.isfinite(dist)
        chosen = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            clash = (chosen & (between[:, j, :] < dist[:, j, None])).any(1)
            chosen[:, j] = ok[:, j] & ~clash & (chosen.sum(1) < most)
        order = np.argsort(np.where(chosen, 0, np.where(ok, 1, 2)), 1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(ok, order, 1), np.take_along_axis(ids, order, 1), -1)


def _unlike(at: np.ndarray) -> np.ndarray:
    """Positions of each row, repeats replaced by -1."""
    order = np.argsort(at, 1, kind="stable")
    sorted_ = np.take_along_axis(at, order, 1)
    again = np.zeros(at.shape, bool)
    again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
    out = at.copy()
    np.put_along_axis(out, order, np.where(again, -1, sorted_), 1)
    return out


def _levels(keys: np.ndarray) -> np.ndarray:
    """Geometric levels from the hash of each vector's smallest id."""
    u = (mix(keys.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(LINKS / 2)).astype(np.int64)


def build(points: Points, levels: np.ndarray) -> list[np.ndarray]:
    """Links of every layer over ``points``, which come in order of falling level."""
    top = int(levels[0]) if len(levels) else 0
    graph, above, layers = Graph(points, []), None, []
    for level in range(top, -1, -1):
        size = int((levels >= level).sum())
        most = LINKS if level == 0 else LINKS // 2
        cap = most + most // 2
        links = np.full((size, cap), -1, np.int64)
        done = 1
        if above is not None:
            done = len(above)
            links[:done, : min(cap, above.shape[1])] = above[:, :cap]
        layers.insert(0, links)
        graph.layers = [None] * level + layers
        while done < size:
            end = min(size, done + min(BATCH, max(16, done // 2)))
            _insert(graph, level, links, done, end, most)
            done = end
        above = links
    return layers


def _insert(graph: Graph, level: int, links: np.ndarray, start: int, end: int, most: int) -> None:
    new = np.arange(start, end)
    queries = graph.points[start:end]
    ids, dist = graph._beam(links, queries, graph.descend(queries, level), BUILD_BEAM)
    # nearest within the batch, which the graph does not hold yet
    each = _apart(Points(None, queries.length[:, None], queries.lift[:, None]), queries, queries.way @ queries.way.T)
    np.fill_diagonal(each, np.inf)
    k = min(BUILD_BEAM // 2, end - start - 1)
    if k > 0:
        mates = np.argpartition(each, k - 1, 1)[:, :k]
        ids = np.concatenate([ids, mates + start], 1)
        dist = np.concatenate([dist, np.take_along_axis(each, mates, 1)], 1)
    order = np.argsort(dist, 1, kind="stable")[:, :BUILD_BEAM]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    links[start:end, :most] = graph.select(ids, dist, most)
    # the way back: append while there is room, else choose anew
    to = links[start:end, :most].ravel()
    from_ = np.repeat(new, most)
    from_, to = from_[to >= 0], to[to >= 0]
    known = (links[to] == from_[:, None]).any(1)
    from_, to = from_[~known], to[~known]
    if not len(to):
        return
    one, two = graph.points[from_], graph.points[to]
    near = _apart(one, two, np.einsum("ij,ij->i", one.way, two.way))
    order = np.lexsort((near, to))
    from_, to = from_[order], to[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    nth = np.arange(len(to)) - np.repeat(first, np.diff(first, append=len(to)))
    used = (links >= 0).sum(1)
    cap = links.shape[1]
    full = np.unique(to[used[to] + nth >= cap])
    fits = ~np.isin(to, full)
    links[to[fits], used[to[fits]] + nth[fits]] = from_[fits]
    for part in np.array_split(full, max(1, -(-len(full) // BATCH))):
        if not len(part):
            continue
        mine = np.isin(to, part) & (nth < cap)
        wide = np.full((len(part), 2 * cap), -1, np.int64)
        wide[:, :cap] = links[part]
        wide[np.searchsorted(part, to[mine]), cap + nth[mine]] = from_[mine]
        far = graph._distance(graph.points[part], wide)
        far[wide < 0] = np.inf
        order = np.argsort(far, 1, kind="stable")[:, : max(BUILD_BEAM, cap)]
        kept = graph.select(np.take_along_axis(wide, order, 1), np.take_along_axis(far, order, 1), most)
        links[part] = -1
        links[part, :most] = kept


def _matrix(column) -> np.ndarray:
    """A list column of floats or doubles, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _build_shard(longest: float):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, raw = table.column("vec_id").to_numpy(), _matrix(table.column("embedding"))
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], raw[order]
        rows = np.ascontiguousarray(raw + raw.dtype.type(0)).view(f"V{raw.itemsize * raw.shape[1]}").ravel()  # -0.0 and 0.0 are one
        _, first, of, count = np.unique(rows, return_index=True, return_inverse=True, return_counts=True)
        levels = _levels(ids[first])
        fall = np.lexsort((ids[first], -levels))
        place = np.empty(len(fall), np.int64)
        place[fall] = np.arange(len(fall))
        by = np.argsort(place[of], kind="stable")
        raw, levels, count = raw[first[fall]], levels[fall], count[fall]
        layers = build(Points.of(raw, longest), levels)
        flat = np.concatenate([[0], np.cumsum(count)])
        out = []
        for part, i in enumerate(range(0, len(raw), PART)):
            j = min(len(raw), i + PART)
            links = b"".join(np.ascontiguousarray(x[i : min(j, len(x))], "<i4").tobytes() for x in layers if i < len(x))
            out.append({"shard": shard, "part": part, "levels": levels[i:j].astype("<i4").tobytes(), "ids": ids[by][flat[i] : flat[j]].astype("<i8").tobytes(), "id_counts": count[i:j].astype("<i8").tobytes(), "vectors": raw[i:j].tobytes(), "links": links})
        return pa.Table.from_pylist(out, _INDEX)

    return run


_INDEX = pa.schema([("shard", pa.int32()), ("part", pa.int32())] + [(c, pa.binary()) for c in ("levels", "ids", "id_counts", "vectors", "links")])


def _load(parts: list[dict], dim: int):
    """Arrays of one shard from its parts."""
    parts = sorted(parts, key=lambda p: p["part"])
    join = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in parts])
    levels = join("levels", "<i4").astype(np.int64)
    counts = join("id_counts", "<i8")
    layers = [[] for _ in range(int(levels[0]) + 1)]
    for p in parts:
        own, at, links = np.frombuffer(p["levels"], "<i4"), 0, np.frombuffer(p["links"], "<i4")
        for level, layer in enumerate(layers):
            n, most = int((own >= level).sum()), LINKS if level == 0 else LINKS // 2
            if n:
                cap = most + most // 2
                layer.append(links[at : at + n * cap].reshape(n, cap))
                at += n * cap
    size = sum(len(p["vectors"]) for p in parts) // (len(levels) * dim)
    return join("vectors", f"<f{size}").reshape(-1, dim), [np.concatenate(x).astype(np.int64) for x in layers], join("ids", "<i8"), np.concatenate([[0], np.cumsum(counts)])


def _search_shard(dim: int, k: int, longest: float):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        rows = ([], [], [], [])
        if index.num_rows and queries.num_rows:
            raw, layers, ids, start = _load(index.to_pylist(), dim)
            graph = Graph(Points.of(raw, longest), layers)
            asked, own = _matrix(queries.column("embedding")), queries.column("query_id").to_pylist()
            keys = queries.column("key").to_pylist()
            for i in range(0, len(asked), BATCH):
                q = asked[i : i + BATCH]
                found, _ = graph.search(Points.of(q, 0.0).way, max(SEARCH_BEAM, 2 * k))
                score = np.matmul(raw[found].astype(np.float64), q.astype(np.float64)[:, :, None])[:, :, 0]
                for r in range(len(q)):
                    hits = []
                    for at, s in zip(found[r].tolist(), score[r].tolist()):
                        if at >= 0:
                            near = ids[start[at] : start[at + 1]][: k + 1].tolist()
                            if own[i + r] in near and (raw[at] == q[r]).all():
                                near.remove(own[i + r])
                            hits += [(-s, v) for v in near]
                    for s, v in sorted(hits)[:k]:
                        for c, x in zip(rows, (keys[i + r], own[i + r], v, -s)):
                            c.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["key", "query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, each vec_id and vector once."""
    inf = float("inf")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0)
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = vectors.filter("vec_id is not null and embedding is not null").filter(fine).select(F.col("vec_id").cast("long"), "embedding", F.size("embedding").alias("dim"))
    return rows.dropDuplicates(["vec_id", "embedding"])


def build_index(rows: DataFrame, dim: int, n: int, longest: float, smallest: int = PART, largest: int = 1_000_000) -> DataFrame:
    """The index table of ``rows`` (vec_id, embedding).  64 shards of ``smallest``
    to ``largest`` rows, or as many more or fewer as these bounds ask for."""
    shards = -(-n // min(largest, max(smallest, n // 64)))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")
    return cut(dealt.groupBy("shard").applyInArrow(_build_shard(longest), INDEX), "hnsw")


def search(index: DataFrame, queries: DataFrame, dim: int, longest: float, k: int) -> DataFrame:
    """``queries`` (query_id, embedding) against every shard: query_id, rank,
    vec_id, score.  A task gets one shard and one block of queries."""
    blocks = max(1, -(-queries.count() // BLOCK))
    shards = [F.lit(r.shard) for r in index.select("shard").distinct().orderBy("shard").collect()]
    keyed = queries.select("query_id", "embedding", F.xxhash64("query_id", "embedding").alias("key"))
    dealt = keyed.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.array(*shards).cast("array<int>")))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = held.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(_search_shard(dim, k, longest), "key long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return hits.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id is divisible by ``every``."""
    rows = cut(usable(vectors), "vectors")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not most:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = most[0].dim, most[0].n, most[0].longest
    rows = rows.filter(F.col("dim") == dim)
    index = build_index(rows, dim, n, longest)
    return search(index, rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding"), dim, longest, k)
