"""Distances, average path length, and its estimate by growing sketch balls."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, registers, sketch
from ..plans.storage import bucketed, cut, drop
from . import pieces, small
from .graph import Graph


def _simple(g: Graph) -> DataFrame:
    """Distinct arcs between different vertices of g."""
    return g.inside().filter("src <> dst").select("src", "dst").distinct()


def bfs_distances(g: Graph, sources: DataFrame | None = None, symmetric: bool = True, most: int | None = None) -> DataFrame:
    """(s, d, dist) for every vertex d reachable from each source s (all
    vertices unless given), s itself at 0.

    Few vertices: one task.  Else one round a level: the frontier joins the arcs, and what was reached before
    is taken off by an anti join.  The result has a row for each reachable pair;
    for large graphs give a sample of sources."""
    arcs = _simple(g)
    if sources is None and most is None and 0 < g.n <= small.SMALL:

        def levels_of(matrix):
            dist = small.distances(matrix | matrix.T if symmetric else matrix)
            s, d = np.nonzero(dist >= 0)
            return s, d, dist[s, d]

        return small.with_matrix(arcs, g.n, levels_of, "s long, d long, dist int")
    if symmetric:
        arcs = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    arcs = bucketed(arcs, "src", "arcs")
    start = (g.vertices if sources is None else sources.select(F.col(sources.columns[0]).alias("vertex")).distinct()).select(F.col("vertex").alias("s"), F.col("vertex").alias("d"))
    levels = [cut(start.withColumn("dist", F.lit(0)), "level")]
    level = 0
    while most is None or level < most:
        level += 1
        step = levels[-1].join(arcs, F.col("d") == F.col("src")).select("s", F.col("dst").alias("d")).distinct()
        known = levels[-2:] if symmetric else levels  # going back both ways, a new vertex can only repeat the last two levels
        step = step.join(_together(known).select("s", "d"), ["s", "d"], "left_anti")
        new = cut(step.withColumn("dist", F.lit(level)), "level")
        if new.isEmpty():
            drop(new)
            break
        levels.append(new)
    drop(arcs)
    return _together(levels)


def _together(tables: list[DataFrame]) -> DataFrame:
    """Stored tables of one schema as one scan, so plans do not grow with them."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.path for t in tables))


def distance_counts(g: Graph, symmetric: bool = True) -> DataFrame:
    """(dist, pairs): how many ordered pairs of different vertices lie ``dist`` apart.

    Going both ways, vertices with one neighbour do not search: what is at k from it
    is at k + 1 from them.  Components of few vertices are searched in tasks
    (:mod:`pieces`); in larger ones, all vertices search at once (``_large_counts``)."""
    arcs = _simple(g)
    schema = "dist int, pairs long"
    if 0 < g.n <= small.SMALL:

        def counts_of(matrix):
            dist = small.distances(matrix | matrix.T if symmetric else matrix)
            return np.unique(dist[dist > 0], return_counts=True)

        return small.with_matrix(arcs, g.n, counts_of, schema)
    counts: dict[int, int] = {}

    def add(dist, pairs):
        if pairs:
            counts[dist] = counts.get(dist, 0) + pairs

    hang = None
    if symmetric:
        arcs, hang = _without_leaves(cut(arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "arcs"))
        total = hang.agg(F.sum("weight").alias("one"), F.sum(F.col("weight") * (F.col("weight") - 1)).alias("two")).first()
        add(1, 2 * (total.one or 0))
        add(2, total.two or 0)
    arcs = cut(arcs, "arcs")
    rows, large = pieces.split(arcs, arcs if symmetric else g.inside(), hang)
    levels = "dist long, pairs long, first long, both long"
    found = pieces.search(rows, pieces.pair_levels, levels).groupBy("dist").agg(*(F.sum(x).alias(x) for x in ("pairs", "first", "both"))).collect()  # a row a level
    if large is not None:
        found += _large_counts(large, hang, symmetric)
    for k, pairs, first, both in found:
        add(k, pairs)
        add(k + 1, 2 * first)
        add(k + 2, both)
    drop(arcs)
    return g.spark.createDataFrame(sorted(counts.items()), schema)


def _without_leaves(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``arcs`` both ways without those of vertices that have one neighbour (of two that
    have each other, the larger one), and (vertex, weight): how many of these a vertex has."""
    ends = cut(arcs.groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.max("dst").alias("up")).filter("k = 1").select(F.col("src").alias("vertex"), "up"), "ends")
    leaves = ends.join(ends.select(F.col("vertex").alias("up"), F.lit(True).alias("also")).hint("merge"), "up", "left").filter("also is null or up < vertex")
    leaves = cut(leaves.select("vertex", "up"), "leaves")
    rest = arcs
    for end in ("src", "dst"):
        rest = rest.join(leaves.select(F.col("vertex").alias(end)).hint("merge"), end, "left_anti")
    return rest.select("src", "dst"), cut(leaves.groupBy(F.col("up").alias("vertex")).agg(F.count(F.lit(1)).alias("weight")), "hang")


def _large_counts(arcs: DataFrame, hang: DataFrame | None, symmetric: bool) -> list[tuple[int, int, int, int]]:
    """(dist, pairs, first, both) as :func:`pieces.pair_levels` has them.

    All vertices of ``arcs`` search at once, 64 to a word: a vertex holds a mask of those that
    reached it, a level sends the new masks along the arcs and merges them by
    bit_or, and popcounts are summed.  No pair ever is a row: n * n / 64 masks at most.
    Going both ways, what is not new was reached in the last two levels, so nothing
    else is read; along the arcs, the masks reached so far are kept."""
    start = arcs.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct().select("vertex", F.expr("vertex div 64").alias("word"), F.expr("shiftleft(1L, cast(vertex % 64 as int))").alias("mask"))
    arcs = bucketed(arcs, "src", "arcs")
    last = cut(start, "masks")
    known, counts = [last], []  # what new masks may repeat
    while True:
        got = last.join(arcs.hint("merge"), F.col("vertex") == F.col("src")).groupBy(F.col("dst").alias("vertex"), "word").agg(F.bit_or("mask").alias("mask"))
        new = F.col("mask")
        for i, old in enumerate(known):
            got = got.join(old.withColumnRenamed("mask", f"old_{i}").hint("merge"), ["vertex", "word"], "left")
            new = new.bitwiseAND(F.bitwise_not(F.coalesce(f"old_{i}", F.lit(0))))
        fresh = cut(got.select("vertex", "word", new.alias("mask")).filter("mask <> 0"), "masks")
        found = fresh.agg(F.sum(F.bit_count("mask"))).first()[0]
        if not found:
            break
        counts.append((len(counts) + 1, found, *_hanging(fresh, hang)))
        keep = [fresh, last] if symmetric else [cut(known[0].unionByName(fresh).groupBy("vertex", "word").agg(F.bit_or("mask").alias("mask")), "masks")]
        for t in {t.path: t for t in (*known, last)}.values():
            if t.path not in (x.path for x in (fresh, *keep)):
                drop(t)
        last, known = fresh, keep
    for t in {t.path: t for t in (arcs, last, fresh, *known)}.values():
        drop(t)
    return counts


def _hanging(masks: DataFrame, hang: DataFrame | None) -> tuple[int, int]:
    """Over the pairs that ``masks`` hold, the sums of a vertex's weight and of both
    weights multiplied."""
    if hang is None:
        return 0, 0
    bits = hang.select(F.expr("vertex div 64").alias("word"), (F.col("vertex") % 64).cast("int").alias("bit"), F.col("weight").alias("w"))
    words = bits.groupBy("word").agg(F.collect_list(F.struct("bit", "w")).alias("loads"))  # 64 at most
    own = masks.join(hang.hint("merge"), "vertex").join(words.hint("merge"), "word", "left")
    there = F.aggregate(F.coalesce("loads", F.array().cast("array<struct<bit:int,w:bigint>>")), F.lit(0).cast("long"), lambda t, x: t + x["w"] * F.getbit("mask", x["bit"]))
    sums = own.agg(F.sum(F.col("weight") * F.bit_count("mask")), F.sum(F.col("weight") * there)).first()
    return sums[0] or 0, sums[1] or 0


def average_path_length(g: Graph, normalize: str = "half") -> DataFrame:
    """One row: apl, reachable_pairs, vertices.  Arcs count both ways.

    ``half``: the sum over ordered pairs, and 1 for each vertex with a self
    loop, by n (n - 1) / 2, which is twice the mean; ``pairs``: the mean over
    ordered pairs.  NULL if some pair is not connected or n < 2."""
    if normalize not in ("half", "pairs"):
        raise ValueError("normalize is half or pairs")
    n = g.n
    sums = distance_counts(g).agg(F.coalesce(F.sum(F.col("dist") * F.col("pairs")), F.lit(0)).alias("total"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("reachable_pairs"))
    loops = g.inside().filter("src = dst").agg(F.count_distinct("src").alias("loops")).scalar()
    pairs = n * (n - 1)
    total = F.col("total") + (loops if normalize == "half" else F.lit(0))
    apl = F.when((F.col("reachable_pairs") == pairs) & F.lit(n > 1), total / F.lit(max(pairs, 1) / (2.0 if normalize == "half" else 1.0)))
    return sums.select(apl.alias("apl"), "reachable_pairs", F.lit(n).cast("long").alias("vertices"))


def ball_limit(g: Graph) -> DataFrame:
    """What :func:`hyper_ball` estimates, exactly: over vertices, the mean of the
    sum of (distance - 1) along out-arcs."""
    total = distance_counts(g, symmetric=False).agg(F.sum((F.col("dist") - 1) * F.col("pairs")).alias("t"))
    return total.select((F.coalesce("t", F.lit(0)) / F.lit(float(g.n) if g.n else None)).alias("ball_limit"))


def _one_hot(ids: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Registers of sketches that hold one id each, a byte a register."""
    hashed = hashing.integer_hash(ids, seed)
    out = np.zeros((len(ids), 1 << b), np.uint8)
    out[np.arange(len(ids)), (hashed & np.uint64((1 << b) - 1)).astype(int)] = hashing.trailing_zeros(hashed >> np.uint64(b)) + 1
    return out


def _ball_steps(edges: DataFrame, b: int, seed: int):
    """Sketches (key, regs) of the out-reach of all ends of ``edges`` as arrays: the tables that
    together, by maximum, hold them, and the growth of the summed estimates by
    round.  A round sends the arrays of vertices that changed against the arcs,
    and writes those that change by them, with what their estimates gain."""
    width = 1 << b

    def start(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), registers.packed_rows(_one_hot(batch.column(0).to_numpy(), b, seed))], ["key", "regs"])

    def changes(batches):
        for batch in batches:
            own, new = registers.rows_of(batch.column(1), width), registers.rows_of(batch.column(2), width)
            all_ = np.maximum(own, new)
            grown = (all_ != own).any(1)
            if grown.any():
                gain = sketch.estimate_dense(all_[grown], b) - sketch.estimate_dense(own[grown], b)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(grown)), registers.packed_rows(all_[grown]), pa.array(gain)], ["key", "regs", "gain"])

    arcs = bucketed(edges.select("src", "dst"), "dst", "arcs")
    state = [cut(edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().mapInArrow(start, "key long, regs binary"), "regs")]
    changed, gains = state[0], []
    while True:
        sent = registers.merged(changed.join(arcs.hint("merge"), F.col("key") == F.col("dst")).select(F.col("src").alias("key"), "regs"), 1 << b)
        sent = cut(sent.withColumnRenamed("regs", "new"), "sent")
        own = _together(state).select("key", "regs").join(sent.select("key").hint("merge"), "key", "left_semi")
        if len(state) > 1:
            own = registers.merged(own, 1 << b)
        delta = cut(own.join(sent.hint("merge"), "key").select("key", "regs", "new").mapInArrow(changes, "key long, regs binary, gain double"), "regs")
        drop(sent)
        gain = delta.agg(F.sum("gain")).first()[0]
        if gain is None:
            drop(delta)
            break
        gains.append(gain)
        delta = _with_path(delta.select("key", "regs"), delta.path)
        state.append(delta)
        changed = delta
        if len(state) > _DELTAS:
            whole = cut(registers.merged(_together(state), 1 << b), "regs")
            for t in state[:-1]:
                drop(t)
            state = [whole, state[-1]]
    drop(arcs)
    return state, gains


def _with_path(df: DataFrame, path: str) -> DataFrame:
    df.path = path
    return df


#: Tables of changes that are kept beside the whole one before all are merged.
_DELTAS = 6


def reach_registers(g: Graph, b: int = 4, seed: int = 0) -> DataFrame:
    """Registers (key, idx, val) of every vertex's out-reach at the fixpoint.

    Few vertices: one task.  Else components of few are searched in tasks, and larger
    ones by an array of registers a vertex, in rounds."""
    if 0 < g.n <= small.SMALL:
        return small.with_matrix(_simple(g), g.n, lambda m: _last_registers(m, b, seed), "key long, idx int, val int")
    width, schema = 1 << b, "key long, idx int, val int"
    arcs = cut(_simple(g), "arcs")
    rows, large = pieces.split(arcs, g.inside(), g.vertices.withColumn("weight", F.lit(0)))

    def last(*piece):
        for vertex, registers, _ in _piece_growth(b, seed, *piece):  # noqa: B007
            pass
        at, idx = np.nonzero(registers)
        yield vertex[at], idx.astype(np.int32), registers[at, idx].astype(np.int32)

    found = pieces.search(rows, last, schema, pieces.ROWS >> max(0, b - 6))
    if large is None:
        return found
    state, _ = _ball_steps(large, b, seed)

    def run(batches):
        for batch in batches:
            rows = registers.rows_of(batch.column(1), width)
            at, idx = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[at]), pa.array(idx.astype(np.int32)), pa.array(rows[at, idx].astype(np.int32))], ["key", "idx", "val"])

    return found.unionByName(registers.merged(_together(state), 1 << b).mapInArrow(run, schema))


def _piece_growth(b: int, seed: int, piece: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
    """Vertices of whole pieces with their registers before and after each round that
    changes some, and what their estimates gain by it."""
    arc = dst >= 0
    vertex = np.unique(np.concatenate([src, dst[arc]]))
    u, v = np.searchsorted(vertex, src[arc]), np.searchsorted(vertex, dst[arc])
    u, v = (x[np.argsort(u, kind="stable")] for x in (u, v))
    registers, changed = _one_hot(vertex, b, seed), np.ones(len(vertex), bool)
    yield vertex, registers, 0.0
    while True:
        live = changed[v]
        at, to = u[live], v[live]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        if not len(first):
            return
        own = registers[at[first]]
        new = np.maximum(own, np.maximum.reduceat(registers[to], first))
        grown = (new != own).any(1)
        if not grown.any():
            return
        changed = np.zeros(len(vertex), bool)
        changed[at[first[grown]]] = True
        registers[at[first[grown]]] = new[grown]
        yield vertex, registers, float((sketch.estimate_dense(new[grown], b) - sketch.estimate_dense(own[grown], b)).sum())


def hyper_ball(g: Graph, b: int = 4, seed: int = 0, textbook: bool = False) -> DataFrame:
    """One row: hyper_ball, rounds.

    Default: each round t = 0, 1, .. adds t times the growth of a vertex's
    estimated ball, and the mean is over vertices.  ``textbook``: weights t + 1,
    and the mean is over the estimated reachable pairs."""
    if 0 < g.n <= small.SMALL:
        return small.with_matrix(_simple(g), g.n, lambda m: _ball_rounds(m, b, seed, textbook), "hyper_ball double, rounds int")
    arcs = cut(_simple(g), "arcs")
    rows, large = pieces.split(arcs, g.inside())

    def gain(*piece):
        own = [x for _, _, x in _piece_growth(b, seed, *piece)][1:]
        yield np.arange(len(own)), np.array(own, np.float64)

    found = pieces.search(rows, gain, "round long, gain double", pieces.ROWS >> max(0, b - 6)).groupBy("round").agg(F.sum("gain").alias("gain")).orderBy("round").collect()  # a row a round
    gains = [r.gain for r in found]
    drop(arcs)
    if large is not None:
        state, more = _ball_steps(large, b, seed)
        for t in state:
            drop(t)
        gains = [x + y for x, y in itertools.zip_longest(gains, more, fillvalue=0.0)]
    total = sum((t + 1 if textbook else t) * x for t, x in enumerate(gains))
    by = sum(gains) if textbook else g.n
    return g.spark.createDataFrame([(float(total / by) if by else None, len(gains) + 1)], "hyper_ball double, rounds int")


def _growth(matrix: np.ndarray, b: int, seed: int):
    """Registers of all vertices as a dense array, before and after each round
    that changes something."""
    n = len(matrix)
    registers = _one_hot(np.arange(n), b, seed)
    src, dst = np.nonzero(matrix)
    first = np.flatnonzero(np.diff(src, prepend=-1))
    yield registers
    while len(src):
        new = registers.copy()
        new[src[first]] = np.maximum(new[src[first]], np.maximum.reduceat(registers[dst], first))
        if (new == registers).all():
            return
        registers = new
        yield registers


def _last_registers(matrix: np.ndarray, b: int, seed: int):
    for registers in _growth(matrix, b, seed):  # noqa: B007
        pass
    key, idx = np.nonzero(registers)
    return key, idx.astype(np.int32), registers[key, idx].astype(np.int32)


def _ball_rounds(matrix: np.ndarray, b: int, seed: int, textbook: bool):
    sizes = [sketch.estimate_dense(r, b).sum() for r in _growth(matrix, b, seed)]
    rows = np.diff(sizes).tolist()
    total = sum((t + 1 if textbook else t) * x for t, x in enumerate(rows))
    by = sum(rows) if textbook else len(matrix)
    return [total / by if by else None], [np.int32(len(rows) + 1)]
