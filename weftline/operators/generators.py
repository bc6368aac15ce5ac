"""Random graphs from explicit seeds, made in parallel without a shuffle."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import COUNTS, Graph, arc_counts, tally


#: Arcs that a task makes at least, sources it has at most (Parquet's dictionary of 1 MB holds
#: these), stretches of targets at most, and arcs that a task draws at a time.
TASK_ARCS, SOURCES, STRETCHES, DRAWN = 1 << 22, 1 << 17, 4096, 1 << 17
#: Cells (what a task makes as rows) that one task counts at most, and arcs of a block from which
#: they are drawn by gaps.
TOGETHER, SPACED = 32, 1 << 12
#: Bytes of an array that is made and freed first: from then on the C library keeps the memory
#: of smaller ones, instead of asking the system for it again with each.
KEPT = 30 << 20


def _dealt(free: np.ndarray, m: int, rng) -> np.ndarray:
    """How many of ``m`` different places, any as likely as others, lie in each of
    several stretches of ``free`` places.  Stretches draw for themselves; what is
    too much or too little in all is taken from, or given to, places at random."""
    if not m:
        return np.zeros(len(free), np.int64)
    counts = rng.binomial(free, m / int(free.sum()))
    spare = int(counts.sum()) - m
    ends = np.cumsum(counts if spare > 0 else free - counts)
    moved = rng.choice(int(ends[-1]), abs(spare), replace=False, shuffle=False) if spare else np.zeros(0, np.int64)
    return counts - np.sign(spare) * np.bincount(np.searchsorted(ends, moved, side="right"), minlength=len(free))


@functools.lru_cache(maxsize=64)
def _gaps(q: float):
    """Gaps between places that are taken with a probability of ``q`` each: a table of 65,536
    gaps to pick from, how often the gap is of the rest instead, and the rest: the summed
    shares of gaps 1, 2, ... that the table leaves out."""
    share = q * (1 - q) ** np.arange(int(45 / q))  # less than 2^-64 is longer
    scale = 1.0
    while (whole := (65536 * scale * share).astype(np.int64)).sum() < 65536:
        scale *= 1.0005
    table = np.repeat(np.arange(1, len(share) + 1, dtype=np.uint16), whole)[:65536]
    rest = np.cumsum(np.maximum(share - np.bincount(table, minlength=len(share) + 1)[1:] / 65536 / scale, 0))
    return table, 1 - 1 / scale, rest / rest[-1]


def _spaced(size: int, barred: np.ndarray, k: int, rng) -> np.ndarray:
    """:func:`_chosen` where that is one of 1,024 places to one of two: gaps are drawn, so
    places come in order, some too many, which are dropped at random; if too few come,
    all are drawn again."""
    q = 2 ** (math.ceil(64 * math.log2((k + 4 * k**0.5) / (size - len(barred)))) / 64)  # few different ones
    table, rare, rest = _gaps(q)
    most = int(size * q + 4 * (size * q) ** 0.5)
    while True:
        gaps = table.take(rng.bit_generator.random_raw(-(-most // 4)).view(np.uint16)[:most])
        at = np.cumsum(rng.geometric(rare, int(most * rare + 9 * (most * rare) ** 0.5) + 40)) - 1
        at = at[: at.searchsorted(most)]
        gaps[at] = rest.searchsorted(rng.random(len(at)), side="right") + 1
        gaps[0] -= 1
        found = np.cumsum(gaps, dtype=np.int32)
        if found[-1] < size:
            continue
        found = found[: found.searchsorted(np.int32(size))]
        kept = np.ones(len(found), bool)
        if len(barred):
            kept[np.isin(found, barred)] = False
        if np.count_nonzero(kept) >= k:
            while more := np.count_nonzero(kept) - k:
                kept[rng.integers(len(found), size=more)] = False
            return found[kept]


def _chosen(size: int, barred: np.ndarray, k: int, rng) -> np.ndarray:
    """``k`` different ones of 0 .. size - 1 in order, none of the ``barred``, any as
    likely as others: what was drawn before is drawn again."""
    if k >= SPACED and size < 1 << 30 and size < 1024 * k and 2 * k < size - len(barred):
        return _spaced(size, barred, k, rng)
    if 16 * k < size:
        found = np.zeros(0, np.int64)
        while len(found) < k:
            new = np.sort(rng.integers(size, size=k - len(found)))
            at = np.searchsorted(found, new) if len(found) else np.zeros_like(new)
            fresh = np.concatenate([[True], new[1:] != new[:-1]])
            if len(found):
                fresh &= found[np.minimum(at, len(found) - 1)] != new
            if len(barred):
                fresh &= ~np.isin(new, barred)
            found = np.insert(found, at[fresh], new[fresh]) if len(found) else new[fresh]
        return found
    out = 2 * k > size - len(barred)  # fewer are left out than taken
    marked, most = np.zeros(size, bool), size - len(barred) - k if out else k
    marked[barred] = True
    while more := most + len(barred) - np.count_nonzero(marked):
        marked[rng.integers(size, size=more)] = True
    marked[barred] = out
    return np.flatnonzero(marked != out)


def _arcs_into(n: int, first: int, past: int, m: int, seed: list[int], least: int = 0):
    """``m`` different arcs from vertices least .. n - 1 to first .. past - 1, none a loop,
    in order, as (src, dst) of some sources at a time."""
    rng, width = np.random.default_rng(seed), past - first
    rows = max(1, min(n - least, DRAWN * (n - least) // max(m, 1)))
    begin = np.arange(least, n, rows)
    end = np.minimum(begin + rows, n)
    low, high = np.maximum(begin, first), np.minimum(end, past)  # sources that are targets, too
    counts = _dealt((end - begin) * width - np.maximum(high - low, 0), m, rng)
    for i in np.flatnonzero(counts).tolist():
        own = np.arange(low[i], max(low[i], high[i]))
        at = _chosen(int(end[i] - begin[i]) * width, (own - begin[i]) * width + own - first, int(counts[i]), rng)
        at = at if n < 1 << 31 else at.astype(np.int64, copy=False)
        src = at // width
        at -= src * width
        src += int(begin[i])
        at += first
        yield src, at


def _made(spark: SparkSession, n: int, m: int, seed: int, count: bool = False) -> DataFrame:
    """The arcs of :func:`gnm`, or with ``count`` their :func:`tally`, cell by cell."""
    if m > n * (n - 1):
        raise ValueError(f"{m} arcs do not fit {n} vertices")
    parts = -(-n // SOURCES)
    stretches = min(STRETCHES, n, -(-m // (TASK_ARCS * max(parts, 1))))
    cells = parts * stretches  # each the arcs of some sources to some targets
    sources, targets = (np.array([n * t // max(k, 1) for t in range(k + 1)], np.int64) for k in (parts, stretches))
    least, past = (np.repeat(x, stretches) for x in (sources[:-1], sources[1:]))
    low, high = (np.tile(x, parts) for x in (targets[:-1], targets[1:]))
    loops = np.maximum(np.minimum(past, high) - np.maximum(least, low), 0)
    counts = _dealt((past - least) * (high - low) - loops, m, np.random.default_rng(seed))

    def run(batches):
        np.empty(KEPT, np.uint8)  # freed at once
        for batch in batches:
            for t in batch.column("id").to_pylist():
                i, j = divmod(t, stretches)
                arcs = _arcs_into(int(sources[i + 1]), int(targets[j]), int(targets[j + 1]), int(counts[t]), [seed, t], int(sources[i]))
                if count:
                    yield tally(n, arcs)
                    continue
                for src, dst in arcs:
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in (src, dst)], ["src", "dst"])

    tasks = max(-(-cells // TOGETHER), min(cells, 4 * spark.sparkContext.defaultParallelism)) if count else cells
    return spark.range(0, cells, 1, max(tasks, 1)).mapInArrow(run, COUNTS if count else "src long, dst long")


def gnm(spark: SparkSession, n: int, m: int, seed: int) -> Graph:
    """m distinct ordered pairs of different vertices, any as likely as others.  A task
    makes the arcs from up to ``SOURCES`` vertices to some of the vertices, in the order of
    (src, dst): tasks have no arc in common, nothing is compared between them, and columns
    in order, of few values each, compress well."""
    return Graph(_made(spark, n, m, seed), n)


def gnm_counts(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """:func:`arc_counts` of :func:`gnm`; arcs are counted in the tasks that draw them,
    before they become rows."""
    return arc_counts(gnm(spark, n, m, seed), _made(spark, n, m, seed, count=True))


def gnp_grid(params: DataFrame) -> DataFrame:
    """``params`` (graph, n, p, seed) -> (graph, n, src, dst): many small graphs as
    :func:`gnp` makes them in one task, one a row, in one job."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n, seed = int(r.n), int(r.seed)
                for src, dst in _arcs_into(n, 0, n, _arcs(n, r.p, seed), [seed, 0]):
                    yield pd.DataFrame({"graph": r.graph, "n": n, "src": src, "dst": dst})

    return params.mapInPandas(run, "graph long, n long, src long, dst long")


def _arcs(n: int, p: float, seed: int) -> int:
    return int(np.random.default_rng(seed).binomial(n * (n - 1) // 2, p))


def gnp(spark: SparkSession, n: int, p: float, seed: int) -> Graph:
    """A binomial number of arcs over n (n - 1) / 2 draws, then :func:`gnm`;
    both directions of a pair may occur."""
    return gnm(spark, n, _arcs(n, p, seed), seed)


def gnp_counts(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """:func:`arc_counts` of :func:`gnp`, as in :func:`gnm_counts`."""
    return gnm_counts(spark, n, _arcs(n, p, seed), seed)


def _grow(n: int, d: int, o: int, seed: int):
    """Arcs of one preferential-attachment graph with closed triads."""
    rng = np.random.default_rng(seed)
    near: list[list[int]] = [[] for _ in range(n)]
    held: set[int] = set()
    tails: list[int] = []  # a vertex once for each of its arcs: a uniform pick is weighted by out-degree

    def add(u, w):
        near[u].append(w)
        held.add(u * n + w)
        tails.append(u)

    add(0, 1)
    yield 0, 1
    for v in range(2, n):
        for _ in range(min(v, d)):
            while True:
                u = tails[int(rng.integers(len(tails)))]
                if v * n + u not in held:
                    break
            add(v, u)
            yield v, u
        own = near[v][:]
        for _ in range(o):
            own = near[v]
            a = int(rng.integers(len(own)))
            b = (a + 1 + int(rng.integers(len(own) - 1))) % len(own)
            if own[a] * n + own[b] not in held:
                add(own[a], own[b])
                yield own[a], own[b]


def clustered_grid(params: DataFrame) -> DataFrame:
    """``params`` (graph, n, d, o, seed) -> (graph, src, dst): a graph a row, each
    grown in one task (growth is sequential), graphs in parallel.  Graphs of more than
    ``TURN_MOST`` vertices are grown by many tasks (:func:`attached_grid`)."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if r.n <= 2 or r.d <= 1:
                    raise ValueError("n must exceed 2 and d 1")
                arcs = np.array(list(_grow(int(r.n), int(r.d), int(r.o), int(r.seed))), np.int64)
                yield pd.DataFrame({"graph": r.graph, "src": arcs[:, 0], "dst": arcs[:, 1]})

    in_turn = params.filter(F.col("n") <= TURN_MOST).mapInPandas(run, "graph long, src long, dst long")
    large = params.filter(F.col("n") > TURN_MOST)
    return in_turn if large.isEmpty() else in_turn.unionByName(attached_grid(large))


#: Vertices of a graph that one task grows in turn: what it holds and takes is bounded.
TURN_MOST = 20_000
#: Vertices that grow in turn before the others follow from hashes.
_IN_TURN = 512
#: Vertices whose arcs one row of work makes.
_BLOCK = 8192


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """63 hashed bits of whole numbers."""
    x = np.uint64(0)
    for p in parts:
        x = (x ^ np.asarray(p, np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(1)).view(np.int64)


def _attach(first: int, past: int, d: int, o: int, seed: int, tails: np.ndarray, start: int):
    """Arcs of vertices first .. past - 1.  Arcs have places: those grown in turn
    (``tails`` are their sources), then d of its own and o of its triads for each
    vertex from ``start`` on.  An arc goes to the source of an arc at a hashed
    earlier place.  That is known for a vertex's own arcs, and a triad's is the target
    of one of them, so references are followed back until one is known."""

    def reference(place, attempt):
        return _mixed(np.full_like(place, seed), place, np.full_like(place, attempt)) % place

    def source(place):
        place, found = place.copy(), np.full(place.shape, -1)
        live = np.flatnonzero(found < 0)
        while len(live):
            at = place[live]
            vertex, i = (at - len(tails)) // (d + o) + start, (at - len(tails)) % (d + o)
            early, own = at < len(tails), (at >= len(tails)) & (i < d)
            found[live[early]], found[live[own]] = tails[at[early]], vertex[own]
            triad = ~(early | own)
            live, at, i = live[triad], at[triad], i[triad]
            place[live] = reference(at - i + _mixed(np.full_like(at, seed), at, np.full_like(at, -1)) % d, 0)
        return found

    v = np.arange(first, past)
    place = len(tails) + (v - start)[:, None] * (d + o) + np.arange(d)
    target = source(reference(place.ravel(), 0)).reshape(place.shape)
    earlier = np.tri(d, k=-1, dtype=bool)
    for attempt in range(1, 1000):
        again = ((target[:, :, None] == target[:, None, :]) & earlier).any(2)
        if not again.any():
            break
        target[again] = source(reference(place[again], attempt))
    else:
        raise RuntimeError("targets did not become distinct")
    triads = place[:, :1] + d + np.arange(o)
    a = _mixed(np.full_like(triads, seed), triads, np.full_like(triads, -1)) % d
    b = (a + 1 + _mixed(np.full_like(triads, seed), triads, np.full_like(triads, -2)) % (d - 1)) % d
    row = np.arange(len(v))[:, None]
    src = np.concatenate([np.repeat(v, d), target[row, a].ravel()])
    return src, np.concatenate([target.ravel(), target[row, b].ravel()])


def attached_grid(params: DataFrame) -> DataFrame:
    """``params`` (graph, n, d, o, seed) -> (graph, src, dst), each graph grown by many
    tasks: preferential attachment by out-degree with closed triads, like
    :func:`clustered_grid` with two small differences.  When later arcs are drawn, a triad
    that repeats an arc still counts, and of an arc that was drawn again the first draw
    does.  Arcs move once, to their source, and repeated ones go there."""
    block = _BLOCK

    def run(batches):
        grown: dict = {}
        for pdf in batches:
            for r in pdf.itertuples():
                n, d, o, seed = int(r.n), int(r.d), int(r.o), int(r.seed)
                if n <= 2 or d <= 1:
                    raise ValueError("n must exceed 2 and d 1")
                start = min(n, max(_IN_TURN, 4 * d))
                if (d, o, seed, start) not in grown:
                    grown.clear()
                    grown[d, o, seed, start] = np.array(list(_grow(start, d, o, seed)), np.int64)
                early = grown[d, o, seed, start]
                if r.first == 0:
                    yield pd.DataFrame({"graph": r.graph, "src": early[:, 0], "dst": early[:, 1]})
                first, past = max(start, int(r.first)), min(n, int(r.first) + block)
                if first < past:
                    src, dst = _attach(first, past, d, o, seed, early[:, 0], start)
                    yield pd.DataFrame({"graph": r.graph, "src": src, "dst": dst})

    rows = params.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("first"))
    return rows.repartition("graph", "first").mapInPandas(run, "graph long, src long, dst long").repartition("src").distinct()


def attached(spark: SparkSession, n: int, d: int, o: int, seed: int) -> Graph:
    return Graph(attached_grid(spark.createDataFrame([(0, n, d, o, seed)], "graph long, n long, d long, o long, seed long")).select("src", "dst"), n)


def clustered(spark: SparkSession, n: int, d: int, o: int, seed: int) -> Graph:
    return Graph(clustered_grid(spark.createDataFrame([(0, n, d, o, seed)], "graph long, n long, d long, o long, seed long")).select("src", "dst"), n)
