"""Global minimum cut by randomised contraction.

Arcs count both ways; parallel ones become one with a weight, and contraction
takes arcs in the order of exponential clocks with that rate, which is a random
order of all parallel arcs.  A trial is a recursion that branches twice, in one
task; trials are the parallel axis.

Up to ``CORE`` vertices trials start from the graph itself.  Beyond that the graph
first loses what no smallest cut can need:

* Sparse certificate (``sparser``).  A scan in maximum adjacency order deals the
  arcs of a part to forests, each maximal in what the earlier ones leave.  Weight
  beyond forest ``size + 1``, where ``size`` is the smallest cut known (at first
  the least weighted degree), is dropped: cuts of up to ``size`` keep all their
  arcs and others stay larger.  Ends of an arc beyond forest ``size`` are joined: more
  than ``size`` arcs would have to go to part them.  Parts are dealt by hash and
  scanned in a task each, as certificates of parts make one of the whole.  Where they
  take little off, arcs with half the weight at one of their ends are joined (``_half_held``),
  as in the kernel.
* Kernel (``kernel``).  Once ``TASK_ARCS`` arcs are left, scans go on in one task;
  where no arc lies beyond the forests any more but more than ``CORE`` sets are
  left, ends that ``size`` arcs at least hold together are joined, too, and ends
  of an arc with half the weight at one of them.  Every cut smaller than the
  smallest known one stays, so nothing is lost to chance up to here.

If ``TASK_ARCS`` are not reached by the certificate and vertices have ``DENSE``
neighbours on average, a trial's two branches first let every vertex pick one of its arcs by
weight and join what is picked (``picked_out``): that leaves half the sets at most, few in
graphs without parts, and keeps a smallest cut that is no degree with a probability of at
least 1/16, for its arcs are at most half of each vertex's and twice the least degree in all.

Where arcs still do not fit, the recursion itself is laid
out as data: each node (trial and branches taken) of a level becomes two, and all
nodes of a level contract their own random arcs to 1 / sqrt 2 of their sets in
the same jobs, until every node fits a task.  Jobs grow with the depth only.

Guarantee: the smallest cut known is exact if it is a degree, a prefix of a scan or
kept by the kernel and found by a trial; a trial finds a smallest cut of its kernel with a
probability of at least one in about log2 of its sets.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, drop
from .components import components, stars
from .disjoint_set import DisjointSet
from .graph import Graph

#: Vertices up to which trials start from the graph itself.
CORE = 64
#: Arcs that one task takes.
TASK_ARCS = 200_000
#: Neighbours a vertex from which trials start by picks, and trials whose picks one job makes.
DENSE, PICKS = 16, 16
#: Contraction to two sets outright below this many.
SMALL = 6


def default_trials(n: int) -> int:
    return math.ceil(math.log2(max(n, 2))) ** 2 + 2


def low_ones_trials(n: int) -> int:
    """The count that follows the trailing one bits of n: L * L + 2."""
    ones = 0
    while n >> ones & 1:
        ones += 1
    return ones * ones + 2


def contract(sets: DisjointSet, arcs: np.ndarray, target: int, rng) -> np.ndarray:
    """Join ends of arcs (u, v, weight) in random order until ``target`` sets are
    left; gives the arcs that still cross, one between any two sets."""
    for i in np.argsort(rng.standard_exponential(len(arcs)) / arcs[:, 2]).tolist():
        if sets.components <= target:
            break
        sets.union(int(arcs[i, 0]), int(arcs[i, 1]))
    ends = np.sort(np.array(sets.labels())[arcs[:, :2]], axis=1)
    cross = ends[:, 0] != ends[:, 1]
    key, of = np.unique(ends[cross, 0] * len(sets.parent) + ends[cross, 1], return_inverse=True)
    return np.column_stack([key // len(sets.parent), key % len(sets.parent), np.bincount(of, arcs[cross, 2], len(key)).astype(np.int64)])


def smallest_cut(sets: DisjointSet, arcs: np.ndarray, rng) -> tuple[int, np.ndarray]:
    """Weight and one side of the smaller cut of two recursive branches; the second
    wins a tie.  Branches work on copies, or on the one structure if it can undo."""
    if sets.components < SMALL:
        left = contract(sets, arcs, 2, rng)
        root = np.array(sets.labels())
        return int(left[:, 2].sum()), root == root[0]
    target = 1 + int(sets.components / math.sqrt(2))
    best = None
    for _ in range(2):
        own, state = (sets, sets.save()) if sets.log is not None else (sets.copy(), None)
        found = smallest_cut(own, contract(own, arcs, target, rng), rng)
        if state is not None:
            sets.restore(state)
        best = found if best is None or found[0] <= best[0] else best
    return best


def _pairs(g: Graph) -> DataFrame:
    """(u, v, w): pairs of different vertices u < v and their number of arcs."""
    ends = g.inside().filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return ends.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w"))


def scan(n: int, arcs: np.ndarray) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
    """Maximum adjacency order of arcs (u, v, weight) over 0 .. n - 1.

    For every arc, the forest that its last unit of weight falls into: the weight
    between its later end and all vertices taken up to its earlier end, which its
    ends hold together by at least.  And the smallest cut between a first part
    of the order and the rest, with that part."""
    begin = np.concatenate([arcs[:, 0], arcs[:, 1]])
    order = np.argsort(begin, kind="stable")
    at = np.searchsorted(begin[order], np.arange(n + 1)).tolist()
    other, weight, arc = (np.concatenate([a, b])[order].tolist() for a, b in ((arcs[:, 1], arcs[:, 0]), (arcs[:, 2],) * 2, (np.arange(len(arcs)),) * 2))
    held, taken, forest = [0] * n, [False] * n, [0] * len(arcs)
    degree = np.bincount(begin, np.concatenate([arcs[:, 2]] * 2), n).astype(np.int64).tolist()
    sequence, crossing, best, ends = [], 0, None, 0
    for start in range(n):
        heap = [] if taken[start] else [(0, start)]
        while heap:
            u = heapq.heappop(heap)[1]
            if taken[u]:
                continue
            taken[u] = True
            sequence.append(u)
            crossing += degree[u] - 2 * held[u]
            if len(sequence) < n and (best is None or crossing < best):
                best, ends = crossing, len(sequence)
            for i in range(at[u], at[u + 1]):
                v = other[i]
                if not taken[v]:
                    held[v] += weight[i]
                    forest[arc[i]] = held[v]
                    heapq.heappush(heap, (-held[v], v))
    return np.array(forest, np.int64), (best, np.array(sequence[:ends], np.int64))


def _joined(n: int, arcs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each vertex's set once all ``ends`` (u, v) are joined, the arcs
    between sets, and how many sets there are."""
    sets = DisjointSet(n)
    for u, v in ends.tolist():
        sets.union(u, v)
    _, number = np.unique(np.array(sets.labels()), return_inverse=True)
    pairs = np.sort(number[arcs[:, :2]], axis=1)
    cross = pairs[:, 0] != pairs[:, 1]
    key, of = np.unique(pairs[cross, 0] * n + pairs[cross, 1], return_inverse=True)
    return number, np.column_stack([key // n, key % n, np.bincount(of, arcs[cross, 2], len(key)).astype(np.int64)]), sets.components


def _halves(n: int, arcs: np.ndarray) -> np.ndarray:
    """Arcs of at least half the weight at one end, no two at one vertex.  Moving
    that end over makes no cut larger, its own degree aside."""
    degree = np.bincount(arcs[:, :2].ravel(), np.repeat(arcs[:, 2], 2), n)
    free, out = [True] * n, []
    for u, v in arcs[2 * arcs[:, 2] >= np.minimum(degree[arcs[:, 0]], degree[arcs[:, 1]]), :2].tolist():
        if free[u] and free[v]:
            free[u] = free[v] = False
            out.append((u, v))
    return np.array(out, np.int64).reshape(-1, 2)


def kernel(n: int, arcs: np.ndarray, size: int, core: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray | None]:
    """Join what no cut smaller than the smallest known one parts.

    Gives each vertex's set, the arcs between sets, the smallest cut known and, if
    that is smaller than ``size``, one side of it.  As long as ``core`` sets or fewer
    are left, every cut of the smallest size is kept; otherwise every smaller one."""
    label, side, strict = np.arange(n), None, True
    count = n
    while len(arcs):
        forest, (crossing, first) = scan(count, arcs)
        degree = np.bincount(arcs[:, :2].ravel(), np.repeat(arcs[:, 2], 2), count).astype(np.int64)
        for found, own in ((int(degree.min()), np.array([degree.argmin()])), (crossing, first)):
            if found is not None and found < size:
                size, side = found, np.isin(label, own)
        before = count
        number, arcs, count = _joined(count, arcs, arcs[forest > size if strict else forest >= size, :2])
        label = number[label]
        if not strict and count > core:
            degree = np.bincount(arcs[:, :2].ravel(), np.repeat(arcs[:, 2], 2), count).astype(np.int64)
            if len(arcs) and degree.min() < size:
                size, side = int(degree.min()), label == degree.argmin()
            number, arcs, count = _joined(count, arcs, _halves(count, arcs))
            label = number[label]
        if count <= core and (not strict or count == before):
            break
        strict = strict and count < before
    return label, arcs, size, side


def least_cut(n: int, arcs: np.ndarray, trials: int, seed: int, strategy: str = "copy", find_mode: str = "halving") -> int:
    """The size of the smallest cut that ``trials`` find in a connected graph of arcs
    (u, v, weight), on the way of :func:`min_cut`, in the task that calls it."""
    size = int(np.bincount(arcs[:, :2].ravel(), np.repeat(arcs[:, 2], 2), n).min())
    if n > CORE:
        label, arcs, size, _ = kernel(n, arcs, size, CORE)
        n = int(label.max()) + 1
    tries = range(trials) if n > 1 else ()
    return min([size, *(smallest_cut(DisjointSet(n, find_mode, undo=strategy == "undo"), arcs, np.random.default_rng([seed, t]))[0] for t in tries)])


def _numbered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Names of the ends u, v in order, and arcs (u, v, weight) by number, sorted."""
    names, ends = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
    arcs = np.column_stack([ends.reshape(-1, 2), pdf["w"].to_numpy()])
    return names, arcs[np.lexsort((arcs[:, 1], arcs[:, 0]))]


def _search(seed: int, strategy: str, find_mode: str, size: int | None = None, core: int = CORE):
    """One node's arcs (node, u, v, w) -> node, cut_size, side (ids of sets).  With
    ``size``, through the node's kernel first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["node"].iloc[0])
        names, arcs = _numbered(pdf)
        label, known = np.arange(len(names)), None
        if size is not None and len(names) > core:
            label, arcs, least, side = kernel(len(names), arcs, size, core)
            known = None if side is None else (least, side)
        count = int(label.max()) + 1
        found, mask = smallest_cut(DisjointSet(count, find_mode, undo=strategy == "undo"), arcs, np.random.default_rng([seed, node])) if count > 1 else (None, None)
        if known is not None and (found is None or known[0] < found):
            found, side = known
        elif found is not None:
            side = mask[label]
        else:
            found, side = np.iinfo(np.int64).max, np.zeros(len(names), bool)
        return pd.DataFrame({"node": [node], "cut_size": [found], "side": [names[side].tolist()]})

    return run


_FOUND = "node long, cut_size long, side array<long>"


def _merged(arcs: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """``arcs`` between the sets that ``moves`` (.., old, new) put their ends into."""
    u, v = (moves.select(*by, F.col("old").alias(x), F.col("new").alias(f"new_{x}")) for x in "uv")
    ends = arcs.join(u.hint("merge"), [*by, "u"], "left").join(v.hint("merge"), [*by, "v"], "left").select(*by, F.coalesce("new_u", "u").alias("a"), F.coalesce("new_v", "v").alias("b"), "w")
    return ends.filter("a <> b").groupBy(*by, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w"))


def _connected(g: Graph, pairs: DataFrame) -> bool:
    """Whether all vertices are; in one task where the pairs fit it."""
    if pairs.count() > TASK_ARCS:
        near = pairs.select("u", "v").repartitionByRange("u")  # what a task joins before the first round
        return stars(near).agg(F.count(F.lit(1)), F.count_distinct("component")).first() == (g.n - 1, 1)
    n = g.n

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, arcs = _numbered(pdf)
        sets = DisjointSet(len(names))
        for u, v in arcs[:, :2].tolist():
            sets.union(u, v)
        return pd.DataFrame({"whole": [len(names) == n and sets.components == 1]})

    return any(r.whole for r in pairs.groupBy().applyInPandas(run, "whole boolean").collect())


def _least_degree(pairs: DataFrame):
    ends = pairs.select(F.explode(F.array("u", "v")).alias("vertex"), "w")
    return ends.groupBy("vertex").agg(F.sum("w").alias("d")).orderBy("d", "vertex").first()


def sparser(pairs: DataFrame, size: int, parts: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """Pairs without the weight beyond forest ``size + 1`` of their part, and (u, v)
    that more than ``size`` arcs of their part hold together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, arcs = _numbered(pdf)
        forest, _ = scan(len(names), arcs)
        weight = arcs[:, 2] - np.maximum(forest - (size + 1), 0)
        out = np.column_stack([names[arcs[:, :2]], np.maximum(weight, 0), forest > size])
        return pd.DataFrame(out[(out[:, 2] > 0) | (out[:, 3] > 0)], columns=["u", "v", "w", "held"])

    part = F.pmod(F.xxhash64("u", "v", F.lit(salt)), F.lit(parts)).alias("part")
    found = cut(pairs.select("u", "v", "w", part).groupBy("part").applyInPandas(run, "u long, v long, w long, held long"), "forests")
    return found.filter("w > 0").select("u", "v", "w"), found.filter("held = 1").select("u", "v")


def _half_held(pairs: DataFrame) -> DataFrame:
    """(u, v): a vertex and the other end of its heaviest arc, if that has half its weight at
    least.  All may be joined at once: towards the root of what they make, each vertex goes
    over to a set that holds half of it, which makes no cut larger, its own degree
    aside.  Equal weights are told apart by a hash, so ways stay short."""
    ends = pairs.select("u", "v", "w").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    rank = F.struct("w", F.xxhash64(F.least("u", "v"), F.greatest("u", "v")), "v")
    return ends.groupBy("u").agg(F.sum("w").alias("d"), F.max("w").alias("top"), F.max_by("v", rank).alias("v")).filter("2 * top >= d").select("u", "v")


def _certified(pairs: DataFrame, known: tuple, maps: list) -> tuple[DataFrame, tuple]:
    """Certificates of parts, one after the other, as long as they take a tenth off; once
    they do not, only cuts smaller than the smallest known one stay, and vertices are joined
    to what holds half of them (``_half_held``) as long as both together take that off.
    ``maps`` get what moved, ``known`` is (size, level, ids): a cut by ids of sets."""

    def joined(kept, held):
        moves = stars(held).toDF("old", "new")
        maps.append(moves)
        out = cut(_merged(kept, moves, []), "pairs")
        least = _least_degree(out)
        return out, (least.d, len(maps), [least.vertex]) if least is not None and least.d < known[0] else known

    count, every = pairs.count(), True
    for salt in range(100):
        if count <= TASK_ARCS:
            break
        before = count
        pairs, known = joined(*sparser(pairs, known[0] - (not every), -(-count // TASK_ARCS), salt))
        count = pairs.count()
        if count > TASK_ARCS and (not every or count > 0.9 * before):
            every = False
            pairs, known = joined(pairs, _half_held(pairs))
            count = pairs.count()
        if count > 0.9 * before:
            break
    return pairs, known


def _contracted(arcs: DataFrame, seed: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Two children of every node of ``arcs`` (node, u, v, w), each contracted to
    about 1 / sqrt 2 of its sets, and what moved (node, old, new).  A turn takes
    random arcs that cannot join too many sets, of all nodes together."""
    arcs = cut(arcs.select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"), "u", "v", "w"), "arcs")
    moved, target = None, None
    for turn in range(200):
        ends = arcs.select("node", F.explode(F.array("u", "v")).alias("x")).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("sets"))
        now = ends.join(arcs.groupBy("node").agg(F.sum("w").alias("total")), "node")
        if target is None:
            target = cut(now.select("node", (1 + F.floor(F.col("sets") / math.sqrt(2))).alias("target")), "target")
        spare = F.col("sets") - F.col("target")
        # near enough else: the last few would take a turn each
        rates = cut(now.join(target, "node").filter(spare * 20 > F.col("target")).select("node", (F.greatest(spare / 2, spare - 6 * F.sqrt("sets")) / F.col("total")).alias("rate")), "rates")
        if rates.isEmpty():
            drop(rates)
            break
        chance = (F.shiftrightunsigned(F.xxhash64("node", "u", "v", F.lit(seed), F.lit(level), F.lit(turn)), 11) + 1) / F.lit(2.0**53)
        picked = arcs.join(rates, "node").filter(-F.log(chance) / F.col("w") < F.col("rate"))
        # (node, vertex) as one id: places of the ends in the order of their names
        ids = cut(picked.select("node", F.explode(F.array("u", "v")).alias("x")).distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
        a, b = (ids.select("node", F.col("x").alias(x), F.col("id").alias(f"id_{x}")) for x in "uv")
        links = picked.join(a, ["node", "u"]).join(b, ["node", "v"]).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))
        found = components(links)
        moves = ids.join(found, "id").join(ids.select(F.col("id").alias("component"), F.col("x").alias("new")), "component").select("node", F.col("x").alias("old"), "new").filter("old <> new")
        moves = cut(moves, "moves")
        merged = cut(_merged(arcs, moves, ["node"]), "arcs")
        if moved is None:
            after = moves
        else:  # what moved before may move again
            on = moves.select("node", F.col("old").alias("new"), F.col("new").alias("next"))
            after = cut(moved.join(on, ["node", "new"], "left").select("node", "old", F.coalesce("next", "new").alias("new")).unionByName(moves), "moves")
            drop(moved)
            drop(moves)
        for t in (arcs, rates, ids):
            drop(t)
        arcs, moved = merged, after
    else:
        raise RuntimeError("contraction did not reach its target")
    drop(target)
    return arcs, moved if moved is not None else cut(arcs.select("node", F.col("u").alias("old"), F.col("v").alias("new")).filter("false"), "moves")


def picked_out(pairs: DataFrame, n: int, nodes: range, seed: int) -> tuple[DataFrame, DataFrame]:
    """Arcs (node, u, v, w) of ``pairs`` between the sets of each node, and what moved (node,
    old, new): in a node, every vertex joins the other end of one of its arcs, taken
    at random by weight.  Arcs are read once for all nodes."""
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y"), "w").unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y"), "w"))

    def clock(node):
        chance = (F.shiftrightunsigned(F.xxhash64("x", "y", F.lit(seed), F.lit(node)), 11) + 1) / F.lit(2.0**53)
        return -F.log(chance) / F.col("w")

    picks = both.groupBy("x").agg(*(F.min_by("y", clock(i)).alias(f"y_{i}") for i in nodes))
    ends = picks.select("x", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("node"), F.col(f"y_{i}").alias("y")) for i in nodes))).alias("p"))
    found = stars(ends.select((F.col("p.node") * n + F.col("x")).alias("u"), (F.col("p.node") * n + F.col("p.y")).alias("v")))
    moves = cut(found.select(F.expr(f"id div {n}").alias("node"), (F.col("id") % n).alias("old"), (F.col("component") % n).alias("new")), "moves")
    to = moves.groupBy("old").agg(F.map_from_entries(F.collect_list(F.struct("node", "new"))).alias("to"))  # a row a vertex
    rows = pairs
    for x in "uv":
        rows = rows.join(to.select(F.col("old").alias(x), F.col("to").alias(f"to_{x}")).hint("merge"), x, "left")
    rows = rows.withColumn("node", F.explode(F.array(*(F.lit(i).cast("long") for i in nodes))))
    rows = rows.select("node", "w", *(F.coalesce(F.try_element_at(f"to_{x}", F.col("node")), x).alias(x) for x in "uv")).filter("u <> v")
    rows = rows.groupBy("node", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("w").alias("w"))
    return cut(rows.select("node", F.col("a").alias("u"), F.col("b").alias("v"), "w"), "arcs"), moves


def _each_trial(pairs: DataFrame, trials: int) -> DataFrame:
    return pairs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))).alias("node"), "u", "v", "w")


def _tree(pairs: DataFrame, n: int, trials: int, seed: int, maps: list) -> tuple[DataFrame, int]:
    """The recursion laid out: arcs (node, u, v, w) of nodes that fit a task, and
    their depth.  ``maps`` get what moved at each level."""
    depth = 0
    vertices = pairs.select(F.explode(F.array("u", "v")).alias("x")).agg(F.count_distinct("x")).first()[0]
    if 2 * pairs.count() >= DENSE * vertices > 0:
        parts = [picked_out(pairs, n, range(i, min(i + PICKS, 2 * trials)), seed) for i in range(0, 2 * trials, PICKS)]
        arcs, moved = (functools.reduce(DataFrame.unionByName, x) for x in zip(*parts))
        maps.append(moved)
    else:
        arcs = _each_trial(pairs, trials)
    while (arcs.groupBy("node").agg(F.count(F.lit(1)).alias("arcs")).agg(F.max("arcs")).first()[0] or 0) > TASK_ARCS:
        arcs, moved = _contracted(arcs, seed, depth)
        maps.append(moved)
        depth += 1
    return arcs, depth


def _side(spark, n: int, maps: list, ids: DataFrame, node: int = 0) -> DataFrame:
    """(vertex): which vertices the sets ``ids`` (id) hold, through all moves; of
    those that have nodes, the ones on the way to ``node``."""
    sets = spark.range(n).select(F.col("id").alias("vertex"), F.col("id").alias("set"))
    deep = sum("node" in m.columns for m in maps)
    for m in maps:
        if "node" in m.columns:
            deep -= 1
            m = m.filter(F.col("node") == node >> deep).drop("node")
        sets = sets.join(m.withColumnRenamed("old", "set").hint("merge"), "set", "left").select("vertex", F.coalesce("new", "set").alias("set"))
    return sets.join(ids.select(F.col("id").alias("set")), "set", "left_semi").select("vertex")


def _kernel_of(pairs: DataFrame, size: int) -> DataFrame:
    """The kernel of pairs that fit a task, as rows of three kinds: arcs, moves
    (old, new), and the vertices of a smaller cut with its size."""
    core = CORE

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, arcs = _numbered(pdf)
        label, arcs, least, side = kernel(len(names), arcs, size, core)
        first = names[np.unique(label, return_index=True)[1]]
        rows = [np.column_stack([np.zeros(len(arcs), np.int64), first[arcs[:, :2]], arcs[:, 2]])]
        rows.append(np.column_stack([np.ones_like(names), names, first[label], np.zeros_like(names)])[names != first[label]])
        if side is not None:
            rows.append(np.column_stack([np.full(side.sum(), 2), names[side], names[side], np.full(side.sum(), least)]))
        return pd.DataFrame(np.concatenate(rows), columns=["kind", "a", "b", "w"])

    return cut(pairs.groupBy().applyInPandas(run, "kind long, a long, b long, w long"), "kernel")


def min_cut(g: Graph, trials: int | str | None = None, seed: int = 0, strategy: str = "copy", find_mode: str = "halving") -> DataFrame:
    """(src, dst): the arcs of the smallest cut found (the first trial that has
    it); empty if the graph is not connected.

    ``trials``: a number, None for ceil(log2 n)^2 + 2, or "low ones".  ``strategy``
    is "copy" or "undo", for the union-find of the branches; both find the same,
    as all ``find_mode``."""
    if strategy not in ("copy", "undo"):
        raise ValueError("strategy is copy or undo")
    spark = g.spark
    pairs = cut(_pairs(g), "pairs")
    if g.n < 2 or not _connected(g, pairs):
        return spark.createDataFrame([], "src long, dst long")
    count = low_ones_trials(g.n) if trials == "low ones" else trials or default_trials(g.n)
    least = _least_degree(pairs)
    maps: list[DataFrame] = []
    known, bound = (least.d, 0, [least.vertex]), None
    if g.n > CORE:
        pairs, known = _certified(pairs, known, maps)
        bound = known[0]
        if pairs.count() <= TASK_ARCS:
            rows, bound = _kernel_of(pairs, known[0]), None
            smaller = rows.filter("kind = 2").select(F.col("a").alias("id"), "w")
            size = smaller.agg(F.min("w")).first()[0]
            known = known if size is None else (size, len(maps), smaller.select("id"))
            maps.append(rows.filter("kind = 1").select(F.col("a").alias("old"), F.col("b").alias("new")))
            pairs = rows.filter("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
    if bound is None:
        # a kernel is few rows, but its trials are not little work: they are not put together in one task
        nodes = _each_trial(pairs, count).repartition(min(count, 2 * spark.sparkContext.defaultParallelism), "node")
    else:
        nodes, _ = _tree(pairs, g.n, count, seed, maps)
    found = cut(nodes.groupBy("node").applyInPandas(_search(seed, strategy, find_mode, bound, CORE), _FOUND), "found")
    best = found.orderBy("cut_size", "node").limit(1)
    first = best.select("node", "cut_size").first()
    if first is None or known[0] < first.cut_size:
        ids = known[2] if isinstance(known[2], DataFrame) else spark.createDataFrame([(x,) for x in known[2]], "id long")
        side = _side(spark, g.n, maps[: known[1]], ids)
    else:
        side = _side(spark, g.n, maps, best.select(F.explode("side").alias("id")), first.node)
    side = cut(side, "side")
    arcs = g.inside().select("src", "dst")
    left, right = (side.select(F.col("vertex").alias(x), F.lit(True).alias(f"in_{x}")) for x in ("src", "dst"))
    return arcs.join(left.hint("merge"), "src", "left").join(right.hint("merge"), "dst", "left").filter("(in_src is null) <> (in_dst is null)").select("src", "dst")


def min_cut_size(g: Graph, trials: int | str | None = None, seed: int = 0, strategy: str = "copy", find_mode: str = "halving") -> DataFrame:
    """One row: cut_size; NULL for fewer than two vertices, 0 if not connected."""
    if g.n < 2:
        return g.spark.range(1).select(F.lit(None).cast("long").alias("cut_size"))
    return min_cut(g, trials, seed, strategy, find_mode).agg(F.count(F.lit(1)).alias("cut_size"))
