"""Golden values, edge cases and metamorphic checks of the graph operators."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import hashing, registers, sketch
from weftline.operators import clustering, components, generators, graph, mincut, paths, pieces, small
from weftline.operators.disjoint_set import DisjointSet, grouped_labels
from weftline.operators.graph import Graph, dense_ids
from weftline.operators.labels import Labels
from weftline.plans import queries
from weftline.sources import derived, edges
from weftline.sources.store import EdgeStore
from weftline.streaming import sketches

SEED = 0xBAD5EED


@pytest.fixture(params=["one task", "distributed"])
def way(request, monkeypatch):
    """Both ways of the operators that take few vertices in one task."""
    if request.param == "distributed":
        monkeypatch.setattr(small, "SMALL", 0)
    return request.param


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_literals(spark):
    g = Graph.literal(spark, 3, [(0, 1), (0, 2), (1, 0)])
    assert (g.n, g.edge_count()) == (3, 3)
    w = Graph.literal(spark, 3, [(0, 1, 42), (0, 2, 33), (2, 0, 25)])
    sums = w.vertices.join(w.edges, F.col("vertex") == F.col("src"), "left").groupBy("vertex").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    assert pairs(sums) == [(0, 75), (1, 0), (2, 25)]


def test_empty_weighted_graphs_take_weighted_links(spark):
    g = Graph.literal(spark, 0, [], weighted=True)
    more = g.with_links(spark.createDataFrame([(2, 0, 7)], "src long, dst long, weight int"))
    assert (g.n, g.edge_count(), more.n, pairs(more.edges)) == (0, 0, 3, [(2, 0, 7)])


def test_loading_validates_and_counts(spark):
    df = spark.createDataFrame([(0, 5)], "src long, dst long")
    assert Graph.from_edges(df).n == 6
    with pytest.raises(ValueError):
        Graph.from_edges(df, n=5, validate=True)
    assert Graph.from_edges(df.filter("false")).n == 0


def test_files(spark, tmp_path):
    g = edges.twin_fives(spark)
    edges.write_edges(g, f"{tmp_path}/e", 3)
    assert pairs(edges.read_edges(spark, f"{tmp_path}/e").edges) == pairs(g.edges)
    (tmp_path / "t.txt").write_text("# arcs\n0 1\n2\t0\n\n")
    assert pairs(edges.read_edge_text(spark, str(tmp_path / "t.txt")).edges) == [(0, 1), (2, 0)]


def test_access_and_mutation(spark):
    g = edges.twin_fives(spark)
    assert g.edge_count() == 43
    assert pairs(g.arcs_of(g.adjacency())) == pairs(g.edges)
    asked = spark.createDataFrame([(2, 6), (6, 2)], "src long, dst long")
    assert pairs(g.has_link(asked)) == [(2, 6)] and pairs(g.lacks_link(asked)) == [(6, 2)]
    more = g.with_links(spark.createDataFrame([(11, 3)], "src long, dst long"))
    assert (more.n, g.n, more.with_vertex(2).n) == (12, 10, 12)
    assert g.lines().filter("vertex = 4").first().line == "4: 0 -> 1 -> 2 -> 3 -> 5"
    with pytest.raises(ValueError):
        g.exactly(44)


def test_dense_ids(spark):
    got = pairs(dense_ids(spark.createDataFrame([(x,) for x in [9, 5, 5, 700, None, -3]], "k long"), "k"))
    assert got == [(-3, 0), (5, 1), (9, 2), (700, 3)]


def test_average_path_length(spark, way):
    g = edges.twin_fives(spark)
    assert paths.average_path_length(g).first().apl == pytest.approx(142 / 45)
    assert paths.average_path_length(g, "pairs").first().apl == pytest.approx(142 / 90)
    looped = g.with_links(spark.createDataFrame([(1, 1), (1, 1)], "src long, dst long"))
    assert paths.average_path_length(looped).first().apl == pytest.approx(143 / 45)
    apart = Graph(g.edges, 11)
    assert paths.average_path_length(apart).first().apl is None
    assert paths.average_path_length(Graph(g.edges.filter("false"), 1)).first().apl is None


def test_distances_from_a_sample(spark):
    chain = Graph(spark.range(1, 40).selectExpr("id - 1 as src", "id as dst"), 40)
    got = paths.bfs_distances(chain, spark.createDataFrame([(0,)], "v long"), symmetric=False)
    assert pairs(got) == [(0, d, d) for d in range(40)]


def test_hyper_ball(spark, way):
    g = edges.twin_fives(spark)
    assert paths.hyper_ball(g, 4, SEED).first().hyper_ball == pytest.approx(2.0901, abs=1e-4)
    assert paths.ball_limit(g).first().ball_limit == pytest.approx(2.6)
    assert paths.hyper_ball(g, 12, SEED).first().hyper_ball == pytest.approx(2.6, rel=0.05)
    assert paths.hyper_ball(g, 12, SEED, textbook=True).first().hyper_ball > 1


def test_distances_both_ways(spark, monkeypatch):
    g = generators.gnm(spark, 70, 160, 3)
    near = [pairs(paths.bfs_distances(g, symmetric=x)) for x in (True, False)]
    counts = [pairs(paths.distance_counts(g, symmetric=x)) for x in (True, False)]
    registers, balls = pairs(paths.reach_registers(g, 5, 9)), [paths.hyper_ball(g, 6, 9, textbook=x).first() for x in (True, False)]
    for x in (0, 1):
        assert counts[x] == sorted(Counter(dist for s, d, dist in near[x] if dist).items())
    monkeypatch.setattr(small, "SMALL", 0)
    monkeypatch.setattr(paths, "_DELTAS", 2)
    assert counts == [pairs(paths.distance_counts(g, symmetric=x)) for x in (True, False)]
    for x, old in zip((True, False), balls):
        new = paths.hyper_ball(g, 6, 9, textbook=x).first()
        assert new.rounds == old.rounds and new.hyper_ball == pytest.approx(old.hyper_ball)
    assert near == [pairs(paths.bfs_distances(g, symmetric=x)) for x in (True, False)]
    assert registers == pairs(paths.reach_registers(g, 5, 9))


@pytest.mark.parametrize("most, few", [(1 << 20, 64), (1 << 20, 2), (7, 64)])
def test_components_of_few_vertices_are_searched_in_tasks(spark, monkeypatch, most, few):
    """Trees, chains, pairs and lone vertices beside a larger component; all three ways."""
    chains = [(x, x + 1) for x in range(100, 160) if x % 6]
    trees = [(x, 200 + x // 4) for x in range(28)] + [(200 + x, 300) for x in range(7)]
    links = [*chains, *trees, (30, 31), (31, 30), *((40 + a, 40 + b) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 5)))]
    g = Graph.literal(spark, 305, links)
    want = [pairs(paths.distance_counts(g, symmetric=x)) for x in (True, False)], pairs(paths.reach_registers(g, 5, 9)), paths.hyper_ball(g, 6, 9).first()
    for name, value in (("ROWS", most), ("FEW", few), ("PAIRS", 50)):
        monkeypatch.setattr(pieces, name, value)
    used = []
    large = paths._large_counts
    monkeypatch.setattr(paths, "_large_counts", lambda arcs, *a: used.append(arcs.count()) or large(arcs, *a))
    for limit in (50, 8) if most > 7 and few > 2 else (50,):
        monkeypatch.setattr(small, "SMALL", limit)
        assert [pairs(paths.distance_counts(g, symmetric=x)) for x in (True, False)] == want[0]
        assert pairs(paths.reach_registers(g, 5, 9)) == want[1]
        ball = paths.hyper_ball(g, 6, 9).first()
        assert ball.rounds == want[2].rounds and ball.hyper_ball == pytest.approx(want[2].hyper_ball)
        assert bool(used) == (limit < 50)


def test_packed_sketches_merge_as_they_are(spark):
    rows = spark.range(4000).selectExpr("id % 40 as key", "id * 7 % 900 as value")
    for n, b in ((1 << 32, 6), (1 << 40, 4)):
        r = sketch.hll_registers(rows, b, 5)
        packed = sketch.hll_compact(r, b, n).repartition(3)
        assert pairs(sketch.hll_expand(sketch.hll_merge_packed(packed, b, n, F.expr("key div 9")), b, n)) == pairs(sketch.hll_rollup(r, F.expr("key div 9")))
        more = sketch.hll_registers(rows.selectExpr("key + 5 as key", "value + 400 as value"), b, 5)
        both = packed.unionByName(sketch.hll_compact(more, b, n))
        assert pairs(sketch.hll_expand(sketch.hll_merge_packed(both, b, n), b, n)) == pairs(sketch.hll_union(r, more))
    assert sketch.hll_merge_packed(packed.filter("false"), 4, 1 << 40).count() == 0


def test_labels_with_save_points(spark):
    rnd = random.Random(4)
    start, sets, saved = Labels(spark, 60), DisjointSet(60, undo=True), []
    now = start
    for turn in range(9):
        arcs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(6)]
        saved.append((now, sets.save()))
        for u, v in arcs:
            sets.union(u, v)
        now = now.joined(spark.createDataFrame([*arcs, (3, 60), (-1, 4), (None, 5)], "src long, dst long"))
        if turn in (3, 6):  # back to the state before
            now, state = saved[-1]
            sets.restore(state)
        assert now.count() == sets.components
    least = {}
    for x in range(60):
        least.setdefault(sets.find(x), x)
    assert pairs(now.all()) == [(x, least[sets.find(x)]) for x in range(60)]
    assert len(now.moves) <= 6 and start.count() == 60 and pairs(start.all()) == [(x, x) for x in range(60)]
    asked = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(30)]
    assert pairs(now.connected(spark.createDataFrame(asked, "a long, b long"))) == sorted((a, b, sets.are_connected(a, b)) for a, b in asked)


def test_stored_arcs_do_not_move_again(spark):
    g = generators.gnm(spark, 300, 4000, 3)
    store = EdgeStore(g)
    assert pairs(store.graph.edges) == pairs(g.edges) and store.n == 300
    rows = store.rows([7, 9])
    assert pairs(rows) == [x for x in pairs(g.edges) if x[0] in (7, 9)]
    plan = lambda df: df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "SelectedBucketsCount: 8 out of 8" in plan(store.graph.edges.groupBy("src").count())
    assert (store.graph.edges.rdd.getNumPartitions(), store.rows([7]).rdd.getNumPartitions()) == (8, 1)  # a file a bucket
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        front = g.edges.select(F.col("dst").alias("vertex"))
        text = plan(store.rows_of(front))
        assert text.count("Exchange (") == 1 and store.rows_of(front).count() == 4000
        assert "Exchange (" not in plan(store.graph.out_degrees())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    store.drop()


def test_merged_registers(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), bytes(rng.integers(0, 9, 16, dtype=np.uint8))) for k in rng.integers(0, 7, 25_000)]
    want = {}
    for k, r in rows:
        want[k] = np.maximum(want.get(k, 0), np.frombuffer(r, np.uint8))
    got = registers.merged(spark.createDataFrame(rows, "key long, regs binary"), 16).collect()
    assert {r.key: bytes(r.regs) for r in got} == {k: r.astype(np.uint8).tobytes() for k, r in want.items()} and len(got) == len(want)


def test_numbered_arcs(spark):
    arcs = generators.gnm(spark, 40, 600, 1).edges
    got = pairs(clustering.numbered_arcs(arcs.repartition(5)))
    assert [p for p, _, _ in got] == list(range(600)) and [(u, v) for _, u, v in got] == pairs(arcs)
    assert clustering.numbered_arcs(arcs.filter("false")).count() == 0


@pytest.mark.parametrize("weights, light", [((1, 1, 2, 5, 12), 0), ((4, 7, 12), 1)])
def test_large_rings_come_down_to_a_kernel(spark, monkeypatch, weights, light):
    """Certificates take nothing off a ring of light arcs: vertices are joined by half their
    weight, and no recursion is laid out.  With two lighter arcs the smallest cut is no degree."""
    monkeypatch.setattr(mincut, "TASK_ARCS", 300)
    monkeypatch.setattr(mincut, "_tree", None)
    n = 1000
    weight = random.Random(3).choices(weights, k=n)
    if light:
        weight[100] = weight[700] = light
    arcs = [(i, (i + 1) % n) for i, w in enumerate(weight) for _ in range(w)]
    found = pairs(mincut.min_cut(Graph(spark.createDataFrame(arcs, "src long, dst long"), n), 20, 3))
    assert len(found) == sum(sorted(weight)[:2])
    rest = list((Counter(arcs) - Counter(found)).elements())
    assert len({r.component for r in components.connected_components(Graph(spark.createDataFrame(rest, "src long, dst long"), n)).collect()}) == 2


@pytest.mark.parametrize("cell", [clustering.CELL, 40])
def test_closed_pairs_are_no_rows(spark, monkeypatch, cell):
    """Arcs are dealt to cubes of parts, and no join or shuffle has the pairs that they close."""
    monkeypatch.setattr(clustering, "CELL", cell)
    rng = random.Random(4)
    arcs = [(rng.randrange(-3, 40), rng.randrange(-3, 40)) for _ in range(700)] + [(50, x) for x in range(40)] + [(x, 51) for x in range(20)] + [(None, 1), (None, 2), (4, None), (60, 1), (60, 60), (60, 2)]
    g = Graph(spark.createDataFrame(arcs, "src long, dst long"), 61)
    held, out = set(arcs), {}
    for u, w in held:
        out.setdefault(u, set()).add(w)
    for least in (2, 3):
        want = {j: (len(x), sum((u, w) in held for u in x for w in x if u != w and None not in (u, w, j))) for j, x in out.items() if len(x) >= least}
        rows = clustering.local_clustering(g, least)
        assert {r.vertex: (r.degree, r.closed) for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "hashpartitioning(j" in plan and "hashpartitioning(y" not in plan


def test_clustering(spark):
    g = edges.twin_fives(spark)
    assert clustering.clustering_exact(g).first().clustering == pytest.approx(0.88)
    assert pairs(clustering.local_clustering(g).select("vertex", F.round("coefficient", 6)))[2:5] == [(2, 0.6), (3, 0.6), (4, 0.6)]
    got = clustering.clustering_sampled(g, 4000, 7).first().clustering
    assert abs(got - 0.88) < 4 * (0.88 * 0.12 / 4000) ** 0.5
    twice = Graph(g.edges.unionByName(g.edges).repartition(5), 10)
    assert clustering.clustering_exact(twice).first().clustering == pytest.approx(0.88)
    none = Graph.literal(spark, 3, [(0, 1)])
    assert clustering.clustering_exact(none).first().clustering == 0.0
    assert clustering.clustering_sampled(none, 10, 1).first().clustering == 0.0
    assert clustering.clustering_sampled(g, 0, 1).first().clustering is None


def every_cut(n, arcs):
    """Sizes of all cuts, by side as a bit mask without vertex n - 1."""
    return {side: sum((side >> u & 1) != (side >> v & 1) for u, v in arcs) for side in range(1, 2 ** (n - 1))}


@pytest.mark.parametrize("core", [64, 7])
def test_min_cut(spark, monkeypatch, core):
    monkeypatch.setattr(mincut, "CORE", core)
    g = edges.twin_fives(spark)
    assert pairs(mincut.min_cut(g, 12, 3)) == [(2, 6), (3, 7), (4, 5)]
    assert mincut.min_cut_size(Graph(g.edges, 11)).first().cut_size == 0


@pytest.mark.parametrize("strategy, mode", [("copy", "halving"), ("undo", "compression"), ("undo", "splitting")])
def test_min_cut_strategies_against_all_cuts(spark, strategy, mode):
    for seed in range(3):
        g = generators.gnm(spark, 10, 40, seed)
        arcs = pairs(g.edges)
        got = mincut.min_cut(g, 20, seed, strategy, mode)
        assert got.count() == min(every_cut(10, arcs).values())
        assert pairs(got) == pairs(mincut.min_cut(g, 20, seed))
    with pytest.raises(ValueError):
        mincut.min_cut(g, strategy="other")


def test_planted_cuts_beyond_the_core(spark):
    bridges = [(5, 205), (17, 230), (90, 399)]
    left, right = (generators.gnm(spark, 200, 3000, seed).edges for seed in (1, 2))
    joined = left.unionByName(right.selectExpr("src + 200 as src", "dst + 200 as dst")).unionByName(spark.createDataFrame(bridges, "src long, dst long"))
    assert pairs(mincut.min_cut(Graph(joined, 400), 2, 3)) == bridges
    # one weak vertex, which contraction alone seldom keeps
    weak = joined.unionByName(spark.createDataFrame([(400, 1), (300, 400)], "src long, dst long"))
    assert pairs(mincut.min_cut(Graph(weak, 401), 1, 3)) == [(300, 400), (400, 1)]


def regular(n, degree, seed):
    """Rings in random order laid over each other: connected, all degrees equal."""
    rng = np.random.default_rng(seed)
    rings = [rng.permutation(n) for _ in range(degree // 2)]
    return [(int(a), int(b)) for r in rings for a, b in zip(r, np.roll(r, 1))]


def weighted(links):
    ends = np.sort(np.array(links), axis=1)
    ends = ends[ends[:, 0] != ends[:, 1]]
    names, w = np.unique(ends, axis=0, return_counts=True)
    return int(ends.max()) + 1, np.column_stack([names, w]).astype(np.int64)


def stoer_wagner(n, arcs):
    near = [{} for _ in range(n)]
    for u, v, w in arcs.tolist():
        near[u][v] = near[v][u] = near[u].get(v, 0) + w
    live, best = set(range(n)), None
    while len(live) > 1:
        held, heap, order, done = {}, [(0, min(live))], [], set()
        while heap:
            u = heapq.heappop(heap)[1]
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in near[u].items():
                if v not in done:
                    held[v] = held.get(v, 0) + w
                    heapq.heappush(heap, (-held[v], v))
        if len(order) < len(live):
            return 0
        s, t = order[-2:]
        phase = sum(near[t].values())
        best = phase if best is None else min(best, phase)
        for v, w in near[t].items():
            del near[v][t]
            if v != s:
                near[s][v] = near[v][s] = near[s].get(v, 0) + w
        near[t] = {}
        live.discard(t)
    return best


def sparse_graphs():
    rng = np.random.default_rng(3)
    for n in (65, 130, 700):
        yield [(i, int(rng.integers(0, i))) for i in range(1, n)] + [tuple(x) for x in rng.integers(0, n, (2 * n, 2)).tolist()]
        yield regular(n, 4, n)
    yield [(i, (i + 1) % 2000) for i in range(2000)]
    yield [(i * 30 + j, k) for i in range(30) for j in range(30) for k in (i * 30 + (j + 1) % 30, (i + 1) % 30 * 30 + j)]
    yield regular(600, 6, 1) + [(a + 600, b + 600) for a, b in regular(600, 6, 2)] + [(1, 700), (50, 800), (99, 900), (340, 1100)]


def test_kernels_keep_a_smallest_cut():
    for links in sparse_graphs():
        n, arcs = weighted(links)
        degree = int(np.bincount(arcs[:, :2].ravel(), np.repeat(arcs[:, 2], 2)).min())
        label, left, size, side = mincut.kernel(n, arcs, degree, 64)
        count = label.max() + 1
        found = size
        if count > 1:
            assert count <= 64
            found = min(size, stoer_wagner(count, left))
        if side is not None:
            assert size == sum(w for u, v, w in arcs.tolist() if side[u] != side[v])
        assert found == stoer_wagner(n, arcs)


def test_kernels_of_small_graphs_keep_all_smallest_cuts():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, arcs = weighted([(i, int(rng.integers(0, i))) for i in range(1, 9)] + [tuple(x) for x in rng.integers(0, 9, (12, 2)).tolist()])
        cuts = every_cut(n, np.repeat(arcs[:, :2], arcs[:, 2], axis=0).tolist())
        label, left, size, _ = mincut.kernel(n, arcs, int(np.bincount(arcs[:, :2].ravel(), np.repeat(arcs[:, 2], 2)).min()), 9)
        least = min(cuts.values())
        assert size >= least
        for mask, weight in cuts.items():
            if weight == least:
                assert len({(int(s), mask >> v & 1) for v, s in enumerate(label)}) == label.max() + 1
        # down to two sets, a cut smaller than the smallest known one stays
        label, left, size, _ = mincut.kernel(n, arcs, 99, 2)
        assert least == (min(size, left[:, 2].sum()) if len(left) else size)


def as_graph(spark, links):
    return Graph(spark.createDataFrame(links, "src long, dst long"), max(map(max, links)) + 1)


@pytest.mark.parametrize("which", [0, 1, 3, 8])
def test_cuts_of_sparse_graphs_with_default_trials(spark, which):
    links = list(sparse_graphs())[which]
    got = pairs(mincut.min_cut(as_graph(spark, links), None, 3))
    assert len(got) == stoer_wagner(*weighted(links))
    sides = components.connected_components(as_graph(spark, [x for x in links if x not in set(got)] + [(v, v) for v in range(max(map(max, links)) + 1)]))
    assert components.component_count(sides).first().components == 2


def test_cut_of_the_session_graph(spark):
    """The registered query that has no SQL, over its whole table."""
    tables = "/root/testdata/sf0.01"
    n, arcs = weighted(pairs(derived.session(spark, tables)))
    assert n > 64
    assert [r.cut_size for r in queries.min_cut_session(spark, tables).collect()] == [stoer_wagner(n, arcs)]


def test_certificates_of_parts_keep_small_cuts(spark):
    rng = np.random.default_rng(6)
    n, arcs = weighted(regular(9, 4, 3) + [tuple(x) for x in rng.integers(0, 9, (60, 2)).tolist()])
    cuts = every_cut(n, np.repeat(arcs[:, :2], arcs[:, 2], axis=0).tolist())
    least = min(cuts.values())
    df = spark.createDataFrame(arcs.tolist(), "u long, v long, w long")
    for size, parts in ((least, 1), (least + 2, 1), (least, 3), (2, 2)):
        kept, held = mincut.sparser(df, size, parts, 7)
        trimmed = every_cut(n, [(u, v) for u, v, w in pairs(kept) for _ in range(w)])
        for mask, weight in cuts.items():
            assert trimmed[mask] == weight if weight <= size else trimmed[mask] > size
            assert weight > size or not any((mask >> u & 1) != (mask >> v & 1) for u, v in pairs(held))


@pytest.mark.parametrize("task_arcs, strategy", [(130, "copy"), (200, "undo")])
def test_cuts_by_a_tree_of_contractions(spark, monkeypatch, task_arcs, strategy):
    monkeypatch.setattr(mincut, "TASK_ARCS", task_arcs)
    monkeypatch.setattr(mincut, "CORE", 12)
    bridges = [(3, 43), (17, 60), (33, 77)]
    links = regular(40, 6, 1) + [(a + 40, b + 40) for a, b in regular(40, 6, 2)] + bridges
    assert pairs(mincut.min_cut(as_graph(spark, links), 1 + (strategy == "undo"), 5, strategy)) == bridges


def test_dense_graphs_start_by_picks(spark, monkeypatch):
    """A planted cut between halves of 24 neighbours, too many arcs for a task."""
    links = regular(200, 24, 4) + [(u + 200, v + 200) for u, v in regular(200, 24, 5)] + [(i, 200 + i) for i in range(9)]
    monkeypatch.setattr(mincut, "TASK_ARCS", 1500)
    monkeypatch.setattr(mincut, "_contracted", None)  # picks are enough
    picked, used = mincut.picked_out, []
    monkeypatch.setattr(mincut, "picked_out", lambda *a: used.append(a) or picked(*a))
    cut = mincut.min_cut(as_graph(spark, links), 12, SEED)
    assert used and pairs(cut) == [(i, 200 + i) for i in range(9)]


def test_dense_graphs_shrink_by_certificates(spark, monkeypatch):
    monkeypatch.setattr(mincut, "TASK_ARCS", 400)
    dense = generators.gnm(spark, 80, 4000, 3).edges
    weak = dense.unionByName(spark.createDataFrame([(80, 81), (81, 82), (82, 80), (80, 82), (80, 5), (82, 17)], "src long, dst long"))
    assert pairs(mincut.min_cut(Graph(weak, 83), 2, 3)) == [(80, 5), (82, 17)] or mincut.min_cut_size(Graph(weak, 83), 2, 3).first().cut_size == 2


def test_ends_outside_the_graph_take_no_part(spark, way):
    odd = spark.createDataFrame([(1, 2), (2, 5), (-1, 0), (None, 1), (1, None), (0, 0)], "src long, dst long")
    g = Graph(odd, 3)
    assert pairs(components.connected_components(g)) == [(0, 0), (1, 1), (2, 1)]
    assert pairs(paths.bfs_distances(g)) == [(0, 0, 0), (1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)]
    assert pairs(paths.reach_registers(g, 4, 1).select("key").distinct()) == [(0,), (1,), (2,)]


def test_compact_sketches(spark):
    r = sketch.hll_registers(spark.range(5000).selectExpr("id % 3 as key", "id as value"), 6, 5)
    packed = sketch.hll_compact(r, 6, 1 << 32)
    assert {len(x.packed) for x in packed.collect()} == {40}
    assert pairs(sketch.hll_expand(packed, 6, 1 << 32)) == pairs(r)
    wide = spark.createDataFrame([(1, 0, 32)], "key long, idx int, val int")
    assert len(sketch.hll_compact(wide, 4, 1 << 33).first().packed) == 12
    with pytest.raises(Exception, match="does not fit 5 bits"):
        sketch.hll_compact(wide, 4, 1 << 32).collect()


def test_min_cut_edge_cases(spark):
    assert mincut.min_cut_size(Graph.literal(spark, 1, [(0, 0)])).first().cut_size is None
    assert mincut.min_cut_size(Graph.literal(spark, 2, [(0, 1), (1, 0), (0, 1)])).first().cut_size == 3
    assert pairs(mincut.min_cut(edges.twin_tens(spark), 12, 5)) == [(i, 10 + i) for i in range(1, 5)]
    assert [mincut.low_ones_trials(n) for n in (20, 7, 63)] == [2, 11, 38]


@pytest.mark.parametrize("mode", ["compression", "halving", "splitting"])
def test_disjoint_set(mode):
    s = DisjointSet(10, mode, undo=True)
    assert s.union(3, 6) and s.union(2, 4)
    state, before = s.save(), (s.parent[:], s.rank[:], s.components)
    assert s.union(2, 3) and not s.union(6, 4) and s.are_connected(3, 4) and s.components == 7
    s.labels()
    s.restore(state)
    assert (s.parent, s.rank, s.components) == before and not s.are_connected(2, 3)
    rnd, s, label = random.Random(1), DisjointSet(60, mode), list(range(60))
    for _ in range(50):
        a, b = rnd.randrange(60), rnd.randrange(60)
        assert s.union(a, b) == (label[a] != label[b])
        label = [label[a] if x == label[b] else x for x in label]
    assert s.components == len(set(label)) and "components" in repr(s)
    with pytest.raises(ValueError):
        DisjointSet(3, "other")


def test_chains_of_customers_in_blocks(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = pairs(queries.union_find_labels(spark, sf))
    monkeypatch.setattr(queries, "BLOCK", 16)
    assert queries._chains(spark, sf).count() == len(whole)
    assert pairs(queries.union_find_labels(spark, sf)) == whole


@pytest.mark.parametrize("undo", [False, True])
def test_large_groups_are_dealt_out(spark, undo):
    rng = random.Random(3)
    rows = [(g, rng.randrange(n), rng.randrange(n)) for g, n, m in [(1, 60, 40), (2, 9, 3), (-3, 200, 190)] for _ in range(m)]
    rows += [(1, i, i + 1) for i in range(100, 160)] + [(4, 5, 5)] * 50 + [(7, 1, None), (None, 1, 2)]
    want = {}
    for g, u, v in rows:
        if None not in (g, u, v):
            a, b = want.setdefault((g, u), {u}), want.setdefault((g, v), {v})
            a |= b
            want |= {(g, x): a for x in a}
    df = spark.createDataFrame(rows, "grp long, u long, v long")
    for limit in (7, 10_000):
        assert pairs(grouped_labels(df, "splitting", undo, limit)) == sorted((g, x, min(s)) for (g, x), s in want.items())
    assert pairs(grouped_labels(df.filter("false"), limit=1)) == []


def test_components(spark, way):
    g = Graph.literal(spark, 9, [(5, 3), (3, 4), (7, 8), (2, 2)])
    labels = components.connected_components(g)
    assert pairs(labels) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 7)]
    assert components.component_count(labels).first().components == 6
    assert pairs(components.are_connected(labels, spark.createDataFrame([(4, 5), (4, 7)], "a long, b long"))) == [(4, 5, True), (4, 7, False)]
    chain = spark.range(1, 300).selectExpr("id as u", "id - 1 as v")
    assert {r.component for r in components.components(chain).collect()} == {0}
    stars = spark.createDataFrame([(4, 1), (1, 5), (9, 2), (9, 2), (3, 3)], "u long, v long")
    assert pairs(components.components(stars, 1)) == [(1, 1), (2, 2), (4, 1), (5, 1), (9, 2)]
    with pytest.raises(RuntimeError):
        components.components(chain, 1)


def test_edges_that_lie_together_take_no_round(spark):
    chains = spark.range(0, 4000, 1, 4).selectExpr("id as u", "id + 1 as v").filter("u % 20 < 19")
    found = components.components(chains, 1)
    assert found.count() == 4000 and not found.filter("component <> id - id % 20").count()


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rnd, sets = random.Random(seed), DisjointSet(400)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)]
    for u, v in links:
        sets.union(u, v)
    least = {}
    for x in range(400):
        least.setdefault(sets.find(x), x)
    ends = {x for u, v in links if u != v for x in (u, v)}
    got = pairs(components.components(spark.createDataFrame(links, "u long, v long")))
    assert got == [(x, least[sets.find(x)]) for x in sorted(ends)]


@pytest.mark.parametrize("b, want", [(9, 104_081.6), (12, 101_100.2), (15, 100_887.2)])
def test_sketch_golden(spark, b, want):
    rows = spark.range(100_000).selectExpr("0L as key", "id as value")
    got = sketch.hll_estimate(sketch.hll_registers(rows, b, 0x156820568), b).first().estimate
    assert got == pytest.approx(want, abs=0.06)


@pytest.mark.parametrize("b", range(4, 16))
def test_sketch_error(spark, b):
    rows = spark.range(20_000).selectExpr("id % 2 as key", "id as value")
    r = sketch.hll_registers(rows, b, 5)
    for x in sketch.hll_estimate_range(r, b).collect():
        assert abs(x.estimate - 10_000) < 5 * 10_000 * sketch.hll_error(b)[1] and x.low < x.estimate < x.high


def test_sketch_union(spark):
    a, b = (sketch.hll_registers(spark.range(x, y).selectExpr("1L as key", "id as value"), 8, 9) for x, y in ((0, 3000), (2000, 5000)))
    both = sketch.hll_registers(spark.range(5000).selectExpr("1L as key", "id as value"), 8, 9)
    assert pairs(sketch.hll_union(a, b)) == pairs(both)
    assert sketch.hll_changed(a, both) and not sketch.hll_changed(both, sketch.hll_union(a, b))
    assert [sketch.register_width(n) for n in (10, 2**32, 2**33)] == [5, 5, 6]
    with pytest.raises(ValueError):
        sketch.hll_registers(spark.range(1).selectExpr("1L as key", "id as value"), 3, 0)


def test_hash_wraps():
    def slow(x, seed):
        m = 2**64
        a, b, c = (seed + x) % m, seed, hashing.GOLDEN
        for right, left, low in hashing.SHIFTS:
            a = (a - b - c) % m ^ (c >> right)
            b = (b - c - a) % m ^ (a << left) % m
            c = (c - a - b) % m ^ (b >> low)
        return c

    x = np.array([0, 1, 2**63, 2**64 - 1, 12345], np.uint64)
    assert hashing.jenkins(x, SEED).tolist() == [slow(int(v), SEED) for v in x]


@pytest.mark.parametrize("width", range(1, 8))
def test_registers(spark, width):
    rows = [(n, [i % 2**width for i in range(n)]) for n in (1, 7, 8, 127)]
    df = spark.createDataFrame(rows, "n int, a array<tinyint>")
    for n, a in rows:
        own = df.filter(F.col("n") == n)
        packed = own.select(registers.pack(F.col("a"), width).alias("p"))
        assert len(packed.first().p) == -(-width * n // 8)
        assert packed.select(registers.unpack(F.col("p"), width, n).alias("a")).first().a == a
    one = df.filter("n = 7").select(registers.put(F.col("a"), F.lit(2), F.lit(1)).alias("a"), registers.zeros(7).alias("z"))
    r = one.select(registers.get(F.col("a"), 2).alias("g"), registers.changed(F.col("a"), F.col("z")).alias("same"), registers.changed(F.col("z"), F.col("a")).alias("new"), registers.merge(F.col("a"), F.col("z")).alias("m"), "a").first()
    assert (r.g, r.same, r.new, r.m) == (1, False, True, r.a)


def test_generators(spark):
    g = generators.gnm(spark, 30, 400, 5)
    arcs = pairs(g.edges)
    assert len(set(arcs)) == 400 and all(a != b and 0 <= a < 30 and 0 <= b < 30 for a, b in arcs)
    assert arcs == pairs(generators.gnm(spark, 30, 400, 5).edges) != pairs(generators.gnm(spark, 30, 400, 6).edges)
    assert len(set(pairs(generators.gnm(spark, 5, 20, 1).edges))) == 20
    with pytest.raises(ValueError):
        generators.gnm(spark, 5, 21, 1)
    assert abs(generators.gnp(spark, 100, 0.5, 2).edge_count() - 2475) < 200


def test_generated_arcs_are_counted_where_they_are_drawn(spark, monkeypatch):
    """Tasks draw in order and have no target in common, so no arc moves to be compared;
    other tables are counted by both ends."""
    monkeypatch.setattr(generators, "TASK_ARCS", 1000)
    for n, m in ((90, 7500), (90, 8010), (3000, 7500)):  # dense, complete, sparse
        g = generators.gnm(spark, n, m, 3)
        assert g.edges.rdd.getNumPartitions() == -(-m // 1000)
        arcs = pairs(g.edges)
        assert len(set(arcs)) == m and all(u != v and 0 <= u < n and 0 <= v < n for u, v in arcs)
        want = (0, 0, 0, m)
        assert generators.gnm_counts(spark, n, m, 3).first() == want == graph.arc_counts(g).first()
    monkeypatch.setattr(graph.F, "count_distinct", None)
    assert generators.gnm_counts(spark, 90, 7500, 3).first() == (0, 0, 0, 7500)
    assert generators.gnm_counts(spark, 1, 0, 3).first() == (0, 0, 0, 0)
    monkeypatch.undo()
    arcs = [(0, 1), (2, 2), (0, 1), (5, 0), (0, -1), (0, 1)]
    for parts in (1, 6):
        rows = spark.createDataFrame(arcs, "src long, dst long").repartition(parts)
        assert graph.arc_counts(Graph(rows, 5)).first() == (1, 2, 2, 6)


def test_generated_arcs_are_written_small(spark, tmp_path):
    """In order of sources, a task's arcs to its targets: 1.5 bytes each, not 2.8 as in random order."""
    generators.gnp(spark, 2000, 0.6, SEED).edges.write.parquet(f"{tmp_path}/arcs")
    arcs = spark.read.parquet(f"{tmp_path}/arcs").count()
    assert sum(f.stat().st_size for f in tmp_path.glob("arcs/*.parquet")) < 2 * arcs


def test_tasks_have_few_sources(spark, monkeypatch):
    """No more than fit Parquet's dictionary; tasks that share targets do not share sources, so still nothing is compared."""
    rows = generators.gnm(spark, 300_000, 600_000, 3).edges.groupBy(F.spark_partition_id()).agg(F.count_distinct("src").alias("k")).collect()
    assert len(rows) > 1 and max(r.k for r in rows) <= 131_072
    monkeypatch.setattr(generators, "TASK_ARCS", 1000)
    monkeypatch.setattr(generators, "SOURCES", 40)
    for n, m in ((90, 7500), (90, 8010), (300, 7500)):
        arcs = pairs(generators.gnm(spark, n, m, 3).edges)
        assert len(set(arcs)) == m and all(u != v and 0 <= u < n and 0 <= v < n for u, v in arcs)
        with monkeypatch.context() as apart:
            apart.setattr(graph.F, "count_distinct", None)
            assert generators.gnm_counts(spark, n, m, 3).first() == (0, 0, 0, m)
    # of two tasks with equal ranges, and of overlapping ones in one band of sources, arcs are counted by both ends
    for arcs, want in (([[(1, 2)], [(1, 2)], [(5, 0)]], 1), ([[(0, 1), (3, 1)], [(1, 5)], [(2, 1), (3, 1)]], 1), ([[(0, 1)], [(1, 1)]], 0)):
        rows = spark.sparkContext.parallelize(arcs, len(arcs)).flatMap(lambda x: x).toDF("src long, dst long")
        assert graph.arc_counts(Graph(rows, 9)).first().repeated == want


def test_sets_of_arcs_are_equally_likely(monkeypatch):
    monkeypatch.setattr(generators, "DRAWN", 2)
    found = Counter(tuple((u, v) for x in generators._arcs_into(4, 1, 3, 3, [seed]) for u, v in zip(*(y.tolist() for y in x))) for seed in range(4000))
    assert len(found) == 20 and all(u != v for arcs in found for u, v in arcs) and 140 < min(found.values()) and max(found.values()) < 260
    split = Counter(tuple(generators._dealt(np.array([2, 3]), 2, np.random.default_rng(seed)).tolist()) for seed in range(4000))
    assert sum(split.values()) == 4000 and [split[x] / 400 for x in ((2, 0), (1, 1), (0, 2))] == pytest.approx([1, 6, 3], abs=0.5)


def test_clustered(spark):
    arcs = [tuple(r) for r in generators.clustered(spark, 300, 5, 4, 9).edges.collect()]
    assert len(arcs) == len(set(arcs)) and arcs[:3] == [(0, 1), (2, 0), (2, 2)]
    out = {}
    for u, w in arcs:
        out.setdefault(u, []).append(w)
    assert all(len(out[v]) >= min(v, 5) for v in range(2, 300)) and 1 not in {w for u, w in arcs[1:]} - {1}


@pytest.mark.parametrize("d, o", [(10, 1), (5, 12), (2, 3)])
def test_attached_graphs_are_like_those_grown_in_turn(spark, monkeypatch, d, o):
    n = 3000
    g = generators.attached(spark, n, d, o, 9)
    arcs = pairs(g.edges)
    monkeypatch.setattr(generators, "_BLOCK", 700)
    assert arcs == pairs(generators.attached(spark, n, d, o, 9).edges) != pairs(generators.attached(spark, n, d, o, 8).edges)
    assert len(arcs) == len(set(arcs)) and all(0 <= u < n and 0 <= v < n for u, v in arcs)
    turn = list(generators._grow(n, d, o, 9))
    assert len(arcs) == pytest.approx(len(turn), rel=0.02)
    outs, outs_turn = (sorted(Counter(u for u, _ in x).values(), reverse=True) for x in (arcs, turn))
    assert min(outs[: n - 2]) >= min(2, d) and sum(outs[:30]) == pytest.approx(sum(outs_turn[:30]), rel=0.35)
    assert all(c >= d for u, c in Counter(u for u, _ in arcs).items() if u >= 512)
    mean, mean_turn = (clustering.clustering_exact(Graph(spark.createDataFrame(x, "src long, dst long"), n)).first().clustering for x in (arcs, turn))
    assert mean == pytest.approx(mean_turn, rel=0.15)


def test_large_graphs_are_not_grown_by_one_task(spark, monkeypatch):
    monkeypatch.setattr(generators, "TURN_MOST", 1000)
    grid = spark.createDataFrame([(0, 1000, 10, 5, 3), (1, 3000, 10, 5, 3)], "graph long, n long, d long, o long, seed long")
    rows = pairs(generators.clustered_grid(grid))
    assert [(u, w) for g, u, w in rows if g == 0] == sorted(generators._grow(1000, 10, 5, 3))
    assert [(u, w) for g, u, w in rows if g == 1] == pairs(generators.attached(spark, 3000, 10, 5, 3).edges)


def test_attached_arcs_move_once(spark):
    """The distinct arcs of a source lie in one place, so counts by source move nothing."""
    counts = queries._grown_shape(generators.attached(spark, 3000, 10, 5, 3).edges)
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning(src") == 1 and "hashpartitioning(graph" in plan and "hashpartitioning(src#" in plan


def test_stream_registers_equal_batch(spark, tmp_path):
    rows = spark.range(500).selectExpr("id % 90 as value", "timestamp_seconds(1700000000 + id * 3) as time")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sketches.windowed_registers(stream, "value", "time", "10 minutes", "1 hour", 5, 3).writeStream.format("memory").queryName("reg").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.table("reg")) == pairs(sketches.windowed_registers(rows, "value", "time", "10 minutes", "1 hour", 5, 3))


def test_many_places_are_drawn_by_gaps(spark, monkeypatch):
    """Nothing is sorted or drawn again, any place is as likely as others, neighbours do not depend on each other."""
    for q in (0.0012, 0.01, 0.3, 0.5):
        table, rare, rest = generators._gaps(q)
        share = (1 - rare) * np.bincount(table, minlength=len(rest) + 1)[1:] / 65536 + rare * np.diff(rest, prepend=0)
        assert np.abs(share - q * (1 - q) ** np.arange(len(rest))).max() < 1e-15
    size, k, barred, none = 50_000, 5000, np.arange(7, 50_000, 100), np.zeros(0, np.int64)
    times, pairs_found = np.zeros(size), 0
    with monkeypatch.context() as unsorted:
        unsorted.setattr(generators.np, "sort", None)
        for seed in range(200):
            at = generators._chosen(size, none, k, np.random.default_rng(seed))
            assert len(at) == k and at[0] >= 0 and at[-1] < size and (np.diff(at) > 0).all()
            times[at] += 1
            pairs_found += np.count_nonzero(np.diff(at) == 1)
    assert abs(((times - 20) ** 2).sum() / (20 * 0.9) - size) < 5 * (2 * size) ** 0.5
    assert abs(pairs_found - 200 * k * (k - 1) / size) < 5 * (200 * k * k / size) ** 0.5
    for seed in range(20):
        at = generators._chosen(size, barred, k, np.random.default_rng(seed))
        assert len(set(at.tolist()) - set(barred.tolist())) == k == len(at)
    # through Spark, in blocks with loops and without
    monkeypatch.setattr(generators, "TASK_ARCS", 30_000)
    monkeypatch.setattr(generators, "DRAWN", 10_000)
    monkeypatch.setattr(generators, "TOGETHER", 2)
    g = generators.gnm(spark, 1500, 200_000, 3)
    assert g.edges.distinct().count() == 200_000 and g.edges.filter("src = dst").isEmpty() and len(g.inside().take(1))
    tasks = generators._made(spark, 1500, 200_000, 3, count=True)
    assert tasks.count() == 7 and tasks.filter("ascend and loops = 0 and outside = 0").count() == 7
    assert generators.gnm_counts(spark, 1500, 200_000, 3).first() == (0, 0, 0, 200_000) == graph.arc_counts(g).first()
    one = generators.gnp_grid(spark.createDataFrame([(1, 400, 0.5, 7)], "graph long, n long, p double, seed long"))
    assert one.distinct().count() == generators._arcs(400, 0.5, 7) and one.filter("src = dst or src not between 0 and 399 or dst not between 0 and 399").isEmpty()


def test_blocks_of_arcs_are_tallied():
    def tallied(*blocks):
        return tuple(graph.tally(5, [[np.array(x, np.int32) for x in zip(*b)] for b in blocks]).to_pylist()[0].values())

    assert tallied([(0, 1), (0, 3)], [(1, 0), (4, 4)]) == (4, 1, 0, True, 0, 4, 0, 4)
    assert tallied([(0, 1), (0, 3)], [(0, 3)])[3] is False is tallied([(0, 3), (0, 1)])[3] is tallied([(1, 0), (0, 1)])[3] is tallied([(2, 1)], [(1, 2)])[3]
    assert tallied([(0, 7), (3, 3), (3, -1)])[:4] == (3, 1, 2, False)
    assert graph.tally(5, []).to_pylist()[0]["arcs"] == 0
