"""The registered graph queries and the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, registers, sketch
from ..operators import clustering, components, disjoint_set, generators, mincut, paths
from ..operators.graph import Graph, dense_ids
from ..operators.labels import Labels
from ..sources import derived, edges
from ..sources.store import EdgeStore
from .storage import new_path

SEED = 0xBAD5EED


def _round(df, *columns):
    return df.select(*(F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns))


def edge_load(s, d):
    return derived.trade(s, d).edges


def vertex_count(s, d):
    return derived.trade(s, d).vertices.agg(F.count(F.lit(1)).alias("vertices"))


def edge_count(s, d):
    return derived.trade(s, d).edges.agg(F.count(F.lit(1)).alias("edges"))


def weighted_load(s, d):
    items = derived.table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    g = Graph.from_edges(items, "l_suppkey", "l_partkey", "l_linenumber")
    return g.edges.groupBy("src").agg(F.sum("weight").cast("long").alias("weight"), F.count(F.lit(1)).alias("arcs"))


def adjacency_sizes(s, d):
    return derived.trade(s, d).adjacency().select("vertex", F.size("neighbours").cast("long").alias("neighbours"))


def adjacency_lines(s, d):
    return derived.trade(s, d).lines()


def adjacency_flattened(s, d):
    g = derived.trade(s, d)
    return g.arcs_of(g.adjacency())


def neighbours_of(s, d):
    return derived.trade(s, d).neighbours(3)


def out_degree_gt2(s, d):
    return derived.trade(s, d).out_degrees().filter("degree > 2")


def _pairs(s, d):
    return derived.table(s, d, "events").select((F.col("user_id") % 50).alias("src"), F.col("user_id").alias("dst")).distinct()


def has_link_semi(s, d):
    return Graph(derived.session(s, d), 0).has_link(_pairs(s, d))


def has_link_anti(s, d):
    return Graph(derived.session(s, d), 0).lacks_link(_pairs(s, d))


def add_links(s, d):
    g = derived.trade(s, d).with_links(s.createDataFrame([(0, 27), (27, 1), (1, 1)], "src long, dst long")).with_vertex(30)
    return g.out_degrees().join(g.vertices, "vertex", "right").select("vertex", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def literal_weights(s, d):
    """Regions in a ring, each arc as heavy as the region's name is long."""
    regions = derived.table(s, d, "region").select("r_regionkey", "r_name").collect()  # five rows
    g = Graph.literal(s, len(regions), [(r.r_regionkey, (r.r_regionkey + 1) % len(regions), len(r.r_name)) for r in regions])
    sums = g.edges.groupBy("src").agg(F.sum("weight").alias("w"))
    return g.vertices.join(sums, F.col("vertex") == F.col("src"), "left").select("vertex", F.coalesce("w", F.lit(0)).cast("long").alias("weight"))


def add_weighted_links(s, d):
    items = derived.table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    g = Graph.from_edges(items, "l_suppkey", "l_partkey", "l_linenumber")
    more = derived.table(s, d, "supplier").select(F.col("s_suppkey").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(100).alias("weight"))
    return g.with_links(more).edges.groupBy("src").agg(F.sum("weight").cast("long").alias("weight"), F.count(F.lit(1)).alias("arcs"))


def empty_graph(s, d):
    g = Graph.literal(s, 0, []).with_links(derived.session(s, d))
    return g.edges.agg(F.count(F.lit(1)).alias("edges"), F.lit(g.n).cast("long").alias("vertices"))


def edge_files(s, d):
    path = new_path(s, "edges")
    edges.write_edges(Graph(derived.session(s, d), 0), path, 4)
    return edges.read_edges(s, path).edges


def edge_text_file(s, d):
    """Lines of source and target with remarks between them."""
    path = new_path(s, "text")
    lines = derived.table(s, d, "lineitem").select(F.concat_ws(" ", "l_suppkey", "l_partkey").alias("value"))
    remarks = derived.table(s, d, "nation").select(F.explode(F.array(F.concat(F.lit("# "), "n_name"), F.lit(""))).alias("value"))
    lines.unionByName(remarks).write.text(path)
    return edges.read_edge_text(s, path).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("arcs"))


def edge_csv_file(s, d):
    path = new_path(s, "csv")
    derived.table(s, d, "orders").select(F.col("o_custkey").alias("from"), F.col("o_orderkey").alias("to"), F.year("o_orderdate").alias("cost")).write.option("header", True).csv(path)
    return edges.read_edges(s, path, "csv", "from", "to", "cost", header=True, inferSchema=True, comment="#").edges.withColumn("weight", F.col("weight").cast("long"))


def stored_rows(s, d):
    """Arcs of chosen sources, read from their buckets, and the arcs behind them."""
    store = EdgeStore(Graph(derived.session(s, d), 0))
    near = store.rows([3, 5, 8])
    return near.select("src", F.col("dst").alias("mid")).join(store.graph.edges.toDF("mid", "dst"), "mid").select("src", "mid", "dst")


def labels_in_batches(s, d):
    """Three batches of arcs; a fourth that joins all is taken back before the last."""
    g = derived.reorders(s, d)
    batch = lambda i: g.edges.filter(F.col("src") % 3 == i)
    saved = Labels(s, g.n).joined(batch(0)).joined(batch(1))
    gone = saved.joined(s.range(1, g.n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")))
    assert gone.count() == 1
    back = saved.joined(batch(2))
    return back.all().withColumn("components", F.lit(back.count()).cast("long"))


def exact_size(s, d):
    return derived.trade(s, d).exactly(10)


def dense_vertex_ids(s, d):
    return dense_ids(derived.table(s, d, "orders"), "o_custkey")


def clustering_local(s, d):
    return _round(clustering.local_clustering(derived.trade(s, d)), "coefficient")


def clustering_exact(s, d):
    return _round(clustering.clustering_exact(derived.trade(s, d)), "clustering")


def clustering_session(s, d):
    return _round(clustering.clustering_exact(Graph(derived.session(s, d), 0)), "clustering")


def clustering_local_two(s, d):
    return _round(clustering.local_clustering(derived.trade(s, d), 2), "coefficient")


def clustering_sampled(s, d):
    return _round(clustering.clustering_sampled(derived.trade(s, d), 20_000, SEED), "clustering")


def clustering_sampled_session(s, d):
    return _round(clustering.clustering_sampled(Graph(derived.session(s, d), 0), 20_000, SEED), "clustering")


def bfs_distances(s, d):
    return paths.bfs_distances(derived.trade(s, d))


def bfs_directed(s, d):
    return paths.bfs_distances(derived.trade(s, d), symmetric=False)


def bfs_from_sample(s, d):
    return paths.bfs_distances(derived.reorders(s, d), derived.first_orders(s, d), symmetric=False)


def ball_limit_chains(s, d):
    return _round(paths.ball_limit(derived.reorders(s, d)), "ball_limit")


def apl_exact(s, d):
    return _round(paths.average_path_length(derived.trade(s, d)), "apl")


def apl_textbook(s, d):
    return _round(paths.average_path_length(derived.trade(s, d), "pairs"), "apl")


def apl_twin_fives(s, d):
    return _round(paths.average_path_length(edges.two_blocks(s, _count(s, d, "region"), [(2, 6), (4, 5), (3, 7)])), "apl")


def apl_catalogue(s, d):
    return _round(paths.average_path_length(derived.catalogue(s, d), "pairs"), "apl")


def distance_counts(s, d):
    return paths.distance_counts(derived.trade(s, d))


def reach_reorders(s, d):
    return paths.reach_registers(derived.reorders(s, d), 4, SEED)


def hyper_ball_reorders(s, d):
    return paths.hyper_ball(derived.reorders(s, d), 4, SEED).select(F.round("hyper_ball", 6).alias("hyper_ball"), "rounds")


def ball_limit(s, d):
    return _round(paths.ball_limit(derived.trade(s, d)), "ball_limit")


def hyper_ball(s, d):
    return paths.hyper_ball(derived.trade(s, d), 10, SEED)


def reach_counts(s, d):
    return paths.reach_registers(edges.two_blocks(s, _count(s, d, "region"), [(2, 6), (4, 5), (3, 7)]), 4, SEED)


def graph_union_bridges(s, d):
    return edges.two_blocks(s, 2 * _count(s, d, "region"), [(i, 10 + i) for i in range(1, 5)]).edges


def connected_components(s, d):
    return components.connected_components(derived.reorders(s, d))


def components_supply(s, d):
    return components.component_count(components.connected_components(derived.supply(s, d)))


def are_connected(s, d):
    g = derived.reorders(s, d)
    labels = components.connected_components(g)
    pairs = g.vertices.select(F.col("vertex").alias("a"), ((F.col("vertex") * 7 + 3) % g.n).alias("b"))
    return components.are_connected(labels, pairs)


def min_cut_size(s, d):
    return mincut.min_cut_size(derived.region_flow(s, d), 20, SEED)


def min_cut_size_undo(s, d):
    return mincut.min_cut_size(derived.region_flow(s, d), "low ones", SEED, strategy="undo")


def min_cut_trade(s, d):
    return mincut.min_cut_size(derived.trade(s, d), None, SEED)


def min_cut_months(s, d):
    return mincut.min_cut_size(derived.months(s, d), None, SEED)


def min_cut_months_arcs(s, d):
    arcs = mincut.min_cut(derived.months(s, d), None, SEED, strategy="undo", find_mode="splitting")
    return arcs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("arcs"))


def min_cut_segments(s, d):
    return mincut.min_cut_size(derived.segments(s, d), "low ones", SEED, strategy="undo", find_mode="compression")


def min_cut_ring(s, d):
    return mincut.min_cut_size(derived.customer_ring(s, d), None, SEED)


def min_cut_session(s, d):
    users = derived.table(s, d, "events").agg(F.max("user_id")).first()[0] + 1
    return mincut.min_cut_size(Graph(derived.session(s, d), users), 4, SEED)


BLOCK = 1 << 20  # customer keys in a window


def _chains(s, d):
    """(grp, u, v): each customer and the one before it of its nation and segment,
    in blocks of keys; the first of a block and the first of the block before."""
    of = ["grp", "c_mktsegment"]
    rows = derived.table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), "c_mktsegment", F.col("c_custkey").alias("u"), F.floor(F.col("c_custkey") / BLOCK).alias("block"))
    inner = rows.withColumn("v", F.lag("u").over(Window.partitionBy(*of, "block").orderBy("u"))).filter("v is not null")
    heads = rows.groupBy(*of, "block").agg(F.min("u").alias("u")).withColumn("v", F.lag("u").over(Window.partitionBy(*of).orderBy("block")))
    return inner.select("grp", "u", "v").unionByName(heads.select("grp", "u", F.coalesce("v", "u").alias("v")))


def union_find_labels(s, d):
    return disjoint_set.grouped_labels(_chains(s, d), "halving")


def union_find_compression(s, d):
    return disjoint_set.grouped_labels(_chains(s, d), "compression")


def union_find_undo(s, d):
    return disjoint_set.grouped_labels(_chains(s, d), "splitting", undo=True)


def min_cut_edges(s, d):
    return mincut.min_cut(edges.two_blocks(s, _count(s, d, "region"), [(2, 6), (4, 5), (3, 7)]), 20, SEED)


def min_cut_tens(s, d):
    return mincut.min_cut(edges.two_blocks(s, 2 * _count(s, d, "region"), [(i, 10 + i) for i in range(1, 5)]), None, SEED)


def _values(s, d):
    return derived.table(s, d, "events").select(F.length("event_type").cast("long").alias("key"), F.col("user_id").alias("value"))


def jenkins_hash(s, d):
    keys = derived.table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return keys.select("id", F.hex(hashing.jenkins64(F.col("id"), SEED)).alias("hash"))


def hll_registers(s, d):
    return sketch.hll_registers(_values(s, d), 6, SEED)


def hll_registers_all_sizes(s, d):
    return sketch.hll_registers_of_sizes(_values(s, d), [4, 5, *range(7, 16)], SEED)


def hll_compact(s, d):
    packed = sketch.hll_compact(sketch.hll_registers(_values(s, d), 6, SEED), 6, 1 << 32)
    return sketch.hll_expand(packed, 6, 1 << 32)


def hll_compact_bytes(s, d):
    packed = sketch.hll_compact(sketch.hll_registers(_values(s, d), 6, SEED), 6, 1 << 32)
    return packed.select("key", F.length("packed").cast("long").alias("bytes"))


def hll_estimate(s, d):
    return _round(sketch.hll_estimate(sketch.hll_registers(_values(s, d), 6, SEED), 6), "estimate")


def hll_range(s, d):
    return _round(sketch.hll_estimate_range(sketch.hll_registers(_values(s, d), 6, SEED), 6), "estimate", "low", "high")


def hll_union(s, d):
    events, orders = _values(s, d), derived.table(s, d, "orders").select(F.lit(11).cast("long").alias("key"), F.col("o_custkey").alias("value"))
    return sketch.hll_union(sketch.hll_registers(events, 6, SEED), sketch.hll_registers(orders, 6, SEED))


def hll_packed_union(s, d):
    events, orders = _values(s, d), derived.table(s, d, "orders").select(F.lit(11).cast("long").alias("key"), F.col("o_custkey").alias("value"))
    packed = [sketch.hll_compact(sketch.hll_registers(x, 6, SEED), 6, 1 << 32) for x in (events, orders)]
    return sketch.hll_expand(sketch.hll_merge_packed(packed[0].unionByName(packed[1]), 6, 1 << 32), 6, 1 << 32)


def hll_packed_rollup(s, d):
    """Users' sketches a day, packed, put together for all days."""
    days = derived.table(s, d, "events").select(F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("key"), F.col("user_id").alias("value"))
    packed = sketch.hll_compact(sketch.hll_registers(days, 6, SEED), 6, 1 << 32)
    return sketch.hll_expand(sketch.hll_merge_packed(packed, 6, 1 << 32, F.lit(0)), 6, 1 << 32)


def register_shape(s, d):
    rows = derived.table(s, d, "customer").select("c_custkey", _registers(3).alias("a"))
    packed = rows.select("c_custkey", registers.size(F.col("a")).cast("long").alias("registers"), registers.pack(F.col("a"), 5).alias("p"))
    return packed.select("c_custkey", "registers", registers.width_of(F.col("p"), 13).cast("long").alias("bits"), F.octet_length("p").cast("long").alias("bytes"))


def hll_rollup(s, d):
    return sketch.hll_rollup(sketch.hll_registers(_values(s, d), 6, SEED), F.lit(0).cast("long"))


def approx_distinct_native(s, d):
    return sketch.approx_distinct(_values(s, d))


def _registers(k):
    return F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: ((F.col("c_custkey") * k + i * 5) % 32).cast("tinyint"))


def register_merge(s, d):
    rows = derived.table(s, d, "customer").select("c_custkey", _registers(3).alias("a"), _registers(11).alias("b"))
    merged = registers.merge(F.col("a"), F.col("b"))
    return rows.select("c_custkey", F.aggregate(merged, F.lit(0).cast("long"), lambda t, x: t + x).alias("total"), registers.changed(F.col("a"), F.col("b")).alias("changed"), registers.get(F.col("a"), 4).cast("long").alias("fifth"))


def register_round_trip(s, d):
    rows = derived.table(s, d, "customer").select("c_custkey", _registers(3).alias("a"))
    back = registers.unpack(registers.pack(F.col("a"), 5), 5, 13)
    bits = registers.bits_text(F.col("a"), 5)
    return rows.select("c_custkey", back.alias("a"), bits.alias("bits")).select("c_custkey", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("registers"), "bits")


def _count(s, d, name):
    return derived.table(s, d, name).count()


def gnm(s, d):
    """As many vertices as customers and arcs as orders."""
    return generators.gnm(s, _count(s, d, "customer"), _count(s, d, "orders"), SEED).edges


def gnp(s, d):
    return generators.gnp(s, _count(s, d, "supplier"), 0.6, SEED).edges


def gnp_shape(s, d):
    """Whether the number of arcs lies within six deviations of the mean."""
    n = _count(s, d, "part")
    pairs, p = n * (n - 1) // 2, 0.02
    near = F.abs(F.col("arcs") - pairs * p) < 6 * (pairs * p * (1 - p)) ** 0.5
    return generators.gnp_counts(s, n, p, SEED).select("loops", "outside", "repeated", near.alias("near"), F.lit(n).cast("long").alias("vertices"))


def gnm_shape(s, d):
    """Vertices as customers, arcs as lines."""
    n = _count(s, d, "customer")
    return generators.gnm_counts(s, n, _count(s, d, "lineitem"), SEED)


def _grown_shape(e):
    """Every vertex from 2 on starts min(v, d) arcs at least; arcs are distinct."""
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("k"))
    return out.filter("src >= 2").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("n") < F.least("src", F.lit(10))).alias("short"), F.sum(F.col("n") - F.col("k")).alias("repeated"))


def clustered_shape(s, d):
    return _grown_shape(generators.clustered(s, _count(s, d, "customer"), 10, 5, SEED).edges)


def attached_shape(s, d):
    return _grown_shape(generators.attached(s, _count(s, d, "orders"), 10, 5, SEED).edges)


def clustered(s, d):
    """Graphs of as many vertices as customers, one for each number of triads."""
    n = _count(s, d, "customer")
    grid = [(i, n, 10, o, SEED) for i, o in enumerate((1, 2, 3, 5, 8, 12, 50))]
    return generators.clustered_grid(s.createDataFrame(grid, "graph long, n long, d long, o long, seed long").repartition(len(grid)))


def complete_graph(s, d):
    return edges.complete(s, _count(s, d, "region")).lines()


_NAMES = [
    edge_load, vertex_count, edge_count, weighted_load, adjacency_sizes, adjacency_lines, adjacency_flattened, neighbours_of, out_degree_gt2,
    has_link_semi, has_link_anti, stored_rows, edge_text_file, edge_csv_file, labels_in_batches, hll_packed_union, hll_packed_rollup, register_shape, add_links, exact_size, dense_vertex_ids, clustering_local, clustering_exact, clustering_session,
    clustering_local_two, clustering_sampled, clustering_sampled_session, apl_catalogue, distance_counts, reach_reorders, hyper_ball_reorders, bfs_distances, bfs_directed, bfs_from_sample, ball_limit_chains, literal_weights, add_weighted_links, empty_graph, edge_files, apl_exact, apl_textbook, apl_twin_fives, ball_limit, hyper_ball, reach_counts,
    graph_union_bridges, connected_components, components_supply, are_connected, min_cut_size, min_cut_size_undo, min_cut_months, min_cut_months_arcs, min_cut_segments, min_cut_ring, min_cut_trade, min_cut_session,
    union_find_labels, union_find_compression, union_find_undo, hll_registers_all_sizes, hll_compact, hll_compact_bytes, gnm_shape, gnp_shape, clustered_shape, attached_shape, min_cut_edges, min_cut_tens, jenkins_hash,
    hll_registers, hll_estimate, hll_range, hll_union, hll_rollup, approx_distinct_native, register_merge, register_round_trip, gnm, gnp, clustered,
    complete_graph,
]


def queries():
    return {f.__name__: f for f in _NAMES}


# ---- SQL ---------------------------------------------------------------

_LINES = """shipped AS (
  SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
_TRADE = f"""{_LINES},
flows AS (SELECT src, dst, count(*) AS n FROM shipped WHERE src <> dst GROUP BY 1, 2),
trade AS (SELECT src, dst FROM flows WHERE n > (SELECT avg(n) FROM flows))"""
_REGIONS = f"""{_LINES},
flow AS (SELECT a.n_regionkey::BIGINT AS src, b.n_regionkey::BIGINT AS dst FROM shipped JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey)"""
_CHAINS = """steps AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS size, first_value(o_orderkey) OVER w AS head
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
least AS (SELECT o_orderkey AS vertex, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders)"""
_SEGMENTS = "SELECT c_nationkey::BIGINT AS grp, c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS label FROM customer"
_SESSION = """session AS (
  SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst)"""
_TWINS = """blocks AS (SELECT a.range AS src, b.range AS dst FROM range({size}) a, range({size}) b WHERE a.range <> b.range),
twins AS (SELECT src, dst FROM blocks UNION ALL SELECT src + {size}, dst + {size} FROM blocks UNION ALL SELECT src::BIGINT, dst::BIGINT FROM (VALUES {bridges}) v(src, dst))"""
_FIVES = _TWINS.format(size="(SELECT count(*) FROM region)", bridges="(2, 6), (4, 5), (3, 7)")
_TENS = _TWINS.format(size="(SELECT 2 * count(*) FROM region)", bridges="(1, 11), (2, 12), (3, 13), (4, 14)")


def _local(arcs, degree=3):
    return f"""degrees AS (SELECT src AS v, count(*) AS degree FROM {arcs} GROUP BY 1 HAVING count(*) >= {degree}),
local AS (SELECT v, degree, (SELECT count(*) FROM {arcs} x, {arcs} y, {arcs} z WHERE x.src = v AND y.src = v AND x.dst <> y.dst AND z.src = x.dst AND z.dst = y.dst) AS closed FROM degrees)"""


def _closed(arcs):
    return f"""degrees AS (SELECT src AS v, count(*) AS degree FROM {arcs} GROUP BY 1 HAVING count(*) >= 3),
shut AS (SELECT x.src AS v, count(*) AS closed FROM {arcs} x JOIN {arcs} z ON z.src = x.dst JOIN {arcs} y ON y.src = x.src AND y.dst = z.dst WHERE x.dst <> y.dst GROUP BY 1),
local AS (SELECT d.v, degree, coalesce(closed, 0) AS closed FROM degrees d LEFT JOIN shut s ON d.v = s.v)"""


def _bfs(arcs, n, symmetric=True):
    both = f"SELECT src, dst FROM {arcs} UNION SELECT dst, src FROM {arcs}" if symmetric else f"SELECT src, dst FROM {arcs}"
    return f"""ways AS ({both}),
walk AS (SELECT range AS s, range AS d, 0 AS dist FROM range({n}) UNION SELECT s, dst, dist + 1 FROM walk JOIN ways ON d = src WHERE dist < {n}),
far AS (SELECT s, d, min(dist)::INTEGER AS dist FROM walk GROUP BY 1, 2)"""


def _apl(arcs, n, divisor):
    return f"SELECT CASE WHEN count(*) = {n * (n - 1)} THEN round(sum(dist) / {divisor}, 9) END AS apl, count(*) AS reachable_pairs, {n}::BIGINT AS vertices FROM far WHERE s <> d"


_M64 = "18446744073709551616"


def _jenkins(rows, value):
    """CTEs jk0 .. jk12: the 64-bit mix in HUGEINT arithmetic; ``rows`` has id."""
    shifts = [(43, 9, 8), (38, 23, 5), (35, 49, 11), (12, 18, 22)]
    out, k = [f"jk0 AS MATERIALIZED (SELECT *, (({value})::HUGEINT + {SEED}) % {_M64} AS a, {SEED}::HUGEINT AS b, 11400714819323198483::HUGEINT AS c FROM {rows})"], 0
    for right, left, low in shifts:
        for t, (x, y, z), s in ((0, "abc", right), (1, "bca", left), (2, "cab", low)):
            taken = f"((({x} - {y} - {z}) % {_M64} + {_M64}) % {_M64})"
            moved = f"({z} * {2**s}::HUGEINT % {_M64})" if t == 1 else f"({z} // {2**s}::HUGEINT)"
            out.append(f"jk{k + 1} AS MATERIALIZED (SELECT * REPLACE (xor({taken}, {moved}) AS {x}) FROM jk{k})")
            k += 1
    return ", ".join(out)


def _mult(value):
    """value * multiplier modulo 2^64 without leaving 128 bits."""
    low, high = hashing.INTEGER % 2**32, hashing.INTEGER // 2**32
    return f"(({value}::HUGEINT * {low} + ({value}::HUGEINT * {high} % 4294967296) * 4294967296) % {_M64})"


def _regs(rows, name, b=6):
    return f"""{_jenkins(rows, _mult('value'))},
{name} AS (SELECT key, (c % {2**b})::INTEGER AS idx, max(CASE WHEN c // {2**b} = 0 THEN 65 ELSE 1 + (SELECT min(t.range) FROM range(64) t WHERE (c // {2**b}) // (2::HUGEINT ** t.range)::HUGEINT % 2 = 1) END)::INTEGER AS val FROM jk12 GROUP BY 1, 2)"""


_VALUES = "v AS (SELECT length(event_type)::BIGINT AS key, user_id AS value FROM events)"
_BOTH = "v AS (SELECT length(event_type)::BIGINT AS key, user_id AS value FROM events UNION ALL SELECT 11::BIGINT, o_custkey FROM orders)"
_EST = """sums AS (SELECT key, sum(2.0 ** -val) + 64 - count(*) AS p, 64 - count(*) AS z FROM regs GROUP BY 1),
est AS (SELECT key, CASE WHEN 0.709 * 64 * 64 / p <= 160 AND z > 0 THEN 64.0 * ln(64.0 / z) ELSE 0.709 * 64 * 64 / p END AS e FROM sums)"""
def _cuts(arcs, n):
    """Sizes of all cuts of an n-vertex graph; vertex n - 1 stays on one side."""
    return f"cuts AS (SELECT side.range AS side, count(*) FILTER ((side.range >> src::INTEGER) & 1 <> (side.range >> dst::INTEGER) & 1) AS size FROM range(1, {2 ** (n - 1)}) side, {arcs} GROUP BY 1)"


def _weighted_cuts(flows, n):
    """The same from (src, dst, w)."""
    return f"cuts AS (SELECT side.range AS side, sum(w) FILTER ((side.range >> src::INTEGER) & 1 <> (side.range >> dst::INTEGER) & 1)::BIGINT AS size FROM range(1, {2 ** (n - 1)}) side, {flows} GROUP BY 1)"


def _mask_cut(arcs, n):
    """The smallest cut from a word of out-neighbours a vertex, vertex n - 1 on one side."""
    words = ", ".join(f"coalesce(bit_or(1 << dst::INTEGER) FILTER (src = {v} AND dst <> src), 0) AS m{v}" for v in range(n))
    size = " + ".join(f"bit_count(m{v} & xor(s, -((s >> {v}) & 1)))::INTEGER" for v in range(n))
    return f"words AS (SELECT {words} FROM {arcs}) SELECT min({size})::BIGINT AS cut_size FROM (SELECT range AS s FROM range(1, {2 ** (n - 1)})), words"


def _sampled(arcs, k):
    """Draws i of trials t by the mix of 3 t + i, without its lowest bit."""
    return f"""places AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place FROM {arcs}),
near AS (SELECT src, count(*) AS degree, row_number() OVER (ORDER BY src) - 1 AS rank FROM {arcs} GROUP BY src HAVING count(*) >= 3),
v AS (SELECT range AS id FROM range({3 * k})), {_jenkins('v', 'id')},
draws AS (SELECT id // 3 AS t, max(c // 2) FILTER (id % 3 = 0) AS x, max(c // 2) FILTER (id % 3 = 1) AS y, max(c // 2) FILTER (id % 3 = 2) AS z FROM jk12 GROUP BY 1),
drawn AS (SELECT t, src, y % degree AS a, (y % degree + 1 + z % (degree - 1)) % degree AS b FROM draws JOIN near ON rank = x % (SELECT count(*) FROM near))
SELECT round(count(e.src) / {k}.0, 9) AS clustering, {k}::BIGINT AS samples FROM drawn d JOIN places p ON p.src = d.src AND p.place = a JOIN places q ON q.src = d.src AND q.place = b
LEFT JOIN {arcs} e ON e.src = p.dst AND e.dst = q.dst"""


_MONTHS = """flow AS (SELECT month(o_orderdate) - 1 AS src, month(l_shipdate) - 1 AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_SEGMENT_FLOW = """flow AS (SELECT dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS src, dense_rank() OVER (ORDER BY o_orderpriority) - 1 + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS dst, w
  FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2))"""
#: Every arc of a tree parts its subtree from the rest.
_CATALOGUE = """sizes AS (SELECT 1 AS below FROM part UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 + count(*) FROM part GROUP BY p_brand
  UNION ALL SELECT 1 + count(s_suppkey) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey), total AS (SELECT count(*) + 1 AS n FROM sizes)"""
#: Reach of every order along its chain, ids without an order reach themselves.
_AHEAD = """ids AS (SELECT range AS value FROM range((SELECT max(o_orderkey) + 1 FROM orders))), hashed AS (SELECT value AS id, value FROM ids)"""
_ORDER_REGS = """own AS MATERIALIZED (SELECT id, (c % 16)::INTEGER AS idx, (1 + (SELECT min(t.range) FROM range(64) t WHERE (c // 16) // (2::HUGEINT ** t.range)::HUGEINT % 2 = 1))::INTEGER AS val FROM jk12)"""
_REGS = "(SELECT c_custkey, i, (c_custkey * 3 + i * 5) % 32 AS a, (c_custkey * 11 + i * 5) % 32 AS b FROM customer, (SELECT unnest(range(13)) AS i))"


def oracle_sql():
    pairs = "pairs AS (SELECT DISTINCT user_id % 50 AS src, user_id AS dst FROM events)"
    lists = "SELECT vertex, vertex || ': ' || coalesce(string_agg(dst::VARCHAR, ' -> ' ORDER BY dst), '') AS line"
    return {
        "edge_load": f"WITH {_TRADE} SELECT * FROM trade",
        "vertex_count": "SELECT count(*) AS vertices FROM nation",
        "edge_count": f"WITH {_TRADE} SELECT count(*) AS edges FROM trade",
        "weighted_load": "SELECT l_suppkey AS src, sum(l_linenumber)::BIGINT AS weight, count(*) AS arcs FROM lineitem GROUP BY 1",
        "adjacency_sizes": f"WITH {_TRADE} SELECT range AS vertex, count(dst) AS neighbours FROM range(25) LEFT JOIN trade ON src = range GROUP BY 1",
        "adjacency_lines": f"WITH {_TRADE} {lists} FROM (SELECT range AS vertex FROM range(25)) LEFT JOIN trade ON src = vertex GROUP BY 1",
        "adjacency_flattened": f"WITH {_TRADE} SELECT * FROM trade",
        "neighbours_of": f"WITH {_TRADE} SELECT dst FROM trade WHERE src = 3",
        "out_degree_gt2": f"WITH {_TRADE} SELECT src AS vertex, count(*) AS degree FROM trade GROUP BY 1 HAVING count(*) > 2",
        "has_link_semi": f"WITH {_SESSION}, {pairs} SELECT * FROM pairs p WHERE EXISTS (SELECT 1 FROM session e WHERE e.src = p.src AND e.dst = p.dst)",
        "has_link_anti": f"WITH {_SESSION}, {pairs} SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM session e WHERE e.src = p.src AND e.dst = p.dst)",
        "add_links": f"WITH {_TRADE}, arcs AS (SELECT * FROM trade UNION ALL VALUES (0, 27), (27, 1), (1, 1)) SELECT range AS vertex, count(dst) AS degree FROM range(30 + 1) LEFT JOIN arcs ON src = range GROUP BY 1",
        "literal_weights": "SELECT r_regionkey::BIGINT AS vertex, length(r_name)::BIGINT AS weight FROM region",
        "add_weighted_links": "SELECT src, sum(w)::BIGINT AS weight, count(*) AS arcs FROM (SELECT l_suppkey AS src, l_linenumber AS w FROM lineitem UNION ALL SELECT s_suppkey, 100 FROM supplier) GROUP BY 1",
        "empty_graph": f"WITH {_SESSION} SELECT count(*) AS edges, (max(greatest(src, dst)) + 1)::BIGINT AS vertices FROM session",
        "edge_files": f"WITH {_SESSION} SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM session",
        "edge_text_file": "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS arcs FROM lineitem GROUP BY 1, 2",
        "edge_csv_file": "SELECT o_custkey AS src, o_orderkey AS dst, year(o_orderdate) AS weight FROM orders",
        "stored_rows": f"WITH {_SESSION} SELECT a.src, b.src AS mid, b.dst FROM session a JOIN session b ON a.dst = b.src WHERE a.src IN (3, 5, 8)",
        "labels_in_batches": f"WITH {_CHAINS}, found AS (SELECT range AS vertex, coalesce(component, range) AS component FROM range((SELECT max(o_orderkey) + 1 FROM orders)) LEFT JOIN least ON vertex = range) SELECT vertex, component, (SELECT count(DISTINCT component) FROM found) AS components FROM found",
        "exact_size": f"WITH {_TRADE} SELECT * FROM trade ORDER BY src, dst LIMIT 10",
        "dense_vertex_ids": "SELECT o_custkey AS key, row_number() OVER (ORDER BY o_custkey) - 1 AS vertex FROM (SELECT DISTINCT o_custkey FROM orders)",
        "clustering_local": f"WITH {_TRADE}, {_local('trade')} SELECT v AS vertex, degree, closed, round(closed / (degree * (degree - 1)), 9) AS coefficient FROM local",
        "clustering_exact": f"WITH {_TRADE}, {_local('trade')} SELECT round(avg(closed / (degree * (degree - 1))), 9) AS clustering, count(*) AS eligible FROM local",
        "clustering_local_two": f"WITH {_TRADE}, {_local('trade', 2)} SELECT v AS vertex, degree, closed, round(closed / (degree * (degree - 1)), 9) AS coefficient FROM local",
        "clustering_sampled": f"WITH {_TRADE}, {_sampled('trade', 20_000)}",
        "clustering_sampled_session": f"WITH {_SESSION}, {_sampled('session', 20_000)}",
        "clustering_session": f"WITH {_SESSION}, {_closed('session')} SELECT round(coalesce(avg(closed / (degree * (degree - 1))), 0.0), 9) AS clustering, count(*) AS eligible FROM local",
        "bfs_distances": f"WITH RECURSIVE {_TRADE}, {_bfs('trade', 25)} SELECT * FROM far",
        "bfs_directed": f"WITH RECURSIVE {_TRADE}, {_bfs('trade', 25, False)} SELECT * FROM far",
        "apl_exact": f"WITH RECURSIVE {_TRADE}, {_bfs('trade', 25)} {_apl('trade', 25, 300.0)}",
        "apl_textbook": f"WITH RECURSIVE {_TRADE}, {_bfs('trade', 25)} {_apl('trade', 25, 600.0)}",
        "apl_twin_fives": f"WITH RECURSIVE {_FIVES}, {_bfs('twins', 10)} {_apl('twins', 10, 45.0)}",
        "apl_catalogue": f"WITH {_CATALOGUE} SELECT round(sum(2.0 * below * (n - below)) / any_value(n * (n - 1.0)), 9) AS apl, any_value(n * (n - 1)) AS reachable_pairs, any_value(n) AS vertices FROM sizes, total",
        "distance_counts": f"WITH RECURSIVE {_TRADE}, {_bfs('trade', 25)} SELECT dist, count(*) AS pairs FROM far WHERE dist > 0 GROUP BY 1",
        "reach_reorders": f"WITH {_CHAINS}, {_AHEAD}, {_jenkins('hashed', _mult('value'))}, {_ORDER_REGS}, reach AS (SELECT a.o_orderkey AS key, b.o_orderkey AS id FROM steps a JOIN steps b ON a.o_custkey = b.o_custkey AND b.place >= a.place UNION ALL SELECT value, value FROM ids WHERE value NOT IN (SELECT o_orderkey FROM orders)) SELECT key, idx, max(val) AS val FROM reach JOIN own USING (id) GROUP BY 1, 2",
        "hyper_ball_reorders": f"WITH {_CHAINS}, {_AHEAD}, {_jenkins('hashed', _mult('value'))}, {_ORDER_REGS}, times AS (SELECT unnest(range((SELECT max(size) FROM steps))) AS t), ball AS (SELECT t, a.o_orderkey AS key, b.o_orderkey AS id FROM steps a JOIN times ON true JOIN steps b ON a.o_custkey = b.o_custkey AND b.place BETWEEN a.place AND a.place + t), regs AS (SELECT t, key, idx, max(val) AS val FROM ball JOIN own USING (id) GROUP BY 1, 2, 3), sums AS (SELECT t, key, sum(2.0 ** -val) + 16 - count(*) AS p, 16 - count(*) AS z FROM regs GROUP BY 1, 2), est AS (SELECT t, sum(CASE WHEN 0.673 * 256 / p <= 40 AND z > 0 THEN 16.0 * ln(16.0 / z) ELSE 0.673 * 256 / p END) AS e FROM sums GROUP BY 1), held AS (SELECT t, sum(val) AS v FROM regs GROUP BY 1), gains AS (SELECT t - 1 AS t, e - lag(e) OVER (ORDER BY t) AS gain, v - lag(v) OVER (ORDER BY t) AS more FROM est JOIN held USING (t)) SELECT round(sum(t * gain) / (SELECT count(*) FROM ids), 6) AS hyper_ball, (count(*) FILTER (more > 0) + 1)::INTEGER AS rounds FROM gains WHERE t >= 0",
        "ball_limit": f"WITH RECURSIVE {_TRADE}, {_bfs('trade', 25, False)} SELECT round(coalesce(sum(dist - 1), 0) / 25.0, 9) AS ball_limit FROM far WHERE s <> d",
        "reach_counts": f"WITH RECURSIVE {_FIVES}, {_bfs('twins', 10, False)}, v AS (SELECT s AS key, d AS value FROM far), {_regs('v', 'regs', 4)} SELECT * FROM regs",
        "graph_union_bridges": f"WITH {_TENS} SELECT * FROM twins",
        "bfs_from_sample": f"WITH {_CHAINS} SELECT head AS s, o_orderkey AS d, place::INTEGER AS dist FROM steps",
        "ball_limit_chains": f"WITH {_CHAINS}, ahead AS (SELECT size - 1 - place AS r FROM steps) SELECT round(sum(r * (r - 1) / 2.0) / (SELECT max(o_orderkey) + 1 FROM orders), 9) AS ball_limit FROM ahead",
        "connected_components": f"WITH {_CHAINS} SELECT range AS vertex, coalesce(component, range) AS component FROM range((SELECT max(o_orderkey) + 1 FROM orders)) LEFT JOIN least ON vertex = range",
        "components_supply": "WITH RECURSIVE s AS (SELECT count(*) AS n FROM supplier), arcs AS (SELECT DISTINCT l_suppkey AS a, l_partkey + n AS b FROM lineitem, s), ways AS (SELECT a, b FROM arcs UNION SELECT b, a FROM arcs), seen AS (SELECT min(a) AS x FROM ways UNION SELECT b FROM seen JOIN ways ON a = x), total AS (SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS n) SELECT n - (SELECT count(*) FROM seen) + 1 AS components FROM total",
        "are_connected": f"WITH {_CHAINS}, size AS (SELECT max(o_orderkey) + 1 AS n FROM orders), labels AS (SELECT range AS vertex, coalesce(component, range) AS component FROM range((SELECT n FROM size)) LEFT JOIN least ON vertex = range) SELECT x.vertex AS a, y.vertex AS b, x.component = y.component AS connected FROM labels x, size, labels y WHERE y.vertex = (x.vertex * 7 + 3) % n",
        "min_cut_size": f"WITH {_REGIONS}, {_cuts('flow', 5)} SELECT min(size) AS cut_size FROM cuts",
        "min_cut_size_undo": f"WITH {_REGIONS}, {_cuts('flow', 5)} SELECT min(size) AS cut_size FROM cuts",
        "min_cut_months": f"WITH {_MONTHS}, {_weighted_cuts('flow', 12)} SELECT min(size) AS cut_size FROM cuts",
        "min_cut_months_arcs": f"WITH {_MONTHS}, {_weighted_cuts('flow', 12)}, best AS (SELECT side FROM cuts ORDER BY size LIMIT 1) SELECT src, dst, w AS arcs FROM flow, best WHERE (side >> src::INTEGER) & 1 <> (side >> dst::INTEGER) & 1",
        "min_cut_segments": f"WITH {_SEGMENT_FLOW}, {_weighted_cuts('flow', 10)} SELECT min(size) AS cut_size FROM cuts",
        "min_cut_ring": "WITH w AS (SELECT 1 + count(o_orderkey) AS w FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT sum(w)::BIGINT AS cut_size FROM (SELECT w FROM w ORDER BY w LIMIT 2)",
        "min_cut_trade": f"WITH {_TRADE}, {_mask_cut('trade', 25)}",
        "union_find_labels": _SEGMENTS,
        "union_find_compression": _SEGMENTS,
        "union_find_undo": _SEGMENTS,
        "min_cut_edges": f"WITH {_FIVES}, {_cuts('twins', 10)}, best AS (SELECT side FROM cuts ORDER BY size LIMIT 1) SELECT src, dst FROM twins, best WHERE (side >> src::INTEGER) & 1 <> (side >> dst::INTEGER) & 1",
        "min_cut_tens": "SELECT range + 1 AS src, range + 11 AS dst FROM range(4)",
        "jenkins_hash": f"WITH v AS (SELECT c_custkey AS id FROM customer), {_jenkins('v', 'id')} SELECT id, hex(c::UBIGINT) AS hash FROM jk12",
        "hll_registers": f"WITH {_VALUES}, {_regs('v', 'regs')} SELECT * FROM regs",
        "hll_registers_all_sizes": " UNION ALL ".join(f"SELECT *, {b}::INTEGER AS b FROM (WITH {_VALUES}, {_regs('v', 'regs', b)} SELECT * FROM regs)" for b in (4, 5, *range(7, 16))),
        "hll_compact": f"WITH {_VALUES}, {_regs('v', 'regs')} SELECT * FROM regs",
        "hll_compact_bytes": "SELECT DISTINCT length(event_type)::BIGINT AS key, (64 * 5 // 8)::BIGINT AS bytes FROM events",
        "gnm_shape": "SELECT 0::BIGINT AS loops, 0::BIGINT AS outside, 0::BIGINT AS repeated, count(*) AS arcs FROM lineitem",
        "gnp_shape": "SELECT 0::BIGINT AS loops, 0::BIGINT AS outside, 0::BIGINT AS repeated, true AS near, count(*) AS vertices FROM part",
        "attached_shape": "SELECT count(*) - 2 AS vertices, 0::BIGINT AS short, 0::BIGINT AS repeated FROM orders",
        "clustered_shape": "SELECT count(*) - 2 AS vertices, 0::BIGINT AS short, 0::BIGINT AS repeated FROM customer",
        "hll_estimate": f"WITH {_VALUES}, {_regs('v', 'regs')}, {_EST} SELECT key, round(e, 9) AS estimate FROM est",
        "hll_range": f"WITH {_VALUES}, {_regs('v', 'regs')}, {_EST} SELECT key, round(e, 9) AS estimate, round(e * 0.87, 9) AS low, round(e * 1.13, 9) AS high FROM est",
        "hll_union": f"WITH {_BOTH}, {_regs('v', 'regs')} SELECT * FROM regs",
        "hll_rollup": f"WITH v AS (SELECT 0::BIGINT AS key, user_id AS value FROM events), {_regs('v', 'regs')} SELECT * FROM regs",
        "hll_packed_union": f"WITH {_BOTH}, {_regs('v', 'regs')} SELECT * FROM regs",
        "hll_packed_rollup": f"WITH v AS (SELECT 0::BIGINT AS key, user_id AS value FROM events), {_regs('v', 'regs')} SELECT * FROM regs",
        "register_shape": f"SELECT c_custkey, count(*) AS registers, 5::BIGINT AS bits, ((count(*) * 5 + 7) // 8)::BIGINT AS bytes FROM {_REGS} GROUP BY 1",
        "register_merge": f"SELECT c_custkey, sum(greatest(a, b))::BIGINT AS total, bool_or(b > a) AS changed, (max(a) FILTER (i = 4))::BIGINT AS fifth FROM {_REGS} GROUP BY 1",
        "register_round_trip": f"SELECT c_custkey, string_agg(a::VARCHAR, ',' ORDER BY i) AS registers, string_agg(right(bin(a), 5).lpad(5, '0'), '|' ORDER BY i) AS bits FROM {_REGS} GROUP BY 1",
        "complete_graph": f"{lists} FROM (SELECT a.range AS vertex, b.range AS dst FROM range((SELECT count(*) FROM region)) a, range((SELECT count(*) FROM region)) b) GROUP BY 1",
    }
