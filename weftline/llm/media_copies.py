"""Copies of pictures by local descriptors: cropped, turned, relit or edited.

Pictures are grey, as binary PGM.  On two scales, corners are the local maxima
of the smaller-eigenvalue kind of response of the structure tensor, all those
above a threshold, so that a crop has the corners of its original; each gets
the direction of its intensity centroid and 128 binary tests of blurred pixels,
turned by that direction.  Tests reach ``REACH`` pixels (those beyond the
picture read its edge), as what lies nearer is alike at all corners of boxes.  28 tables, one for each two of the descriptor's
eight blocks of 16 bits, bring together all descriptors that differ in at most
six bits, and of those with more random differences 92 % at eight, 48 % at
twelve and 5 % at 20; corners are dealt by the first of the two blocks, the
second is matched within the task.  Pairs within ``NEAR`` bits vote for the
similarity transform between their pictures, and a transform with ``VOTES``
different corners behind it links the two.  Linked pictures form groups.

Corners of a table entry are compared in the task that holds it and only near
pairs leave it.  A block's value that more than ``HOT`` corners have is dealt on
by the second block, and an entry that still has more by corner, so that a copy
group of any size is many tasks' work; the parts of an entry all meet its first
corner.  In an entry with more than ``CROWD`` corners each first meets
the one of the smallest pic_id, the first with its own descriptor and the
``BEFORE`` that precede it by pic_id, so a copy group of any size forms from a
few comparisons a corner.  Then all corners of such (and of split) entries whose pictures are
not in one group yet are compared, in squares of ``SQUARE`` by ``SQUARE``.  The
groups are those that comparing all corners of all entries gives; where many
pictures of different groups share an entry, the comparisons there grow with
the square of their number.

Pictures are described in stacks of equal shape, and large ones in strips, of
at most ``PIXELS`` pixels (or one row of strips), whatever the batch holds.

Defined results: pictures that are null, no PGM, or too small for a patch have
no corners and a group of their own; equal pictures link if they have corners
enough; rows that repeat a pic_id give a row each and are one picture with the
corners of all; a group is named by its smallest pic_id, and of equally good
transforms any links; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, drop, text_groups
from .words import mix

RADIUS = 9  # of what must lie within the picture
REACH = 26  # of the tests
NEAR = 20
BLOCKS = 8  # of a descriptor; two equal ones bring corners together
CROWD = 8
BEFORE = 2
SQUARE = 256
ROWS = 400_000  # of the tables, a task
HOT = 100_000  # rows of a key that are dealt on
VOTES = 4
CELL = 8  # pixels
TILE = 80  # pixels; the corners that link two pictures lie in one tile
PIXELS = 1 << 21  # described at once
HALO = 80  # rows beside a strip that its corners may read


def _test_points() -> np.ndarray:
    """Ends of the 128 tests: a place around the corner and one a few pixels off,
    so that a test reads a slope of its own and not the large edges again."""
    rng = np.random.default_rng(11)
    near = rng.normal(0, 12, (128, 2))
    return np.stack([near, near + rng.normal(0, 5, (128, 2))]).clip(-REACH, REACH)


_TESTS = _test_points()
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    m = _HEADER.match(data or b"")
    if not m:
        return None
    width, height = int(m[1]), int(m[2])
    body = np.frombuffer(data, np.uint8, offset=m.end())
    return body.reshape(height, width) if len(body) == width * height else None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares, edges repeated, for a stack of pictures."""
    p = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").astype(np.float64)
    p[:, 0], p[:, :, 0] = 0, 0
    c = p.cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (c[:, k:, k:] - c[:, :-k, k:] - c[:, k:, :-k] + c[:, :-k, :-k]) / (k * k)


def _corners(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Picture, row and column of the corners of a stack, strongest first."""
    g = _box(stack, 1)
    dy, dx = np.gradient(g, axis=1), np.gradient(g, axis=2)
    xx, yy, xy = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
    response = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    edge = RADIUS + 3
    inner = response[:, edge:-edge, edge:-edge]
    if not inner.size:
        none = np.zeros(0, np.int64)
        return none, none, none
    peak = inner > 1.0
    for i in range(-2, 3):
        for j in range(-2, 3):
            if i or j:
                other = response[:, edge + i : response.shape[1] - edge + i, edge + j : response.shape[2] - edge + j]
                peak &= inner > other if (i, j) > (0, 0) else inner >= other
    p, y, x = np.nonzero(peak)
    order = np.lexsort((x, y, -inner[p, y, x], p))
    return p[order], y[order] + edge, x[order] + edge


_DISC = np.array([(i, j) for i in range(-6, 7) for j in range(-6, 7) if i * i + j * j <= 40])


def describe_stack(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Picture, x, y (in full-size pixels), scale, angle and the two halves of
    the descriptor of every corner of equally large pictures."""
    out = []
    for scale in (1, 2):
        s = stack
        if scale == 2:
            h, w = stack.shape[1] // 2 * 2, stack.shape[2] // 2 * 2
            s = stack[:, :h, :w].reshape(len(stack), h // 2, 2, w // 2, 2).mean((2, 4))
        if min(s.shape[1:]) <= 2 * (RADIUS + 3):
            continue
        p, y, x = _corners(s)
        if not len(p):
            continue
        smooth = _box(s, 1)
        around = smooth[p[:, None], y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(around @ _DISC[:, 0], around @ _DISC[:, 1])
        c, n = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = []
        for tx, ty in ((t[:, 0], t[:, 1]) for t in _TESTS):
            px, py = np.rint(c * tx - n * ty).astype(int), np.rint(n * tx + c * ty).astype(int)
            value.append(smooth[p[:, None], (y[:, None] + py).clip(0, s.shape[1] - 1), (x[:, None] + px).clip(0, s.shape[2] - 1)])
        bits = np.packbits(value[0] < value[1], axis=1).view("<i8")
        out.append((p, x * scale, y * scale, np.full(len(p), scale), angle, bits[:, 0], bits[:, 1]))
    if not out:
        return tuple(np.zeros(0, k) for k in (int, int, int, int, float, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _strips(stack: np.ndarray):
    """:func:`describe_stack` in strips of rows, each read with a halo."""
    height = stack.shape[1]
    step = max(HALO, PIXELS // max(1, len(stack) * stack.shape[2]) // 2 * 2)
    for top in range(0, height, step):
        first = max(0, top - HALO)
        out = describe_stack(stack[:, first : top + step + HALO].astype(np.float64))
        y = out[2] + first
        own = (y >= top) & (y < top + step)
        yield tuple(c[own] for c in (*out[:2], y, *out[3:]))


def describe(pictures: DataFrame) -> DataFrame:
    """``pictures`` (pic_id, image) -> a row a corner: pic_id, x, y, scale, angle,
    d0, d1."""

    def run(batches):
        for b in text_groups(batches, "image", PIXELS):
            by_shape: dict = {}
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = decode_pgm(data)
                if a is not None and i is not None:
                    by_shape.setdefault(a.shape, []).append((i, a))
            for (height, width), own in by_shape.items():
                many = max(1, PIXELS // max(1, height * width))
                for k in range(0, len(own), many):
                    ids = np.array([i for i, _ in own[k : k + many]], np.int64)
                    stack = np.stack([a for _, a in own[k : k + many]])
                    for p, x, y, scale, angle, d0, d1 in _strips(stack):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[p]), *(pa.array(v.astype(np.float32)) for v in (x, y, scale, angle)), pa.array(d0), pa.array(d1)], ["pic_id", "x", "y", "scale", "angle", "d0", "d1"])

    return pictures.select(F.col("pic_id").cast("long"), "image").mapInArrow(run, "pic_id long, x float, y float, scale float, angle float, d0 long, d1 long")


def _value(block) -> Column:
    """The 16 bits of a block of the descriptor."""
    width = 128 // BLOCKS
    return F.get(F.array(*(F.shiftrightunsigned(d, s).bitwiseAND(F.lit((1 << width) - 1)) for d in ("d0", "d1") for s in range(0, 64, width))), block)


def _dealt(corners: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A row a corner and block but the last, dealt by the block's value, where so
    many corners have the value that a task can hold them; and of the others a row
    a table, dealt by both blocks' values, and by corner too where still too many
    have them.  These know the first corner of their entry (a struct ``head``)."""
    rows = corners.select(F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 2))).alias("block"), "corner", "pic_id", "d0", "d1").withColumn("value", _value(F.col("block")))
    parts = max(corners.sparkSession.sparkContext.defaultParallelism, -(-corners.count() * (BLOCKS - 1) // ROWS))
    # a row a block and value at the most: 7 * 2**16, whatever the corners
    hot = cut(rows.groupBy("block", "value").count().filter(F.col("count") > HOT).select("block", "value"), "hot")
    own = ["block", "corner", "pic_id", "d0", "d1"]
    if hot.isEmpty():
        return rows.repartition(parts, "block", "value").select(*own), None
    cool = rows.join(F.broadcast(hot), ["block", "value"], "left_anti")
    tables = rows.join(F.broadcast(hot), ["block", "value"], "left_semi").withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.lit(BLOCKS - 1)))).withColumn("second", _value(F.col("other")))
    entry = ["block", "value", "other", "second"]
    large = tables.groupBy(*entry).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pic_id", "corner", "d0", "d1")).alias("head")).filter(F.col("n") > HOT)
    large = large.withColumn("parts", F.ceil(F.col("n") / HOT))
    split = tables.join(cut(large, "large"), entry, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("corner"), "parts"), F.lit(0)).cast("int"))
    many = max(parts, -(-split.count() // ROWS))
    return cool.repartition(parts, "block", "value").select(*own), split.repartition(many, *entry, "part").select(*own, "other", "part", "head")


def _entries(c: dict):
    """The entries of each table in a task, one table after another: the columns'
    places in the order of entry, pic_id and corner; the start and end of the entry
    of each, and its name."""
    values = np.stack([c["d0"], c["d1"]], 1).view(f"<u{16 // BLOCKS}")
    for i, j in itertools.combinations(range(BLOCKS), 2):
        own = np.flatnonzero((c["block"] == i) & (c["other"] == j) if "other" in c else c["block"] == i)
        if len(own):
            key = values[own, i].astype(np.uint64) << np.uint64(16) | values[own, j] | np.uint64(8 * i + j << 32)
            if "part" in c:
                key |= c["part"][own].astype(np.uint64) << np.uint64(38)
            order = np.lexsort((c["corner"][own], c["pic_id"][own], key))
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(first, append=len(key))
            start = np.repeat(first, sizes)
            yield own[order], start, start + np.repeat(sizes, sizes), (key & np.uint64((1 << 38) - 1)).view(np.int64)


def _near(c: dict, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = sum(np.bitwise_count((c[d][p] ^ c[d][q]).view(np.uint64)) for d in ("d0", "d1"))
    return (apart <= NEAR) & (c["pic_id"][p] != c["pic_id"][q])


PAIR = "i long, j long, pic_i long, pic_j long"


def _pair_rows(c: dict, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    i, j = c["corner"][p], c["corner"][q]
    p, q = np.where(i < j, p, q), np.where(i < j, q, p)
    return np.stack([c[name][side] for side in (p, q) for name in ("corner", "pic_id")], 1)[:, [0, 2, 1, 3]]


def _pairs_of(found: list) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], ["i", "j", "pic_i", "pic_j"])


def _columns(batches) -> dict:
    t = pa.Table.from_batches(batches)
    c = {name: t.column(name).to_numpy() for name in t.column_names if name != "head"}
    if "head" in t.column_names:
        head = t.column("head").combine_chunks()
        c["split"] = head.is_valid().to_numpy(zero_copy_only=False)
        c |= {f"head_{f.name}": head.field(f.name).fill_null(0).to_numpy() for f in head.type}
    return c


def _compared(corners: DataFrame) -> DataFrame:
    """(i, j): near corners of different pictures that share an entry; a corner in
    a crowded entry meets the entry's first one, the first that has its descriptor
    and those just before it (of its part, where an entry is split), and gives a
    row (i, -1) with the entry's name and its pic_id."""

    def run(batches):
        batches = list(batches)
        c = _columns(batches) if batches else {"block": np.zeros(0)}
        found = []
        for at, start, end, name in _entries(c) if len(c["block"]) else ():
            n, places = end - start, np.arange(len(at))
            packed = n > CROWD
            if "split" in c:
                packed |= c["split"][at]
            sides = []
            few = places[(n > 1) & ~packed]
            for off in range(1, CROWD):
                few = few[few + off < end[few]]
                if not len(few):
                    break
                sides.append((at[few], at[few + off]))
            crowd = places[packed]
            if len(crowd):
                sides.append((at[start[crowd]], at[crowd]))
                d0, d1 = c["d0"][at[crowd]], c["d1"][at[crowd]]
                order = np.lexsort((crowd, d1, d0, start[crowd]))
                fresh = np.r_[True, np.any(np.diff(np.stack([d0, d1, start[crowd]])[:, order]) != 0, axis=0)]
                heads = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                sides.append((at[crowd[heads]], at[crowd[order]]))
                for off in range(1, BEFORE + 1):
                    later = crowd[crowd - off >= start[crowd]]
                    sides.append((at[later - off], at[later]))
                one = at[crowd]
                found.append(np.stack([c["corner"][one], np.full(len(one), -1), name[crowd], c["pic_id"][one]], 1))
                if "split" in c:
                    one = one[c["split"][one]]
                    first = {k: c[f"head_{k}"][one] for k in ("corner", "pic_id", "d0", "d1")}
                    both = {k: np.concatenate([first[k], c[k][one]]) for k in first}
                    p, q = np.arange(len(one)), np.arange(len(one)) + len(one)
                    near = _near(both, p, q)
                    found.append(_pair_rows(both, p[near], q[near]))
            for p, q in sides:
                near = _near(c, p, q)
                found.append(_pair_rows(c, p[near], q[near]))
            found = [np.unique(np.concatenate(found), axis=0)] if found else []
        yield _pairs_of(found)

    cool, hot = _dealt(corners)
    pairs = cool.mapInArrow(run, PAIR)
    return (pairs if hot is None else pairs.unionByName(hot.mapInArrow(run, PAIR))).distinct()


def _across(crowd: DataFrame, corners: DataFrame, groups: DataFrame) -> DataFrame:
    """(i, j): all near corners that share a crowded entry and whose pictures are
    in no common group yet.  ``crowd`` has a row (corner, entry, pic_id) a corner of
    each crowded entry.  Those of more than one group are dealt in squares of about
    ``SQUARE`` by ``SQUARE`` corners, so no task gets a whole one."""
    labelled = crowd.join(groups.select(F.col("id").alias("pic_id"), "component"), "pic_id", "left").withColumn("component", F.coalesce("component", "pic_id"))
    # counted in the tasks first; a join's hot key is split at run time
    mixed = labelled.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / SQUARE).alias("strips"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rows = labelled.join(mixed.select("entry", "strips"), "entry").join(corners.select("corner", "d0", "d1"), "corner")
    rows = rows.withColumn("strip", F.pmod(F.xxhash64("corner"), "strips")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    side = F.when(F.col("strip") == F.col("other"), 2).otherwise((F.col("strip") > F.col("other")).cast("int"))
    dealt = rows.select("entry", F.least("strip", "other").alias("p"), F.greatest("strip", "other").alias("q"), side.alias("side"), "corner", "pic_id", "component", "d0", "d1")

    def compare(t: pa.Table) -> pa.Table:
        c = {name: t.column(name).to_numpy() for name in t.column_names}
        p, q = (x.ravel() for x in np.meshgrid(np.flatnonzero(c["side"] != 1), np.flatnonzero(c["side"] != 0)))
        keep = (c["component"][p] != c["component"][q]) & _near(c, p, q)
        return pa.Table.from_batches([_pairs_of([_pair_rows(c, p[keep], q[keep])])])

    return dealt.groupBy("entry", "p", "q").applyInArrow(compare, PAIR).distinct()


_SIDE = ["pic", "x", "y", "scale", "angle"]


def _matches(pairs: DataFrame, corners: DataFrame) -> DataFrame:
    """Pairs of corner numbers -> both corners in one row, the smaller pic_id as a."""
    me = corners.select("corner", F.struct(F.col("pic_id").alias("pic"), "x", "y", "scale", "angle").alias("c"))
    both = pairs.select("i", "j").join(me.toDF("i", "p"), "i").join(me.toDF("j", "q"), "j").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return both.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in _SIDE))


def _consensus(matches: DataFrame) -> DataFrame:
    """(u, v): pictures of which one transform explains enough corners.  The
    matches of two pictures stream together through a task, many pairs at once."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            a, v = t.column("a_pic").to_numpy(), t.column("b_pic").to_numpy()
            done = int(np.flatnonzero((a != a[-1]) | (v != v[-1])).max(initial=-1)) + 1
            held = t.slice(done)
            yield _linked(t.slice(0, done))
        if held is not None:
            yield _linked(held)

    return matches.repartition("a_pic", "b_pic").sortWithinPartitions("a_pic", "b_pic").mapInArrow(run, "u long, v long")


def _linked(t: pa.Table) -> pa.RecordBatch:
    c = {name: t.column(name).to_numpy() for name in t.column_names}
    first = np.flatnonzero(np.r_[True, (np.diff(c["a_pic"]) != 0) | (np.diff(c["b_pic"]) != 0)][: t.num_rows])
    ends = [c["a_pic"][first], c["b_pic"][first]]
    sizes = np.diff(first, append=t.num_rows)
    pair = np.repeat(np.arange(len(first)), sizes)
    enough = sizes[pair] >= VOTES  # pictures with too few matches in all cast no votes
    c, pair = {k: x[enough].astype(np.float64) for k, x in c.items()}, pair[enough]
    found = np.zeros(len(first), bool)
    if len(pair):
        reach = np.zeros(len(first))
        np.maximum.at(reach, pair, np.max([c[k] for k in ("a_x", "a_y", "b_x", "b_y")], axis=0))
        one_tile = reach[pair] < TILE
        _, corner = np.unique(np.stack([pair, c["a_x"], c["a_y"]], 1), axis=0, return_inverse=True)
        turn, grow = c["b_angle"] - c["a_angle"], c["b_scale"] / c["a_scale"]
        cos, sin = np.cos(turn), np.sin(turn)
        for t, h, k in itertools.product((0, 1), repeat=3):
            # where the middle of a's tile goes: an error of the angle moves it no further in a large picture
            tx, ty = np.floor(c["a_x"] / TILE + t / 2), np.floor(c["a_y"] / TILE + h / 2)
            ox, oy = c["a_x"] - (tx + 0.5 - t / 2) * TILE, c["a_y"] - (ty + 0.5 - h / 2) * TILE
            dx, dy = c["b_x"] - grow * (cos * ox - sin * oy), c["b_y"] - grow * (sin * ox + cos * oy)
            part = np.floor(turn / (math.pi / 6) + k / 2) % 12
            own = np.flatnonzero(~one_tile) if t or h else np.arange(len(pair))
            for i, j in itertools.product((0, 1), repeat=2):
                at = np.stack([pair, part, np.round(np.log2(grow)), tx, ty, np.floor(dx / CELL + i / 2), np.floor(dy / CELL + j / 2), corner])[:, own].astype(np.int64)
                order = np.lexsort(at[::-1])
                at = at[:, order]
                new = np.r_[True, (np.diff(at) != 0).any(0)][: len(own)]  # a corner votes once for a place
                at = at[:, new]
                place = np.flatnonzero(np.r_[True, (np.diff(at[:-1]) != 0).any(0)][: at.shape[1]])
                found[at[0, place[np.diff(place, append=at.shape[1]) >= VOTES]]] = True
    return pa.RecordBatch.from_arrays([pa.array(e[found]) for e in ends], ["u", "v"])


def copy_groups(pictures: DataFrame) -> DataFrame:
    """pic_id, n_corners, group_id (the smallest pic_id linked)."""
    corners = cut(describe(pictures).withColumn("corner", F.monotonically_increasing_id()), "corners")
    compared = cut(_compared(corners), "pairs")
    pairs = compared.filter("j >= 0")
    crowd = compared.filter("j < 0").select(F.col("i").alias("corner"), F.col("pic_i").alias("entry"), F.col("pic_j").alias("pic_id"))
    links = cut(_consensus(_matches(pairs, corners)), "links")
    groups = components(links)
    if not crowd.isEmpty():
        more = cut(_across(crowd, corners, groups), "across")
        if not more.isEmpty():
            # pictures of one group already have their link
            labelled = pairs.join(groups.toDF("pic_i", "of_i"), "pic_i", "left").join(groups.toDF("pic_j", "of_j"), "pic_j", "left")
            apart = labelled.filter("coalesce(of_i, pic_i) <> coalesce(of_j, pic_j)").select("i", "j", "pic_i", "pic_j")
            links = links.unionByName(_consensus(_matches(apart.unionByName(more).distinct(), corners)))
            groups = components(links)
        drop(more)
    groups = cut(groups, "groups")
    drop(compared)
    counts = corners.groupBy("pic_id").agg(F.count(F.lit(1)).alias("n_corners"))
    rows = pictures.select(F.col("pic_id").cast("long")).join(counts, "pic_id", "left").join(groups.withColumnRenamed("id", "pic_id"), "pic_id", "left")
    return rows.select("pic_id", F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("component", "pic_id").alias("group_id"))


def draw(seed: int, size: int = 80) -> np.ndarray:
    """A picture that follows from its seed: boxes over a soft ground."""
    rng = np.random.default_rng(seed)
    a = np.kron(rng.uniform(60, 190, (5, 5)), np.ones((size // 5, size // 5)))
    a = _box(a[None], 5)[0]
    for _ in range(26):
        x, y = rng.integers(0, size - 6, 2)
        w, h = rng.integers(4, 22, 2)
        a[y : y + h, x : x + w] = 0.25 * a[y : y + h, x : x + w] + 0.75 * rng.uniform(0, 255)
    return a.clip(0, 255).astype(np.uint8)


def edit(a: np.ndarray, kind: int) -> np.ndarray:
    """0 a crop, 1 other light, 2 a box painted over, 3 a quarter turn, 4 a crop in other light."""
    if kind in (0, 4):
        a = a[6:-5, 4:-9]
    if kind in (1, 4):
        a = (a * 0.8 + 20).astype(np.uint8)
    if kind == 2:
        a = a.copy()
        a[30:46, 34:50] = 128
    return np.rot90(a).copy() if kind == 3 else a


def pictures_of(vectors: DataFrame) -> DataFrame:
    """A picture for each vector (pic_id = 2 vec_id), seeded by its id and
    components, and for every eighth an edited copy (2 vec_id + 1)."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            seeds = mix(b.column(1).to_numpy().view(np.uint64))
            for k in range(0, len(ids), 256):
                rows = []
                for v, s in zip(ids[k : k + 256].tolist(), seeds[k : k + 256].tolist()):
                    a = draw(s)
                    rows.append({"pic_id": 2 * v, "image": encode_pgm(a)})
                    if v % 8 == 3:
                        rows.append({"pic_id": 2 * v + 1, "image": encode_pgm(edit(a, v // 8 % 5))})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("pic_id", pa.int64()), ("image", pa.binary())]))

    return vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.xxhash64("vec_id", "embedding").alias("seed")).mapInArrow(run, "pic_id long, image binary")
