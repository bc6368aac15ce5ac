"""N-gram Jaccard join by token-combination prefixes.

Documents become sets of word shingles ("tokens").  Documents with one set are
one class.  Two sets link when 100 * |x & y| >= percent * |x | y|.

1. Extended prefixes.  In a random global order, take the first
   t + 1 + half as many tokens of each set, where t = |x| - ceil(percent |x|) is
   how many tokens of x a partner may lack.  A set that has a partner shares
   all but t of them with it, so sets with fewer shared tokens there drop out.
2. Exact frequencies are counted over the sets that stay.  Tokens nobody else
   has ("own") can never be matched, so sets with more than t of them drop out.
3. Signatures.  Tokens in rising frequency; rare ones are indexed alone,
   frequent ones fall into classes (by hash; how many follows the size) and
   are indexed in pairs within their class.  The prefix is extended until
   own + rare + sum over classes of (held - 1) exceeds t: a partner lacks at
   most t tokens, so some signature is left intact in both.  Sets sign for
   their own size range and the next, so partners count classes alike.
4. Verification.  Each signature's first set, its pivot, is compared with
   the others on full sets; what links becomes components.  The comparison
   also leaves what each set lacks of its pivot and has beside it.  Sets that
   share a signature share its pivot, so the pairs still open are those of one
   pivot in different components; from the two differences to the pivot their
   intersection follows exactly.  Blocks of such sets are compared in a task,
   which returns a spanning forest of its links, never the pairs.

Tokens are counted in the tasks before they move and joined back to their
sets, so a hot token is split at run time like any hot join key; blocks of one
pivot are dealt each on its own.  No step brings a group together in a task
except in blocks of bounded size, and no links or components reach the driver.

``percent`` is 51 to 100.  Below, a set of frequent tokens might have too few
pairs within its classes to sign for all partners.

Defined results: null, empty or blank texts have no shingles and link with
nothing; a text with fewer than k words is one shingle, one of any length is
read whole; equal texts link; rows that repeat a doc_id each give a row and are
told apart by their sets; ties do not matter, as a component is named by its
smallest doc_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import bloom, cut, drop, text_groups
from .words import mix, shingle_sets

#: A token in more sets than this is frequent.
RARE = 64
BLOCK = 512


def _lacking(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its n tokens a set may lack in a partner."""
    return n - -(-percent * n // 100)


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    t = _lacking(n, percent) + 1
    return np.minimum(n, t + (t + 1) // 2)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens, digest_size=16).digest()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row_key, row_tag, n, and the 128-bit identity of the set."""

    def run(batches):
        for b in text_groups(batches, limit=500_000):
            sets = shingle_sets([t or "" for t in b.column(1).to_pylist()], k)
            keys = np.frombuffer(b"".join(_key(s) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["doc_id", "row_key", "row_tag", "n", "hi", "lo"])

    return docs.select("doc_id", "text", row_key().alias("row_key"), row_tag().alias("row_tag")).mapInArrow(run, "doc_id long, row_key long, row_tag int, n long, hi long, lo long")


def row_key():
    """Names a row by doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def row_tag():
    """Tells apart what shares a row_key: with it a row is named by 96 bits."""
    return F.hash("text", F.col("doc_id").cast("long"))


def _first_tokens(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, hi) of the extended prefixes in the order of a mixed hash; a task
    gives equal sets once as far as it remembers them."""

    def run(batches):
        seen: set[bytes] = set()
        for b in text_groups(batches, limit=500_000):
            tokens, owners = [], []
            for s in shingle_sets([t or "" for t in b.column(1).to_pylist()], k):
                key = _key(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                m = int(_prefix_length(np.int64(len(s)), percent))
                tokens.append(s[:m])  # hashes are mixed: their order is the random order
                owners.append(np.full(m, np.frombuffer(key, "<i8", 1)[0]))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "hi"])

    return docs.mapInArrow(run, "token long, hi long")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, tokens) of the wanted sets.  A Bloom filter of bounded size
    spares most others their way to the join that decides."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, F.col("row_key"), wanted.count()))

    def run(batches):
        for b in batches:
            hit = shared.value.holds(b.column(0).to_numpy())
            for g in text_groups([b.filter(pa.array(hit))], limit=500_000):
                sets = shingle_sets([t or "" for t in g.column(1).to_pylist()], k)
                keys = [int(np.frombuffer(_key(s), "<i8", 1)[0]) for s in sets]
                yield pa.RecordBatch.from_arrays([g.column(0), pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["row_key", "hi", "tokens"])

    found = docs.select(row_key().alias("row_key"), "text").mapInArrow(run, "row_key long, hi long, tokens binary")
    # repeated rows: any of them serves if it has the wanted set
    return found.join(wanted.select("row_key", "hi", "key"), ["row_key", "hi"]).dropDuplicates(["key"]).select("key", "tokens")


def _signatures(percent: int):
    """Rows (key, n, tokens sorted by frequency) -> (sig, key, n, own)."""
    ratio = np.log(100 / percent)

    def of(n: int, own: int, tokens: np.ndarray, df: np.ndarray):
        t = int(_lacking(np.int64(n), percent))
        base = int(np.floor(np.log(n) / ratio + 1e-9))
        rare = df <= RARE
        for size in (base, base + 1):
            classes = max(1, int(np.exp(size * ratio)) // 12)
            kind = np.where(rare, -1, (mix(tokens ^ np.uint64(size)) % np.uint64(classes)).astype(np.int64))
            # how much each token adds: the first one of a class adds nothing
            adds = np.ones(len(tokens), np.int64)
            heavy = np.flatnonzero(kind >= 0)
            _, first = np.unique(kind[heavy], return_index=True)
            adds[heavy[first]] = 0
            reach = own + np.cumsum(adds)
            m = int(np.searchsorted(reach, t + 1)) + 1 if own <= t else 0
            for i in np.flatnonzero(kind[:m] == -1).tolist():
                yield size, tokens[i], np.uint64(0), i
            order = np.argsort(kind[:m], kind="stable")
            order = order[kind[order] >= 0]
            for g in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else ():
                for b in range(1, len(g)):
                    for a in range(b):
                        x, y = tokens[g[a]], tokens[g[b]]
                        yield size, min(x, y), max(x, y), int(g[b])

    def run(batches):
        for batch in batches:
            rows = []
            for d, n, got in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                df = got.values.field("df").to_numpy(zero_copy_only=False)
                tokens = got.values.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
                for size, x, y, pos in of(n, n - len(df), tokens, df):
                    rows.append((size, int(x), int(y), d, n, n - len(df)))
            if rows:
                size, x, y, d, n, own = (np.array(c, np.uint64 if i in (1, 2) else np.int64) for i, c in enumerate(zip(*rows)))
                sig = mix(mix(x + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + y)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(d), pa.array(n), pa.array(own)], ["sig", "key", "n", "own"])

    return run


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (u, v) -> u, v, n_u, n_v, lacking (how many tokens of u v has
    not), other (these, and v's tokens that u has not), linked."""

    def run(batches):
        for b in batches:
            rows = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                twice = np.zeros(len(both) + 1, bool)
                twice[1:-1] = both[1:] == both[:-1]
                other = both[~(twice[1:] | twice[:-1])]
                same = (len(both) - len(other)) // 2
                rows.append((u, v, len(x), len(y), len(x) - same, other.tobytes(), 100 * same >= percent * (len(x) + len(y) - same)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STARRED)], schema=_STARRED)

    left, right = sets.select(F.col("key").alias("u"), F.col("tokens").alias("x")), sets.select(F.col("key").alias("v"), F.col("tokens").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long, n_u long, n_v long, lacking long, other binary, linked boolean")


_STARRED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n_u", pa.int64()), ("n_v", pa.int64()), ("lacking", pa.int64()), ("other", pa.binary()), ("linked", pa.bool_())])


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of token arrays."""
    out = np.zeros((len(a), len(b)), np.float32)
    tokens = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    names, column = np.unique(tokens, return_inverse=True)
    # only tokens that occur on both sides count
    left = np.zeros(len(names), bool)
    left[column[row < len(a)]] = True
    right = np.zeros(len(names), bool)
    right[column[row >= len(a)]] = True
    use = (left & right)[column]
    _, column = np.unique(column[use], return_inverse=True)
    row = row[use]
    width = 2048
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        own = (column >= at) & (column < at + width)
        grid = np.zeros((len(a) + len(b), width), np.float32)
        grid[row[own], column[own] - at] = 1
        out += grid[: len(a)] @ grid[len(a) :].T
    return out


def _across(percent: int):
    """A block pair of one pivot: rows (v, n_u, n_v, lacking, other, component,
    side) -> a spanning forest of the links between different components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        b = b if len(b) else a
        size = int(pdf.n_u.iloc[0])

        def wide(column):
            return a[column].to_numpy()[:, None], b[column].to_numpy()[None, :]

        (n, m), (lack, lack_m), (c, c_m) = wide("n_v"), wide("lacking"), wide("component")
        # the pair may share what both kept of the pivot and, at most, all additions
        most = size - np.maximum(lack, lack_m) + np.minimum(n - size + lack, m - size + lack_m)
        open_ = (c != c_m) & (100 * most >= percent * (n + m - most))
        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        none = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        if not len(rows):
            return none
        tokens = [[np.frombuffer(x, np.uint64) for x in side.other.iloc[own]] for side, own in ((a, rows), (b, columns))]
        part = np.ix_(rows, columns)
        same = size - lack[rows] - lack_m[:, columns] + _common(*tokens).astype(np.int64)
        link = open_[part] & (100 * same >= percent * (n[rows] + m[:, columns] - same))
        ids, ids_b = a.v.to_numpy()[rows], b.v.to_numpy()[columns]
        # smallest id reachable within the block pair
        far = np.iinfo(np.int64).max
        label, label_b = ids.copy(), ids_b.copy()
        while True:
            new = np.minimum(label, np.where(link, label_b[None, :], far).min(1))
            new_b = np.minimum(label_b, np.where(link, new[:, None], far).min(0))
            if (new == label).all() and (new_b == label_b).all():
                break
            label, label_b = new, new_b
        u, v = np.concatenate([label, label_b]), np.concatenate([ids, ids_b])
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    return run


def _open_blocks(starred: DataFrame, found: DataFrame) -> DataFrame:
    """Sets of each pivot dealt to block pairs.  Sets in the pivot's own
    component need no comparison with each other, only with the others."""
    label = found.withColumnRenamed("component", "of")
    here = (
        starred.join(label.select(F.col("id").alias("v"), F.col("of").alias("component")), "v", "left").join(label.select(F.col("id").alias("u"), F.col("of").alias("home")), "u", "left")
        .withColumn("component", F.coalesce("component", "v")).withColumn("out", F.col("component") != F.coalesce("home", "u"))
    )
    sizes = here.groupBy("u").agg(F.count_if("out").alias("outside"), F.count(F.lit(1)).alias("all")).filter("outside > 0 and all > 1")
    here = here.join(sizes, "u")
    outer = F.ceil(F.col("outside") / BLOCK).cast("int")
    inner = F.ceil((F.col("all") - F.col("outside")) / BLOCK).cast("int")
    at = F.when(F.col("out"), F.pmod(F.xxhash64("v"), outer)).otherwise(outer + F.pmod(F.xxhash64("v"), F.greatest(inner, F.lit(1)))).cast("int")
    others = F.when(F.col("out"), F.sequence(F.lit(0), outer + inner - 1)).otherwise(F.sequence(F.lit(0), outer - 1))
    return (
        here.withColumn("at", at).withColumn("with", F.explode(others))
        .select("u", F.least("at", "with").alias("a"), F.greatest("at", "with").alias("b"), (F.col("at") > F.col("with")).cast("int").alias("side"), "v", "n_u", "n_v", "lacking", "other", "component")
    )


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), and
    class_id (smallest doc_id with the same set), one row a document; beside them
    ``row_key`` with ``row_tag`` and ``group``, which name the row and, even where
    doc_ids repeat, its component (null without shingles)."""
    if not 51 <= percent <= 100:
        raise ValueError("percent is 51 to 100")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = cut(_sets(docs, k), "sets")
    classes = sets.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("row_key").alias("row_key"))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    final = _linked_classes(docs, classes, k, percent) if percent < 100 else None
    named = classes.withColumn("group", F.col("key"))
    if final is not None:
        named = classes.join(final.withColumnRenamed("id", "key"), "key", "left").withColumn("group", F.coalesce("component", "key"))
    named = cut(named.select("hi", "lo", F.col("doc_id").alias("class_id"), "group"), "named")
    least = named.groupBy("group").agg(F.min("class_id").alias("least"))
    return (
        sets.withColumnRenamed("n", "n_shingles").join(named.join(least, "group"), ["hi", "lo"], "left")
        .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("least", "doc_id").alias("component_id"), "row_key", "row_tag", "group")
    )


def _linked_classes(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the keys of classes that link with others."""
    # 1: sets with enough shared tokens in their extended prefixes
    shared = _first_tokens(docs, k, percent).groupBy("token").agg(F.min("hi").alias("low"), F.max("hi").alias("high")).filter("low < high").select("token")
    shared = _first_tokens(docs, k, percent).join(shared, "token").distinct().groupBy("hi").agg(F.count(F.lit(1)).alias("shared"))
    t = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9)
    enough = F.least(F.col("n"), t + 1 + F.floor((t + 2) / 2)) - t
    wanted = cut(classes.join(shared, "hi").filter(F.col("shared") >= enough).select("row_key", "hi", "n", "key"), "wanted")
    # 2: exact frequencies among them
    full = cut(_full_sets(docs, wanted, k), "full")
    tokens = full.mapInArrow(_explode, "token long, key long")
    tokens = tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "token")
    ranked = tokens.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens")).join(wanted.select("key", "n"), "key").filter(F.size("tokens") >= F.col("n") - t)
    # 3: signatures that at least two sets have
    signed = cut(ranked.select("key", "n", "tokens").mapInArrow(_signatures(percent), "sig long, key long, n long, own long"), "signed")
    heads = cut(signed.groupBy("sig").agg(F.min("key").alias("head"), F.max("key").alias("last")).filter("head < last"), "heads")
    # 4: each signature's first set against the others
    stars = cut(signed.join(heads.select("sig", "head"), "sig").filter("key > head").select(F.col("head").alias("u"), F.col("key").alias("v")).distinct(), "stars")
    starred = cut(_compare(stars, full, percent), "starred")
    links = starred.filter("linked").select("u", "v")
    found = cut(components(links), "found")
    # by block and not by pivot alone, else all blocks of a pivot meet in one task
    blocks = _open_blocks(starred, found).repartition("u", "a", "b")
    more = cut(blocks.groupBy("u", "a", "b").applyInPandas(_across(percent), "u long, v long"), "more")
    final = cut(components(links.unionByName(more)), "final")
    for t in (wanted, full, signed, heads, stars, starred, found, more):
        drop(t)
    return final


def _explode(batches):
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1)):
            tokens = np.frombuffer(t.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), d))], ["token", "key"])
