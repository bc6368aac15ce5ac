"""Near duplicates by SuperMinHash, banding, verification and union of groups.

Documents become sets of word shingles; documents with one set are one class.
Two sets link when 100 * |x & y| >= percent * |x | y|.

1. Signatures.  Every shingle seeds a random permutation of the m registers,
   drawn step by step, and a fraction for each step.  In step j it offers j plus
   its fraction to the register that is j-th in its permutation, and a register
   keeps the least offer.  So a set's registers share its shingles out evenly,
   which is where the lower variance against independent minima comes from.  A
   set stops as soon as all its registers are taken: later steps offer more.
   Steps are taken for all shingles of a group of texts at once; the first ones
   look their permutation up in the draws before them, so large sets, which end
   after few steps, never write one out.
2. Banding.  ``rows`` registers make a band, and sets that agree in a band meet.
   Two sets of similarity s miss all bands with (1 - s^rows)^bands; the number of
   bands follows from ``percent`` and ``miss``, one in a hundred million.
3. Verification.  Each band's first set, its pivot, is compared with the others
   on full sets.  Pairs of one pivot in different components stay open; from
   their differences to the pivot the intersection follows exactly, and blocks
   of bounded size are compared in a task, which returns a spanning forest.
4. Groups are the components of all links, joined in DataFrames: no links or
   components reach the driver, and a group of any size is dealt over tasks.

Defined results: null, empty or blank texts have no shingles, link with nothing
and are kept; a text with fewer than k words is one shingle, one of any length is
read whole; equal texts link; rows that repeat a doc_id each give a row and are
told apart by their sets; a component is named by its smallest doc_id (null only
where it has no other), and a row is kept if that is its doc_id; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import jaccard_join
from .common import cut, drop, text_groups
from .words import mix, shingle_sets

#: Steps whose permutations are looked up in the draws before them.
_LOOKED_UP = 6
_ALL = 2**64 - 1
_UNTAKEN = np.uint64(_ALL)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def band_count(percent: int, rows: int, miss: float) -> int:
    """Bands with which two sets of ``percent`` similarity miss each other with a
    probability of ``miss`` at the most."""
    if percent == 100:
        return 1
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _draw(x: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The offer of step j (step above, fraction below) and the place j .. m - 1
    that it swaps with place j."""
    bits = mix(x + np.uint64((j + 1) * int(_STEP) & _ALL))
    place = ((bits & _LOW) * np.uint64(m - j) >> _32).astype(np.int64) + j
    return np.uint64(j) << _32 | bits >> _32, place


def signatures(sets: list[np.ndarray], m: int, seed: int) -> np.ndarray:
    """(len(sets), m) registers; those of empty sets stay untaken."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = mix(np.concatenate([np.zeros(0, np.uint64), *sets]) ^ np.uint64(seed))
    registers = np.full(len(sets) * m, _UNTAKEN)
    free = np.where(sizes > 0, m, 0)
    draws: list[np.ndarray] = []
    order = None  # written-out permutations of those still running
    for j in range(m):
        if not len(x):
            break
        offer, place = _draw(x, j, m)
        if j < _LOOKED_UP:
            at = place
            for i in range(j - 1, -1, -1):  # a place swapped before holds what the earlier place held
                at = np.where(draws[i] == at, i, at)
            draws.append(place)
        else:
            row = np.arange(len(x))
            if order is None:
                order = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                for i, d in enumerate(draws):
                    order[row, i], order[row, d] = order[row, d], order[row, i]
            at = order[row, place]
            order[row, place] = order[:, j]
        key = owner * m + at
        first = registers[key] == _UNTAKEN  # the others are taken by earlier steps for less
        key = key[first]
        np.minimum.at(registers, key, offer[first])
        free -= np.bincount(np.unique(key) // m, minlength=len(sets))
        running = free[owner] > 0
        if not running.all():
            x, owner, draws = x[running], owner[running], [d[running] for d in draws]
            order = None if order is None else order[running]
    return registers.reshape(-1, m)


def bands_of(registers: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit hashes of ``rows`` registers in turn."""
    n, m = registers.shape
    taken = registers.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows))
    for r in range(rows):
        out = mix(out * _STEP + taken[:, :, r])
    return out


def _banded(docs: DataFrame, k: int, rows: int, bands: int, seed: int) -> DataFrame:
    """doc_id, row_key, n, the 128-bit identity of the set, and its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in text_groups(batches, limit=500_000):
            sets = shingle_sets([t or "" for t in b.column(1).to_pylist()], k)
            raw = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            keys = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
            once: dict[bytes, int] = {}
            of = [once.setdefault(r, len(once)) if len(s) else -1 for r, s in zip(raw, sets)]
            different = dict(zip(of, sets))
            found = bands_of(signatures([different[i] for i in range(len(once))], rows * bands, seed), rows).view(np.int64)
            of = np.array(of)
            full = of >= 0
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[of[full]].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], schema=schema)

    return docs.select("doc_id", "text", jaccard_join.row_key().alias("row_key")).mapInArrow(run, "doc_id long, row_key long, n long, hi long, lo long, bands array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-8, seed: int = 20240901) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept
    (whether that is its own), one row a document."""
    if not 51 <= percent <= 100:
        raise ValueError("percent is 51 to 100")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    banded = cut(_banded(docs, k, rows, band_count(percent, rows, miss), seed), "banded")
    classes = banded.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("row_key").alias("row_key"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    final = linked(docs, classes, k, percent)
    named = classes.join(final.withColumnRenamed("id", "key"), "key", "left").select("hi", "lo", F.col("doc_id").alias("class_id"), F.coalesce("component", "key").alias("group"))
    named = cut(named, "named")
    least = named.groupBy("group").agg(F.min("class_id").alias("least"))
    found = banded.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(named.join(least, "group").select("hi", "lo", "least"), ["hi", "lo"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the keys of classes that link with others."""
    signed = cut(classes.select(F.explode("bands").alias("sig"), "key"), "signed")
    heads = cut(signed.groupBy("sig").agg(F.min("key").alias("head"), F.max("key").alias("last")).filter("head < last").select("sig", "head"), "heads")
    meeting = cut(signed.join(heads, "sig").select(F.col("head").alias("u"), F.col("key").alias("v")).distinct(), "meeting")
    stars = meeting.filter("u < v")
    wanted = cut(classes.join(meeting.select(F.col("v").alias("key")).distinct(), "key", "left_semi").select("row_key", "hi", "n", "key"), "wanted")
    full = cut(jaccard_join._full_sets(docs, wanted, k), "full")
    starred = cut(jaccard_join._compare(stars, full, percent), "starred")
    links = starred.filter("linked").select("u", "v")
    found = cut(components(links), "found")
    # by block and not by pivot alone, else all blocks of a pivot meet in one task
    blocks = jaccard_join._open_blocks(starred, found).repartition("u", "a", "b")
    more = cut(blocks.groupBy("u", "a", "b").applyInPandas(jaccard_join._across(percent), "u long, v long"), "more")
    final = cut(components(links.unionByName(more)), "final")
    for t in (signed, heads, meeting, wanted, full, starred, found, more):
        drop(t)
    return final
