"""Best-fit packing with certified bin counts and repacking.

Pieces are dealt to partitions by a hash.  Each partition packs its pieces by
best-fit decreasing and certifies the count with lower bounds from dual
feasible functions: if bins equal the bound, no packing of these pieces has
fewer.  Partitions with a gap give the documents of their unfilled bins, and
certified ones those of their emptiest bin, to the next round, where they are
dealt anew, so that gaps of different partitions can meet.  A round is kept
only if it needs fewer bins than it was given; rounds end when nothing is won
or all loose pieces fit one partition.

Pieces of exactly the capacity fill a sequence alone and are never moved.
Only totals of a round reach the driver; partitions are of bounded size.  Each
piece carries the certificate of the partition it was settled in: its bins and
their lower bound.

Defined results: a null text counts as empty and holds only the end id; a text
of any length is encoded whole; rows with equal doc_id are packed apart; pieces
of equal length may take any order; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import encoder
from .common import cut, drop, text_groups

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = f"{PIECES}, row long, part int, bin int, offset long, loose boolean, bins int, bound int"


def piece_table(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row a piece.  A document longer than ``capacity`` is cut so that all
    pieces but the first are full."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in text_groups(batches):
            ids, at = enc.encode([t or "" for t in b.column(1).to_pylist()])
            ids = np.insert(ids.astype("<u4"), at[1:], end_id)
            at = at + np.arange(len(at))
            rows = []
            for d, i, j in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                edges = [i, *range(i + ((j - i) % capacity or capacity), j + 1, capacity)]
                rows += [(d, k, x - i, y - x, zlib.crc32(ids[x:y])) for k, (x, y) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions.

    Thresholds: lengths above C - t count as C, those below t as nothing.
    Roundings by k: x counts as floor((k + 1) x / C) / k bins, or as x / C where
    (k + 1) x / C is whole."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(volume[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    above = number[-1] - number[capacity - t]
    kept = volume[capacity - t] - volume[t - 1]
    best = max(best, int((above - (-kept // capacity)).max(initial=0)))
    for k in range(1, 21):
        scaled = (k + 1) * size
        # in units of 1 / (k * C), so that sums stay whole
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and what stays free in each bin.

    Bins wait in stacks by free space; a bit mask of non-empty stacks gives the
    tightest fit in one step."""
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    bin_of, offset = np.empty(len(lengths), np.int32), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bin_of[i], offset[i] = b, capacity - room
        free[b] = room - n
        if free[b]:
            if not stacks[free[b]]:
                mask |= 1 << free[b]
            stacks[free[b]].append(b)
    return bin_of, offset, np.array(free, np.int64)


def _packer(capacity: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        pdf["bin"], pdf["offset"], free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        loose = np.zeros(len(free), bool)
        if not last:
            if len(free) > bound:
                loose = free > 0
            elif len(free) and free.max() > 0:
                loose[free.argmax()] = True
        return pdf.assign(loose=loose[pdf["bin"]], bins=len(free), bound=bound)

    return run


def pack(pieces: DataFrame, capacity: int = 2048, rows_a_partition: int = 8192) -> DataFrame:
    """``pieces`` (as from :func:`piece_table`) with sequence_id, offset, bins and
    bound."""
    base = cut(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    alone = base.filter(F.col("length") == capacity).select(*_names(PIECES), (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).alias("bins"), F.lit(1).alias("bound"))
    active, given, tables = base.filter(F.col("length") < capacity), None, []
    settled = []
    for n in itertools.count():
        rows = active.count()
        parts = max(1, -(-rows // rows_a_partition))
        last = parts == 1
        dealt = active.withColumn("part", F.pmod(F.xxhash64("row", F.lit(n)), F.lit(parts)).cast("int"))
        packed = cut(dealt.groupBy("part").applyInPandas(_packer(capacity, last), _PACKED), "packed")
        tables.append(packed)
        used, loose = _bins(packed)
        if given is not None and used >= given:
            settled[-1] = tables[-2]  # nothing won: the bins of the round before stay
            break
        settled.append(packed.filter(~F.col("loose")))
        if last or not loose:
            break
        active, given = packed.filter("loose").select(*_names(PIECES), "row"), loose
    out = alone
    for n, t in enumerate(settled):
        key = F.lit(n << 48) + F.shiftleft(F.col("part").cast("long"), 22) + F.col("bin")
        out = out.unionByName(t.select(*_names(PIECES), key.alias("sequence_id"), "offset", "bins", "bound"))
    out = cut(out, "sequences")
    for t in (base, *tables):
        drop(t)
    return out


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _bins(packed: DataFrame) -> tuple[int, int]:
    """All bins of a round, and those that are loose."""
    by_part = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.count_distinct(F.when(F.col("loose"), F.col("bin"))).alias("loose"))
    r = by_part.agg(F.sum("bins").alias("bins"), F.sum("loose").alias("loose")).first()
    return r.bins or 0, r.loose or 0


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    return pack(piece_table(docs, tokenizer, end_id, capacity), capacity)
