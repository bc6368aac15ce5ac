"""Substring dedup: matching statistics by backward search in FM-indexes.

A window is ``size`` consecutive words.  Words covered by a window whose word
sequence starts anywhere else are removed.

1. Anchors.  Every window has one anchor, the word n-gram with the smallest
   hash in it (the leftmost, if equal; ``ANCHOR`` words, or ``size`` if fewer).  Equal windows have equal anchors at
   equal places, so an occurrence of an anchor, with the words its windows
   span, can be judged among the occurrences of the same anchor alone.  These
   regions cover every window of every text once.
2. Equal regions are counted before anything else moves: a region that occurs
   twice repeats in all its windows, one whose anchor has no other region in
   none of them.  Only distinct regions that share an anchor go on.
3. FM-indexes.  These are dealt to shards by anchor.  A shard sorts the
   suffixes of its words to the depth of a region, keeps the Burrows-Wheeler
   transform as a wavelet matrix of bit vectors, and streams its regions
   through it: searching backwards from a window's end until the interval
   holds one occurrence gives the longest repeated match that ends there,
   which settles that window and its neighbours on one side; what is left
   open is halved until all windows are settled.
4. An anchor with more than ``HOT`` distinct regions would outgrow a shard.
   Its regions are dealt on by window instead: windows are keyed with their
   place and words, and counted in each task before the shuffle, which
   answers them.

Any ``size`` from one word on is taken.  Words are compared by 64-bit hashes.
Window verdicts are on the input.

Defined results: a null, empty or short text loses nothing; a text of any
length is read whole; equal documents, equal doc_ids included, are each other's
repeats (of equal windows none is preferred, all go); other columns are ignored
or kept under any name; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, cut, drop, text_groups
from .words import _powers, mix, ngrams, words

ANCHOR = 6
HOT = 4096
SHARD_WORDS = 400_000


def spans(hashes: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hash of the words first to past of one text, wherever they stand."""
    up, down = _powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    return (total[past] - total[first]) * down[first]


def regions(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, identity, first window and number of windows of each region of
    one text with at least ``size`` words."""
    n = len(hashes)
    wide = min(ANCHOR, size)
    grams = ngrams(hashes, wide)
    # leftmost minima of sliding blocks, by doubling: least[i] over [i, i + width)
    span, width, at = size - wide + 1, 1, np.arange(len(grams))
    while width < span:
        step = min(width, span - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        width += step
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=len(at))
    place = at[first]
    body = spans(hashes, first, first + count + size - 1)
    identity = mix(mix(body + (place - first).astype(np.uint64)) + count.astype(np.uint64))
    return grams[place], identity, first, count


def _region_rows(docs: DataFrame, size: int) -> DataFrame:
    """(dk, dc, anchor, region, first, windows): every region of every text.  ``dk``
    and ``dc`` name the document."""

    def run(batches):
        for b in text_groups(batches, limit=500_000):
            hashes, _, _, at, _ = words([t.encode() for t in b.column(2).to_pylist()])
            out = []
            for dk, dc, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at.tolist(), at[1:].tolist()):
                if j - i >= size:
                    anchor, region, first, count = regions(hashes[i:j], size)
                    out.append((np.full(len(first), dk), np.full(len(first), dc, np.int32), anchor.view(np.int64), region.view(np.int64), first.astype(np.int32), count.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["dk", "dc", "anchor", "region", "first", "windows"])

    return docs.select("dk", "dc", "text").mapInArrow(run, "dk long, dc int, anchor long, region long, first int, windows int")


def _region_words(docs: DataFrame, wanted: DataFrame, n: int, size: int) -> DataFrame:
    """(anchor, region, words) of the n wanted regions, at least once each.  A Bloom
    filter of bounded size on the region spares most others the way to the join."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, F.col("region"), n))

    def run(batches):
        seen: set[int] = set()
        for b in text_groups(batches, limit=500_000):
            hashes, _, _, at, _ = words([t.encode() for t in b.column(0).to_pylist()])
            rows = []
            for i, j in zip(at.tolist(), at[1:].tolist()):
                if j - i < size:
                    continue
                anchor, region, first, count = regions(hashes[i:j], size)
                hit = np.flatnonzero(shared.value.holds(region))
                for r in hit.tolist():
                    key = int(region[r])
                    if key not in seen:
                        seen.add(key)
                        rows.append((int(anchor.view(np.int64)[r]), int(region.view(np.int64)[r]), hashes[i + first[r] : i + first[r] + count[r] + size - 1].tobytes()))
            if len(seen) > 500_000:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["anchor", "region", "words"])

    return docs.select("text").mapInArrow(run, "anchor long, region long, words binary")


class WaveletMatrix:
    """Rank over a sequence of symbols: a bit vector a level, highest bit first,
    each stored as 64-bit words with counts before every word."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        n = len(sequence)
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view("<u8")
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before ``at``; ``base`` is where the
        symbol's run starts in the last level."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            one = symbol >> (self.levels - 1 - level) & 1
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at - base


class FMIndex:
    """Counting index of one shard's words; symbols are 1 and up, and 0 for the
    separator, with which the text ends."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.size = len(text), int(text.max()) + 1
        rank, width = text.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1
            key = rank * (n + self.size + 1) + ahead
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(sorted_, prepend=sorted_[:1]) != 0)
            width *= 2
            if width >= depth or rank[order[-1]] == n - 1:
                break
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, (self.size - 1).bit_length()))
        every = np.arange(self.size)
        self.base = self.wavelet.rank(every, np.zeros(self.size, np.int64), np.zeros(self.size, np.int64))

    def start(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of symbol + pattern, from the interval of pattern."""
        both = self.wavelet.rank(np.tile(symbol, 2), np.concatenate([low, high]), np.tile(self.base[symbol], 2))
        n = len(symbol)
        return self.first[symbol] + both[:n], self.first[symbol] + both[n:]


def repeated_windows(texts: list[np.ndarray], ask: np.ndarray, size: int) -> np.ndarray:
    """For distinct regions (arrays of word hashes): which windows of each asked
    one occur in another."""
    lengths = np.array([len(t) for t in texts])
    _, symbols = np.unique(np.concatenate(texts), return_inverse=True)
    text = np.zeros(int(lengths.sum()) + len(texts), np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(texts)), lengths)] = symbols + 1
    index = FMIndex(text, int(lengths.max()) + 1)
    start, windows = start[ask], lengths[ask] - size + 1
    columns = np.arange(int(windows.max()) if len(windows) else 0)
    unsettled = columns < windows[:, None]
    repeated = np.zeros_like(unsettled)
    live = np.arange(len(ask))
    while len(live):
        waiting = unsettled[live]
        nth = (waiting.sum(1) + 1) // 2
        window = (waiting.cumsum(1) == nth[:, None]).argmax(1)
        end = window + size - 1
        # reach: the leftmost start such that [reach, end] occurs elsewhere
        reach = end + 1
        low, high = index.start(text[start[live] + end])
        go = np.flatnonzero(high - low > 1)
        low, high = low[go], high[go]
        reach[go] -= 1
        while len(go):
            inside = reach[go] > 0
            go, low, high = go[inside], low[inside], high[inside]
            if not len(go):
                break
            low, high = index.extend(text[start[live[go]] + reach[go] - 1], low, high)
            more = high - low > 1
            go, low, high = go[more], low[more], high[more]
            reach[go] -= 1
        good = reach <= window
        left, right = np.where(good, reach, window), np.where(good, window, reach - 1)
        settled = (columns >= left[:, None]) & (columns <= right[:, None])
        repeated[live] |= settled & good[:, None]
        unsettled[live] &= ~settled
        live = live[unsettled[live].any(1)]
    return repeated


def _search(size: int):
    """One shard: (anchor, region, alone, words) -> offsets of the repeated windows
    of regions not known to be repeated as a whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = np.flatnonzero(pdf["alone"].to_numpy())
        found = repeated_windows([np.frombuffer(w, np.uint64) for w in pdf["words"]], ask, size)
        some = found.any(1)
        return pdf.iloc[ask[some]][["anchor", "region"]].assign(at=[np.flatnonzero(row).astype(np.int32) for row in found[some]])

    return run


def _windows(size: int):
    """Rows (anchor, region, many, words) -> a row a window, keyed by its content."""

    def run(batches):
        for b in batches:
            for a, r, m, w in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = np.frombuffer(w, np.uint64)
                first = np.arange(len(own) - size + 1)
                key = mix(spans(own, first, first + size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), x)) for x in (a, r, m)] + [pa.array(first.astype(np.int32)), pa.array(key)], ["anchor", "region", "many", "i", "window"])

    return run


def repeated_spans(docs: DataFrame, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """(dk, dc, first, windows, at): per region the offsets of the windows that repeat
    (none: all ``windows`` of it do); and the tables to drop when it has been read.
    ``docs`` has dk, dc and text."""
    if size < 1:
        raise ValueError("a window has a word at least")
    placed = cut(_region_rows(docs, size), "regions")
    counted = placed.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("many"), F.first("windows").alias("windows"))
    # counted in the tasks first, so an anchor of any frequency is safe; a join's hot key is split at run time
    crowds = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    counted = cut(counted.join(crowds, "anchor", "left").filter("many > 1 or d > 1"), "counted")
    rivals = counted.filter("d > 1")
    sizes = rivals.agg(F.sum(F.col("windows") + size).alias("n"), F.max("d").alias("d"), F.count(F.lit(1)).alias("regions")).first()
    found = counted.filter("many > 1").select("anchor", "region", "windows", F.array().cast("array<int>").alias("at"))
    tables = [placed, counted]
    if sizes.n:
        bodies = _region_words(docs, rivals, sizes.regions, size).dropDuplicates(["anchor", "region"]).join(rivals.select("anchor", "region", "many", "d"), ["anchor", "region"])
        bodies = cut(bodies, "bodies")
        shards = max(1, -(-sizes.n // SHARD_WORDS))
        calm = bodies.filter(F.col("d") <= HOT).select("anchor", "region", (F.col("many") == 1).alias("alone"), "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
        tables.append(cut(calm.groupBy("shard").applyInPandas(_search(size), "anchor long, region long, at array<int>"), "found"))
        if sizes.d > HOT:
            single = bodies.filter(F.col("d") > HOT).select("anchor", "region", "many", "words").mapInArrow(_windows(size), "anchor long, region long, many long, i int, window long")
            twice = single.groupBy("anchor", "window").agg(F.sum("many").alias("n")).filter("n > 1").select("anchor", "window")
            hot = single.filter("many = 1").join(twice, ["anchor", "window"], "left_semi").groupBy("anchor", "region").agg(F.collect_list("i").alias("at"))
            tables.append(cut(hot, "hot"))
        for t in tables[2:]:
            found = found.unionByName(t.withColumn("windows", F.lit(0)))
        drop(bodies)
    return placed.drop("windows").join(found, ["anchor", "region"]).select("dk", "dc", "first", "windows", "at"), tables


def covered(first: list[int], windows: list[int], at: list[list[int]], n: int, size: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    starts = np.concatenate([np.arange(f, f + w) if not a else f + np.array(a) for f, w, a in zip(first, windows, at)])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, size: int = 50, keep: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default) with n_words, n_removed
    and kept_text: the words that stay, joined by single blanks; with ``as_is``, the
    text itself where no word goes."""
    keep = keep or ["doc_id"]
    # two hashes of unlike kinds, 96 bits: one of 64 would give a few of 10**10 documents another's spans
    key = [F.xxhash64("doc_id", "text").alias("dk"), F.hash("text", "doc_id").alias("dc")]
    found, tables = repeated_spans(docs.filter("text is not null").select(*key, "text"), size)
    flags = found.distinct().groupBy("dk", "dc").agg(*(F.collect_list(c).alias(c) for c in ("first", "windows", "at")))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    wide = docs.select(*own, F.col("text").alias("text"), *key).join(flags, ["dk", "dc"], "left").drop("dk", "dc")
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def run(batches):
        for b in text_groups(batches, "text", 2_000_000):
            k, rows = len(keep), []
            for text, *repeats in zip(*(b.column(k + i).to_pylist() for i in range(4))):
                own = (text or "").encode().split()
                rest = own
                if repeats[0]:
                    gone = covered(*repeats, len(own), size)
                    rest = [w for w, g in zip(own, gone.tolist()) if not g]
                rows.append((len(own), len(own) - len(rest), text if as_is and len(rest) == len(own) else b" ".join(rest).decode()))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))], [*keep, "n_words", "n_removed", "kept_text"])

    out = cut(wide.mapInArrow(run, schema), "deduped")
    for t in tables:
        drop(t)
    return out


def dedup_digests(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs.select(F.col("doc_id").cast("long"), "text"), size).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
