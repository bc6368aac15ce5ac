"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every
substring of it.  A document is parsed into phrases, each the longest match
from where the last one ended; a language that fits needs few phrases.  The
phrases are normalised by the length of the document and weighed with the
bits that name a place in the training text (log2 of its length), which gives
an estimate of the cross entropy; the least wins.

Texts are lower-cased; letters stay, everything else becomes single blanks.
Documents are cut into segments of ``SEGMENT`` symbols that are parsed in
lock-step by table lookups, so a phrase ends at a segment's end at the latest,
for all languages alike.

Training takes a bounded sample of the labelled rows: for each language ``rows``
distinct texts, those of up to ``usual`` characters in the order of a hash first
and longer ones by length after them.  Each text of the sample is learned whole,
and all its letters are symbols of their own.  The automata, which go to the driver
and the executors, grow with these texts and so with ``rows``.  Every document is then
parsed over its whole text.

Defined results: a null text or one without letters is ``und`` with score 0;
so is every text if nothing was labelled; a row with a null doc_id is neither
held out nor learned; ties go to the smaller label;
repeated rows each get a row and are learned once; a text of any length is
parsed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_groups

SEGMENT = 256
BLANK, UNKNOWN, PAD = 0, 1, 2
_MISS = 1 << 29


def held_out(doc_id: str):
    """Whether crc32 of the decimal doc_id is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(texts: list[str], of_char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in turn, their offsets, and which have letters.
    ``of_char`` gives each code point's symbol."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([0, *map(len, lowered)])
    own = of_char[codes]
    blank = own == BLANK
    again = np.zeros(len(own), bool)
    again[1:] = blank[1:] & blank[:-1]
    again[ends[:-1][ends[:-1] < len(own)]] = False
    at = np.concatenate([[0], np.cumsum(~again)])[ends]
    letters = np.concatenate([[0], np.cumsum(~blank)])[ends]
    return own[~again], at, np.diff(letters) > 0


class SuffixAutomaton:
    """The smallest automaton of all substrings of a symbol sequence."""

    def __init__(self, sequence):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in sequence:
            new = self._state({}, self.length[last] + 1, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 < self.length[q]:
                    twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = q = twin
                self.link[new] = q
            last = new

    def _state(self, moves, length, link) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def comb(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moves as rows laid over each other in one array: state s moves by c to
        ``to[base[s] + c]`` if ``owner`` there is s.  The root's row comes first
        and is whole: a symbol that the text lacks is a phrase of its own and
        leads back to the root."""
        moves = self.next
        used = bytearray(b"\1" * width + b"\0" * (sum(map(len, moves)) + width))
        base = np.zeros(len(moves), np.int64)
        low = width
        order = sorted(range(1, len(moves)), key=lambda s: -len(moves[s]))
        for s in order:
            own = sorted(moves[s])
            if not own:
                continue
            at, tries = low, 0
            while True:
                at = used.find(0, at)
                if at < 0 or tries == 50:  # behind all others
                    at = max(used.rfind(1) + 1, width)
                    used.extend(bytes(width))
                    break
                if all(c - own[0] + at < len(used) and not used[c - own[0] + at] for c in own):
                    break
                at, tries = at + 1, tries + 1
            base[s] = at - own[0]
            for c in own:
                used[at + c - own[0]] = 1
            if low == at:
                low = max(used.find(0, low), low)
        size = int(base.max(initial=0)) + width
        to, owner = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        owner[:width], to[:width] = 0, _MISS
        to[PAD] = 0
        for s, own in enumerate(moves):
            at = base[s] + np.fromiter(own.keys(), np.int64, len(own))
            owner[at], to[at] = s, np.fromiter(own.values(), np.int64, len(own))
        return base, owner, to


class LanguageModel:
    """One automaton a label, all in the same arrays."""

    def __init__(self, samples: dict[str, list[str]]):
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.labels = sorted(samples)
        self.of_char = np.where(_alphabetic(), UNKNOWN, BLANK).astype(np.int32)
        for i, c in enumerate(letters):
            self.of_char[ord(c)] = 3 + i
        width = 3 + len(letters)
        base, owner, to, root, restart, self.bits = [], [], [], [], [], []
        states = cells = 0
        for label in self.labels:
            own, ends, _ = symbols(samples[label], self.of_char)
            text = [s for i, j in zip(ends, ends[1:]) for s in [*own[i:j].tolist(), BLANK]]
            b, o, t = SuffixAutomaton(text).comb(width)
            base.append(b + cells)
            owner.append(np.where(o >= 0, o + states, -1))
            to.append(t + states)
            # where a phrase ends, the symbol begins the next one; if the text lacks it, that is one more
            restart.append(np.where(t[:width] >= _MISS, states + 2 * _MISS, t[:width] + states + _MISS))
            root.append(states)
            self.bits.append(np.log2(max(2, len(text))))
            states, cells = states + len(b), cells + len(o)
        if max(states, cells) >= _MISS:
            raise ValueError("the training sample is too large")
        join = lambda parts: np.concatenate([np.zeros(0), *parts]).astype(np.int32)
        self.base, self.owner, self.to = join(base), join(owner), join(to)
        self.root, self.restart = np.array(root, np.int32), np.array(restart, np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text (rows) under each label, symbols, and whether
        the text has letters."""
        own, at, letters = symbols(texts, self.of_char)
        lengths = np.diff(at)
        pieces = -(-lengths // SEGMENT)
        first = np.concatenate([[0], np.cumsum(pieces)])
        grid = np.full(int(first[-1]) * SEGMENT, PAD, np.int32)
        grid[np.arange(len(own)) + np.repeat(first[:-1] * SEGMENT - at[:-1], lengths)] = own
        columns = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        root = self.root[:, None]
        state = np.repeat(root, columns.shape[1], 1)
        count = np.zeros(state.shape, np.int32)
        for c in columns:
            at = self.base[state] + c
            move = np.where(self.owner[at] == state, self.to[at], self.restart[:, c])
            if (c == PAD).any():
                move = np.where(c == PAD, state, move)
            count += move >> 29
            state = move & (_MISS - 1)
        count += state != root
        total = np.concatenate([np.zeros((1, len(self.labels)), np.int64), np.cumsum(count.T, 0)])
        return total[first[1:]] - total[first[:-1]], lengths, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and scores: the runner-up's share of the two least entropies,
        from 0.5 (as good) towards 1 (far behind)."""
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts))
        count, lengths, letters = self.phrases([t or "" for t in texts])
        entropy = count * np.array(self.bits) / np.maximum(lengths, 1)[:, None]
        order = np.argsort(entropy, 1, kind="stable")
        rows = np.arange(len(texts))
        best = entropy[rows, order[:, 0]]
        second = entropy[rows, order[:, 1]] if len(self.labels) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(letters, np.where(np.isinf(second), 1.0, second / np.maximum(best + second, 1e-12)), 0.0)
        return [self.labels[k] if ok else "und" for k, ok in zip(order[:, 0].tolist(), letters.tolist())], score


_KEY = ["lang", "over", "h", "doc_id"]


def _chosen(labelled: DataFrame, rows: int, usual: int) -> DataFrame:
    """(lang, h) of the sample; tasks send on the first ``rows`` distinct texts of each
    label, so neither repeated rows nor a label's size matter."""
    keys = labelled.select("lang", F.greatest(F.length("text") - usual, F.lit(0)).alias("over"), "h", "doc_id")

    def first(batches):
        held = None
        for pdf in batches:
            held = pd.concat([held, pdf]).drop_duplicates(["lang", "h"]).sort_values(_KEY).groupby("lang").head(rows)
        if held is not None:
            yield held

    few = keys.mapInPandas(first, keys.schema).groupBy("lang", "h").agg(F.min("over").alias("over"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("over", "h"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= rows).select("lang", "h")


def fit(docs: DataFrame, rows: int = 16, usual: int = 40_000) -> LanguageModel:
    """Learn ``rows`` texts a label, whole; the driver holds these."""
    fold = ~F.coalesce(held_out("doc_id"), F.lit(True))
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "") & fold)
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    wanted = _chosen(labelled, rows, usual).collect()
    if not wanted:
        return LanguageModel({})
    asked = docs.sparkSession.createDataFrame(wanted, labelled.select("lang", "h").schema)  # rows a label
    texts = labelled.join(F.broadcast(asked), ["lang", "h"]).select("lang", "h", "text")

    def once(batches):
        seen = set()
        for pdf in batches:
            new = [k not in seen and not seen.add(k) for k in zip(pdf["lang"], pdf["h"])]
            yield pdf[np.array(new, bool)]

    samples: dict[str, list[str]] = {}
    for r in texts.mapInPandas(once, texts.schema).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():
        samples.setdefault(r.lang, []).append(r.text)
    return LanguageModel(samples)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default) with lang_pred and score."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in text_groups(batches, "text", 500_000):
            labels, score = shared.value.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def label(spark: SparkSession, model: LanguageModel):
    """The label of a text column as a column: only texts go to the workers and only labels
    come back, so the other columns of whole documents stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            groups = text_groups([pa.RecordBatch.from_arrays([texts], ["text"])], limit=500_000)
            yield pa.array([x for g in groups for x in shared.value.predict(g.column(0).to_pylist())[0]], pa.string())

    # else a filter on the label would predict once more
    return F.arrow_udf(run, "string").asNondeterministic()


def identify(docs: DataFrame, rows: int = 16, usual: int = 40_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, fit(docs, rows, usual)).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
