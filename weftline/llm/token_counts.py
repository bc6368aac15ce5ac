"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A document's leaves are runs of pre-tokens, cut only where the tokenizer always
separates: before a blank between solid characters, and between a letter and a
closing mark.  A flat array holds the token counts of the leaves and of all
subtrees.  :func:`build_trees` makes a table of texts, leaf edges and sums to
be stored; :func:`update_trees` takes it with a batch of edits and gives the
same table for the edited texts.  An edit replaces characters: only the leaves
it touches and one leaf on either side (the boundary context, whose outer edges
no edit can make unsafe) are encoded again, cut into leaves anew so that none
grows with the number of edits, and the sums above them are updated.  Counts
equal those of encoding the edited text as a whole.

Defined results: a null text counts as empty, a null edit list as no edits;
offsets beyond the text are taken as its end, an edit that ends before it
starts is an insertion at its start; edits of one document are in offsets of
the unedited text and are applied from the last to the first (equal starts:
the later in the list first), so they must not overlap, and one that reaches
into its successor ends there; repeated rows each give a row; a text of any
length is encoded whole, and one without a safe place to cut is one leaf; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, encoder
from .common import cut, drop, text_groups

RUN = 32  # pre-tokens a leaf, about
TREES = "doc_id long, text string, n_tokens long, edges array<int>, sums array<long>"
#: Letters: basic and extended Latin, Cyrillic, Kana, common Han, Hangul.
_LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x400, 0x481), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
_MARKS = ".,;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_LETTER, _MARK, _SOLID = (np.zeros(1 << 16, bool) for _ in range(3))
for _low, _high in _LETTERS:
    _LETTER[_low : _high + 1] = True
_MARK[[ord(c) for c in _MARKS]] = True
_SOLID[:] = _LETTER | _MARK
_SOLID[33:127] = True


def leaf_edges(text: str) -> np.ndarray:
    """Offsets at which leaves begin, and the end; an empty text is one leaf."""
    c = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)
    safe = np.zeros(0, np.int64)
    if len(c) > 2:
        blank = (c[1:-1] == 32) & _SOLID[c[:-2]] & _SOLID[c[2:]]
        safe = np.flatnonzero(blank | (_MARK[c[1:-1]] & _LETTER[c[:-2]])) + 1
    return np.concatenate([[0], safe[RUN - 1 :: RUN], [len(c)]])


def leaf_counts(enc: ChunkEncoder, leaves: list[str]) -> np.ndarray:
    """Token counts of leaves; a blank in front belongs to the first word."""
    blank = np.array([t[:1] == " " and t[1:2] not in ("", " ", "\n") for t in leaves], bool)
    _, at = enc.encode([t[1:] if b else t for t, b in zip(leaves, blank.tolist())], blank)
    return np.diff(at)


def _edges(enc: ChunkEncoder, text: str) -> np.ndarray:
    return np.array([0, len(text)]) if enc.kind == "whole" else leaf_edges(text)


def _leaves(text: str, edges: np.ndarray) -> list[str]:
    return [text[i:j] for i, j in zip(edges.tolist(), edges[1:].tolist())]


class CountTree:
    """Sums over ``n`` leaves: node i has children 2 i and 2 i + 1."""

    def __init__(self, sums: np.ndarray, n: int):
        self.sums, self.n = sums, n

    @staticmethod
    def of(counts: np.ndarray) -> CountTree:
        size = 1 << max(0, len(counts) - 1).bit_length()
        sums = np.zeros(2 * size, np.int64)
        sums[size : size + len(counts)] = counts
        while size > 1:
            half = size // 2
            sums[half:size] = sums[size : 2 * size].reshape(-1, 2).sum(1)
            size = half
        return CountTree(sums, len(counts))

    @property
    def total(self) -> int:
        return int(self.sums[1])

    @property
    def counts(self) -> np.ndarray:
        return self.sums[len(self.sums) // 2 :][: self.n]

    def replaced(self, regions: list[tuple[int, int, np.ndarray]]) -> CountTree:
        """With new counts for the leaves left to right of each region (first to
        last).  As many as before: only the sums on the way to the root change;
        else the leaves move, and the sums are taken anew."""
        if all(len(new) == right - left + 1 for left, right, new in regions):
            sums = self.sums.copy()
            for left, right, new in regions:
                for leaf, count in zip(range(left, right + 1), new.tolist()):
                    node = len(sums) // 2 + leaf
                    change = count - int(sums[node])
                    while node and change:
                        sums[node] += change
                        node //= 2
            return CountTree(sums, self.n)
        return CountTree.of(_spliced(self.counts, regions))


def _spliced(values: np.ndarray, regions: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    parts, done = [], 0
    for left, right, new in regions:
        parts += [values[done:left], new]
        done = right + 1
    return np.concatenate([*parts, values[done:]])


def _touched(start: int, end: int, edges: np.ndarray) -> tuple[int, int]:
    """First and last leaf that characters start to end lie in."""
    last = len(edges) - 2
    i = min(max(int(np.searchsorted(edges, start, "right")) - 1, 0), last)
    return i, min(max(int(np.searchsorted(edges, end, "left")) - 1, i), last)


def apply_edits(text: str, edges: np.ndarray, edits: list) -> tuple[list[tuple[int, int, str]], str]:
    """Edits (start, end, replacement) -> (first leaf, last leaf, new text) of each
    region to encode again, from first to last, and the edited text.  Edits whose
    regions meet share one, so regions lie apart."""
    limit = len(text)
    ordered = sorted(enumerate(edits), key=lambda e: (max(0, min(e[1][0], len(text))), e[0]), reverse=True)
    groups: list[list] = []  # first leaf, start, end, replacement
    for _, (start, end, new) in ordered:
        start = max(0, min(start, len(text)))
        end = max(start, min(end, limit))
        limit = start
        i, j = _touched(start, end, edges)
        if groups and j + 2 >= groups[-1][0]:
            behind = groups[-1]
            groups[-1] = [i, start, behind[2], new + text[end : behind[1]] + behind[3]]
        else:
            groups.append([i, start, end, new])
    regions, out, done = [], [], 0
    for _, start, end, new in reversed(groups):
        i, j = _touched(start, end, edges)
        left, right = max(i - 1, 0), min(j + 1, len(edges) - 2)
        regions.append((left, right, text[int(edges[left]) : start] + new + text[end : int(edges[right + 1])]))
        out += [text[done:start], new]
        done = end
    return regions, "".join([*out, text[done:]])


def _lists(arrays: list[np.ndarray], kind: str) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *arrays]).astype(kind)))


def _rows(column) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in column]


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs`` (doc_id, text) -> the table of trees."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in text_groups(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            edges = [_edges(enc, t) for t in texts]
            counts = leaf_counts(enc, [x for t, e in zip(texts, edges) for x in _leaves(t, e)])
            at = np.cumsum([len(e) - 1 for e in edges])[:-1]
            trees = [CountTree.of(c) for c in np.split(counts, at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([t.total for t in trees], pa.int64()), _lists(edges, "<i4"), _lists([t.sums for t in trees], "<i8")], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TREES)


_NAMES = [c.split()[0] for c in TREES.split(", ")]


def update_trees(trees: DataFrame, tokenizer: str) -> DataFrame:
    """``trees`` (the table, with edits array<struct<start, end, text>>) -> the
    table of the edited texts, with n_tokens_before and n_chars_encoded (again)."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in text_groups(batches):
            todo, leaves, texts, encoded = [], [], [], []
            old = zip(b.column(1).to_pylist(), _rows(b.column(3)), b.column(5).to_pylist())
            for text, edges, edits in old:
                regions, new = apply_edits(text, edges, [(e["start"], e["end"], e["text"] or "") for e in edits or () if e])
                texts.append(new)
                encoded.append(sum(len(r) for _, _, r in regions))
                for left, right, region in regions:
                    own = _edges(enc, region)
                    leaves += _leaves(region, own)
                    todo.append((len(texts) - 1, left, right, np.diff(own)))
            counts = np.split(leaf_counts(enc, leaves), np.cumsum([len(x[3]) for x in todo])[:-1]) if todo else []
            by_row: dict[int, list] = {}
            for (row, left, right, sizes), own in zip(todo, counts):
                # a region that was emptied leaves no leaf, unless it is all there is
                keep = sizes > 0
                by_row.setdefault(row, []).append((left, right, sizes[keep], own[keep]))
            new_edges, new_trees = [], []
            for row, (edges, sums) in enumerate(zip(_rows(b.column(3)), _rows(b.column(4)))):
                tree = CountTree(sums, len(edges) - 1)
                if row in by_row:
                    tree = tree.replaced([(x, y, own) for x, y, _, own in by_row[row]])
                    sizes = _spliced(np.diff(edges), [(x, y, own) for x, y, own, _ in by_row[row]])
                    edges = np.concatenate([[0], np.cumsum(sizes)])
                    if not tree.n:
                        tree, edges = CountTree.of(np.zeros(1, np.int64)), np.zeros(2, np.int64)
                new_edges.append(edges)
                new_trees.append(tree)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array([t.total for t in new_trees], pa.int64()), _lists(new_edges, "<i4"), _lists([t.sums for t in new_trees], "<i8"), b.column(2), pa.array(encoded, pa.int64())],
                [*_NAMES, "n_tokens_before", "n_chars_encoded"],
            )

    return trees.select(*_NAMES, "edits").mapInArrow(run, f"{TREES}, n_tokens_before long, n_chars_encoded long")


def edited_counts(docs: DataFrame, tokenizer: str, edits) -> DataFrame:
    """Trees of ``docs`` (doc_id, text) are stored, read back and updated by
    ``edits``, a column over doc_id and text: doc_id, n_tokens, n_tokens_edited,
    n_chars_edited, n_chars_encoded."""
    stored = cut(build_trees(docs, tokenizer), "trees")
    new = update_trees(stored.withColumn("edits", edits), tokenizer)
    out = cut(new.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("n_chars_edited"), "n_chars_encoded"), "counts")
    drop(stored)
    return out


def sample_edits(doc_id="doc_id", text="text", number: int = 3):
    """Edits that follow from doc_id and the text alone: a replacement, a
    deletion and an insertion at hashed places, in turn."""
    length = F.length(F.coalesce(text, F.lit("")))
    made = []
    for k in range(number):
        at = F.pmod(F.xxhash64(doc_id, F.lit(k)), length + 1).cast("int")
        end = at if k % 3 == 2 else at + F.pmod(F.xxhash64(F.lit(k), doc_id), F.lit(40)).cast("int")
        new = F.lit("") if k % 3 == 1 else F.concat(F.lit(" edited "), F.col(doc_id).cast("string"), F.lit(", so")) if k % 3 == 0 else F.lit("in\n serted ")
        made.append(F.struct(at.alias("start"), end.cast("int").alias("end"), new.alias("text")))
    return F.array(*made)
