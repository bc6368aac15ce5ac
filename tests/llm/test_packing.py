"""Packing: invariants, bounds and a comparison with exhaustive search."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """Exhaustive search for the smallest number of bins."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, 31, rng.integers(1, 9))
        optimum = fewest(lengths.tolist(), 30)
        assert packing.lower_bound(lengths, 30) <= optimum <= len(packing.best_fit_decreasing(lengths, 30)[2])


def check(rows, texts, capacity):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, pieces in by_doc.items():
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.length == capacity for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("rows_a_partition", [16, 8192])
def test_packs_every_document(spark, rows_a_partition):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(["word", "tok en", "x"][k % 3] for k in range(int(rng.integers(0, 60)))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "long " * 500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = packing.pack(packing.piece_table(docs, PATH, 0, 64), 64, rows_a_partition).collect()
    assert {r.doc_id for r in out} == set(texts)
    n = check(out, texts, 64)
    assert n <= packing.lower_bound(np.array([r.length for r in out]), 64) + (1 if rows_a_partition > 16 else 10)


def test_repeated_rows_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 9, 1), (1, "a b", 9, 2)], "doc_id long, text string, bin int, offset long")
    out = packing.pack_documents(docs, PATH).collect()
    assert [r.doc_id for r in out] == [1, 1] and {r.offset for r in out} == {0, 3}
    assert packing.pack_documents(docs.filter("false"), PATH).count() == 0


def test_rounds_go_on_while_bins_are_won(spark, monkeypatch):
    lengths = np.random.default_rng(3).integers(12, 36, 8000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    labels = []
    cut = packing.cut
    monkeypatch.setattr(packing, "cut", lambda df, label: labels.append(label) or cut(df, label))
    rows = packing.pack(pieces, 64, 8).collect()
    assert labels.count("packed") > 6
    assert sorted(r.doc_id for r in rows) == list(range(8000))
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    print("rounds", labels.count("packed"), "sequences", len(at), "bound", packing.lower_bound(np.array(lengths), 64))
