"""Substring dedup against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import substring_dedup as sd


def brute(rows, size):
    cut = [[w for w in re.split("[ \t-\r]+", t or "") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in cut for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, cut):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        rest = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(rest), hashlib.sha256(" ".join(rest).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, size):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    passages = [[word() for _ in range(rnd.randint(max(1, size - 3), 3 * size))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rnd.randint(0, 4 * size))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            at = rnd.randint(0, len(w))
            p = rnd.choice(passages)
            if rnd.random() < 0.5:
                p = p[rnd.randrange(len(p)) :]
            w[at:at] = p
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    base = [word() for _ in range(200)]
    for i in range(40):
        w = list(base)
        w[rnd.randrange(200)] = word()
        rows.append((200 + i, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, "x " * 500), (303, "y z " * 300), (304, rows[3][1]), (304, rows[3][1]), (304, rows[4][1] + " é"), (305, "A b " * size), (306, "a b " * size)]


@pytest.mark.parametrize("size, hot, shard", [(35, 4096, 400_000), (10, 4096, 500), (12, 3, 2000), (1, 4096, 400_000), (4, 2, 400_000), (6, 4096, 400_000), (80, 4096, 9000), (120, 2, 400_000), (200, 4096, 400_000)])
def test_equals_brute_force(spark, monkeypatch, size, hot, shard):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD_WORDS", shard)
    rows = corpus(size, size)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int").repartition(4)
    assert sorted(map(tuple, sd.dedup_digests(docs, size).collect())) == brute(rows, size)


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", "x", 7)], "doc_id long, text string, dk string, first int").withColumn("_text", F.lit(3))
    got = sd.dedup(docs, 3, ["doc_id", "dk", "first", "_text"]).first()
    assert (got.doc_id, got.dk, got["first"], got._text, got.n_removed) == (1, "x", 7, 3, 6)
    with pytest.raises(ValueError):
        sd.dedup(docs, 0)


def test_empty_table(spark):
    assert sd.dedup_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_counts_equal_brute_force():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = sd.FMIndex(text, 64)
    flat = text.tolist()
    for _ in range(200):
        i = int(rng.integers(0, 290))
        pattern = flat[i : i + int(rng.integers(1, 10))]
        low, high = index.start(np.array(pattern[-1:]))
        for c in reversed(pattern[:-1]):
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == sum(flat[j : j + len(pattern)] == pattern for j in range(len(flat)))


def test_documents_of_one_hash_keep_their_own_spans(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    texts = [f"{shared} " + " ".join(f"a{i}" for i in range(9)), " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(5)) + f" {shared}"]
    docs = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "dk long, dc int, text string")
    found, _ = sd.repeated_spans(docs, 10)
    starts = {}
    for r in found.collect():
        starts.setdefault(r.dc, set()).update(r.first + x for x in (r.at or range(r.windows)))
    assert starts == {0: {0, 1, 2}, 2: {5, 6, 7}}
