"""Components against brute force over all pairs of shingle sets."""

import random
import re

import pytest

from weftline.llm import jaccard_join


def brute(docs, k, percent):
    sets = {}
    for d, text in docs:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in sets:
        for y in sets:
            i = len(sets[x] & sets[y])
            if x < y and i and 100 * i >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                comp[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    docs = []
    for i in range(260):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.2:
            w = w + passage
        docs.append((i * 3, rnd.choice([" ", "\n", " \t"]).join(w)))
    return docs + [(1, None), (2, ""), (4, " \n"), (5, "One"), (7, "one"), (8, "a b c"), (10, "A B\tC"), (11, "x " * 3000), (13, "X " * 2999)]


@pytest.mark.parametrize("k, percent, rare, block", [(4, 85, 64, 512), (4, 85, 2, 16), (5, 80, 4, 8), (4, 100, 64, 512), (2, 51, 2, 8)])
def test_equals_brute_force(spark, monkeypatch, k, percent, rare, block):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = corpus(k + rare)
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, k, percent)
    assert len(got) == len(docs)


def test_empty_table_extra_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e", 1, "x"), (3, "a b c d e", 2, "y"), (9, "A b c d e", 3, "z")], "doc_id long, text string, n long, component string")
    got = jaccard_join.jaccard_components(docs, 4, 85)
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(3, 2, 3, 3), (3, 2, 3, 3), (9, 2, 3, 3)]
    assert jaccard_join.jaccard_components(docs.filter("false"), 4, 85).count() == 0


def test_doc_ids_with_two_texts_and_bad_percents(spark):
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    docs = spark.createDataFrame([(5, x), (5, y), (3, y + " z"), (7, x + " z"), (None, y), (None, None), (None, "w " + y)], "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs, 4, 85).collect()
    assert sorted((r.n_shingles, r.component_id or -1, r.doc_id or -1) for r in got) == [(0, -1, -1), (57, 3, -1), (57, 3, 5), (57, 5, 5), (58, 3, -1), (58, 3, 3), (58, 5, 7)]
    assert len({r.group for r in got}) == 3
    for percent in (0, 50, 101):
        with pytest.raises(ValueError):
            jaccard_join.jaccard_components(docs, 4, percent)
