"""Variants against counts and comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import spelling_variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs, min_letters=6, min_count=5, factor=5, every=199):
    count = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_letters:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= min_count}
    beside = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(beside[w]), words.get(form[w], 0)) for w, n in words.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("seed, letters, lengths, every", [(1, "ab", (4, 9), 7), (2, "abé", (6, 8), 3), (3, "a", (4, 30), 2), (4, "abcdefgÿ", (6, 12), 5), (5, "abAB", (5, 7), 1)])
def test_equals_comparing_all_words(spark, seed, letters, lengths, every):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(*lengths))) for _ in range(150)]
    for w in words[:100]:  # one or two edits away
        for _ in range(rnd.randint(1, 2)):
            i, x = rnd.randrange(len(w)), rnd.choice(letters)
            w = rnd.choice([w[:i] + x + w[i:], w[:i] + w[i + 1 :], w[:i] + x + w[i + 1 :]])
        words.append(w)
    weights = [rnd.choice([1, 1, 3, 20, 150]) for _ in words]
    docs = [(i, rnd.choice(" \n.-_9ŁЖ").join(rnd.choices(words, weights, k=200))) for i in range(60)]
    kind = dict(min_letters=min(lengths), min_count=3, factor=2 + seed % 4, every=every)
    want = plain(docs, **kind)
    assert got(spelling_variants.variants(frame(spark, docs), **kind)) == want and any(x[1] for x in want)


def test_chains_of_forms(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    docs = [(i, " ".join(w for w, n in zip(chain, (1, 6, 40, 250, 1600)) for _ in range(n))) for i in range(5)]
    want = plain(docs, every=2**32)
    assert got(spelling_variants.variants(frame(spark, docs), every=2**32)) == want
    assert {r[2] for r in want} == {"aaaabbbb"} and [r[1] for r in want][:2] == ["aaaaaaab", "aaaaaabb"]


def test_nulls_ties_long_texts_extra_columns_and_no_rows(spark):
    docs = [(1, None), (2, ""), (None, "Élanter " * 7), (3, "ÉLANTER élanter elanters " * 5), (3, "ÉLANTER élanter elanters " * 5), (4, "abcdefg " * 50_000 + "abcdefh " * 50_000 + "bbcdefg " * 9), (5, "abcdef" * 100_000)]
    df = frame(spark, docs).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(None).cast("string"))
    assert got(spelling_variants.variants(df)) == plain(docs)
    empty = spelling_variants.variants(df.filter("doc_id = 1"))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling_variants.variants(df, min_letters=3)
