"""Language identification: parsing against brute force, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from weftline.llm import language_id

SAMPLES = {"aa": ["the cat sat on the mat and then the rat ran"], "bb": ["zwölf boxkämpfer jagen viktor quer über den großen sylter deich"]}


def brute(model, label, text):
    """Phrases of one text by substring search in the training text."""
    own, at, _ = language_id.symbols(SAMPLES[label], model.of_char)
    train = tuple(own.tolist()) + (language_id.BLANK,)
    doc = language_id.symbols([text], model.of_char)[0].tolist()
    count = 0
    for s in range(0, len(doc), language_id.SEGMENT):
        piece = doc[s : s + language_id.SEGMENT]
        i = 0
        while i < len(piece):
            n = 0
            while i + n < len(piece) and any(train[j : j + n + 1] == tuple(piece[i : i + n + 1]) for j in range(len(train) - n)):
                n += 1
            i += max(n, 1)
            count += 1
    return count


def test_phrases_equal_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "SEGMENT", 16)
    model = language_id.LanguageModel(SAMPLES)
    rnd = random.Random(4)
    texts = ["", "123", "the cat", "Über den Deich!", "日本 the 語", "x"] + ["".join(rnd.choice("the catznßü 1é") for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    count, lengths, letters = model.phrases(texts)
    for t, c in zip(texts, count):
        assert c.tolist() == [brute(model, k, t) for k in model.labels], t


def test_labels_nulls_and_fold(spark):
    rows = [(i, SAMPLES["aa"][0][i % 20 :], "aa", 1.0) for i in range(30)] + [(i, SAMPLES["bb"][0][i % 20 :], "bb", 1.0) for i in range(30, 60)]
    rows += [(60, None, "aa", 0.0), (61, "123 !?", "bb", 0.0), (62, "", None, 0.0), (63, "the cat " * 20000, None, 0.0), (63, "the cat", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        want = "aa" if r.doc_id < 30 or r.doc_id == 63 else "bb" if r.doc_id < 60 else "und"
        assert r.lang_pred == want, r
    assert language_id.identify(docs.filter("false")).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id = 1").selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    pred = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert pred.selectExpr("avg(int(lang = lang_pred)) as a").first().a >= 0.95


def test_scripts_with_many_letters(spark):
    rnd = random.Random(2)
    draw = lambda low, n: "".join(chr(low + int(n * rnd.random() ** 2)) + (" " if rnd.random() < 0.2 else "") for _ in range(900))
    rows = [(i, draw(0x4E00, 9000), "han") for i in range(40)] + [(i, draw(0xAC00, 9000), "hangul") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    known = {c for _, t, k in rows for c in t if c.isalpha()}
    assert sum(model.of_char[ord(c)] > language_id.UNKNOWN for c in known) > 4096
    got = language_id.identify(docs).join(docs, "doc_id").filter("held_out").collect()
    assert got and all(r.lang_pred == r.lang for r in got)


def test_many_labels_repeated_rows_and_long_texts(spark):
    rows = []
    for k in range(60):
        letters = [chr(97 + (k * 7 + j * (k + 1)) % 26) for j in range(5)] + [chr(0x430 + k % 32)]
        rnd = random.Random(k)
        rows += [(100 * k + i, " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(60)), f"l{k:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    same = spark.range(100_000).selectExpr("7L as doc_id", "'la la la lo lu' as text", "'one' as lang")
    long = spark.createDataFrame([(5, "wo wi wu " * 8_000, "two"), (6, "wi wo wu " * 9_000, "two"), (8, "wi wu wo " * 9_000, "two")], docs.schema)
    docs = docs.unionByName(same).unionByName(long)
    model = language_id.fit(docs, rows=8, usual=3000)
    assert len(model.labels) == 62
    got = language_id.predict(docs, model, ["doc_id", "lang"]).groupBy("lang", "lang_pred").count().collect()
    assert sum(r["count"] for r in got if r.lang == r.lang_pred) >= 0.99 * sum(r["count"] for r in got)


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "the cat", "x", "y")], "doc_id long, text string, _text string, c0 string")
    got = language_id.predict(docs, language_id.LanguageModel(SAMPLES), ["doc_id", "_text", "c0", "text"]).first()
    assert (got.doc_id, got._text, got.c0, got.text, got.lang_pred) == (1, "x", "y", "the cat", "aa")


def test_texts_of_the_sample_are_learned_whole(spark):
    rnd = random.Random(6)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(6))
    texts = [" ".join(word("abcdefg") for _ in range(20_000)) for _ in range(2)]
    rows = [(1, texts[0], "x"), (3, texts[1], "x"), (None, " ".join(word("stuv") for _ in range(99)), "x"), (8, "zyz yzy zzy", "y")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for t in texts:  # any piece of either is one phrase
        for at in (0, 50_000, 99_000, len(t) - 201):
            assert model.phrases([t[at : at + 200]])[0][0].tolist()[0] <= 1 + (not t[at].isalpha())
    assert model.labels == ["x", "y"] and model.bits[0] > np.log2(2 * 139_000)
    assert not {ord(c) for c in "stuv"} & set(np.flatnonzero(model.of_char > language_id.UNKNOWN).tolist())
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.lang_pred) for r in got)[0][:2] == (0, False)
