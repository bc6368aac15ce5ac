"""Edited counts against encoding the edited text as a whole."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_chunks import texts
from weftline.llm import token_counts
from weftline.llm.chunks import ChunkEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def edited(text, edits):
    limit = len(text)
    order = sorted(range(len(edits)), key=lambda i: (max(0, min(edits[i][0], len(text))), i), reverse=True)
    out = text
    for i in order:
        a, b, new = edits[i]
        a = max(0, min(a, len(text)))
        b = max(a, min(b, limit))
        limit = a
        out = out[:a] + new + out[b:]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")


WIDE = "\u6c34\u306f\u6d41\u308c\u3001\u5c71\u306f\u9ad8\u3044\u3002\ud55c\uad6d\uc5b4\ub294 \uc5b4\ub835\ub2e4.\u0412\u043e\u0434\u0430 \u0442\u0435\u0447\u0451\u0442, \u0433\u043e\u0440\u044b "


def test_counts_after_two_batches_of_edits(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 2)
    lib = Tokenizer.from_file(PATH)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rnd = random.Random(8)
    pool = [*texts(3), WIDE, "it's", "don't.", " ", "\u3000", "x\u00a0y"]

    def edits(text):
        return [(rnd.randint(-1, len(text) + 2), rnd.randint(0, len(text) + 2), rnd.choice(["", " ", "x", "  y\n", " word", "<|endoftext|>", "é.", "\u3002", "\u6c34", "'"])) for _ in range(rnd.randint(0, 4))]

    enc = ChunkEncoder(PATH)
    for n in range(1500):
        text = rnd.choice([" ", ""]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))
        edges = token_counts.leaf_edges(text)
        tree = token_counts.CountTree.of(token_counts.leaf_counts(enc, token_counts._leaves(text, edges)))
        assert tree.total == count(text), text
    rows = []
    for n in range(600):
        text = rnd.choice([" ", ""]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))
        rows.append((n, text, edits(text)))
    trees = token_counts.build_trees(frame(spark, rows), PATH)
    for _ in range(3):
        got = token_counts.update_trees(trees.join(frame(spark, rows).select("doc_id", "edits"), "doc_id"), PATH).collect()
        assert len(got) == len(rows)
        want = {n: edited(text, own) for n, text, own in rows}
        for r in got:
            assert r.text == want[r.doc_id] and r.n_tokens == count(r.text) == r.sums[1], (r, rows[r.doc_id])
            assert r.edges[0] == 0 and r.edges[-1] == len(r.text) and (r.edges == sorted(set(r.edges)) or r.text == "")
        trees = spark.createDataFrame([tuple(r)[:5] for r in got], token_counts.TREES)
        rows = [(n, text, edits(text)) for n, text in want.items()]


def test_only_regions_are_encoded_and_leaves_do_not_grow(spark):
    lib = Tokenizer.from_file(PATH)
    for text in (" ".join(f"word{i}" for i in range(20_000)), WIDE * 2000):
        trees = token_counts.build_trees(frame(spark, [(1, text, None)]), PATH)
        for n in range(4):
            text_now = trees.first().text
            edit = (len(text_now) // 2, len(text_now) // 2 + 5, "new words and more of them, " * 40)
            got = token_counts.update_trees(trees.drop("edits").join(frame(spark, [(1, None, [edit])]).select("doc_id", "edits"), "doc_id"), PATH).first()
            assert got.text == edited(text_now, [edit]) and got.n_tokens == len(lib.encode(got.text).ids)
            assert got.n_chars_encoded < 4000 and max(b - a for a, b in zip(got.edges, got.edges[1:])) < 1200
            trees = spark.createDataFrame([tuple(got)[:5]], token_counts.TREES)


def test_table(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (3, "Hello there, world. " * 50, 5), (3, "Hello there, world. " * 50, 5)], "doc_id long, text string, n_tokens int")
    got = token_counts.edited_counts(docs, PATH, token_counts.sample_edits()).collect()
    lib = Tokenizer.from_file(PATH)
    rows = docs.withColumn("edits", token_counts.sample_edits()).collect()
    want = [(r.doc_id, len(lib.encode(r.text or "").ids), len(lib.encode(edited(r.text or "", [(e.start, e.end, e.text) for e in r.edits])).ids)) for r in rows]
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in got) == sorted(want)
    assert token_counts.edited_counts(docs.filter("false"), PATH, token_counts.sample_edits()).count() == 0
    assert token_counts.build_trees(docs, PATH).filter("n_tokens <> element_at(sums, 2)").count() == 0
