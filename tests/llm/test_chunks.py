"""Chunked encoding against the tokenizers library on plain and odd texts."""

import random

import numpy as np
import public_tokenizers
import pytest

from weftline.llm import chunks, words

ODD = ["", " ", "a", "a  b", "a\n b", "a \nb", "a  ", " a", "\n", "a\n\nb", "\ta b", "it's John's <|endoftext|> x<|endoftext|>y  z", "a\r\nb c", "x\x1cy z\x1f w", "　a b", "ΑΣ ΣΑΣ ς", "é é ① ½ ²a", "don't we'll!!! ... \"q\". a.b.c", "<|startoftext|>hi <|endoftext|>.", "a b c", "İI ǅ", "a\x85b", "word.\nNext, É. ×. ÷. ’. ²."]
ODD += ["w’s it", "日本語 テキスト。", "a" * 3000, "x " * 50, "👍🏽 ok.", "é. É, Ö! ñ?", "A.\nB.\nC", "a\x7f b", "a\0b \0"]


def texts(seed):
    rnd = random.Random(seed)
    pool = [" ", " ", "\n", "a", "b.", "'s", "1", "²", "\t", "<|", "é", "|>", "\r", "Word", ",", "É", "×"]
    return ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14))) for _ in range(6000)] + ["Plain words, and lines.\nMore of them! Été? " * 3 + str(i) for i in range(50)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library(name):
    enc = chunks.ChunkEncoder(public_tokenizers.path(name), most=100)
    enc.fast = chunks.HashStore(bits=7)
    for seed in range(2):
        own = texts(seed)
        for i in range(0, len(own), 40):
            part = own[i : i + 40]
            if len(enc.fast.keys) > 60:
                enc.fast = chunks.HashStore(bits=10)
            ids, at = enc.encode(part)
            want = [e.ids for e in enc.lib.encode_batch(part, add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_store_keeps_what_came_up_most():
    store = chunks.HashStore(bits=6)
    rng = np.random.default_rng(1)
    known = rng.integers(0, 2**63, 20, dtype=np.uint64)
    store.add(known, np.zeros(20, np.uint32), [[i] * (i % 3) for i in range(20)])
    store.gather(np.repeat(np.arange(10), 5))
    store.add(rng.integers(0, 2**63, 15, dtype=np.uint64), np.zeros(15, np.uint32), [[7]] * 15)
    store.trim()
    codes = store.find(known, np.zeros(20, np.uint32))
    assert (codes[:10] >= 0).all() and (codes[10:] < 0).all()
    assert store.gather(codes[:10])[0].tolist() == [i for i in range(10) for _ in range(i % 3)]


def test_hash_of_a_word_without_its_last_byte():
    hashes, first, past, _, joined = words.words([b"abc. ab. x", b"abc ab x."])
    last = np.frombuffer(joined, np.uint8)[past - 1]
    bare = words.strip(hashes, last, first, past)
    assert bare[0] == hashes[3] and bare[1] == hashes[4] and bare[5] == hashes[2]
