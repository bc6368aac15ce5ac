"""Pieces, spans and the character map against the library's own results."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from weftline.llm import piece_spans
from weftline.llm.piece_spans import CharMap, PieceEncoder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a\n b", "\n", "a\rb", "▁", "a▁b", "▁▁ a", "<s> </s> <unk>", "日本語 テキスト", "👍🏽 ok", "ﬁne ① Ⅷ ｆｕｌｌ", "x" * 3000, "é é", "a　b  c", "<0x0A>"]


def texts():
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice([" ", "\n", "ab", "the", "▁", "é", "語", "\r", "1", ". "]) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]


def test_ids_and_decoding_equal_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceEncoder(MODEL)
    ids, at = own.encode(texts())
    for t, i, j in zip(texts(), at, at[1:]):
        assert lib.encode(t) == ids[i:j].tolist(), repr(t)


def test_spans_give_back_the_source():
    own = PieceEncoder(MODEL)
    ids, at = own.encode(texts())
    for t, i, j in zip(texts(), at, at[1:]):
        start, end = own.spans(t, ids[i:j])
        assert b"".join(t.encode()[a:b] for a, b in zip(start, end)) == t.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_character_map_equals_the_library(rule):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    chars = CharMap(pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec.precompiled_charsmap)
    for t in texts():
        assert b"".join(n for _, n, _ in chars.segments(t)).decode() == lib.normalize(t), repr(t)
        assert b"".join(s for s, _, _ in chars.segments(t)) == t.encode()


@pytest.mark.parametrize("options", [(True, True), (True, False), (False, True)])
def test_a_model_with_a_character_map(tmp_path, options):
    model = pb.ModelProto.FromString(open(MODEL, "rb").read())
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model.normalizer_spec.precompiled_charsmap = pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = options
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    lib, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), PieceEncoder(str(path))
    ids, at = own.encode(texts())
    for t, i, j in zip(texts(), at, at[1:]):
        assert lib.encode(t) == ids[i:j].tolist(), repr(t)
        start, end = own.spans(t, ids[i:j])
        assert (start[1:] >= start[:-1]).all() and (end >= start).all() and (not len(end) or end[-1] <= len(t.encode()))


def test_table(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:300])] + [(900, None, 2), (900, None, 2), (901, "long words " * 20000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((d, len(ids), sha, hashlib.sha256(lib.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, piece_spans.piece_digests(docs, MODEL).collect())) == sorted(want)
    spans = piece_spans.encode_spans(docs.filter("doc_id < 300"), MODEL).collect()
    by_id = {d: t or "" for d, t, _ in rows}
    for r in spans:
        assert b"".join(by_id[r.doc_id].encode()[a:b] for a, b in zip(r.starts, r.ends)) == by_id[r.doc_id].encode()
    assert piece_spans.piece_digests(docs.filter("false"), MODEL).count() == 0
