"""Token files: exact round trips and the contract's digests."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [1, 255, 256, 65536, 2**24, 2**32 - 1])
def test_code_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = rng.integers(0, top + 1, n).astype(np.uint32)
        ends = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 3)), [n]])
        control, _, data, at = token_output.encode_ranks(values, ends)
        assert at[-1] == len(data)
        assert (token_output.decode_ranks(control.tobytes(), data.tobytes(), np.diff(ends)) == values).all()


def expected(rows, end_id=1):
    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark):
    rows = [(i * 7 % 101, ["Hello, World! it's 42", "", None, "ΑΣ ⅷ́ \x1c　x", "a\n\n  b<|endoftext|>c", "Zoë naïve 'll"][i % 6] and "".join(["Hello, World! it's 42", "", "", "ΑΣ ⅷ́ \x1c　x", "a\n\n  b<|endoftext|>c", "Zoë naïve 'll"][i % 6] * (1 + i % 4))) for i in range(101)] + [(500, "very long " * 20000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, file int").repartition(5)
    got = sorted(map(tuple, token_output.round_trip(docs, PATH).collect()))
    assert got == expected(rows)


def test_order_of_files_and_end_offsets(spark, tmp_path):
    rows = [(i, f"word {i} " * (i % 9)) for i in range(400)]
    path = f"file://{tmp_path}/t"
    token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), path, PATH, block_tokens=50)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("file", "base").collect()
    ids = np.concatenate([np.frombuffer(b.doc_ids, "<i8") for b in blocks])
    assert (np.diff(ids) > 0).all() and len(ids) == 400
    got = sorted(map(tuple, token_output.id_digests(token_output.read_tokens(spark, path)).collect()))
    assert got == expected(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert [r.start for r in token_output.round_trip(docs, PATH).orderBy("start").collect()] == [0, 2, 4]
    assert token_output.round_trip(docs.filter("false"), PATH).count() == 0
    null = spark.createDataFrame([(None, "b"), (-5, "a"), (-(2**63), "c")], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in token_output.round_trip(null, PATH).orderBy("start").collect()] == [(None, 0), (-(2**63), 2), (-5, 4)]


def test_rows_of_one_id_spread_over_files(spark, tmp_path):
    rows = [(7 if i % 3 else None, f"word {i} " * (i % 5)) for i in range(3000)]
    path = f"file://{tmp_path}/t"
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # the parts of a small table would be put together
    try:
        token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, PATH)
    finally:
        spark.conf.unset(small)
    assert spark.read.parquet(f"{path}/blocks").select("file").distinct().count() >= 6
    got = sorted(token_output.id_digests(token_output.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 1000 + [7] * 2000
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(r.ids_crc32 for r in got) == sorted(x[3] for x in expected([(0, t) for _, t in rows]))
