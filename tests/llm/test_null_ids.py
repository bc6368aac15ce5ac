"""Rows without an id, and clashing column names, go through every operator."""

import public_tokenizers

from weftline.llm import jaccard_join, language_id, packing, piece_spans, substring_dedup, token_counts, url_filter

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_null_ids(spark):
    text = "one two three four five six seven eight nine ten " * 5
    docs = spark.createDataFrame([(None, text, "en"), (None, None, None), (4, text + "more", "en"), (5, text, None)], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "1 as dk", "2 as n", "3 as key", "4 as sig", "5 as piece", "6 as n_words", "'x' as lang_pred")
    assert packing.pack_documents(docs, BYTE).count() == 4
    assert piece_spans.piece_digests(docs, PIECE).count() == 4
    assert piece_spans.encode_spans(docs, PIECE).count() == 4
    assert language_id.identify(docs).count() == 4
    assert substring_dedup.dedup(docs, 35, ["doc_id", "dk", "key"]).columns == ["doc_id", "dk", "key", "n_words", "n_removed", "kept_text"]
    assert sorted(r.n_removed for r in substring_dedup.dedup_digests(docs, 35).collect()) == [0, 50, 50, 50]
    rows = jaccard_join.jaccard_components(docs, 4, 85).collect()
    assert len(rows) == 4 and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert token_counts.edited_counts(docs, BYTE, token_counts.sample_edits()).count() == 4
    pages = spark.createDataFrame([(None, None, "h", 1)], "page_id long, url string, host string, key int")
    assert url_filter.UrlFilter([("net", "/", "block")]).fit(pages).judge(pages).collect()[0].verdict == "allow"
