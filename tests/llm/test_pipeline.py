"""The pipeline against brute-force versions of its first three stages."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_packing import check
from weftline.llm import jaccard_join, substring_dedup
from weftline.plans import storage


def cut_words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def expected(rows):
    rows = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    groups = components([(r.doc_id, r.text) for r in rows], 5, 80)
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    words = {r.doc_id: cut_words(r.text) for r in rows}
    seen = Counter(tuple(w[i : i + 50]) for w in words.values() for i in range(len(w) - 49))
    out = {}
    for r in rows:
        w = words[r.doc_id]
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if seen[tuple(w[i : i + 50])] > 1:
                gone[i : i + 50] = [True] * 50
        rest = [x for x, g in zip(w, gone) if not g]
        if len(rest) == len(w):
            out[r.doc_id] = r.text
        elif rest:
            out[r.doc_id] = " ".join(rest)
    return out


def test_stages_and_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", None, 0), (9001, "12 34", "en", "s", 5), (9002, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = expected(docs.collect())
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == corpus_pipeline.DOCUMENTS, name
    assert {r.doc_id: r.text for r in step.collect()} == texts
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(texts)
    check(rows, texts, 2048)


def test_repeated_and_missing_ids(spark, tmp_path):
    x, y, z = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    rows = [(9005, x), (9005, y), (9003, y + " more"), (None, z), (None, z), (None, "and " + z), (None, None), (9007, z + " end")]
    odd = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], docs.schema)
    step = odd
    for name, stage in corpus_pipeline.STAGES[:2]:
        step = stage(spark, step if name != "language_id" else docs.unionByName(odd), str(tmp_path))
    got = {(r.doc_id, r.text) for r in step.collect() if r.doc_id is None or r.doc_id > 9000}
    assert got == {(9005, x), (9003, y + " more"), (9007, z + " end")}
    for table in (docs.filter("false"), docs.filter("false").unionByName(odd.filter("text is null"))):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_languages_unlabelled_rows_and_the_session(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = docs.filter("lang is not null").select("doc_id", "lang")
    names = [f"spark.sql.execution.{x}" for x in ("arrow.maxRecordsPerBatch", "pythonUDF.arrow.enabled")]
    before = [spark.conf.get(x) for x in names]
    got = corpus_pipeline.recognised(spark, docs.withColumn("more", F.lit(1)), "")
    assert got.columns == corpus_pipeline.DOCUMENTS and before == [spark.conf.get(x) for x in names]
    # a document's lang is what was recognised, labelled or not
    assert got.filter("lang is null").count() == 0
    assert got.withColumnRenamed("lang", "found").join(known, "doc_id").filter("found = lang").count() >= 0.95 * got.join(known.select("doc_id"), "doc_id").count()
    bare = docs.limit(30).withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(9001, "12 34", None, "s", 5), (9002, None, None, "s", 0)], docs.schema))
    kept = corpus_pipeline.recognised(spark, bare, "")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in bare.collect() if r.text and any(c.isalpha() for c in r.text)}
    bare.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_very_long_texts_and_other_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    long = spark.createDataFrame([(9001, " ".join(f"w{i}x" for i in range(150_000)), None, "s", None), (9002, "long " * 200_000, None, "s", None)], docs.schema)
    odd = docs.unionByName(long).withColumn("group", F.lit("g")).withColumn("n", F.lit(None).cast("int")).withColumn("row_key", F.lit(3))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = expected(docs.unionByName(long).collect())
    assert {r.doc_id for r in rows} == set(texts) and 9001 in texts
    check(rows, texts, 2048)


def test_rows_that_share_a_key(spark, monkeypatch):
    """With a row_key of few values all documents are told apart by the other hash."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null")
    rows = [(-1, "!", "en", None, 1), (-1, "!", "en", None, 1), (-2, "!", "en", None, 1), (-3, "", "en", None, 0), (-4, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    expected = sorted(corpus_pipeline.distinct_documents(spark, docs, "").select("doc_id", "text").collect())
    assert [r.doc_id for r in expected[:3]] == [-4, -3, -2] and len({r.doc_id for r in expected}) == len(expected)
    groups = components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert {r.doc_id for r in expected} == {d for d, g in groups.items() if g[1] == d}
    whole = jaccard_join.row_key
    monkeypatch.setattr(jaccard_join, "row_key", lambda: F.pmod(whole(), F.lit(3)))
    assert sorted(corpus_pipeline.distinct_documents(spark, docs, "").select("doc_id", "text").collect()) == expected


def test_texts_move_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = corpus_pipeline.distinct_documents(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # documents by name, and the names that stay: by group, then by name
    texts = plan[: plan.index("one#")] if "one#" in plan else plan
    assert "SortMergeJoin" in texts and plan.count("hashpartitioning(row_key#") == 2 and "hashpartitioning(doc_id#" not in plan, plan


def test_texts_are_stored_once(spark, monkeypatch):
    """Whole texts that a stage stores beside its result stay on disk while later stages run."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stored, write = [], storage.cut
    for module in (corpus_pipeline, substring_dedup):
        monkeypatch.setattr(module, "cut", lambda df, label, *a: stored.append((label, df.columns)) or write(df, label, *a))
    step = corpus_pipeline.recognised(spark, docs, "")
    assert step.columns == corpus_pipeline.DOCUMENTS and not stored, stored
    step = corpus_pipeline.without_repeats(spark, step, "")
    assert step.columns == corpus_pipeline.DOCUMENTS
    assert [(label, [c for c in columns if "text" in c]) for label, columns in stored if any("text" in c for c in columns)] == [("deduped", ["kept_text"])]


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, " two  blanks\n"), (2, words), (3, f"x  y {words}"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(corpus_pipeline.without_repeats(spark, docs, "").select("doc_id", "text", "n_chars").collect()) == [(1, " two  blanks\n", None), (3, "x y", 3), (4, "", None), (5, None, None)]
