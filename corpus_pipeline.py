"""From raw documents to packed training sequences.

1. ``language_id``: documents in which no learned language is recognised (no
   text, or no letters) go; the others get the language recognised as their lang.
   Where no row is labelled, all documents with letters stay as they are.
2. ``jaccard_join``: of each group of documents linked by a Jaccard similarity
   of 0.8 or more of their five-word shingles, the one with the smallest
   doc_id stays.
3. ``substring_dedup``: words in passages of 50 words or more that start
   elsewhere too go; a document that loses nothing keeps its text as it is, one
   that loses all its words goes, others keep the rest joined by blanks.
4. ``packing``: what is left is packed into sequences of 2048 tokens.

Each stage takes the documents its predecessor kept and, but for the last,
returns the columns of documents.  ``run`` stores what a stage returns, once; a
stage stores no whole texts of its own but what is left of repeats.

Defined results: a null or empty text has no language and goes; a null doc_id
is a document like any other; rows equal in doc_id and text are one document
(any of them stays), rows equal in doc_id alone are told apart by their texts;
of a group the smallest doc_id stays, a null one last, between equal ones any;
texts of any length are read whole; other columns of documents are dropped; an
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, language_id, packing, substring_dedup
from weftline.llm.common import cut, table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def recognised(spark, docs, sf_dir):
    docs = docs.select(*DOCUMENTS)
    model = language_id.fit(docs)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    label = language_id.label(spark, model)
    return docs.withColumn("lang", label("text")).filter("lang <> 'und'")


def distinct_documents(spark, docs, sf_dir):
    groups = jaccard_join.jaccard_components(docs, k=5, percent=80)
    name = ["row_key", "row_tag"]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *name)
    # documents without shingles are groups of their own
    stay = groups.groupBy("group", *(F.when(F.col("group").isNull(), F.col(c)).alias(f"own_{c}") for c in name)).agg(F.min(order).alias("one")).select("one.row_key", "one.row_tag")
    # distinct rows by their name, so that they lie as the join wants them and texts move once
    rows = docs.select(*DOCUMENTS, jaccard_join.row_key().alias("row_key"), jaccard_join.row_tag().alias("row_tag")).dropDuplicates(name)
    return rows.join(stay, name, "left_semi").select(*DOCUMENTS)


def without_repeats(spark, docs, sf_dir):
    rest = substring_dedup.dedup(docs, 50, ["doc_id", "lang", "source", "n_chars"], as_is=True).filter("n_removed = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def packed(spark, docs, sf_dir):
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("language_id", recognised), ("jaccard_join", distinct_documents), ("substring_dedup", without_repeats), ("packing", packed)]
#: No stage but the last filter is expressible in SQL; tests/llm checks the rows against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
