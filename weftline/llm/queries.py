"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import centroid_clusters, jaccard_join, language_id, media_copies, minhash_dedup, packing, piece_spans, spelling_variants, substring_dedup, token_counts, token_output, url_filter, vector_search
from .common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_output(spark, sf_dir):
    return token_output.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_media_copies(spark, sf_dir):
    return media_copies.copy_groups(media_copies.pictures_of(table(spark, sf_dir, "embeddings")))


def op3_piece_spans(spark, sf_dir):
    return piece_spans.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark, sf_dir):
    return token_counts.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_counts.sample_edits())


def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.UrlFilter(URL_RULES).fit(pages).judge(pages).drop("url")


def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_digests(table(spark, sf_dir, "documents"), size=35)


def op9_vector_search(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"), min_letters=6, min_count=5, factor=5, every=199)


def op13_centroid_clusters(spark, sf_dir):
    return centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings"), size=64, k=8, rounds=10, scale=1024, seed=3)


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)"
_OP5 = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT h || p FROM rules r WHERE {_FITS} ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules r WHERE {_FITS} ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""


def _lloyd(k, rounds):
    """Assignments and centroids round by round; ``own`` numbers the kept rows."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    near = "SELECT own, arg_min(j, {{'d': d, 'j': j}}) AS j, min(d) AS d FROM (SELECT own, j, {far} AS d FROM kept, c{r}) GROUP BY own"
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, x AS c FROM kept QUALIFY j < {k})"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED ({near.format(far=far, r=r)}),
s{r} AS (SELECT j, i, sum(x[i])::BIGINT AS t, count(*) AS n FROM a{r} JOIN kept USING (own), (SELECT unnest(range(1, 65)) AS i) GROUP BY j, i),
m{r} AS (SELECT j, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return f"""WITH {", ".join(parts)}, fin AS ({near.format(far=far, r=rounds)})
SELECT vec_id, j::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM fin JOIN kept USING (own) JOIN c{rounds} USING (j)"""


def queries():
    return {
        "op1_token_output": op1_token_output,
        "op2_media_copies": op2_media_copies,
        "op3_piece_spans": op3_piece_spans,
        "op4_token_counts": op4_token_counts,
        "op5_url_filter": op5_url_filter,
        "op6_packing": op6_packing,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_vector_search": op9_vector_search,
        "op10_language_id": op10_language_id,
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_centroid_clusters": op13_centroid_clusters,
    }


def oracle_sql():
    return {"op5_url_filter": _OP5, "op13_centroid_clusters": _lloyd(8, 10)}
