"""One query per operator over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from songloom.llm.exact_dedup import exact_groups
from songloom.llm.langid import identify
from songloom.llm.mixing import taken_words
from songloom.llm.near_vectors import near_links
from songloom.llm.ngram_join import near_groups
from songloom.llm.orchard import clustered
from songloom.llm.packing import pack
from songloom.llm.page_text import extract_text
from songloom.llm.substrings import remove_repeats
from songloom.llm.text_model import score_texts
from songloom.llm.tokens import count_tokens
from songloom.llm.toxicity import toxicity
from songloom.llm.whitening import whitened

#: Weights that the mixing contract gives to the sources in turn.
WEIGHTS = (3.0, 1.0, 2.0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_cube_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(table(spark, folder, "documents"), WEIGHTS).drop("source")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = identify(table(spark, folder, "documents"), reject=False)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_links(table(spark, folder, "embeddings"))


def op11_context_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


def op12_orchard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cube_mixing, op2_substring_dedup, op3_exact_dedup, op4_language_id, op5_ngram_jaccard_join, op6_token_counts, op7_toxicity,
        op8_bin_slack_packing, op9_wrapper_induction, op10_near_vectors,
        op11_context_tree_scores, op12_orchard_clusters, op13_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op5_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
        ), g AS (
            SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
            FROM w WHERE len(w) > 0
        ), c AS (
            SELECT md5(array_to_string(list_sort(g), '|')) AS c, any_value(g) AS g, count(*) AS n, min(doc_id) AS first FROM g GROUP BY 1
        ), s AS (SELECT c, n, len(g) AS size, unnest(g) AS s FROM c),
        p AS (
            SELECT a.c AS a, b.c AS b FROM s a JOIN s b ON a.s = b.s AND a.c <> b.c
            GROUP BY a.c, b.c, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9
        ), reach AS (
            SELECT c AS a, c AS b FROM c UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
        ), k AS (
            SELECT reach.a AS c, min(o.first) AS class_id FROM reach JOIN c o ON o.c = reach.b GROUP BY 1
        ), l AS (
            SELECT c.c, c.n - 1 + coalesce(sum(o.n), 0) AS n_links
            FROM c LEFT JOIN p ON p.a = c.c LEFT JOIN c o ON o.c = p.b GROUP BY c.c, c.n
        ), d AS (
            SELECT doc_id, md5(array_to_string(list_sort(g), '|')) AS c FROM g
        )
        SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
            coalesce(class_id, documents.doc_id) = documents.doc_id AS kept
        FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN k USING (c) LEFT JOIN l USING (c)
    """,
    "op10_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
        FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op2_substring_dedup": """
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
        ), p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w WHERE len(w) >= 20),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM p),
        r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM r),
        l AS (SELECT doc_id, w, list(i) AS gone FROM w LEFT JOIN gone USING (doc_id) GROUP BY doc_id, w),
        k AS (
            SELECT doc_id, len(w) AS n, list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(gone, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept
            FROM l
        )
        SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op12_orchard_clusters": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (
            SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1)::INTEGER AS cluster, x FROM v
            ORDER BY sha256('1:' || vec_id), x LIMIT 16
        ),
        d1 AS (
            SELECT v.vec_id, v.row, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM v, c0 c
        ), a1 AS (SELECT row, any_value(x) AS x, arg_min(cluster, d * 16 + cluster) AS cluster FROM d1 GROUP BY row),
        s1 AS (SELECT cluster, i, floor(sum(x[i]) / count(*)) AS m FROM a1, range(1, 65) r(i) GROUP BY cluster, i),
        c1 AS (
            SELECT c.cluster, coalesce(n.x, c.x) AS x
            FROM c0 c LEFT JOIN (SELECT cluster, list(m::BIGINT ORDER BY i) AS x FROM s1 GROUP BY cluster) n USING (cluster)
        ),
        d2 AS (
            SELECT v.vec_id, v.row, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM v, c1 c
        ), a2 AS (SELECT row, any_value(x) AS x, arg_min(cluster, d * 16 + cluster) AS cluster FROM d2 GROUP BY row),
        s2 AS (SELECT cluster, i, floor(sum(x[i]) / count(*)) AS m FROM a2, range(1, 65) r(i) GROUP BY cluster, i),
        c2 AS (
            SELECT c.cluster, coalesce(n.x, c.x) AS x
            FROM c1 c LEFT JOIN (SELECT cluster, list(m::BIGINT ORDER BY i) AS x FROM s2 GROUP BY cluster) n USING (cluster)
        ),
        d3 AS (
            SELECT v.vec_id, v.row, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM v, c2 c
        ), a3 AS (SELECT row, any_value(x) AS x, arg_min(cluster, d * 16 + cluster) AS cluster FROM d3 GROUP BY row),
        s3 AS (SELECT cluster, i, floor(sum(x[i]) / count(*)) AS m FROM a3, range(1, 65) r(i) GROUP BY cluster, i),
        c3 AS (
            SELECT c.cluster, coalesce(n.x, c.x) AS x
            FROM c2 c LEFT JOIN (SELECT cluster, list(m::BIGINT ORDER BY i) AS x FROM s3 GROUP BY cluster) n USING (cluster)
        ),
        d4 AS (
            SELECT v.vec_id, v.row, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM v, c3 c
        ), f AS (SELECT row, any_value(vec_id) AS vec_id, arg_min(cluster, d * 16 + cluster) AS cluster, min(d) AS distance FROM d4 GROUP BY row)
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
        FROM f JOIN c3 USING (cluster)
    """,
}
