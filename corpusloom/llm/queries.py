"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dual_tree, hnsw, html_content, maxent, mixing, packing, simhash, spelling, surrogates, syncmers, token_counts, token_files, toxicity
from .common import table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.neighbour_likeness(table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "n_entities")


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.lloyd(table(spark, sf_dir, "embeddings"))


def op12_hashed_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_pii_surrogates,
        op3_poisson_mixing,
        op4_html_main_text,
        op5_toxicity_scores,
        op6_trie_token_counts,
        op7_cost_balanced_packing,
        op8_hnsw_near_duplicates,
        op9_simhash_near_duplicates,
        op10_huffman_token_files,
        op11_dual_tree_lloyd,
        op12_hashed_maxent_scores,
        op13_spelling_variants,
    )
}


def _unit(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def _lloyd(rounds: int) -> str:
    """Each round as two steps: the vectors with their clusters, and the centroids after it."""
    steps = [
        """v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    apart = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, cluster)) AS best FROM (SELECT row, vec_id, v, cluster, {apart} AS d FROM v, c{i}) GROUP BY row)")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT cluster, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS m FROM (SELECT best[2] AS cluster, place, sum(v[place])::DOUBLE AS total, count(*)::DOUBLE AS n FROM a{i}, range(1, 65) AS t(place) GROUP BY 1, 2) GROUP BY 1),
            c{i + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))""")
    return f"""WITH {', '.join(steps)} SELECT vec_id, best[2] AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best[2] = cluster"""


#: DuckDB SQL where it can express the operator.
ORACLES: dict[str, str] = {
    "op3_poisson_mixing": f"""WITH m AS (SELECT coalesce(source, chr(0)) AS origin, sum(greatest(coalesce(length(text), 0), 1))::DOUBLE AS mass FROM documents GROUP BY 1),
        r AS (SELECT origin, 1.0::DOUBLE / (SELECT count(*) FROM m)::DOUBLE * (SELECT sum(mass) FROM m) / mass AS rate FROM m),
        c AS (SELECT origin, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY origin ORDER BY k) AS cdf FROM r, range(0, 2000) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
        d AS (SELECT *, coalesce(source, chr(0)) AS origin, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents),
        n AS (SELECT d.*, (SELECT count(*) FROM c WHERE c.origin = d.origin AND c.cdf <= {_unit("'mix|' || key")}) AS times FROM d)
        SELECT doc_id, text, lang, source, n_chars, CAST(k AS BIGINT) AS copy, {_unit("'mix-order|' || key || '|' || CAST(k AS VARCHAR)")} AS order_key FROM n, range(1, 2000) AS t(k) WHERE k <= times""",
    "op8_hnsw_near_duplicates": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE),
        r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id""",
    "op11_dual_tree_lloyd": _lloyd(3),
}
