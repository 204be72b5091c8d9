"""The registered queries of the operators: whole tables in, whole results out, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embed_dedup import near_duplicate_vectors
from .html_text import extract
from .maxscore import top_k
from .mixing import mix
from .packing import pack
from .quality import score_quality
from .rans import round_trip
from .simhash import near_duplicates
from .substring import remove_repeats
from .toxicity import score_toxicity


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with the words the mix of sources takes of it."""
    return mix(table(spark, sf_dir, "documents"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every 20th row of embeddings."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and the digest of what is left of every document without repeated 35-word windows."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces of documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written token files hold of every document."""
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_maxscore": op2_maxscore,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring": op6_substring,
    "op7_simhash": op7_simhash,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
}

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES: dict[str, str] = {
    "op2_maxscore": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS i FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.i, c.i) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op5_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE} AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM r GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op6_substring": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, w FROM d),
k AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN md5(array_to_string(w[i : i + 34], ' ')) END AS h FROM p),
c AS (SELECT doc_id, i, word, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN i END AS hit FROM k),
g AS (SELECT doc_id, i, word, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone FROM c),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)""",
}
