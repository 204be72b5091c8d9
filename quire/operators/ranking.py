"""Dense ranking, rank lists, reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import constants as C
from quire.operators import scoring
from quire.scratch import Workspace


#: Query vectors of one block.
BLOCK = 4096
#: Bytes of blocks that a task keeps; more blocks are read again for each batch of vectors.
BROADCAST_BYTES = 64 << 20
#: Scores that agree to this many decimals tie: the order of a sum must not decide a rank.
DIGITS = 9


def _scored(vectors: DataFrame, query_vectors: DataFrame, key: list[str], pool: int | None) -> DataFrame:
    """Queries are written in blocks that hold all vectors of a query; a slice of vectors meets a block in one matrix product."""
    space = Workspace(vectors.sparkSession, "dense")
    asked = space.save(query_vectors.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    space.save(asked.repartition(blocks, "query_id"), "blocks")
    rows = vectors.select(*key, "embedding")
    schema = ", ".join(["query_id " + asked.schema["query_id"].dataType.simpleString(), *(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key), "score double"])
    uri = space.path("blocks")
    kept = BROADCAST_BYTES
    run = scoring.every(uri, scoring.Vectors, key, False, kept) if pool is None else scoring.best(uri, scoring.Vectors, key, False, pool, DIGITS, kept)
    return rows.mapInArrow(run, schema)


def dense_scores(vectors: DataFrame, query_vectors: DataFrame, key: list[str]) -> DataFrame:
    """query_id, key, score: the best dot product over a query's vectors (both sides of unit length); null where a vector is or holds null."""
    return _scored(vectors, query_vectors, key, None)


def dense_best(vectors: DataFrame, query_vectors: DataFrame, key: list[str], pool: int = C.SEARCH_POOL) -> DataFrame:
    """Of `dense_scores`, all rows that `rank_list` or `top` can take with up to `pool` rows a query: each task's best."""
    return _scored(vectors, query_vectors, key, pool)


def rank_list(scores: DataFrame, key: list[str], pool: int = C.SEARCH_POOL, positive: bool = False) -> DataFrame:
    """query_id, key, rank: the best `pool` of each query, ties by key; positive drops scores that aren't.

    The cut is a window group limit: each task keeps `pool` rows a query before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), *key)
    ranked = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= pool)
    return (ranked.where("score > 0") if positive else ranked).select("query_id", *key, "rank")


def fuse(lists: list[DataFrame], key: list[str], rrf_k: int = C.RRF_K) -> DataFrame:
    """query_id, key, score: the sum of 1 / (rrf_k + rank) over the lists."""
    both = lists[0]
    for more in lists[1:]:
        both = both.unionByName(more)
    return both.groupBy("query_id", *key).agg(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"))


def top(scores: DataFrame, key: list[str], k: int = C.DEFAULT_K) -> DataFrame:
    """The k best rows of each query with their rank."""
    if k < 1:
        raise ValueError(f"ask for one result or more, not {k}")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), *key)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
