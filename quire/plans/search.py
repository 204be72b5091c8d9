"""Evidence search: dense and BM25 rankings, fused; best sentence and neighbours of the few results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import cite, text as T
from quire.functions.vector import dot
from quire.operators.chunks import with_neighbours
from quire.operators.lexical import bm25_best
from quire.operators.ranking import dense_best, fuse, rank_list, top
from quire.scratch import Workspace
from quire.sources.embedder import Embedder

KEY = ["ordinal", "source_id", "chunk_id"]


def query_vectors(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """query_id, embedding: one vector, or one a sentence for a query over 200 words."""
    long = F.size(F.split(T.squeeze(F.col("text")), " ")) > C.LONG_QUERY_WORDS
    parts = F.when(long, T.sentences(F.col("text"))).otherwise(F.array("text"))
    return queries.select("query_id", F.explode(parts).alias("part")).select("query_id", embedder.embed(F.col("part")).alias("embedding"))


def corpus(chunks: DataFrame, vectors: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources in step, sources skipped): in step are those with as many vectors as chunks, and some."""
    n = chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"))
    m = vectors.groupBy("source_id").agg(F.count("*").alias("n_vectors"))
    both = sources.join(n, "source_id", "left").join(m, "source_id", "left")
    good = F.coalesce(F.col("n_chunks") == F.col("n_vectors"), F.lit(False))
    return both.where(good).select(*sources.columns), both.where(~good).select("source_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"))


def search(
    chunks: DataFrame, vectors: DataFrame, sources: DataFrame, queries: DataFrame, embedder: Embedder, k: int = C.DEFAULT_K, only: list[str] | None = None,
) -> DataFrame:
    """query_id, rank, score, source_id, chunk_id, text, best_sentence, page_label, citation, quote, before, after, and the parts they are made of.

    Statistics are those of the sources searched (`only`, or all in step). Blank queries have no results. Sentences
    are embedded for the k results alone.
    """
    if k < 1:
        raise ValueError(f"ask for one result or more, not {k}")
    asked = queries.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    scope = sources if only is None else sources.where(F.col("source_id").isin(only))
    used, _ = corpus(chunks, vectors, scope)
    used = Workspace(chunks.sparkSession, "scope").save(used, "used")
    ordinal = used.select("source_id", "ordinal")
    own = chunks.join(F.broadcast(ordinal), "source_id")  # one row a source
    asked_vectors = query_vectors(asked, embedder)
    dense = dense_best(vectors.join(F.broadcast(ordinal), "source_id"), asked_vectors, KEY)
    lexical = bm25_best(own, asked, more=["ordinal"])
    lists = [rank_list(dense, KEY), rank_list(lexical, KEY, positive=True)]
    # few rows from here on, written once
    space = Workspace(chunks.sparkSession, "search")
    best = space.save(top(fuse(lists, KEY), KEY, k).select("query_id", "source_id", "chunk_id", "rank", "score"), "best")
    near = space.save(with_neighbours(own, best), "near")
    each = near.select("query_id", "source_id", "chunk_id", F.posexplode("sentences").alias("pos", "sentence")).withColumn("v", embedder.embed(F.col("sentence")))
    pairs = each.join(asked_vectors.withColumnRenamed("embedding", "q"), "query_id")
    sims = pairs.groupBy("query_id", "source_id", "chunk_id", "pos").agg(F.max(dot(F.col("v"), F.col("q"))).alias("sim"))
    chosen = sims.groupBy("query_id", "source_id", "chunk_id").agg(F.min_by("pos", F.struct(-F.col("sim"), F.col("pos"))).alias("best_sentence"))
    full = near.join(chosen, ["query_id", "source_id", "chunk_id"], "left").join(used.select("source_id", "title", "author", "filename"), "source_id")
    sentence = cite.best_sentence_text(F.col("sentences"), F.coalesce("best_sentence", F.lit(0)), F.col("text"))
    return full.select(
        "query_id", "rank", "score", "source_id", "chunk_id", "text", F.coalesce("best_sentence", F.lit(0)).alias("best_sentence"),
        cite.page_label(F.col("printed_page"), F.col("pdf_page")).alias("page_label"),
        cite.mla(F.col("author"), F.col("title"), F.col("printed_page"), F.col("pdf_page")).alias("citation"),
        cite.quoted_line(sentence, F.col("author"), F.col("printed_page")).alias("quote"),
        "before", "after", "sentences", "pdf_page", "printed_page", "chapter", "title", "author", "filename",
    )


def as_json(results: DataFrame) -> DataFrame:
    """query_id, rank, json: each result of `search` as one JSON object with its source, chunk, context and citations; nulls are kept."""
    sentence = cite.best_sentence_text(F.col("sentences"), F.col("best_sentence"), F.col("text"))
    of = lambda *names: F.struct(*[F.col(n) for n in names])
    citation = F.struct(
        F.col("citation").alias("mla"), cite.parenthetical(F.col("author"), F.col("printed_page")).alias("in_text"), F.col("quote").alias("quoted_line"),
        cite.citation_block(sentence, F.col("author"), F.col("title"), F.col("printed_page"), F.col("pdf_page")).alias("block"),
    )
    whole = F.struct(
        "score", of("source_id", "title", "author", "filename").alias("source"), "page_label",
        of("source_id", "chunk_id", "text", "sentences", "pdf_page", "printed_page", "chapter").alias("chunk"),
        "best_sentence", sentence.alias("best_sentence_text"), "before", "after", citation.alias("citation"),
    )
    return results.select("query_id", "rank", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


__all__ = ["as_json", "corpus", "query_vectors", "search"]
