"""Key terms of every chapter of every book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.operators.terms import CHAPTER, TermTables, chapter_directions, chapter_key, prune, rerank
from quire.sources.embedder import Embedder


def key_terms(
    chunks: DataFrame, sources: DataFrame, top: int = C.DEFAULT_TOP, vectors: DataFrame | None = None, embedder: Embedder | None = None,
    only: list[str] | None = None, overlap: int = C.CHUNK_OVERLAP,
) -> DataFrame:
    """book, chapter_key, label, titled, term_rank, term (as shown), term_count, score, source_id, pdf_page, tier.

    With vectors (source_id, chunk_id, embedding) and an embedder, candidates are re-ranked where every chunk of
    the book has a vector; other books stay lexical (tier null). `only` narrows the report to chapters that touch
    these sources, after scoring against the whole book.
    """
    made = TermTables(chunks, sources, overlap)
    # few rows from here on, written once: pages are gone over again for these terms alone
    found = made.space.save(made.candidates(made.counts()), "found")
    named = found.select("book", "term").distinct()
    shown, dense = made.space.save(made.display(named), "shown"), made.densest(named)
    lexical = found.withColumn("final_rank", F.col("cut_rank"))
    ranked = lexical.withColumn("reranked", F.lit(False))
    if vectors is not None and embedder is not None:
        rows = made.space.save(made.chunks.join(vectors, ["source_id", "chunk_id"], "left").select("book", "chapter_key", "embedding"), "rows")
        whole = rows.groupBy("book").agg(F.bool_and(F.col("embedding").isNotNull()).alias("full")).where("full").select("book")
        usable = rows.join(whole, "book", "left_semi")
        named = found.join(shown, ["book", "term"]).select("book", "term", embedder.embed(F.col("shown")).alias("embedding")).distinct()
        better = rerank(found.join(whole, "book", "left_semi"), named, chapter_directions(usable)).withColumn("reranked", F.lit(True))
        keep = [*CHAPTER, "term", "count", "final_rank", "reranked"]
        ranked = better.select(*keep).unionByName(ranked.join(whole, "book", "left_anti").select(*keep))
    flags = ranked.select(*CHAPTER, "reranked").distinct()
    kept = prune(ranked, top).join(flags, CHAPTER)
    chapters = made.chunks.groupBy(*CHAPTER).agg(
        F.min_by(F.coalesce(F.when(F.col("chapter") != "", F.col("chapter")), F.col("filename")), F.struct("ordinal", "chunk_id")).alias("label"),
        F.bool_or(F.coalesce(F.col("chapter") != "", F.lit(False))).alias("titled"),
        F.collect_set("source_id").alias("source_ids"),
    )
    if only is not None:
        chapters = chapters.where(F.arrays_overlap("source_ids", F.array(*[F.lit(s) for s in only])))
    full = kept.join(chapters, CHAPTER).join(shown, ["book", "term"]).join(dense, [*CHAPTER, "term"])
    tier = F.when(F.col("reranked"), F.lit(embedder.tier if embedder else None))
    return full.select(*CHAPTER, "label", "titled", "term_rank", F.col("shown").alias("term"), F.col("count").alias("term_count"), (F.lit(1.0) / F.col("term_rank")).alias("score"), "source_id", "pdf_page", tier.alias("tier"))


__all__ = ["chapter_key", "key_terms"]
