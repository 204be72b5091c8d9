"""Streaming ingest: book pages that arrive as files are added source by source, each once.

An extension: the batch library has the same idempotent add, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire import schemas
from quire.sources.embedder import Embedder
from quire.sources.library import Library


def ingest_pages(spark: SparkSession, folder: str, library: Library, embedder: Embedder, checkpoint: str, on_added: Callable[[dict], None] = lambda _: None) -> StreamingQuery:
    """Watch a folder of Parquet book pages (whole sources per file) and add what arrives; stops when caught up."""

    def batch(pages: DataFrame, _: int) -> None:
        kept = pages.persist()
        for row in kept.select("source_id").distinct().collect():  # a batch's sources are few
            on_added(library.add(kept, row["source_id"], row["source_id"], embedder))
        kept.unpersist()

    stream = spark.readStream.schema(schemas.BOOK_PAGES).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
