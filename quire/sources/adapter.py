"""The documents table as books: a source for each language and origin, a page for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.ordering import running_offset

#: The same mapping for the oracle; `documents` is a registered view there.
PAGES_SQL = """
SELECT concat(lang, '-', source) AS source_id,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS INT) AS pdf_page,
       text, CAST(NULL AS INT) AS printed_page, source AS chapter, lang AS title
FROM documents
"""


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, pdf_page, text, printed_page, chapter, title; doc_ids are unique.

    Pages are numbered on the ids alone, range by range, and then join their texts: no source is sorted in one task.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.concat_ws("\u0001", F.coalesce("lang", F.lit("\u0002")), F.coalesce("source", F.lit("\u0002"))).alias("__key")
    placed = running_offset(docs.select("doc_id", key), "__key", "doc_id", F.lit(1), "__before")
    numbers = placed.select("doc_id", (F.col("__before") + 1).cast("int").alias("pdf_page"))
    # the exchange that the join needs where the numbers are many; where they are few, it spreads a file of one row group.
    # Its width is fixed: partitions put together by their bytes would leave the work on texts to a few tasks
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(width, "doc_id").join(numbers, "doc_id").select(
        F.concat("lang", F.lit("-"), "source").alias("source_id"),
        "pdf_page",
        "text",
        F.lit(None).cast("int").alias("printed_page"),
        F.col("source").alias("chapter"),
        F.col("lang").alias("title"),
    )


def sources(pages: DataFrame) -> DataFrame:
    """source_id, ordinal (reading order of sources), title, author, filename, page_count."""
    books = pages.groupBy("source_id").agg(F.first("title").alias("title"), F.count("*").cast("int").alias("page_count"))
    order = Window.orderBy("source_id")  # one row a source
    named = books.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))
    return named.select("source_id", "ordinal", "title", F.lit("").alias("author"), F.concat("source_id", F.lit(".pdf")).alias("filename"), "page_count")
