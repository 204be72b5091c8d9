"""Schemas of the engine's tables, as DDL."""

SPANS = "source_id string, pdf_page int, block_no int, line_no int, span_no int, text string, size double, flags int"
TOC = "source_id string, seq int, level int, title string, page_no int"
BOOK_PAGES = "source_id string, pdf_page int, text string, printed_page int, chapter string"
CHUNKS = "source_id string, chunk_id int, text string, sentences array<string>, pdf_page int, printed_page int, chapter string"
VECTORS = "tier string, source_id string, chunk_id int, embedding array<float>"
SOURCES = (
    "source_id string, ordinal bigint, filename string, title string, author string, added date, page_count int, "
    "chunk_count int, chunk_size int, overlap int, tiers array<string>, index_version int, path string"
)
RATES = "tier string, pages_per_second double"
QUERIES = "query_id int, text string"
