"""PDF files as spans. Decoding is the one opaque step: a decoder turns bytes into rows, all else is relational."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.cite import resolve_author, resolve_title
from quire.functions.text import strip
from quire.runtime import ship

#: bytes -> (spans, outline, info): lists of dicts without source_id, and {"title", "author", "pages"}.
Decoder = Callable[[bytes], tuple[list[dict], list[dict], dict]]


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """source_id (SHA-256 of the bytes), path, filename, content. Globs are Hadoop globs; no match is an error."""
    df = spark.read.format("binaryFile").load(path)
    if not df.limit(1).count():
        raise FileNotFoundError(path)
    return df.select(F.sha2("content", 256).alias("source_id"), "path", F.regexp_extract("path", "[^/]+$", 0).alias("filename"), "content").dropDuplicates(["source_id"])


def page_spans(number: int, blocks: list[dict], raw: Callable[[], str]) -> list[dict]:
    """The spans of one page; a page without any, as some generators write only raw text, has a span of size 0 for each raw line."""
    found = [
        {"pdf_page": number, "block_no": b, "line_no": at, "span_no": k, "text": s.get("text", ""), "size": float(s.get("size", 0)), "flags": int(s.get("flags", 0))}
        for b, block in enumerate(blocks)
        for at, line in enumerate(block.get("lines", []))
        for k, s in enumerate(line.get("spans", []))
    ]
    return found or [{"pdf_page": number, "block_no": 0, "line_no": at, "span_no": 0, "text": t, "size": 0.0, "flags": 0} for at, t in enumerate(raw().splitlines())]


def default_decoder(data: bytes) -> tuple[list[dict], list[dict], dict]:
    """Decode with PyMuPDF where it is installed."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("no PDF decoder is installed; pass one, or start from spans or book pages") from e
    doc = pymupdf.open(stream=data, filetype="pdf")
    spans = []
    for number, page in enumerate(doc, 1):
        spans += page_spans(number, page.get_text("dict").get("blocks", []), lambda page=page: page.get_text("text"))
    toc = [{"seq": i, "level": level, "title": title, "page_no": page} for i, (level, title, page) in enumerate(doc.get_toc(simple=True))]
    return spans, toc, {"title": doc.metadata.get("title") or "", "author": doc.metadata.get("author") or "", "pages": doc.page_count}


def decode(files: DataFrame, decoder: Decoder = default_decoder) -> DataFrame:
    """source_id, filename, path, spans (array), toc (array), title, author, page_count, failure (null if it went well).

    A file that can't be decoded is a row with its failure; it doesn't stop the others.
    """
    ship(files.sparkSession)
    span = "array<struct<" + ", ".join(x.replace(" ", ":", 1) for x in schemas.SPANS.split(", ")[1:]) + ">>"
    toc = "array<struct<" + ", ".join(x.replace(" ", ":", 1) for x in schemas.TOC.split(", ")[1:]) + ">>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    spans, outline, info = decoder(bytes(r.content))
                    failure = None if info["pages"] else "no pages"
                except Exception as e:  # reported in the row
                    spans, outline, info, failure = [], [], {}, str(e) or type(e).__name__
                rows.append((r.source_id, r.filename, r.path, spans, outline, info.get("title", ""), info.get("author", ""), info.get("pages", 0), failure))
            yield pd.DataFrame(rows, columns=["source_id", "filename", "path", "spans", "toc", "title", "author", "page_count", "failure"])

    return files.mapInPandas(run, f"source_id string, filename string, path string, spans {span}, toc {toc}, title string, author string, page_count int, failure string")


def spans_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("source_id", F.inline("spans"))


def toc_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("source_id", F.inline("toc"))


def described(decoded: DataFrame, title: str | None = None, author: str | None = None) -> DataFrame:
    """Title and author: given, else embedded, else (title only) from the filename."""
    given = lambda v: F.lit(v).cast("string")
    return decoded.withColumn("title", resolve_title(given(title), F.col("title"), F.col("filename"))).withColumn("author", resolve_author(given(author), strip(F.col("author"))))
