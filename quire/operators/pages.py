"""Pages: running heads, cleaning, chapters, folios, scans, and pages built from spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import text as T
from quire.operators.ordering import BUCKET, each_of


def running_heads(pages: DataFrame) -> DataFrame:
    """(source_id, line): short lines on 30 % of a source's pages, or at the edge of at least three.

    Edges are the first and last two short lines of a page; bare numbers don't count there. Sources with fewer
    than four pages have none.
    """
    short = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: (x != "") & (F.length(x) <= C.MAX_HEAD_CHARS))
    cut = pages.select("source_id", short.alias("ls"))
    n = F.size("ls")
    edges = F.concat(F.slice("ls", 1, C.EDGE_LINES), F.slice("ls", F.greatest(n - (C.EDGE_LINES - 1), F.lit(1)), F.lit(C.EDGE_LINES)))
    edges = F.when(n > 0, F.filter(edges, lambda x: ~T.is_digits(x))).otherwise(F.array().cast("array<string>"))
    marked = cut.select("source_id", F.array_distinct("ls").alias("ls"), F.array_distinct(edges).alias("edges"))
    # one row for each distinct line of a page; the aggregation combines before its shuffle
    each = each_of(marked, ["source_id", "edges"], F.col("ls"), ("line",)).select("source_id", "line", F.array_contains("edges", F.col("line")).cast("int").alias("edge"))
    seen = each.groupBy("source_id", "line").agg(F.count("*").alias("n"), F.sum("edge").alias("at_edge"))
    size = pages.groupBy("source_id").agg(F.count("*").alias("pages")).where(F.col("pages") >= C.MIN_HEAD_PAGES)
    heads = seen.join(size, "source_id")
    return heads.where((F.col("n") >= F.col("pages") * F.lit(C.HEAD_RATIO)) | (F.col("at_edge") >= C.MIN_EDGE_REPEATS)).select("source_id", "line")


def clean_pages(pages: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Pages with text reflowed: hyphenation mended, running heads and bare numbers gone.

    A source's heads travel as one array, as there are few, and are broadcast; no line is exploded and no page shuffled.
    """
    heads = running_heads(pages) if heads is None else heads
    by_source = heads.groupBy("source_id").agg(F.collect_set("line").alias("__heads"))
    kept = F.filter(
        F.transform(T.lines(T.dehyphenate(F.col("text"))), T.strip),
        lambda x: (x != "") & ~T.is_digits(x) & ~F.coalesce(F.array_contains("__heads", x), F.lit(False)),
    )
    return pages.join(F.broadcast(by_source), "source_id", "left").withColumn("text", T.squeeze(F.array_join(kept, " "))).drop("__heads")


def carry_forward(pages: DataFrame, starts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Set `chapter` to the last chapter that started on or before each page; null before the first.

    An as-of join without pairs: page numbers and starts (source_id, page_no, title) are cut in ranges of pages, each
    range carries its own starts, and the last title of earlier ranges fills what comes before its first.
    """
    at = lambda p: F.floor(F.col(p) / bucket).alias("__range")
    marks = pages.select("source_id", at("pdf_page"), F.col("pdf_page").alias("__page"), F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("__title"))
    marks = marks.unionByName(starts.select("source_id", at("page_no"), F.col("page_no").alias("__page"), F.lit(0).alias("__kind"), F.col("title").alias("__title")))
    marks = marks.repartition("source_id", "__range")  # one exchange for both uses
    last = marks.groupBy("source_id", "__range").agg(F.max_by("__title", F.when(F.col("__title").isNotNull(), F.col("__page"))).alias("__last"))
    earlier = Window.partitionBy("source_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("source_id", "__range", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    inside = Window.partitionBy("source_id", "__range").orderBy("__page", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    own = marks.withColumn("__own", F.last("__title", ignorenulls=True).over(inside)).where("__kind = 1")
    found = own.join(carried, ["source_id", "__range"]).select("source_id", F.col("__page").alias("pdf_page"), F.coalesce("__own", "__carried").alias("chapter"))
    return pages.drop("chapter").join(found, ["source_id", "pdf_page"], "left").select(*[c for c in pages.columns if c != "chapter"], "chapter")


def scan_report(pages: DataFrame) -> DataFrame:
    """source_id, page_count, empty_pages, is_scan: over 80 % of pages have fewer than 20 characters."""
    empty = (F.length(T.strip(F.coalesce("text", F.lit("")))) < C.MIN_TEXT_CHARS).cast("int")
    report = pages.groupBy("source_id").agg(F.count("*").alias("page_count"), F.sum(empty).alias("empty_pages"))
    return report.withColumn("is_scan", F.col("empty_pages") / F.col("page_count") > F.lit(C.SCANNED_RATIO))


def chapters_from_toc(toc: DataFrame) -> DataFrame:
    """Starts from an outline: level 1, a real page, the first title of a page, titles tidied and not empty."""
    named = toc.where((F.col("level") == 1) & (F.col("page_no") >= 1)).withColumn("title", T.normalize_title(F.col("title")))
    return named.where(F.col("title") != "").groupBy("source_id", "page_no").agg(F.min_by("title", "seq").alias("title"))


def body_sizes(spans: DataFrame) -> DataFrame:
    """(source_id, body_size): the font size with most characters; the first seen on a tie. Raw text has size 0 and no say."""
    chars = F.length(T.strip(F.col("text")))
    place = F.struct("pdf_page", "block_no", "line_no", "span_no")
    by_size = spans.where((chars > 0) & (F.col("size") > 0)).groupBy("source_id", F.bround("size", 1).alias("size")).agg(F.sum(chars).alias("n"), F.min(place).alias("first"))
    return by_size.groupBy("source_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("first"))).alias("body_size"))


def _span_lines(spans: DataFrame) -> DataFrame:
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("span_no", "text")))), lambda s: s["text"]), "")
    plain = F.col("flags").bitwiseAND(C.SUPERSCRIPT_FLAG) == 0
    return spans.groupBy("source_id", "pdf_page", "block_no", "line_no").agg(ordered(plain).alias("plain"), ordered(F.lit(True)).alias("full"), F.max("size").alias("size"))


def chapters_from_headings(spans: DataFrame) -> DataFrame:
    """Starts from type size: on each page the first short line, no folio, at least 1.25 times the body size."""
    full = T.strip(T.normalize_ligatures(F.col("full")))
    made = _span_lines(spans).join(body_sizes(spans), "source_id").withColumn("full", full)
    fits = (F.length("full").between(1, C.MAX_HEADING_CHARS)) & T.parse_folio(F.col("full")).isNull() & (F.col("size") >= F.col("body_size") * C.HEADING_RATIO) & (F.col("body_size") > 0)
    first = made.where(fits).groupBy("source_id", "pdf_page").agg(F.min_by("full", F.struct("block_no", "line_no")).alias("full"))
    return first.select("source_id", F.col("pdf_page").alias("page_no"), T.normalize_title(F.col("full")).alias("title"))


def chapter_starts(spans: DataFrame, toc: DataFrame) -> DataFrame:
    """Outline starts for sources whose outline has any, headings for the others."""
    outline = chapters_from_toc(toc)
    rest = chapters_from_headings(spans).join(outline.select("source_id").distinct(), "source_id", "left_anti")
    return outline.select("source_id", "page_no", "title").unionByName(rest)


def pages_from_spans(spans: DataFrame, toc: DataFrame) -> DataFrame:
    """Book pages from decoded spans: superscripts dropped, glyphs and endnotes mended, folio and chapter found."""
    line = F.struct("block_no", "line_no", "plain")
    rows = F.sort_array(F.collect_list(line))
    made = _span_lines(spans).groupBy("source_id", "pdf_page").agg(rows.alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["plain"]), "\n")
    pages = made.select("source_id", "pdf_page", text.alias("raw"))
    pages = pages.select("source_id", "pdf_page", T.strip_endnotes(T.normalize_ligatures(F.col("raw"))).alias("text"), T.printed_page(F.col("raw")).alias("printed_page"))
    return carry_forward(pages.withColumn("chapter", F.lit(None).cast("string")), chapter_starts(spans, toc))
