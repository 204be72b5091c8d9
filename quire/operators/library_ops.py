"""Relational parts of the library: resolving sources, gaps between tiers, rates, books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.errors import AmbiguousSourceError, SourceNotFoundError
from quire.functions.text import strip


def matching(sources: DataFrame, needle: str) -> DataFrame:
    """Sources whose id is the needle, or else whose id starts with it or whose filename, stem or title equals it."""
    n = needle.strip().lower()
    exact = sources.where(F.lower("source_id") == n)
    stem = F.lower(F.regexp_replace("filename", "(?<=.)\\.[^.]*$", ""))
    other = F.lower("source_id").startswith(n) | (F.lower("filename") == n) | (stem == n) | (F.lower(strip(F.col("title"))) == n)
    # the exact match short-circuits: other matches count only when there is none
    hits = sources.where(other).withColumn("__exact", F.lower("source_id") == n)
    any_exact = exact.select(F.lit(True).alias("__any")).limit(1)
    return hits.join(F.broadcast(any_exact), F.lit(True), "left").where(F.col("__exact") | F.col("__any").isNull()).drop("__exact", "__any")


def resolve_sources(sources: DataFrame, needle: str) -> DataFrame:
    """The sources of one book that the needle names."""
    found = matching(sources, needle)
    n, titles = found.agg(F.count("*"), F.countDistinct(F.lower(strip(F.col("title"))))).first()
    if not n:
        raise SourceNotFoundError(f"no source matches {needle!r}")
    if titles > 1:
        raise AmbiguousSourceError(f"{needle!r} matches {n} sources of several books; use an id")
    return found


def resolve_source(sources: DataFrame, needle: str) -> DataFrame:
    """The one source that the needle names."""
    found = matching(sources, needle)
    n = found.count()
    if not n:
        raise SourceNotFoundError(f"no source matches {needle!r}")
    if n > 1:
        raise AmbiguousSourceError(f"{needle!r} matches {n} sources; use an id")
    return found


def group_books(sources: DataFrame) -> DataFrame:
    """One row a book (equal title and author after strip and lower case), in the order of its first member."""
    key = [F.lower(strip(F.col("title"))).alias("title_key"), F.lower(strip(F.col("author"))).alias("author_key")]
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "source_id"))), lambda s: s["source_id"])
    return sources.groupBy(*key).agg(F.min("ordinal").alias("first_ordinal"), ids.alias("source_ids"), F.sum("page_count").cast("bigint").alias("pages"))


def stale(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce("index_version", F.lit(0)) < C.INDEX_VERSION)


def available_tiers(vectors: DataFrame) -> DataFrame:
    """(source_id, tier) pairs that have vectors, whatever the catalog says."""
    return vectors.select("source_id", "tier").distinct()


def rate_of(rates: DataFrame) -> dict[str, float]:
    """Pages a second by tier: measured, else the default."""
    return C.PAGES_PER_SECOND | {r["tier"]: r["pages_per_second"] for r in rates.where(F.col("tier").isin(*C.TIERS)).collect()}


def record_rate(rates: DataFrame, tier: str, pages: int, seconds: float) -> DataFrame:
    """Rates with the first substantial run of a tier added; later and small runs change nothing."""
    if pages < C.MIN_PAGES_FOR_RATE or seconds <= 0 or rates.where(F.col("tier") == tier).limit(1).count():
        return rates
    return rates.unionByName(rates.sparkSession.createDataFrame([(tier, round(pages / seconds, 2))], "tier string, pages_per_second double"))


def tier_gap(sources: DataFrame, vectors: DataFrame, tier: str, rates: dict[str, float] | None = None) -> DataFrame:
    """One row: tier, missing (ids in order), pages, seconds, alternatives (other tiers that every source has)."""
    have = available_tiers(vectors)
    there = have.where(F.col("tier") == tier).select("source_id")
    missing = sources.join(there, "source_id", "left_anti")
    gap = missing.agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "source_id"))), lambda s: s["source_id"]).alias("missing"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("bigint").alias("pages"))
    per = have.join(sources.select("source_id"), "source_id").groupBy("tier").agg(F.count("*").alias("n"))
    total = sources.agg(F.count("*").alias("total"))
    full = per.join(F.broadcast(total), F.lit(True)).where((F.col("n") == F.col("total")) & (F.col("tier") != tier))
    order = F.array(*[F.lit(t) for t in C.TIERS])
    alt = full.agg(F.collect_set("tier").alias("full")).select(F.filter(order, lambda t: F.array_contains("full", t)).alias("alternatives"))
    rate = (rates or C.PAGES_PER_SECOND)[tier]
    return gap.join(alt, F.lit(True)).select(F.lit(tier).alias("tier"), "missing", "pages", (F.col("pages") / F.lit(rate)).alias("seconds"), "alternatives")


def upsert(table: DataFrame, row: DataFrame) -> DataFrame:
    """A catalog with one row replaced in place, or added last."""
    known = table.select("source_id", F.col("ordinal").alias("__known"))
    last = table.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("__next"))
    placed = row.join(known, "source_id", "left").join(last, F.lit(True)).withColumn("ordinal", F.coalesce("__known", "__next")).select(*table.columns)
    return table.join(row.select("source_id"), "source_id", "left_anti").select(*table.columns).unionByName(placed)


def title_equals(column: Column, other: Column) -> Column:
    return F.lower(strip(column)) == F.lower(strip(other))
