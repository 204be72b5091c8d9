"""Steps that must not shuffle what stands in one row, and the ways for more queries, folds and ranges than the usual."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import text as T
from quire.operators import chunks as ch, lexical, pages as pg, ranking, terms
from quire.plans.catalog import ORACLES, QUERIES
from quire.plans.search import query_vectors
from quire.sources.embedder import HashingEmbedder
from tests.test_engine import SF, library_tables, plain


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_tokens_and_scores_of_a_row_are_not_shuffled(spark):
    chunks, vectors, src = library_tables(spark)
    asked = spark.createDataFrame([(1, "the melon farm")], "query_id int, text string")
    assert exchanges(lexical.postings(chunks)) == 0
    assert exchanges(lexical.bm25(chunks, asked)) == 0
    assert exchanges(ranking.dense_scores(vectors, query_vectors(asked, HashingEmbedder()), ["source_id", "chunk_id"])) == 0
    pages = spark.createDataFrame([("a", 1, "One word. One more.", None, None)], schemas.BOOK_PAGES)
    made = terms.TermTables.of_pages(pages, src)
    assert exchanges(made.page_words()) == 0 and [tuple(r) for r in made.page_words().collect()] == [("a", 1, 4, 3)]
    heads = spark.createDataFrame([("a", "One word. One more.")], "source_id string, line string")
    assert "BroadcastHashJoin" in pg.clean_pages(pages, heads)._jdf.queryExecution().executedPlan().toString()
    placed = ch.chunk_pages(pages, place="place")
    assert exchanges(ch.unique_sentences(placed, place="place")) == exchanges(placed)


@pytest.mark.parametrize("block", [1, 4096])
def test_best_rows_are_those_of_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", block)
    chunks, vectors, _ = library_tables(spark)
    chunks = chunks.unionByName(chunks.withColumn("chunk_id", F.col("chunk_id") + 100))  # every score ties
    vectors = vectors.unionByName(vectors.withColumn("chunk_id", F.col("chunk_id") + 100))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["the melon farm", "fever of workers", "the the road", "nothing"])], "query_id int, text string")
    key, q = ["source_id", "chunk_id"], query_vectors(asked, HashingEmbedder())
    rows = lambda df: sorted((r.query_id, r["rank"], r.source_id, r.chunk_id) for r in df.collect())
    for pool in (1, 7, 1000):
        assert rows(ranking.top(ranking.dense_best(vectors, q, key, pool), key, pool)) == rows(ranking.top(ranking.dense_scores(vectors, q, key), key, pool))
        assert rows(ranking.top(lexical.bm25_best(chunks, asked, pool), key, pool)) == rows(ranking.top(lexical.bm25(chunks, asked), key, pool))


def test_odd_vectors_have_null_scores_and_come_last(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [1.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, None)], "query_id int, embedding array<float>")
    got = {(r.query_id, r.vec_id): r.score for r in ranking.dense_scores(df, q, ["vec_id"]).collect()}
    assert got == {(7, 1): 1.0, (7, 2): None, (7, 3): None, (7, 4): None, (7, 5): 0.5} | {(8, k): None for k in range(1, 6)}
    assert [(r.query_id, r.vec_id) for r in ranking.top(ranking.dense_best(df, q, ["vec_id"], 3), ["vec_id"], 3).orderBy("query_id", "rank").collect()] == [(7, 1), (7, 5), (7, 2), (8, 1), (8, 2), (8, 3)]


def test_terms_with_joined_folds_and_from_chunks(spark, monkeypatch):
    text = ["The farm and the farms. Farms\u2014melons grow, melon fields. A Farm-hand sings", "Nurses and a nurse. The nurse's ward; wards", ""]
    pages = spark.createDataFrame([(s, p, t, None, c) for s, c in (("a", "One"), ("b", None), ("c", None)) for p, t in enumerate(text, 1)], schemas.BOOK_PAGES)
    _, _, src = library_tables(spark)

    def all_of(made):
        return [Counter(map(tuple, df.collect())) for df in (made.counts(), made.display(), made.densest())]

    plain_rows = all_of(terms.TermTables.of_pages(pages, src))
    assert ("fields \u0001seth holmes".replace(" ", "", 1), "c:One", "farm") in {r[:3] for r in plain_rows[0]}
    assert all_of(terms.TermTables(ch.chunk_pages(pages), src)) == plain_rows
    monkeypatch.setattr(terms, "FOLD_ROWS", 0)
    assert all_of(terms.TermTables.of_pages(pages, src)) == plain_rows


@pytest.mark.parametrize("bucket", [1, 2, 3, 4096])
def test_neighbours_over_ranges(spark, monkeypatch, bucket):
    monkeypatch.setattr(ch, "BUCKET", bucket)
    ids = [0, 1, 2, 3, 5, 6, 9]
    df = spark.createDataFrame([("s", i, f"t{i}") for i in ids], "source_id string, chunk_id int, text string")
    near = lambda i: f"t{i}" if i in ids else None
    assert {r.chunk_id: (r.before, r.after) for r in ch.neighbours(df).collect()} == {i: (near(i - 1), near(i + 1)) for i in ids}


def test_folios_in_odd_lines(spark):
    rows = [("a\n\u00a0\n 12 ", 12), ("0000", None), ("x\n- 0047 -\n", 47), ("", None), ("\n", None), (None, None), ("\n".join(["7", *"abcdefg"]), 7)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", T.printed_page(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: f for i, (_, f) in enumerate(rows)}


@pytest.mark.parametrize("name", "segment_words term_counts term_display term_distinctiveness densest_page postings bm25_scores dense_multi_query_max rrf_fused_topk search_evidence".split())
def test_more_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert not math.isnan(len(want)) and Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
