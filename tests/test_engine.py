"""The engine against DuckDB on the smallest tables, and its lifecycle and sequential rules against small models."""

import datetime
import json
import math
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire import constants as C, schemas
from quire.errors import AmbiguousSourceError, ModelUnavailableError, NoTextLayerError, SourceNotFoundError
from quire.functions import text as T
from quire.operators import chunks as ch, lexical, library_ops as lib, pages as pg, ranking
from quire.operators.ordering import running_offset
from quire.operators.terms import prune_frame, rerank
from quire.plans.catalog import ORACLES, QUERIES
from quire.plans.search import as_json, query_vectors, search
from quire.plans.terms import key_terms
from quire.scratch import Workspace, open_fs, released
from quire.sources import pdf
from quire.sources.pdf import page_spans
from quire.sources.embedder import HashingEmbedder, ModelEmbedder
from quire.sources.library import Library

SF = "/root/testdata/sf0.001"
LITERAL = "ligatures endnotes title_norm folio_parse title_from_filename format_author format_duration format_bytes mla parenthetical quoted_line truncated".split()
TABLES = "sentences_split chunks_windowed unique_sentences chunk_neighbours running_heads clean_pages printed_folio chapter_carry_forward scan_detection dense_topk tier_gap book_groups skipped_sources plural_fold terms_pruned ligatures_in_texts endnotes_in_texts truncated_texts citation_blocks resolved_names long_query_vectors bm25_topk".split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", [*LITERAL, *TABLES])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_every_query_has_a_name_and_most_an_oracle():
    assert len(QUERIES) >= 45 and set(ORACLES) <= set(QUERIES) and len(QUERIES) - len(ORACLES) <= 2


def book(n=6):
    return [("a" * 64, k, f"RUNNING HEAD\nPage {k} says one thing. It says an-\nother thing. Dr. Smith agrees. Farm workers rest.\n{k}", None, "One" if k < 4 else "Two") for k in range(1, n + 1)]


def test_sentences_follow_the_abbreviation_rule(spark):
    rows = [("Dr. Smith went. He left.", ["Dr. Smith went.", "He left."]), ("See e.g. The book. Yes", ["See e.g. The book.", "Yes"]), ("It was I. Then no. More", ["It was I. Then no. More"]), ("the U.S. Border wall", ["the U.S.", "Border wall"]), ("Why? “Because.” So (A) ended.", ["Why?", "“Because.”", "So (A) ended."]), ("", []), ("  ", [])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(T.sentences(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [w for _, w in rows]


@pytest.mark.parametrize(("size", "overlap"), [(3, 1), (2, 0), (4, 3)])
def test_windows_match_a_loop(spark, size, overlap):
    pages = [("s", p, " ".join(f"S{i} is here." for i in range(n)), None, None) for p, n in ((1, 1), (2, 7), (3, 0), (5, 4))]
    got = ch.chunk_pages(spark.createDataFrame(pages, schemas.BOOK_PAGES), size, overlap).orderBy("chunk_id").collect()
    want = []
    for _, p, text, _, _ in pages:
        s, at = [x + "." for x in text.rstrip(".").split(". ")] if text else [], 0
        while s:
            want.append((len(want), p, " ".join(s[at : at + size])))
            if at + size >= len(s):
                break
            at += size - overlap
    assert [(r.chunk_id, r.pdf_page, r.text) for r in got] == want
    for bad in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            ch.chunk_pages(spark.createDataFrame(pages, schemas.BOOK_PAGES), *bad)


def test_running_offset_over_ranges(spark):
    rows = [("k", i * 3, i % 4) for i in range(50)]
    got = running_offset(spark.createDataFrame(rows, "k string, o long, v long"), "k", "o", F.col("v"), "before", bucket=10).collect()
    assert all(r.before == sum(v for _, o, v in rows if o < r.o) for r in got)


def test_prune_matches_the_sequential_rule():
    rng = random.Random(3)
    for _ in range(200):
        names = list(dict.fromkeys(" ".join(rng.sample("abcde", rng.choice((1, 1, 2)))) for _ in range(12)))
        count = {t: rng.randrange(3, 9) for t in names}
        kept, uses = [], Counter()
        for t in names:
            if len(kept) == 4 or any(uses[w] > 1 for w in t.split()):
                continue
            near = [p for p in names if " " in p and t in p.split()]
            if " " not in t and (any(count[p] >= 0.6 * count[t] for p in near) or any(p in kept for p in near)):
                continue
            kept.append(t)
            uses.update(t.split())
        frame = pd.DataFrame({"term": names, "count": [count[t] for t in names], "final_rank": range(1, len(names) + 1)})
        assert prune_frame(frame, 4)["term"].tolist() == kept


def test_pages_from_spans(spark):
    def line(page, block, at, *spans):
        return [("s", page, block, at, k, t, float(size), flags) for k, (t, size, flags) in enumerate(spans)]

    spans = line(1, 0, 0, ("C H A P T E R", 20, 0)) + line(1, 1, 0, ("The body text", 11, 0), ("3", 7, 1), (" goes on.", 11, 0)) + line(1, 2, 0, ("12", 11, 0))
    spans += line(2, 0, 0, ("More body text is here.", 11, 0)) + line(2, 1, 0, ("13", 20, 0))
    df, none = spark.createDataFrame(spans, schemas.SPANS), spark.createDataFrame([], schemas.TOC)
    got = {r.pdf_page: r for r in pg.pages_from_spans(df, none).collect()}
    assert got[1].text == "CHAPTER\nThe body text goes on.\n12".replace("CHAPTER", "C H A P T E R")
    assert (got[1].printed_page, got[1].chapter, got[2].printed_page, got[2].chapter) == (12, "CHAPTER", 13, "CHAPTER")
    toc = spark.createDataFrame([("s", 0, 1, "Two", 2), ("s", 1, 2, "Sub", 2), ("s", 2, 1, "Later", 2), ("s", 3, 1, " ", 1)], schemas.TOC)
    assert {r.pdf_page: r.chapter for r in pg.pages_from_spans(df, toc).collect()} == {1: None, 2: "Two"}


def test_library_lifecycle(spark, tmp_path):
    pages, library = spark.createDataFrame(book(), schemas.BOOK_PAGES), Library(spark, str(tmp_path / "lib"))
    with pytest.raises(SourceNotFoundError):
        lib.resolve_sources(library.sources(), "x")
    said = library.add(pages, "a" * 64, "fresh_fruit2013.pdf", HashingEmbedder(), author=" Seth Holmes ")
    assert said["state"] == "added" and said["source"]["title"] == "Fresh fruit 2013" and said["source"]["page_count"] == 6
    text = " ".join(r.text for r in library.chunks().collect())
    assert "RUNNING HEAD" not in text and "another thing" in text
    assert library.vectors("fast").count() == library.chunks().count() == said["source"]["chunk_count"]
    assert library.add(pages, "a" * 64, "copy.pdf", HashingEmbedder())["state"] == "unchanged"
    gap = library.gap("best").first()
    assert gap.missing == ["a" * 64] and gap.pages == 6 and gap.alternatives == ["fast"]
    assert library.add(pages, "a" * 64, "copy.pdf", HashingEmbedder("best"))["state"] == "embedded"
    assert library.sources().first().tiers == ["fast", "best"] and library.sources().first().added == datetime.date.today()
    assert library.edit("fresh_fruit2013", title="New")["author"] == "Seth Holmes" and library.edit("aaaa", author="")["author"] == ""
    with pytest.raises(ValueError):
        library.edit("aaaa")
    scan = spark.createDataFrame([("b" * 64, 1, " ", None, None)], schemas.BOOK_PAGES)
    with pytest.raises(NoTextLayerError):
        library.add(scan, "b" * 64, "scan.pdf", HashingEmbedder())
    manifest = library._read()
    manifest["sources"][0]["index_version"] = 1
    library._write(manifest)
    notes = []
    assert library.upgrade_stale(lambda e: None, HashingEmbedder(), notes.append) == [] and notes
    old = library._entry("a" * 64)
    assert library.upgrade_stale(lambda e: pages, HashingEmbedder(), notes.append) == [] and "best" in notes[-1]  # no tier is lost
    assert library._entry("a" * 64) == old and library.vectors("best").count() == library.chunks().count()
    whole = Library(spark, str(tmp_path / "lib"), {"best": HashingEmbedder("best")})
    assert whole.upgrade_stale(lambda e: pages, HashingEmbedder()) == ["a" * 64] and library.sources().first().title == "New"
    assert library.sources().first().tiers == ["fast", "best"] and library.vectors("best").count() == library.vectors("fast").count() == library.chunks().count()
    assert not (tmp_path / "lib" / old["chunks"]).exists() and library.size_bytes() > 0
    assert library.diagnostics().first().sources == 1
    library.remove("new")
    assert library.sources().count() == 0 and library.chunks().count() == 0


def test_resolution_rules(spark):
    rows = [(c * 64, i, f"{n}.pdf", t, "", None, 1, 1, 3, 1, ["fast"], 2, None) for i, (c, n, t) in enumerate([("a", "x", "Book"), ("b", "y", "book "), ("c", "z", "Other")])]
    src = spark.createDataFrame(rows, schemas.SOURCES)
    assert lib.resolve_sources(src, " BOOK ").count() == 2 and lib.resolve_source(src, "z").first().title == "Other"
    with pytest.raises(AmbiguousSourceError):
        lib.resolve_source(src, "book")
    with pytest.raises(AmbiguousSourceError):
        lib.resolve_sources(src, "")
    assert lib.resolve_source(src, "a" * 64).count() == 1


def test_a_missing_model_is_an_error(spark):
    def load():
        raise OSError("offline")

    with pytest.raises(Exception, match=ModelUnavailableError.__name__):
        spark.createDataFrame([("t",)], "t string").select(ModelEmbedder("best", 4, load).embed(F.col("t"))).collect()
    with pytest.raises(ValueError):
        HashingEmbedder("huge")
    assert C.DEFAULT_TIER in C.TIERS


def library_tables(spark, n=40):
    """Chunks of three sources with their hashed vectors, and the sources (two chapters of one book, and another book)."""
    rng = random.Random(7)
    common = "the farm and clinic of workers".split()
    rows = []
    for s, own in (("a", "melon harvest field"), ("b", "nurse fever ward"), ("c", "engine wheel road")):
        for k in range(n):
            sentences = [" ".join(rng.choice(common + own.split() * 2) for _ in range(9)).capitalize() + "." for _ in range(3)]
            rows.append((s, k, " ".join(sentences), sentences, k // 4 + 1, 100 + k // 4 if s == "a" else None, "One" if s == "a" else None))
    chunks = spark.createDataFrame(rows, schemas.CHUNKS)
    vectors = chunks.select("source_id", "chunk_id", HashingEmbedder().embed(F.col("text")).alias("embedding"))
    src = [(s, i, f"{s}.pdf", t, "Seth Holmes", None, n // 4, n, 3, 1, ["fast"], 2, None) for i, (s, t) in enumerate([("a", "Fields"), ("b", "fields "), ("c", "Roads")])]
    return chunks, vectors, spark.createDataFrame(src, schemas.SOURCES)


def test_results_as_json_and_narrowing(spark):
    chunks, vectors, src = library_tables(spark)
    asked = spark.createDataFrame([(1, "melon harvest"), (2, "  "), (3, "nurse")], "query_id int, text string")
    found = search(chunks, vectors, src, asked, HashingEmbedder(), k=3)
    rows = {(r.query_id, r["rank"]): r for r in found.collect()}
    assert sorted(rows) == [(q, k) for q in (1, 3) for k in (1, 2, 3)]
    for r in as_json(found).collect():
        said, own = json.loads(r.json), rows[(r.query_id, r["rank"])]
        assert list(said) == ["score", "source", "page_label", "chunk", "best_sentence", "best_sentence_text", "before", "after", "citation"]
        assert said["source"] == {"source_id": own.source_id, "title": own.title, "author": "Seth Holmes", "filename": f"{own.source_id}.pdf"}
        assert said["chunk"]["sentences"] == own.sentences and said["best_sentence_text"] == own.sentences[own.best_sentence]
        assert said["citation"]["block"] == f"{own.citation}\n{own.quote}" and list(said["citation"]) == ["mla", "in_text", "quoted_line", "block"]
        near = {c.chunk_id: c.text for c in chunks.where(F.col("source_id") == own.source_id).collect()}
        assert said["before"] == near.get(own.chunk_id - 1) and said["after"] == near.get(own.chunk_id + 1)
    only = search(chunks, vectors, src, asked, HashingEmbedder(), k=50, only=["b"]).collect()
    assert {r.source_id for r in only} == {"b"}
    with pytest.raises(ValueError):
        search(chunks, vectors, src, asked, HashingEmbedder(), k=0)


def test_salted_joins_give_the_same_scores(spark, monkeypatch):
    chunks, vectors, _ = library_tables(spark)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["the melon farm", "fever of workers", "the the road", "nothing"])], "query_id int, text string")
    lexical_scores = lambda: sorted((r.query_id, r.source_id, r.chunk_id, round(r.score, 9)) for r in lexical.bm25(chunks, asked).collect())
    dense = lambda: sorted((r.query_id, r.source_id, r.chunk_id, round(r.score, 9)) for r in ranking.dense_scores(vectors, query_vectors(asked, HashingEmbedder()), ["source_id", "chunk_id"]).collect())
    plain_lexical, plain_dense = lexical_scores(), dense()
    assert len(plain_dense) == 4 * 120
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(ranking, "BLOCK", 2)
    assert lexical_scores() == plain_lexical and dense() == plain_dense


def test_key_terms_report_and_narrowing(spark):
    chunks, vectors, src = library_tables(spark)
    whole = key_terms(chunks, src, top=5).collect()
    only = key_terms(chunks, src, top=5, only=["b"]).collect()
    assert only and sorted(map(tuple, only)) == sorted(tuple(r) for r in whole if r.label == "b.pdf")  # scored against the whole book
    assert {r.label for r in whole} == {"One", "b.pdf", "c.pdf"} and {r.titled for r in whole if r.label == "One"} == {True}
    better = key_terms(chunks, src, top=5, vectors=vectors.where("source_id <> 'c'"), embedder=HashingEmbedder()).collect()
    assert {(r.label, r.tier) for r in better} == {("One", "fast"), ("b.pdf", "fast"), ("c.pdf", None)}
    assert all(r.score == 1 / r.term_rank for r in better)


def test_rerank_fuses_both_orders(spark):
    rng = random.Random(5)
    rows = [("k", "c", f"t{i}", 9 - i, i + 1, [rng.random(), rng.random()]) for i in range(9)]
    cand = spark.createDataFrame([r[:5] for r in rows], "book string, chapter_key string, term string, count long, cut_rank int")
    named = spark.createDataFrame([(r[0], r[2], r[5]) for r in rows], "book string, term string, embedding array<double>")
    way = spark.createDataFrame([("k", "c", [0.6, 0.8])], "book string, chapter_key string, direction array<double>")
    got = {r.term: r.final_rank for r in rerank(cand, named, way).collect()}
    by_sim = sorted(rows, key=lambda r: (-(r[5][0] * 0.6 + r[5][1] * 0.8), r[4]))
    dense = {r[2]: k for k, r in enumerate(by_sim, 1)}
    want = sorted(rows, key=lambda r: (-(1 / (C.RRF_K + r[4]) + 1 / (C.RRF_K + dense[r[2]])), r[4]))
    assert got == {r[2]: k for k, r in enumerate(want, 1)}


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_carry_forward_over_ranges(spark, bucket):
    pages = [(s, p) for s in "xy" for p in (1, 2, 5, 6, 7, 11, 12)]
    starts = {"x": {2: "A", 4: "B", 8: "C"}, "y": {7: "D"}}
    df = spark.createDataFrame(pages, "source_id string, pdf_page int").withColumn("chapter", F.lit("old"))
    got = pg.carry_forward(df, spark.createDataFrame([(s, p, t) for s, m in starts.items() for p, t in m.items()], "source_id string, page_no int, title string"), bucket)
    want = {(s, p): next((t for q, t in sorted(starts[s].items(), reverse=True) if q <= p), None) for s, p in pages}
    assert {(r.source_id, r.pdf_page): r.chapter for r in got.collect()} == want


def test_pages_without_spans_fall_back_to_raw_text():
    spans = page_spans(3, [{"lines": [{"spans": []}]}, {}], lambda: "Line one\nLine two\n")
    assert [(s["pdf_page"], s["line_no"], s["text"], s["size"]) for s in spans] == [(3, 0, "Line one", 0.0), (3, 1, "Line two", 0.0)]
    assert page_spans(1, [{"lines": [{"spans": [{"text": "x", "size": 9, "flags": 1}]}]}], lambda: 1 / 0)[0]["text"] == "x"


def test_files_described_and_rates(spark, tmp_path):
    for name, data in (("one.pdf", b"1"), ("same.pdf", b"1"), ("two.txt", b"2")):
        (tmp_path / name).write_bytes(data)
    files = pdf.binary_files(spark, f"{tmp_path}/*.pdf")
    assert files.count() == 1
    with pytest.raises(Exception):
        pdf.binary_files(spark, f"{tmp_path}/*.epub")

    def decoder(data):
        if data == b"2":
            raise ValueError("broken")
        return [], [], {"title": " ", "author": " Ann Lee ", "pages": 2}

    made = {r.filename: r for r in pdf.described(pdf.decode(pdf.binary_files(spark, f"{tmp_path}/*"), decoder)).collect()}
    assert made["two.txt"].failure == "broken" and len(made) == 2
    first = next(r for n, r in made.items() if n != "two.txt")
    assert first.author == "Ann Lee" and first.title in ("One", "Same") and first.failure is None
    none = spark.createDataFrame([], schemas.RATES)
    rates = lib.record_rate(none, "fast", 10, 4.0)
    assert lib.rate_of(rates)["fast"] == 2.5 and lib.rate_of(none) == C.PAGES_PER_SECOND
    assert lib.record_rate(rates, "fast", 10, 1.0).collect() == rates.collect() and lib.record_rate(none, "best", 4, 1.0).count() == 0


def test_workspaces_are_removed(spark):
    keep = Workspace(spark, "keep")
    with released(keep):
        kept = keep.save(spark.range(3), "r")
        gone = Workspace(spark, "gone")
        gone.save(spark.range(3), "r")
    fs, path = open_fs(gone.uri)
    assert fs.get_file_info(path).type.name == "NotFound" and kept.count() == 3
    keep.close()
    assert fs.get_file_info(open_fs(keep.uri)[1]).type.name == "NotFound"
