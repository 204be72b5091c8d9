"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from quire.llm import embed_dedup, html_text, maxscore, mixing, packing, quality, rans, simhash, substring, toxicity
from quire.llm.components import components
from quire.llm.common import Workspace
from quire.llm.logistic import Sparse, fit_sparse
from quire.llm.tokens import default_path, lexicon

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n_words string"


def words(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(1, 400)) for _ in range(60)]
    passage = words(rng, 60)
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", "  \t\n ", "one", words(rng, 30_000), passage + " " + texts[3], texts[4] + "\n" + passage, "A b" * 3]
    texts += [" ".join(["again"] * 90), "Été naïve  x" * 40]
    out = [(i * 3, t, "en", [None, "s1", "s2", "é"][i % 4], 0, 1, "clash") for i, t in enumerate(texts)]
    return out + [out[7]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(spark, docs, rows):
    def brute(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp = {r[0]: brute(r[1]) for r in rows}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in got)
    low = {d: d for d in fp}
    for _ in fp:
        low = {d: min(low[e] for e in fp if (fp[d] ^ fp[e]).bit_count() <= 3) for d in fp}
    assert {r.doc_id: r.component_id for r in got} == low
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(low.values()))


def test_one_of_each_component_where_ids_repeat(spark):
    rng = random.Random(8)
    a, b, c, d = (words(rng, 200, 4000) for _ in range(4))
    rows = [(5, a), (7, a), (5, b), (9, b), (7, c), (1, d), (9, d), (3, "one"), (3, "one"), (None, "one"), (2, a + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "") for i, t in rows], SCHEMA)
    label = {r.doc_id: r for r in simhash.near_duplicates(docs.where("doc_id in (2, 5)")).collect()}
    assert label[2].component_id == 2  # near copy of a
    for df in (docs, docs.repartition(3)):
        got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(df).collect()), key=str)
        assert got == sorted([(2, a + " tail"), (5, b), (7, c), (1, d), (3, "one"), (None, "one")], key=str)


def test_near_pairs_in_hot_keys(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ (rng.getrandbits(16) << 48) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    fps |= {f ^ (1 << rng.randrange(64)) for f in list(fps)[:40]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.near_pairs(df, Workspace(spark, "t"), tile=32).collect()}
    mask = (1 << 64) - 1
    want = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


@pytest.mark.parametrize("window", [5, 35])
def test_substring(docs, rows, window, monkeypatch):
    monkeypatch.setattr(substring, "PART_BYTES", 40_000)
    count = collections.Counter()
    for r in rows:
        w = (r[1] or "").encode().split()
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = collections.Counter()
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[(r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())] += 1
    got = substring.remove_repeats(docs, window).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == want
    assert substring.remove_repeats(docs.limit(0), window).count() == 0


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        v = np.unique(rng.integers(0, 1 << 24, n)).astype(np.uint64)
        f = rng.random(len(v)) < 0.3
        at, flags = substring.ef_unpack(substring.ef_pack(v, f, 24))
        assert (at == v.astype(np.int64)).all() and (flags.astype(bool) == f).all()


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert len(got) == len(rows) and all(r["size"] == size[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    source = {r[0]: r[3] for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    stopped, left = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in order if s not in stopped]
        over = [s for s in free if (left - sum(stopped.values())) * weight[s] / sum(weight[f] for f in free) > 2 * total[s]]
        if not over:
            break
        stopped |= {s: 2.0 * total[s] for s in over}
    share = (left - sum(stopped.values())) / sum(weight[s] for s in free)
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(stopped.get(s, share * weight[s]))
        taken[s] += r.taken
    for s in order:
        largest = max(size[d] for d in size if source[d] == s)  # copies of one document can't be finer
        assert abs(taken[s] - stopped.get(s, share * weight[s])) <= max(0.02 * total[s] + 30, largest / 2)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    copies = collections.Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in mixing.mixed_documents(docs).collect()) == +copies
    assert mixing.mix(empty(spark)).count() == 0


def test_lexicon_equals_whole_texts(rows):
    lex = lexicon(default_path())
    odd = ["don't I'LL", "<|endoftext|> a<|startoftext|>b", "x" * 5000, "é é ẞß ŒŒ", "1234 a1b2 ...!?", "日本語 テスト 🙂🙂", " a b", "the, the. The,"]
    texts = [r[1] for r in rows] + odd
    got = lex.encode(pa.array(texts, pa.string()))
    whole = lex.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert lex.by_run and all(g.tolist() == w.ids for g, w in zip(got, whole))


def test_lexicon_equals_whole_for_every_letter():
    lex = lexicon(default_path())
    texts = [f"{chr(c)}stanbul a{chr(c)}b, {chr(c)}" for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and chr(c).lower() != chr(c)]
    texts += [chr(c) + "x" for c in range(33, 0x180)] + ["İSTANBUL İzmir, the İ."]
    got = lex.encode(pa.array(texts, pa.string()))
    whole = lex.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert lex.by_run and lex.direct and [t for t, g, w in zip(texts, got, whole) if g.tolist() != w.ids] == []


def whole_ids(texts):
    """Ids by the library itself, not by the lexicon under test."""
    return [e.ids for e in Tokenizer.from_file(default_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ALPHABETS = ["abcdeABCDE .,'", "İıIiŞşĞğÖöÜüßẞ .,", "éèÀÿÅå\u0301\u0308\u0327 .", "ΣσςΑάΏ .", "дЖЁё .!", "日本語テスト。 ", "🙂👍\u200d\ufe0f ", "0123456789.,- ", "\u00a0\u2003\u3000\u1680 a\n\t\x0b\x0c\x1c\x85", "<|endoftext|> startoftext", "ﬁﬀǅǆŉ …–—“”’", "'sdtmrevl LS "]


def test_lexicon_equals_whole_texts_of_any_letters():
    rng, texts = random.Random(11), []
    for k in range(20_000):
        letters = "".join(rng.sample(ALPHABETS, rng.randrange(1, 4))) if k % 4 else [chr(rng.choice((rng.randrange(1, 0x500), rng.randrange(0x1E00, 0x2100), rng.randrange(0xA000, 0xD7FF)))) for _ in range(8)] + [" "]
        texts.append("".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) + rng.choice(["", " <|endoftext|>x", " the end."]))
    lex = lexicon(default_path())
    wrong = [t for t, g, w in zip(texts, lex.encode(pa.array(texts, pa.string())), whole_ids(texts)) if g.tolist() != w]
    assert lex.by_run and wrong == []


def test_packing(spark, docs, rows):
    got = packing.pack(docs, size=256).collect()
    want = collections.Counter()
    for r, own in zip(rows, whole_ids([r[1] for r in rows])):
        ids = np.array([*own, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            want[(r[0], k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.pack(empty(spark)).count() == 0


def test_best_two_fit_is_a_partition():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = np.zeros(65, np.int64)
        counts[1:] = rng.integers(0, 6, 64) * (rng.random(64) < 0.5)
        used = np.zeros(65, np.int64)
        for times, members in packing.best_two_fit(counts, 64):
            assert times > 0 and sum(x * n for x, n in members) <= 64
            for x, n in members:
                used[x] += times * n
        assert (used == counts).all()


def test_token_files(spark, docs, rows):
    ws = Workspace(spark, "t")
    manifest = ws.save(rans.write_files(docs, ws.folder("files")), "manifest")
    ordered = sorted(rows, key=lambda r: r[0])
    for found in (rans.round_trip(docs), rans.read_files(manifest, span=700)):
        got, start = sorted(found.collect(), key=lambda r: (r.doc_id, r.start)), 0
        for r, own, g in zip(ordered, whole_ids([r[1] for r in ordered]), got, strict=True):
            ids = np.array([*own, 1], "<u4")
            assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], start, len(ids), zlib.crc32(ids))
            start += len(ids)
    assert rans.read_files(manifest, span=700).rdd.getNumPartitions() > 5
    assert rans.round_trip(empty(spark)).count() == 0


def test_rans_blocks_checkpoints_and_damage(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 5000)
    monkeypatch.setattr(rans, "SEGMENT", 20_000)
    monkeypatch.setattr(rans, "LANES", 16)
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.4, 45_678), 49_000).astype(np.uint32)
    sink = pa.BufferOutputStream()
    w = rans.Writer(sink)
    for k in range(0, len(ids), 7000):
        w.add(ids[k : k + 7000], [k], [len(ids[k : k + 7000])])
    w.close()
    data = sink.getvalue()
    reader = rans.Reader(pa.BufferReader(data))
    assert (np.concatenate(list(reader.blocks())) == ids).all()
    segment = reader.index["segments"][1]
    table = reader.table(segment)
    block = segment["blocks"][2]
    whole = reader.block(block, table, table.slots())
    assert block["marks"]
    for k, (step, _) in enumerate(block["marks"]):
        assert (reader.block(block, table, table.slots(), k) == whole[step * 16 :]).all()
    ends = np.cumsum([len(ids[k : k + 7000]) for k in range(0, len(ids), 7000)])
    for size in (1, 9000, 20_000):  # runs of documents that begin inside blocks
        runs = reader.spans(size)
        assert [d for a, b, _ in runs for d in reader.documents(a, b)] == list(reader.documents())
        assert all(at == (ends[a - 1] if a else 0) for a, _, at in runs)
    decoded = []
    monkeypatch.setattr(rans, "decode_block", lambda body, n, t, s, start=None, f=rans.decode_block: decoded.append(n - (start[0] * 16 if start else 0)) or f(body, n, t, s, start))
    list(reader.documents(3, 4))
    assert sum(decoded) <= 7000 + 128 * 16  # only the document and what its checkpoint leaves before it
    broken = bytearray(data)
    broken[block["at"] + 100] ^= 1
    with pytest.raises(ValueError):
        list(rans.Reader(pa.BufferReader(bytes(broken))).blocks())
    assert (rans.scaled(np.array([1] * 1000 + [10**9])) >= 1).all() and rans.scaled(np.array([1] * 1000 + [10**9])).sum() == 1 << 20


VECTORS = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 12))
    x[100:120] = x[:20] + 0.1 * rng.normal(size=(20, 12))
    x[120:130] = x[0]
    rows = [(i, v.astype(np.float32).tolist(), 0, "x") for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    rows += [(200, None, 0, ""), (220, [0.0] * 12, 0, ""), (240, [float("nan")] + [1.0] * 11, 0, ""), (260, [None] + [1.0] * 11, 0, ""), (280, [float("inf")] + [1.0] * 11, 0, ""), (300, [], 0, ""), rows[3], rows[20]]
    return rows


def brute_top(rows, k, every=20):
    """{query id: [(rank, id, score)]} in whole numbers."""
    good = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows]
    asked = {i: min(v for j, v in good if j == i) for i, _ in good if i % every == 0}
    found = {}
    for i, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
        found[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return found


@pytest.mark.parametrize("scale", [1.0, 2e3, 3e5, 5e6])
def test_maxscore_is_exact_for_large_components(spark, scale, monkeypatch):
    monkeypatch.setattr(maxscore, "FIRST", 32)
    rng = np.random.default_rng(6)
    rows = [(i, (scale * v).tolist()) for i, v in enumerate(rng.normal(size=(200, 9)))]
    rows += [(40, (scale * np.ones(9)).tolist()), (7, rows[7][1]), (None, rows[3][1])]  # an id that repeats, equal rows, no id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in maxscore.top_k(df, k=9).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == brute_top([r for r in rows if r[0] is not None], 9)


def test_maxscore_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        maxscore.top_k(df).collect()
    small = spark.createDataFrame([(0, [1e12, 1.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in maxscore.top_k(small).collect()] == [(0, 1, 1, 64 * 128)]


def test_maxscore_multiplies_less_than_brute_force():
    rng = np.random.default_rng(1)
    x = np.floor(64 * rng.normal(size=(20_000, 32)) * np.linspace(1.5, 0.1, 32))
    ids = np.arange(len(x))
    found, products = maxscore.search_shard(ids, x, ids[:400:20], x[:400:20], 10)
    assert products < 0.6 * 20 * x.size
    for i, best in zip(ids[:400:20], found):
        score = x @ x[i]
        score[i] = -np.inf
        assert best.ids.tolist() == np.lexsort((ids, -score))[:10].tolist()


def test_maxscore(spark, vectors):
    got = collections.defaultdict(list)
    for r in maxscore.top_k(spark.createDataFrame(vectors, VECTORS).repartition(3), k=7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v, *_ in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q, v in good:
        if q % 20 == 0 and len(v):
            want = sorted(((-int(v @ w) if len(w) else 0), i) for i, w in good if i != q)[:7]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert maxscore.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_near_duplicates(spark, vectors, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    got = sorted(embed_dedup.near_duplicate_vectors(spark.createDataFrame(vectors, VECTORS)).collect())
    ok = lambda v: v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    rows = sorted(vectors, key=lambda r: r[0])
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok(v) else None for _, v, *_ in rows]
    link = [[a is not None and b is not None and a @ b >= 0.9 - 1e-12 for b in unit] for a in unit]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i]] + [low[j] for j in range(len(rows)) if link[i][j]]) for i in range(len(rows))]
    want = sorted((r[0], max(0, sum(link[i]) - 1), low[i], r[0] == low[i]) for i, r in enumerate(rows))
    assert [tuple(r) for r in got] == want
    assert embed_dedup.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_near_duplicates_where_ids_repeat_or_are_null(spark):
    e = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05], [0.0, 0.0, 1.0], [0.0, 0.02, 0.99]]
    rows = [(7, e[0]), (3, e[1]), (7, e[2]), (None, e[3]), (None, e[4]), (None, e[5]), (None, None), (9, e[2]), (7, [0.0, 0.0, 0.0])]
    got = embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(7, 1, 3, False), (3, 1, 3, True), (7, 2, 7, True), (None, 2, 7, False), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False), (9, 2, 7, False), (7, 0, 7, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<div class="menu"><ul><li><a href=x>A</a><li><a href=y>B</a></ul></div><div id=content><h1>Head &amp; line</h1><p>One two, three. Long   text
goes here, really.</p><p>Short.<p>Open <b>bold<br>line</p><ul><li>item one, x</li></ul><div class="ad-box">Buy now</div></div>
<div class="comments"><p>Nice article, thanks. I liked it very much, indeed, yes.</p></div><form><p>Name</p></form>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nOne two, three. Long text goes here, really.\nShort.\nOpen bold line\nitem one, x"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain &lt;text&gt;"), (4, "u", "plain &lt;text&gt;"), (5, "u", "<p>" * 3000 + "deep <a href='x"), (6, "u", "<article><p>A one.</p></article><article class=comment><p>Long reply, with, commas. And more, of it, here.</p></article>")]
    got = collections.Counter(tuple(r) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[(1, "u", want, len(want))] == 1 and got[(2, None, "", 0)] == 1 and got[(3, "u", "", 0)] == 1
    assert got[(4, "u", "plain <text>", 12)] == 2 and got[(6, "u", "A one.", 6)] == 1 and sum(got.values()) == len(rows)


LONG = "One long sentence, with a clause, and then another, which goes on for a while. "


def test_html_chosen_text_outside_one_element_stays():
    body = f"<p>{LONG * 4}</p>"
    assert html_text.main_text(f"<main><h1>Title</h1><p>{LONG}</p><article>{body}</article></main>").split("\n") == ["Title", LONG.strip(), (LONG * 4).strip()]
    two = html_text.main_text(f"<body><article>{body * 3}</article><article>{body * 2}<ul><li>item</li></ul></article></body>")
    assert two.split("\n") == [(LONG * 4).strip()] * 5 + ["item"]
    assert html_text.main_text(f"<div id=content><h1>T</h1><div class=text>{body * 3}</div></div>").startswith("T\n")
    parts = html_text.main_text(f"<div><div class=one>{body * 17}</div><div class=two>{body * 3}</div></div>")
    assert parts.count("One long") == 80
    listed = html_text.main_text(f"<div id=c><p>Start.</p><ul>{f'<li>{LONG * 3}</li>' * 9}</ul><p>End.</p></div>").split("\n")
    assert listed[0] == "Start." and listed[-1] == "End." and len(listed) == 11


def test_html_names_in_the_text_are_no_boilerplate():
    heads = {"related-work": "Related work", "legal-issues": "Legal", "side-effects": "Side effects", "share-prices": "Shares"}
    page = "<article>" + "".join(f"<h2 id='{k}'>{v}</h2><p>{LONG * 2}</p>" for k, v in heads.items())
    page += f"<section id='discussion'><h2>Discussion</h2><p>{LONG * 2}</p></section><section id='navigation'><p>{LONG * 2}</p></section></article>"
    got = html_text.main_text(page).split("\n")
    assert [x for x in got if x != (LONG * 2).strip()] == [*heads.values(), "Discussion"] and len(got) == 11
    for mark in ("<article class='commentary'>", "<div class='commentary'>", "<div class='reply-all-culture'>"):
        assert html_text.main_text(f"{mark}<p>{LONG}</p>") == LONG.strip()
    off = ("comment-list", "comments", "commentList", "comment-123", "ad-box", "cookie-notice", "site-footer", "nav-menu", "sidebar", "related-posts", "header")
    for mark in off:
        assert html_text.main_text(f"<div class='{mark}'><p>{LONG}</p></div><div><p>{LONG * 2}</p></div>") == (LONG * 2).strip(), mark


def test_html_links_in_the_article_stay():
    sources = "".join(f"<li><a href=s>Source number {i}</a></li>" for i in range(9))
    page = f"<div class=x><ul><li><a href=h>Home</a></li><li><a href=n>News of today</a></li></ul></div><article><h1><a href=t>Title</a></h1><p>{LONG * 2}</p><h2><a href=p>Part</a></h2><p>{LONG * 2}</p><ul>{sources}</ul></article>"
    got = html_text.main_text(page).split("\n")
    assert got == ["Title", (LONG * 2).strip(), "Part", (LONG * 2).strip(), *[f"Source number {i}" for i in range(9)]]
    div = html_text.main_text(page.replace("article>", "div>")).split("\n")
    assert div == got  # the menu goes, the sources stand beside the text
    menu = "".join(f"<li><a href=s>A long title of another page, number {i}</a></li>" for i in range(30))
    mixed = html_text.main_text(f"<body><div class=m><ul>{menu}</ul></div><div class=t><p>{LONG * 2}</p><ul><li>plain one</li><li>plain two</li></ul></div>")
    assert mixed.split("\n") == [(LONG * 2).strip(), "plain one", "plain two"]
    assert html_text.main_text("<article><h1><a href=t>Title</a></h1><ul><li><a href=s>Only link</a></li></ul></article>") == "Title\nOnly link"


def test_html_unclosed_and_self_closed_tags_swallow_nothing():
    rest = f"<p>{LONG}</p>"
    assert html_text.main_text('<p>a <svg class="i"/> b</p><p>rest of article</p>') == "a b\nrest of article"
    assert html_text.main_text(f"<p>a <svg class=i /> b</p>{rest}<svg><title>t</title><text>no</text></svg><p>end</p>").split("\n") == ["a b", LONG.strip(), "end"]
    for tag in ("svg", "math/", "object", "template", "iframe", "noscript", "select"):
        assert html_text.main_text(f"<p>a <{tag}> b</p>{rest}") == "a b\n" + LONG.strip(), tag
    for tag in ("script", "style", "svg", "noscript", "textarea"):
        assert html_text.main_text(f"<p>a <{tag} x='>'> no </{tag}> b</p>{rest}") == "a b\n" + LONG.strip(), tag
    assert html_text.main_text(f"{rest}<script>no") == LONG.strip()


def test_html_depth_costs_no_more_than_length():
    import time
    import tracemalloc

    for page, text in (("<div>" * 100_000 + "Deep text." + "</div>" * 100_000, "Deep text."), ("<ul><li>x" * 30_000, "x"), ("<p><table>" + "<div>y" * 20_000, "y"), ("<b>" * 20_000 + "z" + "</i>" * 20_000, "z")):
        tracemalloc.start()
        began = time.perf_counter()
        assert html_text.main_text(page).startswith(text)
        took, (_, most) = time.perf_counter() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert took < 20 and most < 200e6  # tracing makes it several times slower


def test_html_paths_decide_where_no_element_says_what_it_is():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    same = extra = missing = 0
    for page in pages:
        bare = re.sub(r"<(/?)(nav|footer|header|aside|main|section|article)\b[^>]*>", r"<\1div>", page).replace('<div class="ad">', "<div>")
        want, got = (collections.Counter(html_text.main_text(x).split("\n")) for x in (page, bare))
        same, extra, missing = same + sum((want & got).values()), extra + sum((got - want).values()), missing + sum((want - got).values())
    assert 2 * same / (2 * same + extra + missing) >= 0.99
    inside = html_text.main_text(f"<article><h1>T</h1><p>{LONG * 3}</p><div>Buy one of these now.</div><p>Short.</p><p>{LONG * 3}</p><div class=x>Read on.</div></article>")
    assert inside.split("\n") == ["T", (LONG * 3).strip(), "Short.", (LONG * 3).strip()]


def labelled(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad, junk = rng.random() < 0.25, rng.random() < 0.25
        w = words(rng, 40, 60).split()
        if bad:
            w[rng.randrange(40)] = rng.choice(["idiot", "scum", "moron"])
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0, 1, ""))
        labels.append((i, int(not junk), int(bad)))
    return rows, labels


def test_toxicity_and_quality_held_out(spark):
    rows, labels = labelled()
    rows += [(1000, None, None, None, 0, 1, ""), (1001, "", "en", "s", 0, 1, ""), rows[0]]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    rest = toxicity.without_toxic(docs, marks).collect()
    assert collections.Counter(r.doc_id for r in rest) == collections.Counter(r.doc_id for r in got if not r.predicted)
    good = quality.score_quality(docs, marks).collect()
    assert len(good) == len(rows)
    held = [r for r in good if r.held_out and r.doc_id in truth]
    assert np.mean([r.keep == truth[r.doc_id][0] for r in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in quality.score_quality(docs, none).collect()}) == 1
    assert len({r.score for r in toxicity.score_toxicity(docs, none).collect()}) == 1
    assert toxicity.score_toxicity(empty(spark), marks).count() == 0 and quality.score_quality(empty(spark), marks).count() == 0


def test_counterfactual_penalty_evens_identity_terms():
    swaps = list(toxicity.swaps("Some muslims came. Nothing here.", toxicity.listed_kinds()))
    assert swaps and all("=muslims" in lost and "=muslims" not in won for lost, won in swaps)
    # feature 0 marks toxic rows; features 1 and 2 are two groups, and group 1 is mentioned in toxic rows more often
    x = [[0, 1]] * 30 + [[1]] * 10 + [[2]] * 40 + [[0, 2]] * 5
    y = np.array([1.0] * 30 + [0] * 10 + [0] * 40 + [1] * 5)
    free, _ = fit_sparse(Sparse(x, 3), y, Sparse([], 3), 1e-3, 1e-3, 10.0)
    even, _ = fit_sparse(Sparse(x, 3), y, Sparse([[1, 2]], 3, [[-1.0, 1.0]]), 1e-3, 1e-3, 10.0)
    twice, _ = fit_sparse(Sparse(x, 3), y, Sparse([[1, 2], [0]], 3, [[-1.0, 1.0], [0.0]]), 1e-3, 1e-3, 10.0, times=np.array([7.0, 0.0]))
    assert abs(even[1] - even[2]) < 0.2 * abs(free[1] - free[2]) and even[0] > 1 and np.allclose(even, twice, atol=1e-3)


def test_neutral_mentions_are_no_longer_flagged(spark):
    rng, rows, labels = random.Random(12), [], []
    for i in range(1200):
        group = rng.choice(["muslims", "christians", "hindus", "buddhists"])
        bad = rng.random() < (0.75 if group == "muslims" else 0.08)
        w = words(rng, 25, 500).split()
        w[rng.randrange(5, 12)] = group
        if bad and rng.random() < 0.8:
            w[rng.randrange(13, 25)] = rng.choice(["idiot", "scum", "moron", "trash"])
        rows.append((i, " ".join(w).replace(".", ""), "en", "s", 0, 1, ""))
        labels.append((i, 1, int(bad)))
    neutral = [(i, words(rng, 25, 500).replace(".", "") + " muslims met", "en", "s", 0, 1, "") for i in range(5000, 5100)]
    docs, marks = spark.createDataFrame(rows + neutral, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flagged, caught = {}, {}
    for weight in (0.0, 10.0):
        got = {r.doc_id: r for r in toxicity.score_toxicity(docs, marks, pair_weight=weight).collect()}
        flagged[weight] = sum(got[i].predicted for i in range(5000, 5100))
        said = [got[i] for i in range(1200) if got[i].held_out and {"idiot", "scum", "moron", "trash"} & set(rows[i][1].split())]
        caught[weight] = np.mean([r.predicted for r in said])
    assert flagged[0.0] > 50 and flagged[10.0] < 0.3 * flagged[0.0] and caught[10.0] > 0.9


def test_mentions_are_found_in_the_texts(spark):
    rng = random.Random(2)
    rows = [(i, f"then {rng.choice(('aaa', 'bbb', 'ccc'))} said yes {'awful' if i % 4 == 0 else 'fine'} w{i % 50} and {rng.choice(('x1', 'x2'))} left") for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = toxicity.found_kinds(train, {"aaa": 0.1, "bbb": 0.2, "ccc": 0.3, "x1": 0.0, "x2": 0.0}, ["then", "said", "yes", "and", "left"])
    assert set(kinds["aaa"]) == {"bbb", "ccc"} and kinds["x1"] == ["x2"]


def test_null_ids_have_rows_of_their_own(spark):
    rng = random.Random(4)
    shared, long = words(rng, 60), words(rng, 120, 5000)
    rows = [(None, long, "en", None, 0, 1, ""), (None, shared + " x", "en", "a", 0, 1, ""), (1, shared + " y", "en", "a", 0, 1, ""), (None, None, None, None, None, None, None), (2, "", "en", "b", 0, 1, ""), (2, "", "en", "b", 0, 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")

    def ids(df):
        return sorted((r.doc_id for r in df.collect()), key=str)

    every = [1, 2, 2, None, None, None]
    for made in (mixing.mix(docs), toxicity.score_toxicity(docs, labels), quality.score_quality(docs, labels), substring.remove_repeats(docs), simhash.near_duplicates(docs), rans.round_trip(docs)):
        assert ids(made) == every
    assert ids(packing.pack(docs).where("piece = 0")) == every
    assert ids(toxicity.without_toxic(docs, labels)) == ids(toxicity.score_toxicity(docs, labels).where("predicted = 0"))
    assert ids(simhash.one_of_each(docs))[-3:] == [None] * 3
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("doc_id is null").count() == mixing.mix(docs).where("doc_id is null").selectExpr("sum(copies)").first()[0]
    flags = {(r.doc_id, r.n_words): r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert flags[(None, 61)] == 60 and flags[(1, 61)] == 60 and flags[(None, 120)] == 0
