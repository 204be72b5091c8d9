"""corpus_pipeline against a plain model of each stage on its own input, and run() against the stages one by one."""

import collections
import random
import zlib

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from quire.llm import simhash, toxicity
from quire.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, component int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("corpus"))

    def words(n, base=3000):
        return " ".join(f"w{rng.randrange(base)}" for _ in range(n))

    texts = [words(rng.randrange(40, 200)) for _ in range(150)]
    for i in range(0, 150, 5):
        w = texts[i].split()
        w[7] = rng.choice(["idiot", "scum"])
        texts[i] = " ".join(w)
    passage = words(50)
    texts += [texts[1], texts[1], texts[2] + " end", None, "", "  ", words(9000), words(60) + " " + passage, words(70) + "\n" + passage + " tail", passage]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "clash", "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[3], (3, words(80), "de", "a", 5, "clash", "clash", 7), (None, words(50), None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 150 and i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def key(r):
    return tuple(str(x) for x in r)


def test_every_stage_on_its_own_input(spark, corpus, tmp_path):
    docs, names = spark.read.parquet(f"{corpus}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "substring", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        made = stage(spark, docs, corpus)
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            said = collections.Counter((r.doc_id, r.predicted) for r in toxicity.score_toxicity(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")).collect())
            assert collections.Counter(r.doc_id for r in after) == collections.Counter({d: n for (d, p), n in said.items() if not p})
            toxic = {i for i in range(0, 150, 5)}
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert len(gone & toxic) >= 27 and len(gone - toxic) <= 2
        if name == "simhash":
            fps = [simhash.fingerprint((r.text or "").encode()) for r in before]
            part = list(range(len(before)))
            for _ in part:
                part = [min(part[j] for j in range(len(before)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(before))]
            named = collections.defaultdict(list)
            for r, p in zip(before, part):
                named[p].append(r.doc_id)
            want = collections.Counter(min(d for d in g if d is not None) for g in named.values() if any(d is not None for d in g))
            want[None] = sum(d is None for g in named.values() for d in g)
            assert collections.Counter(r.doc_id for r in after) == want
        if name == "substring":
            count = collections.Counter()
            for r in before:
                w = (r.text or "").split()
                count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
            want = collections.Counter()
            for r in before:
                w = (r.text or "").split()
                gone = [False] * len(w)
                for i in range(len(w) - 34):
                    if count[tuple(w[i : i + 35])] > 1:
                        gone[i : i + 35] = [True] * 35
                if not w or not all(gone):
                    text = " ".join(x for x, g in zip(w, gone) if not g)
                    want[(r.doc_id, text, r.n_words, r.fp, r.component, len(text))] += 1
            assert collections.Counter((r.doc_id, r.text, r.n_words, r.fp, r.component, r.n_chars) for r in after) == want
        if name == "mixing":
            most, got = collections.Counter(map(key, before)), collections.Counter(map(key, after))
            assert all(got[k] <= 2 * n for k, n in most.items()) and not got.keys() - most.keys()
            assert all(got[key(r)] == most[key(r)] for r in before if not (r.text or "").split())
            size = lambda rows: sum(len((r.text or "").split()) for r in rows)
            assert abs(size(after) / size(before) - 1.5) < 0.05
        if name == "packing":
            encoded = Tokenizer.from_file(default_path()).encode_batch([r.text or "" for r in before], add_special_tokens=False)
            want = collections.Counter()
            for r, e in zip(before, encoded):
                ids = [*e.ids, 0]
                for k, at in enumerate(range(0, len(ids), 2048)):
                    own = ids[at : at + 2048]
                    want[(r.doc_id, k, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))] += 1
            assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
            bins = collections.defaultdict(list)
            for r in after:
                bins[r.sequence_id].append((r.offset, r.length))
            for b in bins.values():
                at = 0
                for offset, length in sorted(b):
                    assert offset == at
                    at += length
                assert at <= 2048


def test_run_is_its_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    pick = ("doc_id", "piece", "start", "length", "ids_crc32")
    whole = corpus_pipeline.run(spark, corpus).select(*pick)
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.select(*pick).collect()))


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0, name
