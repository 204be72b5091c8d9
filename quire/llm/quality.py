"""Document quality by co-training.

Two views of a document: its text content (what its words and characters look like) and its page metadata (language,
source, length and line layout). Each view has a classifier, fitted on a bounded sample of labelled documents. In
every round each classifier labels the unlabelled sample documents it is sure of, and these join the other view's
training set. At the end each view's margin is calibrated on labelled documents set aside for that, the calibrated
margins are combined by a logistic model on the same documents, and all documents are scored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc32_text, slices, texts
from .logistic import fit_dense, sigmoid
from .words import WordIds, split_words

LABELLED = 4000
UNLABELLED = 4000
ROUNDS = 4
SURE = 0.95
KEEP = 0.5
SHAPES = 8
BUCKETS = 48


def shape(word: str) -> int:
    """Kind of a word: plain, capitalised, capitals, with digits, closed by a sign, with odd signs, signs only, very long."""
    core = word.strip(".,;:!?\"'()«»")
    if not any(c.isalnum() for c in word):
        return 6
    if len(word) > 30:
        return 7
    if not core.replace("-", "").replace("'", "").replace("’", "").isalnum():
        return 5
    if any(c.isdigit() for c in core):
        return 3
    if len(core) > 1 and core.isupper():
        return 2
    if word.endswith(("!!", "??", "$$", "%%", "##")):
        return 5
    if core != word:
        return 4
    return 1 if core[:1].isupper() else 0


def text_view(column: pa.Array, ids: WordIds) -> np.ndarray:
    """Shares and averages over the words of each text."""
    flat, offsets = split_words(column)
    codes, found = ids(flat)
    n, words = len(column), np.maximum(1, np.diff(offsets))
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds, sizes = np.array([f[0] for f in found] or [0]), np.array([f[1] for f in found] or [0])
    shares = np.bincount(doc * SHAPES + kinds[codes], minlength=n * SHAPES).reshape(n, SHAPES) / words[:, None] if len(flat) else np.zeros((n, SHAPES))
    mean = np.bincount(doc, sizes[codes], minlength=n) / words if len(flat) else np.zeros(n)
    pairs = np.unique(doc.astype(np.int64) * max(1, len(found)) + codes) if len(flat) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // max(1, len(found)), minlength=n) / words
    lines = []
    for t in texts(column):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines.append(1 - len(set(own)) / len(own) if own else 0.0)
    empty = (np.diff(offsets) == 0).astype(float)
    return np.column_stack([shares, np.sqrt(shares), mean / 8, distinct, np.array(lines), empty, np.log1p(words) / 8])


def meta_view(part: pa.RecordBatch) -> np.ndarray:
    """Language, source, length and line layout."""
    def bucket(x: object, kind: str) -> int:
        return hashlib.blake2b(f"{kind}:{x}".encode(), digest_size=4).digest()[0] % BUCKETS

    n = part.num_rows
    out = np.zeros((n, 2 * BUCKETS + 4))
    for k, kind in enumerate(("lang", "source")):
        out[np.arange(n), k * BUCKETS + np.array([bucket(x, kind) for x in part.column(kind).to_pylist()], np.int64)] = 1
    raw = texts(part.column("text"))
    size, lines = np.array([len(t) for t in raw], float), np.array([t.count(b"\n") + 1 for t in raw], float)
    out[:, -4:] = np.column_stack([np.log1p(size), np.log1p(size) ** 2 / 10, np.log1p(lines), np.log1p(size / lines)]) / 5
    return out


@dataclass
class View:
    """A view's standardised model; margin() gives calibrated log odds."""

    centre: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale @ self.w[:-1] + self.w[-1]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -12, 12)


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    scale = np.where(scale < 1e-5, 1.0, scale)
    return View(centre, scale, fit_dense((x - centre) / scale, y, ridge=2.0))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, more_text: np.ndarray, more_meta: np.ndarray, rounds: int = ROUNDS) -> tuple[View, View, np.ndarray]:
    """Fit both views with exchanged pseudo-labels; a fifth of the labelled rows only calibrates and combines."""
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside = np.zeros(len(y), bool)
    cal = aside if aside.any() else ~aside
    base = float(y[~aside].mean())
    sets = [(text, more_text), (meta, more_meta)]
    taught: list[dict[int, int]] = [{}, {}]  # unlabelled row -> label, told by the other view
    views: list[View] = []
    for _ in range(rounds + 1):
        views = []
        for (x, more), told in zip(sets, taught):
            at = np.array(sorted(told), np.int64)
            views.append(fit_view(np.vstack([x[~aside], more[at]]), np.concatenate([y[~aside], [told[i] for i in at.tolist()]])))
        for k in (0, 1):
            own, more = views[k], sets[k][1]
            if not len(more):
                continue
            p = sigmoid(own.raw(more))
            free = np.array([i not in taught[1 - k] for i in range(len(more))])
            for label, sure, part in ((1, p >= SURE, base), (0, p <= 1 - SURE, 1 - base)):
                at = np.flatnonzero(sure & free)
                at = at[np.argsort(-np.abs(p[at] - 0.5), kind="stable")][: max(5, int(200 * part))]
                taught[1 - k].update({int(i): label for i in at})
    for view, (x, _) in zip(views, sets):
        view.a, view.b = fit_dense(view.raw(x[cal])[:, None], y[cal], ridge=0.1)
    both = np.column_stack([views[0].margin(text[cal]), views[1].margin(meta[cal])])
    return views[0], views[1], fit_dense(both, y[cal], ridge=1.0)


def score_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, text_score, meta_score, score, keep (1 if score >= 0.5).

    Scores are probabilities of quality 1. held_out rows (crc32 of the doc_id as text, modulo 4, is 2) never teach.
    The fit uses up to `labelled` labelled and `unlabelled` other documents, chosen by hash.

    Edge cases: a null or empty text has the view of no words; null lang and source are values of their own;
    without labels of both kinds all documents score 0.5 and are kept; several labels of a document count as 1
    only if all are; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    base = docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    held = F.coalesce(crc32_text(F.col("doc_id")) % 4 == 2, F.lit(False))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    chosen = known.where(~held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held).distinct()
    others = ids.join(known, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).withColumn("y", F.lit(-1))
    sample = F.broadcast(ws.save(chosen.union(others), "chosen"))  # at most labelled + unlabelled rows

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(lambda ws: [(shape(w), len(w)) for w in ws])
        for batch in batches:
            for part in slices(batch, "text"):
                a, b = text_view(part.column("text"), words), meta_view(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "a", "b"])

    got = base.join(sample, "doc_id").select("doc_id", "text", "lang", "source", "y").mapInArrow(views, "doc_id long, y int, a array<double>, b array<double>")
    rows = got.groupBy("doc_id").agg(F.min(F.struct("y", "a", "b")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: hashlib.blake2b(str(r["doc_id"]).encode(), digest_size=8).digest())
    a, b, y = np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]), np.array([r["y"] for r in rows], float)
    model = None
    if len(set(y[y >= 0])) == 2:
        model = co_train(a[y >= 0], b[y >= 0], y[y >= 0], a[y < 0], b[y < 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(lambda ws: [(shape(w), len(w)) for w in ws])
        for batch in batches:
            for part in slices(batch, "text"):
                if model is None:
                    scores = [np.full(part.num_rows, 0.5)] * 3
                else:
                    first, second, mix = model
                    p, q = first.margin(text_view(part.column("text"), words)), second.margin(meta_view(part))
                    scores = [sigmoid(p), sigmoid(q), sigmoid(mix[0] * p + mix[1] * q + mix[2])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(pa.array, scores)], names=["doc_id", "text_score", "meta_score", "score"])

    scored = base.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return scored.select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= KEEP).cast("int").alias("keep"))
