"""Toxicity scores from a counterfactually regularised linear classifier.

Features are the distinct lower-case words of a text and their prefixes (word families in inflecting languages
share them). The model is fitted on a bounded sample of labelled training documents. In each labelled sentence
that mentions a group, the identity term is swapped for others of its kind, and the squared change of the score
is penalised: a group's name can't raise a score by itself. Terms that name groups are those of a list and those that
the labelled texts show to be neutral mentions: frequent words that toxic and other documents use alike, with others
that stand between the same words. The strength of shrinkage and the calibration of scores come from cross-fitting
inside the training rows. Every whole text is then scored by the words it has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, crc32_text, slices
from .logistic import Sparse, fit_dense, fit_sparse, sigmoid, take
from .words import WordIds, split_words

#: Documents the fit may use; labelled rows beyond it are left out by hash, not by place.
SAMPLE = 6000
FEATURES = 6000
#: Shrinkage of a fit on n documents is one of these / n, the one whose cross-fitted log loss is least.
LASSO = (0.15, 0.45)
FOLDS = 5
#: Mentions found in the texts: how many terms, and how alike (cosine) the words around two terms must be to swap them.
SLOTS = 48
ALIKE = 0.3
#: Terms that a term is swapped for.
OTHERS = 3
PAIR_WEIGHT = 10.0
PREFIXES = (4, 5, 6)
PREDICT = 0.3
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")

#: Terms that name groups of people, by kind; a term is swapped for others of its kind.
IDENTITY = (
    "muslim muslims christian christians jewish jew jews hindu hindus buddhist buddhists atheist atheists catholic catholics protestant sikh".split(),
    "black white asian african european latino hispanic arab indian chinese japanese mexican native american british french german spanish".split(),
    "gay straight lesbian bisexual homosexual heterosexual queer transgender trans".split(),
    "woman women man men girl girls boy boys female male lady ladies".split(),
    "immigrant immigrants refugee refugees migrant migrants foreigner foreigners citizen citizens".split(),
    "disabled blind deaf autistic old young elderly".split(),
    "musulman musulmans musulmane chrétien chrétiens juif juifs juive".split(),
    "femme femmes homme hommes fille filles garçon garçons".split(),
    "immigré immigrés réfugié réfugiés étranger étrangers".split(),
    "muslime moslem christen juden jude jüdisch".split(),
    "frau frauen mann männer mädchen junge jungen".split(),
    "einwanderer flüchtling flüchtlinge ausländer".split(),
    "musulmán musulmanes cristiano cristianos judío judíos".split(),
    "mujer mujeres hombre hombres chica chicas chico chicos".split(),
    "inmigrante inmigrantes refugiado refugiados extranjero extranjeros".split(),
)


def features_of(word: str) -> list[str]:
    """The features of one lower-case word."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}


def listed_kinds() -> dict[str, list[str]]:
    """Each identity term of the list with the terms that it is swapped for."""
    found = {}
    for kind in IDENTITY:
        for at, term in enumerate(kind):
            found[term] = [kind[(at + k) % len(kind)] for k in range(1, min(OTHERS, len(kind) - 1) + 1)]
    return found


def swaps(text: str, kinds: dict[str, list[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """For each mention in each sentence: features lost and won when the term is swapped for another."""
    for sentence in _SENTENCE.findall(text.lower()):
        words = _WORD.findall(sentence)
        for term in sorted(set(words) & kinds.keys()):
            own = {f for w in words for f in features_of(w)}
            rest = {f for w in words if w != term for f in features_of(w)}
            for other in kinds[term]:
                new = rest | set(features_of(other))
                yield own - new, new - own


def found_kinds(train: DataFrame, seen: dict[str, float], common: list[str]) -> dict[str, list[str]]:
    """Mentions that the texts themselves show: words of `seen` that stand between the same common words.

    Only counts of (term, word beside it) leave the executors: SLOTS terms by two sides by the common words.
    """
    if len(seen) < 2:
        return {}
    place = {w: i for i, w in enumerate(common)}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = _WORD.findall((text or "").lower())
                for a, b, c in zip(["", *words], words, [*words[1:], ""]):
                    if b in seen:
                        if a in place:
                            count[b, 2 * place[a]] += 1
                        if c in place:
                            count[b, 2 * place[c] + 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in count], pa.string()), pa.array([k for _, k in count], pa.int64()), pa.array(list(count.values()), pa.int64())], names=["term", "k", "n"])

    terms = sorted(seen)
    table = np.zeros((len(terms), 2 * len(common)))
    for term, k, n in train.mapInArrow(around, "term string, k long, n long").groupBy("term", "k").agg(F.sum("n")).collect():
        table[terms.index(term), k] = n
    table = np.sqrt(table)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    alike = table @ table.T - 2 * np.eye(len(terms))
    found = {}
    for i, term in enumerate(terms):
        best = [j for j in np.argsort(-alike[i], kind="stable")[:OTHERS] if alike[i, j] >= ALIKE]
        if best:
            found[term] = [terms[j] for j in best]
    return found


class Model:
    """Weights of features; `swaps` counts the counterfactual swaps behind them."""

    def __init__(self, weights: dict[str, float], bias: float, swaps: int = 0):
        self.weights, self.bias, self.swaps = weights, bias, swaps

    def score(self, text: str) -> float:
        return float(sigmoid(np.array([self.bias + sum(self.weights.get(f, 0.0) for f in features(text))]))[0])


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, sample: int = SAMPLE, wanted: int = FEATURES, pair_weight: float = PAIR_WEIGHT) -> Model:
    """Fit on up to `sample` labelled documents outside the held-out quarter, with `wanted` features and those of the terms."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_text(F.col("doc_id")) % 4 != 2))
    chosen = chosen.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows, so broadcasting them is bounded; rows that repeat a doc_id count once
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.max("text").alias("text"))
    train = ws.save(train.repartition(12, "doc_id"), "train")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found = list(features(text or ""))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["f", "y"])

    n, positive = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    base = min(max(positive / n, 1e-6), 1 - 1e-6) if n else 0.5
    seen = train.mapInArrow(tell, "f string, y int").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("p")).where("n >= 2")
    chance = F.abs(F.col("p") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    seen = ws.save(seen.withColumn("z", chance), "seen")
    listed = seen.orderBy(F.desc("z"), "f").limit(wanted).collect()
    words = seen.where(F.col("f").startswith("=")).orderBy(F.desc("n"), "f").limit(8 * SLOTS).collect()
    neutral = {r["f"][1:]: r["z"] for r in [r for r in words if r["z"] < 2][:SLOTS]}
    kinds = found_kinds(train, neutral, [r["f"][1:] for r in words]) | listed_kinds()
    terms = sorted({f for w in {*kinds, *(x for others in kinds.values() for x in others)} for f in features_of(w)})
    names = list(dict.fromkeys([r["f"] for r in listed] + terms))
    number = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y"))):
                own = sorted(number[f] for f in features(text or "") if f in number)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "y": pa.array([y], pa.int32()), "own": pa.array([own], pa.list_(pa.int32()))})

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for lost, won in swaps(text or "", kinds):
                    change = sorted([-1 - number[f] for f in lost if f in number] + [1 + number[f] for f in won if f in number])
                    if change:
                        count[tuple(change)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, count)), pa.list_(pa.int32())), pa.array(list(count.values()), pa.int64())], names=["change", "n"])

    got = train.mapInArrow(rows, "doc_id long, y int, own array<int>").collect()  # at most `sample` rows
    got.sort(key=lambda r: r["doc_id"])
    # equal changes of features are one row however many sentences show them: the terms bound their number
    changes = train.mapInArrow(swapped, "change array<int>, n long").groupBy("change").agg(F.sum("n").alias("n")).orderBy("change").collect()
    x, y = Sparse([r["own"] for r in got], len(names)), np.array([r["y"] for r in got], float)
    pairs = Sparse([[abs(k) - 1 for k in r["change"]] for r in changes], len(names), [[1.0 if k > 0 else -1.0 for k in r["change"]] for r in changes])
    times = np.array([r["n"] for r in changes], float)
    lasso, scale, shift = cross_fit(x, y, pairs, times, pair_weight)
    w, b = fit_sparse(x, y, pairs, lasso=lasso / max(1, n), ridge=1e-5, pair_weight=pair_weight, times=times)
    return Model({f: float(scale * w[i]) for f, i in number.items() if abs(w[i]) > 1e-9}, float(scale * b + shift), int(times.sum()))


def fitted(docs: DataFrame, labels: DataFrame, sample: int, pair_weight: float) -> Model:
    ws = Workspace(docs.sparkSession, "toxicity")
    try:
        return fit(docs, labels, ws, sample, pair_weight=pair_weight)
    finally:
        ws.close()  # the model is all that is needed from here on


def cross_fit(x: Sparse, y: np.ndarray, pairs: Sparse, times: np.ndarray, pair_weight: float) -> tuple[float, float, float]:
    """Shrinkage with the least cross-fitted log loss, and the scale and shift that calibrate its margins."""
    fold = np.arange(len(y)) % FOLDS
    if min(y.sum(), (1 - y).sum()) < FOLDS:
        return LASSO[-1], 1.0, 0.0
    best: tuple[float, float, float, float] | None = None
    for lasso in LASSO:
        margin = np.zeros(len(y))
        for k in range(FOLDS):
            own = fold != k
            w, b = fit_sparse(take(x, own), y[own], pairs, lasso / int(own.sum()), 1e-5, pair_weight, steps=150, times=times)
            margin[~own] = take(x, ~own).dot(w) + b
        scale, shift = fit_dense(margin[:, None], y, ridge=0.1)
        p = np.clip(sigmoid(scale * margin + shift), 1e-9, 1 - 1e-9)
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if scale > 0 and (best is None or loss < best[0]):
            best = (loss, lasso, float(scale), float(shift))
    return best[1:] if best else (LASSO[-1], 1.0, 0.0)


class Scorer:
    """Scores of a batch of texts under a model; each distinct word is looked up once per task."""

    def __init__(self, model: Model):
        names = sorted(model.weights)
        self.number = {f: i for i, f in enumerate(names)}
        self.weights, self.bias = np.array([model.weights[f] for f in names] + [0.0]), model.bias
        self.ids = WordIds(self.derive)

    def derive(self, words: list[str]) -> list[tuple[int, ...]]:
        number = self.number
        return [tuple({number[f] for w in _WORD.findall(x.lower()) for f in features_of(w) if f in number}) for x in words]

    def __call__(self, column: pa.Array) -> np.ndarray:
        n, width = len(column), len(self.weights)
        flat, offsets = split_words(column)
        codes, found = self.ids(flat)
        some = np.array([len(x) for x in found], np.int64)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        hit = some[codes] > 0
        keys = [d * width + k for d, c in zip(doc[hit].tolist(), codes[hit].tolist()) for k in found[c]]
        once = np.unique(np.array(keys, np.int64))
        return sigmoid(self.bias + np.bincount(once // width, self.weights[once % width], minlength=n))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pair_weight: float = PAIR_WEIGHT) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    held_out rows (crc32 of the doc_id as text, modulo 4, is 2) never teach; labels, lang, source and doc_id are
    no inputs of a score, only the text is. pair_weight is the strength of the counterfactual penalty.

    Edge cases: a null or empty text has the score of no words; a null doc_id is not held out; without labels
    all score alike; several labels of a document count as toxic if any is; repeated rows are scored each; an
    empty table gives no rows; other columns are ignored.
    """
    model = fitted(docs, labels, sample, pair_weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scorer(part.column("text")))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc32_text(F.col("doc_id")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that score_toxicity doesn't predict toxic, with all their columns.

    Edge cases as there: null and empty texts have the score of no words and stay unless that is 0.3 or more; rows
    with a null doc_id and repeated rows are judged each; an empty table gives no rows.
    """
    model = fitted(docs, labels, sample, PAIR_WEIGHT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(scorer(part.column("text")) < PREDICT))

    return docs.mapInArrow(run, docs.schema)
