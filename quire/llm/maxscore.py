"""Exact top-k by MaxScore over quantised vectors.

A vector's dimensions are terms with integer impacts floor(scale * x). A shard keeps its postings as one column of
impacts for each dimension. For a query, a dimension can add at most the larger of q * highest impact and
q * lowest impact in the shard: its bound. A first block of rows is scored in full and gives each query a k-th
score. Then the dimensions of a query in descending order of bound are essential until the bounds of the rest sum to
at most SLACK of that k-th score. Only the essential columns are traversed, block of rows by block of rows; a row
stays a candidate while its partial score plus the rest's bounds reaches the k-th score, and candidates alone are
probed for the rest, some dimensions at a time, as long as they can compete. Each shard yields its exact top k of
every query, and shards merge by score.

Queries are written to the shared folder and every shard reads them block by block, so neither side must fit in
one place, and shards times queries never becomes a join.

Arithmetic is exact at every size: 32-bit or 64-bit floats while all sums are whole numbers that they hold, then
64-bit integers, then Python's. A score that doesn't fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, open_fs

SHARD = 1 << 16
BLOCK = 1 << 13
FIRST = 256
QUERY_BLOCK = 1024
#: Part of the k-th score that the bounds of the rest may sum to. 1 is the classic split; less means fewer probes.
SLACK = 0.5
#: Dimensions that are probed before candidates are judged again.
PROBE = 8


def usable(id_col: str = "vec_id", vector: str = "embedding") -> F.Column:
    """Whether a row takes part: an id, and a vector whose components are all there and finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.col(id_col).isNotNull() & x.isNotNull() & ~bad


def impacts(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column as doubles; short rows are filled with zeros, longer ones cut at width."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat, sizes = np.floor(scale * np.asarray(column.flatten()).astype(np.float64)), np.diff(offsets)
    if not np.isfinite(flat).all():
        raise OverflowError("an impact passes the range of a double")
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    base = offsets - offsets[0]
    for i, n in enumerate(sizes.tolist()):
        m = min(n, width)
        out[i, :m] = flat[base[i] : base[i] + m]
    return out


def kind_for(rows: np.ndarray, queries: np.ndarray) -> type:
    """The fastest number type in which every sum of products is exact."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


class Best:
    """The k best rows of one query so far: score descending, then id ascending."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int, kind: type):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, kind)

    @property
    def least(self):
        return self.scores[self.k - 1] if len(self.ids) == self.k else None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        if len(ids) > 4 * self.k + 64 and scores.dtype != object:  # only what reaches the k-th score
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
        order = order[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class Shard:
    """Rows as posting columns of one number type, ready to be searched."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type):
        self.ids, self.kind = ids, kind
        rows = as_kind(rows, kind)
        self.first = np.ascontiguousarray(rows[:FIRST])
        cuts = [*range(min(FIRST, len(rows)), len(rows), BLOCK), len(rows)]
        self.blocks = [(a, b, np.ascontiguousarray(rows[a:b].T)) for a, b in zip(cuts, cuts[1:]) if b > a]
        self.high = np.array([c.max() for c in rows.T]) if len(rows) else np.zeros(rows.shape[1], kind)
        self.low = np.array([c.min() for c in rows.T]) if len(rows) else np.zeros(rows.shape[1], kind)
        self.products = 0  # multiplications so far

    def search(self, query_id: int, query: np.ndarray, k: int, slack: float = SLACK) -> Best:
        """The exact k best rows of other ids."""
        best = Best(k, self.kind)
        q = as_kind(query[None, :], self.kind)[0]
        m = len(self.first)
        other = self.ids[:m] != query_id
        best.add(self.ids[:m][other], (self.first @ q)[other])
        self.products += self.first.size
        if not self.blocks:
            return best
        wide = object if self.kind is object else np.int64 if self.kind is np.int64 else np.float64
        bound = np.maximum(q * self.high, q * self.low).astype(wide)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bounds from each place on
        for a, b, columns in self.blocks:
            least = best.least
            essential = order if least is None or least <= 0 else order[: int(np.argmax(rest <= (least * slack if wide is np.float64 else int(least) // 2)))]
            n = len(essential)
            score = q[essential] @ columns[essential] if n else np.zeros(b - a, self.kind)
            self.products += n * (b - a)
            at = np.arange(b - a) if least is None else np.flatnonzero(score >= least - rest[n])
            score = score[at]
            while n < len(order) and len(at):  # probe the rest for what can still compete
                some = order[n : n + PROBE]
                score = score + q[some] @ columns[np.ix_(some, at)]
                self.products += len(some) * len(at)
                n += len(some)
                near = score >= least - rest[n]
                at, score = at[near], score[near]
            own = self.ids[a:b][at]
            keep = own != query_id
            if keep.any():
                best.add(own[keep], score[keep])
        return best


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, slack: float = SLACK) -> tuple[list[Best], int]:
    """Exact top k of a shard for a block of queries, and the multiplications they took."""
    shard = Shard(ids, rows, kind_for(rows, queries))
    found = [shard.search(i, q, k, slack) for i, q in zip(query_ids.tolist(), queries)]
    return found, shard.products


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k best other rows.

    Score: inner product of the impacts floor(scale * x); ties go to the smaller vec_id.

    Edge cases: rows with a null id or vector, or with a null or non-finite component, take no part; vectors of
    other lengths are compared over the common components; rows that repeat a vec_id are candidates each for
    itself, and a repeated query is asked once (its first vector in value order); a query with fewer candidates
    than k gets all; an empty table gives no rows; other columns are ignored; a score past the range of a long
    raises OverflowError.
    """
    ws = Workspace(vectors.sparkSession, "maxscore")
    rows = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    ws.save(asked, "queries")
    folder = ws.path("queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SHARD:
                yield from shard(held)
                held, n = [], 0
        if n:
            yield from shard(held)

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(held).combine_chunks()
        ids = np.asarray(data.column("vec_id"))
        vecs = data.column("x").chunk(0)
        width = int(np.diff(np.asarray(vecs.offsets)).max(initial=0))
        mine = impacts(vecs, width, scale)
        ready: dict[type, Shard] = {}
        fs, root = open_fs(folder)
        for path in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")):
            with fs.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=QUERY_BLOCK):
                    query_ids = np.asarray(batch.column("vec_id"))
                    queries = impacts(batch.column("x"), width, scale)  # dimensions that no row here has meet nothing
                    kind = kind_for(mine, queries)
                    if kind not in ready:
                        ready = {kind: Shard(ids, mine, kind)}
                    found = [ready[kind].search(i, q, k) for i, q in zip(query_ids.tolist(), queries)]
                    scores = [int(s) for f in found for s in f.scores]
                    if any(abs(s) >= 1 << 63 for s in scores):
                        raise OverflowError("a score doesn't fit a long")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(query_ids, [len(f.ids) for f in found])), pa.array(np.concatenate([f.ids for f in found]) if found else [], pa.int64()), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"]
                    )

    found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
