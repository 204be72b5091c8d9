"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors are one row with a count, however many copies there are. Rows are normalised and rotated onto the
principal axes (a 2-d second-moment sum is all the driver sees), range-ordered along the first axis and written
as tile files. A tile pair is skipped when the tiles' boxes on the leading axes are further apart than two
vectors at the threshold can be. Otherwise products are accumulated over the leading axes first; with each row's
suffix norm as one more column, a single matrix product gives the partial product plus the bound on what the
rest can add. Pairs whose bound stays below the threshold stop there; the others go on with further axes, and
survivors are verified in double precision on the original vectors.

Each tile is compared with the following half of the ring of tiles, so every pair of tiles meets once; a task
holds two tiles at a time and reads them from the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, open_fs
from .components import components

TILE = 2048
LEAD = 16
BOX = 8
MARGIN = 1e-4  # for 32-bit partial products


def usable() -> F.Column:
    """Whether `embedding` can link: not null, not zero, all components there and finite. Never null."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def dense(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(rows: DataFrame, dim: int) -> np.ndarray:
    """Axes as columns, by falling variance, of the normalised rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit(dense(batch.column("embedding")))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["k", "v"])

    total = np.zeros(dim * dim)
    for k, v in rows.select("embedding").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v")).collect():  # dim * dim rows
        total[k] = v
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


def write_tiles(rows: DataFrame, folder: str, axes: np.ndarray) -> DataFrame:
    """Write tile files in the order of the first axis: a row for each with its place, size and box."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = unit(dense(batch.column("embedding"))) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding").cast(pa.list_(pa.float64())), pa.array(lead)], names=["id", "embedding", "lead"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0
        fs, root = open_fs(folder)

        def flush(data: pa.Table, k: int) -> pa.RecordBatch:
            x = dense(data.column("embedding").combine_chunks())
            y = unit(x) @ axes[:, :BOX]
            name = f"{part:06d}-{k:06d}-{uuid.uuid4().hex[:12]}.parquet"
            pq.write_table(data.select(["id", "embedding"]), f"{root}/{name}", filesystem=fs)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "k": pa.array([k], pa.int64()), "path": [f"{folder}/{name}"], "low": pa.array([y.min(axis=0).tolist()], pa.list_(pa.float64())), "high": pa.array([y.max(axis=0).tolist()], pa.list_(pa.float64()))})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= TILE:
                data = pa.Table.from_batches(held).combine_chunks()
                yield flush(data.slice(0, TILE), k)
                k, held, n = k + 1, data.slice(TILE).to_batches(), n - TILE
        if n:
            yield flush(pa.Table.from_batches(held).combine_chunks(), k)

    ordered = rows.select("id", "embedding").mapInArrow(place, "id long, embedding array<double>, lead double")
    n = max(1, rows.count() // (4 * TILE))
    ordered = ordered.repartitionByRange(n, "lead", "id").sortWithinPartitions("lead", "id")
    return ordered.mapInArrow(write, "part long, k long, path string, low array<double>, high array<double>")


class Tile:
    """A tile ready for comparison: originals, rotated rows, suffix norms where accumulation may stop."""

    def __init__(self, uri: str, axes: np.ndarray):
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as source:
            data = pq.read_table(source)
        self.id = np.asarray(data.column("id"))
        self.x = dense(data.column("embedding").combine_chunks())
        self.norm = np.linalg.norm(self.x, axis=1)
        self.y = (unit(self.x) @ axes).astype(np.float32)
        dim = self.y.shape[1]
        self.cuts = sorted({min(LEAD, dim), min(2 * LEAD, dim), dim})
        squares = np.cumsum(self.y[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
        self.rest = {c: np.sqrt(squares[:, c]).astype(np.float32) if c < dim else np.zeros(len(self.id), np.float32) for c in self.cuts}
        self.first = np.hstack([self.y[:, : self.cuts[0]], self.rest[self.cuts[0]][:, None]])


def compare(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a and b with cosine at the threshold or above; each pair once when a is b."""
    least = np.float32(threshold - MARGIN)
    bound = a.first @ b.first.T  # partial product plus the product of suffix norms
    i, j = np.nonzero(bound >= least)
    if same:
        i, j = i[i < j], j[i < j]
    for cut in a.cuts[1:]:
        if not len(i):
            break
        keep_i, keep_j = [], []
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            whole = np.einsum("ij,ij->i", a.y[p, :cut], b.y[q, :cut]) + a.rest[cut][p] * b.rest[cut][q]
            live = whole >= least
            keep_i.append(p[live])
            keep_j.append(q[live])
        i, j = np.concatenate(keep_i), np.concatenate(keep_j)
    if len(i):
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good[at : at + (1 << 16)] = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q]) >= threshold
        i, j = i[good], j[good]
    return a.id[i], b.id[j]


def links(rows: DataFrame, ws: Workspace, dim: int, threshold: float, name: str) -> DataFrame:
    """Links (a, b) between different rows (id, embedding of `dim` components) at the threshold or above."""
    axes = principal_axes(rows, dim)
    tiles = ws.save(write_tiles(rows, ws.folder(f"tiles-{name}"), axes), f"manifest-{name}")
    count, folder = tiles.count(), ws.path(f"manifest-{name}")
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if listed is None:
                    fs, root = open_fs(folder)
                    listed = pq.read_table(root, filesystem=fs).sort_by([("part", "ascending"), ("k", "ascending")])
                    paths = listed.column("path").to_pylist()
                    low, high = dense(listed.column("low").combine_chunks()), dense(listed.column("high").combine_chunks())
                me, n = paths.index(path), len(paths)
                own = Tile(path, axes)
                for step in range(n // 2 + 1):
                    other = (me + step) % n
                    if step and 2 * step == n and me > other:
                        continue  # the opposite tile meets this one from its side
                    gap = np.maximum(0, np.maximum(low[me] - high[other], low[other] - high[me]))
                    if np.sqrt((gap**2).sum()) > reach:
                        continue
                    a, b = compare(own, own if not step else Tile(paths[other], axes), threshold, not step)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return ws.save(tiles.repartitionByRange(max(1, count), "part", "k").select("path").mapInArrow(run, "a long, b long"), f"links-{name}")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Links join vectors with cosine at the threshold or above, in double precision, whatever their labels;
    component_id is the smallest vec_id reachable by links, itself included; kept = (vec_id = component_id).

    Edge cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing, and
    so do vectors of different lengths with each other; equal vectors and repeated rows link with each other; a
    row is a vector of its own whatever its vec_id, so different vectors of one vec_id are linked only by their
    cosines; a null vec_id gets a row, and its links are counted; a group of null ids has a null component; an empty
    table gives no rows; other columns are ignored.
    """
    ws = Workspace(vectors.sparkSession, "vectors")
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = base.where(usable())
    # A number for each distinct vector, fixed once written; a vec_id is only a label, as vectors may share it.
    grouped = rows.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = ws.save(grouped.select(F.monotonically_increasing_id().alias("id"), "low", "copies", "embedding", F.size("embedding").alias("dim")), "distinct")
    dims = [r[0] for r in reps.select("dim").distinct().collect()]  # a handful of lengths
    found = [links(reps.where(F.col("dim") == d), ws, d, threshold, str(d)) for d in dims]
    if not found:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    weight = reps.select("id", "copies")
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(weight, both["b"] == weight["id"]).groupBy("a").agg(F.sum("copies").alias("near"))
    node = components(pairs, ws).withColumnRenamed("node", "id")
    named = reps.select("id", "low").join(node, "id")
    lows = named.groupBy("component").agg(F.min("low").alias("component_low"))
    named = named.join(lows, "component").select("id", "component_low")
    full = reps.join(near.withColumnRenamed("a", "id"), "id", "left").join(named, "id", "left")
    full = full.select("embedding", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"))
    linked = rows.join(full, "embedding").select("vec_id", "n_links", "component_id")
    alone = base.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
