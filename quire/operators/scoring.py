"""Scores of many rows against blocks of queries, and the best rows a task has of each, in numpy.

For mapInArrow: a slice of rows meets each block of queries as one matrix; blocks lie in the folder that executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq

from quire.scratch import open_fs

#: Scores that are in memory at once.
CELLS = 2 << 20
#: Bytes of blocks that a task keeps; more blocks are read again for each batch.
KEPT_BYTES = 64 << 20

#: (scores, where there is one; None: everywhere): rows x queries.
Scored = tuple[np.ndarray, np.ndarray | None]


class Blocks:
    """The blocks of a folder: one for each of its files."""

    def __init__(self, uri: str, make: Callable[[pa.Table], object], kept: int = KEPT_BYTES):
        self.fs, path = open_fs(uri)
        files = [f for f in self.fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
        self.files, self.make = sorted(f.path for f in files), make
        self.kept = [self._read(f) for f in self.files] if sum(f.size for f in files) <= kept else None

    def _read(self, path: str) -> object:
        return self.make(pq.read_table(path, filesystem=self.fs))

    def __iter__(self) -> Iterator:
        return iter(self.kept) if self.kept is not None else map(self._read, self.files)


class Vectors:
    """Queries' vectors by length; null ones, and those that hold a null, score nothing."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("query_id")
        ids = table.column("query_id").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], table.schema.field("query_id").type).dictionary_encode()
        self.ids, of = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False)
        self.by_length = []
        for m, rows in matrices(table.column("embedding").combine_chunks() if table.num_rows else None):
            mine = of[rows]
            starts = np.flatnonzero(np.diff(mine, prepend=-1))
            self.by_length.append((m, starts, mine[starts]))

    def scores(self, rows: pa.RecordBatch) -> Scored:
        n, nq = rows.num_rows, len(self.ids)
        out, has = np.zeros((n, nq)), np.zeros((n, nq), bool)
        for v, at in matrices(rows.column("embedding")):
            for m, starts, queries in self.by_length:
                if m.shape[1] == v.shape[1]:
                    with np.errstate(all="ignore"):
                        p = v @ m.T
                        p = p if len(starts) == p.shape[1] else np.maximum.reduceat(p, starts, axis=1)
                    out[np.ix_(at, queries)] = p
                    has[np.ix_(at, queries)] = True
        return out, has


def matrices(column: pa.Array | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(matrix, its rows' places) for each length; rows that are null or hold a null are left out."""
    if column is None or not len(column):
        return
    lengths = pc.list_value_length(column)
    good = np.array(lengths.is_valid())
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    offsets = np.cumsum(sizes) - sizes
    if flat.null_count:
        bad = np.repeat(np.arange(len(column)), sizes)[np.array(flat.is_null())]
        good[bad] = False
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    for length in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == length))
        yield values[(offsets[at][:, None] + np.arange(length)).ravel()].reshape(len(at), length), at


class Weights:
    """Queries' token weights (query_id, tok, weight, avgdl); rows have dl and toks."""

    def __init__(self, table: pa.Table, k1: float, b: float):
        ids = table.column("query_id").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], table.schema.field("query_id").type).dictionary_encode()
        toks = table.column("tok").combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
        self.ids, self.k1, self.b = ids.dictionary, k1, b
        self.place = {t: i for i, t in enumerate(toks.dictionary.to_pylist())}
        of = toks.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        self.query, self.weight = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], table.column("weight").to_numpy()[order] if table.num_rows else np.zeros(0)
        self.starts = np.searchsorted(of[order], np.arange(len(self.place) + 1))
        self.avgdl = table.column("avgdl")[0].as_py() if table.num_rows else 1.0

    def scores(self, rows: pa.RecordBatch) -> Scored:
        n, nq = rows.num_rows, len(self.ids)
        enc = rows.column("toks").flatten().dictionary_encode()
        known = np.array([self.place.get(t, -1) for t in enc.dictionary.to_pylist()], np.int64)
        dl = pc.list_value_length(rows.column("toks")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), dl)
        tok = known[enc.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
        met = tok >= 0
        wide = max(1, len(self.place))
        key, tf = np.unique(row[met] * wide + tok[met], return_counts=True)
        r, t = key // wide, key % wide
        sat = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[r] / self.avgdl))
        each = self.starts[t + 1] - self.starts[t]
        at = np.repeat(self.starts[t] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        cell = np.repeat(r, each) * nq + self.query[at]
        out = np.bincount(cell, self.weight[at] * np.repeat(sat, each), n * nq).reshape(n, nq)
        has = np.zeros(n * nq, bool)
        has[cell] = True
        return out, has.reshape(n, nq)


def _made(kind: list[pa.Schema], key: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """A batch of the schema that the first one of the task had."""
    if not kind:
        kind.append(pa.schema(list(zip(["query_id", *key, "score"], (a.type for a in arrays)))))
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, kind[0])], schema=kind[0])


def _cut(batch: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, wide))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def every(uri: str, make: Callable[[pa.Table], object], key: list[str], sparse: bool, kept: int = KEPT_BYTES):
    """query_id, key, score of each row and query; sparse: only where there is a score, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, kind = Blocks(uri, make, kept), []
        for batch in batches:
            for block in blocks:
                for rows in _cut(batch, len(block.ids)):
                    score, has = block.scores(rows)
                    r, q = np.nonzero(has) if sparse else (x.ravel() for x in np.indices(has.shape))
                    made = pa.array(score[r, q], mask=None if sparse else ~has[r, q])
                    if len(r):
                        yield _made(kind, key, [block.ids.take(pa.array(q)), *(rows.column(k).take(pa.array(r)) for k in key), made])

    return run


def best(uri: str, make: Callable[[pa.Table], object], key: list[str], sparse: bool, pool: int, digits: int, kept: int = KEPT_BYTES):
    """Of `every`, the rows that can be among the best `pool` of a query: a task's best by rounded score, ties by key."""

    def merge(held: pa.Table | None, new: pa.Table, nq: int) -> tuple[pa.Table, np.ndarray]:
        both = new if held is None else pa.concat_tables([held, new])
        both = both.take(pc.sort_indices(both, [("__q", "ascending"), ("__o", "descending"), *((k, "ascending") for k in key)]))
        q = both.column("__q").to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        both = both.filter(pa.array(rank < pool))
        q, rank, o = q[rank < pool], rank[rank < pool], both.column("__o").to_numpy()
        least = np.full(nq, -np.inf)
        last = rank == pool - 1
        least[q[last]] = o[last]
        return both.combine_chunks(), least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held, kind = Blocks(uri, make, kept), {}, []
        for batch in batches:
            for number, block in enumerate(blocks):
                nq = len(block.ids)
                ids, (table, least) = block.ids, held.get(number, (block.ids, (None, np.full(nq, -np.inf))))[1]
                for rows in _cut(batch, nq):
                    score, has = block.scores(rows)
                    order = np.where(np.isnan(score), np.inf, np.round(score, digits))
                    order[~has] = -np.inf
                    floor = least
                    if rows.num_rows > 2 * pool and np.isneginf(least).any():
                        floor = np.maximum(least, np.partition(order, rows.num_rows - pool, axis=0)[rows.num_rows - pool])
                    r, q = np.nonzero((order >= floor) & has if sparse else order >= floor)
                    if len(r):
                        new = {"__q": pa.array(q), "__o": pa.array(order[r, q])} | {k: rows.column(k).take(pa.array(r)) for k in key} | {"score": pa.array(score[r, q], mask=~has[r, q])}
                        table, least = merge(table, pa.table(new), nq)
                held[number] = (ids, (table, least))
        for ids, (table, _) in held.values():
            if table is not None:
                for b in table.to_batches(max_chunksize=1 << 16):
                    yield _made(kind, key, [ids.take(b.column("__q")), *(b.column(k) for k in key), b.column("score")])

    return run
