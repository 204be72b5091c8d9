"""SimHash near-duplicates, found with pivot distance tables.

A fingerprint has a bit set where over half of the shingles' 64-bit hashes have it. Fingerprints within `bits`
differing bits link, and documents fall into the components of these links. Equal fingerprints are one node, so
thousands of copies cost one row.

Pairs are reached without comparing all: cut the 64 bits in B blocks; two fingerprints within k bits agree on at
least B - k blocks, so they meet under one of the C(B, k) keys made of B - k whole blocks. Under a key, rows are
sorted by the distance to the first pivot and compared along that order only while these distances differ by at
most k. A pair whose tables of distances to the pivots differ by more than k anywhere is discarded (the triangle
inequality allows it); survivors are verified. A key that holds very many fingerprints is split into tiles, and
tiles meet in pairs, so one task never holds more than two tiles. B grows with the number of fingerprints, to
keep keys small; every B is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Workspace, slices, tasks_of, texts
from .components import components

PIVOTS = 16
TILE = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 of all word shingles, repeats included; no words: zero."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    m = n - shingle + 1
    pieces = map(joined.__getitem__, map(slice, starts[:m].tolist(), ends[shingle - 1 :].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, m)
    votes = np.zeros(64, np.int64)
    for k in range(0, m, 1 << 15):
        part = h[k : k + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): each document's fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([fingerprint(t, shingle, seed) for t in texts(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, as signed numbers."""
    made = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(n)], np.uint64)
    return made.view(np.int64).tolist()


def near_pairs(fps: DataFrame, ws: Workspace, bits: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints (column fp) that differ in 1 to `bits` bits."""
    spark = fps.sparkSession
    table = ws.save(fps.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()]).alias("far")), "pivots")
    count = table.count()
    blocks = bits + 1
    while blocks < bits + 3 and count > 1 << (64 * (blocks - bits) // blocks + 6):  # over 64 rows a key, on average
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - bits)]
    signed = np.array(chosen, np.uint64).view(np.int64).tolist()
    keyed = table.select("fp", "far", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("key", "bits"))
    hot = keyed.groupBy("key", "bits").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    hot = hot.select("key", "bits", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    tiled = keyed.join(hot, ["key", "bits"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = tiled.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = own.select("*", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    met = met.select("key", "bits", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own", "fp", "far", F.element_at("far", 1).alias("d"))
    by = ["key", "bits", "t", "u"]
    ordered = met.repartition(tasks_of(spark, fps), *by).sortWithinPartitions(*by, "d", "fp")
    masks_of = np.array(chosen, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            names = [np.asarray(now.column(c)) for c in by]
            new = np.any([x[1:] != x[:-1] for x in names], axis=0)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if last:
                yield compare(now.slice(0, last))
            held = now.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield compare(held)

    def compare(rows: pa.Table) -> pa.RecordBatch:
        fp = np.asarray(rows.column("fp")).view(np.uint64)
        key, t, u, own = (np.asarray(rows.column(c)) for c in ("key", "t", "u", "own"))
        group = np.concatenate(([0], np.cumsum(np.any([np.asarray(rows.column(c))[1:] != np.asarray(rows.column(c))[:-1] for c in by], axis=0))))
        far = np.asarray(rows.column("far").combine_chunks().flatten()).reshape(-1, PIVOTS).astype(np.int16)
        found_a, found_b = [], []
        i, s, n = np.arange(len(fp)), 1, len(fp)
        while len(i):
            i = i[i + s < n]
            j = i + s
            live = (group[i] == group[j]) & (far[j, 0] - far[i, 0] <= bits)  # sorted by it: no later row can do
            i, j = i[live], j[live]
            cross = (t[i] == u[i]) | (own[i] != own[j])
            a, b = i[cross], j[cross]
            near = np.abs(far[a] - far[b]).max(axis=1, initial=0) <= bits
            a, b = a[near], b[near]
            x = fp[a] ^ fp[b]
            ok = np.bitwise_count(x) <= bits
            a, b, x = a[ok], b[ok], x[ok]
            # the first key on which the two agree reports them
            first = np.argmax((x[:, None] & masks_of[None, :]) == 0, axis=1) if len(x) else np.zeros(0, np.int64)
            mine = first == key[a]
            found_a.append(fp[a[mine]])
            found_b.append(fp[b[mine]])
            s += 1
        a = np.concatenate(found_a or [np.zeros(0, np.uint64)]).view(np.int64)
        b = np.concatenate(found_b or [np.zeros(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, bits: int, shingle: int, seed: int) -> DataFrame:
    """One row per document: doc_id, fp, component (a fingerprint of it, the same for all its rows), component_id."""
    ws = Workspace(docs.sparkSession, "simhash")
    own = ws.save(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = ws.save(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = ws.save(near_pairs(nodes, ws, bits), "links")
    reached = components(links, ws).withColumnRenamed("node", "fp")
    # only fingerprints with links need more than their own smallest document
    linked = nodes.join(reached, "fp")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_low"))
    other = linked.join(lows, "component").select("fp", "component", "component_low")
    label = nodes.join(other, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_low", "low").alias("component_id"))
    return own.join(label, "fp").select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Edge cases: a null or empty text has fingerprint zero and links like any other; equal texts share a
    fingerprint; a null doc_id gets a row and, when alone, a null component; an empty table gives no rows; other
    columns are ignored.
    """
    found = labelled(docs, bits, shingle, seed)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """All columns of the documents, and __fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts(part.column("text"))), np.uint64, part.num_rows)
                yield part.append_column("__fp", pa.array(fps.view(np.int64)))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__fp", LongType())]))


def one_of_each(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id.

    Where a doc_id repeats, rows count one by one: a component that has several rows of its smallest doc_id keeps the
    one with the smallest text hash, and different texts of one doc_id stay in their own components. A null doc_id
    can't be compared with others and stays.
    """
    ws = Workspace(docs.sparkSession, "one-of-each")
    found = ws.save(labelled(docs, bits, shingle, seed), "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    many = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = many.limit(1).count() > 0
    if repeated:
        many = ws.save(many, "many")
        gone = gone.unionByName(many).distinct()
    # merged, not broadcast while small: the plan is the same at every size
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if repeated:
        # (doc_id, fp) names a row's component; equal ids in one component are told apart by their texts
        lows = found.where("doc_id = component_id").select("doc_id", F.col("fp").alias("__fp"), F.col("component").alias("__component")).join(many, "doc_id", "left_semi").distinct()
        rows = with_fingerprint(docs.join(many.hint("merge"), "doc_id", "left_semi").select(*docs.columns), shingle, seed)
        row = F.struct(F.sha2("text", 256).alias("text_hash"), *[F.col(c) for c in docs.columns])
        first = rows.join(lows, ["doc_id", "__fp"]).groupBy("__component").agg(F.min(row).alias("row"))
        kept = kept.unionByName(first.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    return kept
