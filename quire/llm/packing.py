"""Best-fit packing of tokenised documents into sequences: best-two-fit.

Only lengths decide how documents share a sequence, so the plan is made on the histogram of lengths, whose size
is bounded by the sequence length and not by the corpus. A bin is filled greedily with the longest lengths that
still fit; then its shortest document gives way to two unpacked ones whenever two fit the widened gap more
tightly. The same bin is repeated while the histogram lasts. Pieces then take the plan's places by their rank
within their length, which is a sum of per-task counts: no length, however common, is gathered anywhere.

Edge cases: a null or empty text is one piece holding only the end id; a document longer than a sequence is cut
into full pieces and a last one; equal documents and repeated rows are packed once per row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import default_path, encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def best_two_fit(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] documents of each length: (how many such bins, [(length, documents of it)]).

    Every bin's lengths sum to at most size, and every document is in exactly one bin.
    """
    left = np.array(counts, np.int64)
    avail = np.flatnonzero(left).tolist()  # lengths still there, ascending
    plan = []

    def longest(most: int, used: dict[int, int]) -> int:
        """The longest length up to `most` of which some document is neither packed nor in this bin."""
        i = bisect_right(avail, most) - 1
        while i >= 0 and left[avail[i]] <= used.get(avail[i], 0):
            i -= 1
        return avail[i] if i >= 0 else 0

    while avail:
        used: dict[int, int] = {}
        gap = size
        while gap > 0 and (x := longest(gap, used)):
            n = max(1, min(int(left[x]) - used.get(x, 0), gap // x))
            used[x] = used.get(x, 0) + n
            gap -= n * x
        if gap > 0 and used:
            small = min(used)
            room = gap + small
            a = np.array(avail[: bisect_right(avail, room)], np.int64)
            free = left[a] - np.array([used.get(int(x), 0) for x in a]) + (a == small)
            a = a[(free > 0) & (a <= room // 2)]
            if len(a):
                pool = np.array([x for x in avail if x <= room and left[x] > used.get(x, 0)], np.int64)
                if len(pool):
                    at = np.searchsorted(pool, room - a, side="right") - 1
                    b = np.where(at >= 0, pool[np.maximum(at, 0)], 0)
                    twice = (a == b) & (left[a] - np.array([used.get(int(x), 0) for x in a]) < 2)
                    taken = left[a] <= np.array([used.get(int(x), 0) for x in a])
                    total = np.where((b > 0) & ~twice & ~taken, a + b, 0)
                    k = int(np.argmax(total))
                    if total[k] > small:
                        used[small] -= 1
                        for x in (int(a[k]), int(b[k])):
                            used[x] = used.get(x, 0) + 1
        used = {x: n for x, n in used.items() if n}
        times = min(int(left[x]) // n for x, n in used.items())
        plan.append((times, sorted(used.items(), reverse=True)))
        for x, n in used.items():
            left[x] -= times * n
            if not left[x]:
                avail.pop(bisect_right(avail, x) - 1)
    return plan


def pieces(docs: DataFrame, size: int, end_id: int, path: str) -> DataFrame:
    """Pieces of every document with their ids' checksum; nth is the rank within length and task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), np.uint32(end_id)
        for batch, ids, offsets in encoded(batches, path):
            rows = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[a:b], end).astype("<u4")
                for k, at in enumerate(range(0, len(own), size)):
                    x = own[at : at + size]
                    rows.append((doc, k, at, len(x), zlib.crc32(x), part, int(seen[len(x)])))
                    seen[len(x)] += 1
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `size` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces of a
    sequence follow each other from offset 0 without gaps.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    cut = ws.save(pieces(docs, size, end_id, tokenizer or default_path()), "pieces")
    tally = ws.save(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "tally")
    counts = np.zeros(size + 1, np.int64)
    for length, n in tally.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        counts[length] = n
    # Each run of places: `times` bins from `first`, each with `each` documents of this length from `base` on.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = np.zeros(size + 1, np.int64), 0
    for times, members in best_two_fit(counts, size):
        base = 0
        for length, each in members:
            runs.setdefault(length, []).append((int(taken[length]), sequence, each, base))
            taken[length] += times * each
            base += each * length
        sequence += times
    assert (taken == counts).all(), "the plan must place every piece"
    packed = {k: np.array(v, np.int64) for k, v in runs.items()}
    plan = spark.sparkContext.broadcast(packed)  # at most 2 * size bins of at most sqrt(2 * size) lengths each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                table = plan.value[int(x)]
                r = rank[own]
                k = np.searchsorted(table[:, 0], r, side="right") - 1
                start, first, each, base = table[k].T
                seq[own] = first + (r - start) // each
                off[own] = base + (r - start) % each * x
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
