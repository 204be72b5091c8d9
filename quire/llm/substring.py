"""Removal of word windows that repeat anywhere in the corpus, with a count-min prefilter.

The corpus is written once as part files of bounded size; every later pass maps over these files, so all passes
see the same windows in the same order whatever is recomputed.

1. Sketch. Each part sends, for every sketch row, which counters its windows touch (sorted, Elias-Fano coded, with
   one bit for "more than once here"). A sketch is cut into ranges of counters; the task that merges a range adds
   the parts' counters, saturating at 2, and answers each part with one bit per counter it touched. No task holds
   a whole sketch. A counter never underestimates, so a window with a counter below 2 is unique: nothing is lost.
2. Exact. Each part sends the 128-bit fingerprints of the windows whose counters all reached 2. Ranges of
   fingerprints are grouped, and each part is answered with one bit per fingerprint.
3. Removal. Words covered by a repeated window go; the rest, joined by one space, stay.

Documents of one word sequence are copies: one of them stands for all in passes 1 and 2 (their every window
repeats), so a large group of copies costs one document. Two different windows are taken for equal only if both
of their 64-bit polynomial hashes agree, which rest on different hashes of the words.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, open_fs, slices, texts
from .words import WordIds, hash_words, ranges, split_words

PART_BYTES = 12 << 20
RANGE_BITS = 24
ADDED = ("n_words", "n_removed", "kept_sha256")
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, window: int) -> list[np.ndarray]:
    """Two hashes of every window of `window` words inside each document, in order, from two independent hashes of each word."""
    n = len(words[0])
    starts = ranges(offsets[:-1], np.maximum(np.diff(offsets) - window + 1, 0))
    out = []
    for h, base in zip(words, BASES):
        power, inverse = powers(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power[:n], out=sums[1:])
        out.append(mixed((sums[starts + window] - sums[starts]) * inverse[starts]))
    return out


def part_windows(uri: str, skip: set[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of all windows of a part file, without the rows in skip."""
    fs, path = open_fs(uri)
    found: list[list[np.ndarray]] = []
    ids = WordIds(hash_words)
    with fs.open_input_file(path) as source:
        row = 0
        for batch in pq.ParquetFile(source).iter_batches(batch_size=4096, columns=["text"]):
            for part in slices(batch, "text"):
                keep = np.array([row + i not in skip for i in range(part.num_rows)])
                row += part.num_rows
                flat, offsets = split_words(part.column("text").filter(pa.array(keep)))
                codes, hashes = ids(flat)
                both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
                found.append(window_hashes((both[codes, 0], both[codes, 1]), offsets, window))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def ef_pack(values: np.ndarray, flags: np.ndarray, width_bits: int) -> bytes:
    """Sorted distinct numbers below 2^width_bits and one flag each, Elias-Fano coded."""
    n = len(values)
    low_bits = 8 if width_bits - max(1, n).bit_length() < 12 else 16
    low = values.astype(np.uint8 if low_bits == 8 else np.uint16)
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, bool)
    bits[high] = True
    return struct.pack("<IB", n, low_bits) + low.tobytes() + np.packbits(flags).tobytes() + np.packbits(bits).tobytes()


def ef_unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, low_bits = struct.unpack_from("<IB", data)
    at, kind = 5, np.uint8 if low_bits == 8 else np.uint16
    low = np.frombuffer(data[at : (at := at + n * low_bits // 8)], kind).astype(np.int64)
    flags = np.unpackbits(np.frombuffer(data[at : (at := at + (n + 7) // 8)], np.uint8), count=n)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data[at:], np.uint8)))[:n] - np.arange(n)
    return (high << low_bits) + low, flags


def distinct(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where a new key starts in it."""
    order = np.lexsort((*more[::-1], keys)) if more else np.argsort(keys)
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in (keys, *more)], axis=0)
    return order, new


def bits_to_range(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def write_parts(docs: DataFrame, folder: str, window: int) -> DataFrame:
    """Write all columns of docs as part files; a row for each document: part, path, row, n_words, h1, h2."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        fs, root = open_fs(folder)
        out, held, row, path = None, 0, 0, ""
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    path = f"{folder}/part-{task:06d}-{k:04d}-{uuid.uuid4().hex[:12]}.parquet"
                    out, held, row = pq.ParquetWriter(fs.open_output_stream(open_fs(path)[1]), part.schema, compression="zstd"), 0, 0
                out.write_batch(part)
                split = [t.split() for t in texts(part.column("text"))]
                sums = [xxhash.xxh3_128_digest(b" ".join(w)) for w in split]
                n = part.num_rows
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(n, (task << 20) + k, np.int64)), "path": pa.array([path] * n), "row": pa.array(np.arange(row, row + n), pa.int64()),
                    "n_words": pa.array([len(w) for w in split], pa.int64()),
                    "h1": pa.array([struct.unpack("<q", s[:8])[0] for s in sums], pa.int64()), "h2": pa.array([struct.unpack("<q", s[8:])[0] for s in sums], pa.int64()),
                })
                held += part.nbytes
                row += n
                if held >= PART_BYTES:
                    out.close()
                    out, k = None, k + 1
        if out is not None:
            out.close()

    return docs.mapInArrow(write, "part long, path string, row long, n_words long, h1 long, h2 long")


def remove_repeats(docs: DataFrame, window: int = 35, depth: int = 2, counters: int = 4) -> DataFrame:
    """Remove every word covered by a `window`-word sequence that starts anywhere else in the corpus too.

    The text becomes the kept words joined by one space; n_words, n_removed and kept_sha256 (hex SHA-256 of the
    new text) are added, in place of input columns of these names; all other columns are kept. The sketch has
    `depth` rows of at least `counters` counters a window.

    Edge cases: a null text has no words and becomes empty; texts shorter than a window keep all words; repeated
    rows and equal texts are copies of each other, so their windows repeat; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED).withColumn("text", F.col("text").cast("string"))
    ws = Workspace(spark, "substring")
    index = ws.save(write_parts(docs, ws.folder("parts"), window), "index")
    counts = index.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("part", "row")).alias("first")).where("n > 1")
    copies = index.join(counts, ["h1", "h2"]).select("part", "row", (F.struct("part", "row") != F.col("first")).alias("again"))
    copied = copies.groupBy("part").agg(F.collect_list("row").alias("copies"), F.collect_list(F.when(F.col("again"), F.col("row"))).alias("skip"))
    empty = F.array().cast("array<bigint>")
    parts = index.groupBy("part", "path").agg(F.sum(F.greatest(F.col("n_words") - (window - 1), F.lit(0))).alias("windows"))
    parts = ws.save(parts.join(copied, "part", "left").withColumns({c: F.coalesce(c, empty) for c in ("copies", "skip")}), "tasks")
    total, n_parts = parts.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.count("*")).first()
    width_bits = max(16, int(counters * max(1, total) - 1).bit_length())
    range_bits = min(RANGE_BITS, width_bits)
    top_bits = width_bits - range_bits

    def spread(df: DataFrame) -> DataFrame:
        return df.repartitionByRange(max(1, n_parts), "part")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _rows(batches):
            hashes = part_windows(task["path"], set(task["skip"]), window)
            for d in range(depth):
                at = np.sort(_counter(hashes, d, width_bits))
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                begin = np.flatnonzero(new)
                once = at[begin]
                twice = np.diff(np.append(begin, len(at))) > 1
                del at, new
                cut = np.searchsorted(once >> np.uint64(range_bits), np.arange((1 << top_bits) + 1, dtype=np.uint64))
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    a, b = int(cut[r]), int(cut[r + 1])
                    own = once[a:b] & np.uint64((1 << range_bits) - 1)
                    yield _sent(task["part"], d, r, ef_pack(own, twice[a:b], range_bits))

    def merge(group: pa.Table) -> pa.Table:
        counter = np.zeros(1 << range_bits, np.uint8)
        blobs = [ef_unpack(x.as_py()) for x in group.column("data")]
        for at, twice in blobs:
            counter[at] = np.minimum(counter[at] + 1 + twice, 2)
        return _answer(group, [counter[at] > 1 for at, _ in blobs])

    touched = spread(parts.select("part", "path", "skip")).mapInArrow(sketch, _SENT)
    answers = ws.save(touched.groupBy("d", "r").applyInArrow(merge, _SENT), "counted")
    told = answers.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("d", "r", "data"))).alias("told"))
    side = ws.folder("survivors")
    key_bits = max(0, min(top_bits, 24))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _rows(batches):
            hashes = part_windows(task["path"], set(task["skip"]), window)
            alive = np.ones(len(hashes[0]), bool)
            for d in range(depth):
                order, new = distinct(_counter(hashes, d, width_bits))
                rank = np.cumsum(new) - 1
                once = _counter(hashes, d, width_bits)[order[new]]
                cut = np.searchsorted(once >> np.uint64(range_bits), np.arange((1 << top_bits) + 1, dtype=np.uint64))
                seen = np.zeros(len(once), bool)
                for t in task["told"] or []:
                    if t["d"] == d:
                        a, b = int(cut[t["r"]]), int(cut[t["r"] + 1])
                        seen[a:b] = np.unpackbits(np.frombuffer(t["data"], np.uint8), count=b - a).astype(bool)
                alive[order] &= seen[rank]
            place = np.flatnonzero(alive)
            a, b = hashes[0][place], hashes[1][place]
            del hashes, alive
            order, new = distinct(a, b)
            _write_side(side, task["part"], place[order], new)
            begin = np.flatnonzero(new)
            a, b = a[order[begin]], b[order[begin]]
            twice = np.diff(np.append(begin, len(order))) > 1
            cut = np.searchsorted(a >> np.uint64(40), np.arange((1 << key_bits) + 1, dtype=np.uint64) << np.uint64(24 - key_bits))
            for r in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(int(cut[r]), int(cut[r + 1]))
                yield _sent(task["part"], 0, r, a[own].tobytes() + b[own].tobytes() + np.packbits(twice[own]).tobytes(), own.stop - own.start)

    def group(rows: pa.Table) -> pa.Table:
        firsts, seconds, flags, sizes = [], [], [], rows.column("n").to_pylist()
        for x, n in zip(rows.column("data"), sizes):
            x = x.as_py()
            firsts.append(np.frombuffer(x, np.uint64, n))
            seconds.append(np.frombuffer(x, np.uint64, n, 8 * n))
            flags.append(np.unpackbits(np.frombuffer(x, np.uint8, offset=16 * n), count=n).astype(bool))
        a, b, repeated = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(flags)
        order, new = distinct(a, b)
        several = ~new
        several[:-1] |= ~new[1:]
        repeated[order] |= several
        # one part's own mark holds for every other part with that window: those have it as a neighbour here
        return _answer(rows, np.split(repeated, np.cumsum(sizes)[:-1]))

    asked = spread(parts.select("part", "path", "skip").join(told, "part", "left")).mapInArrow(survivors, _SENT)
    exact = ws.save(asked.groupBy("r").applyInArrow(group, _SENT), "grouped")
    known = exact.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("r", "n", "data"))).alias("told"))
    names = docs.columns
    schema = docs.schema.simpleString()[7:-1] + ", n_words: bigint, n_removed: bigint, kept_sha256: string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _rows(batches):
            place, new = _read_side(side, task["part"])
            seen = [np.unpackbits(np.frombuffer(t["data"], np.uint8), count=t["n"]) for t in task["told"] or []]
            seen = np.concatenate(seen).astype(bool) if seen else np.zeros(0, bool)
            repeated = np.sort(place[seen[np.cumsum(new) - 1]]) if len(place) else place
            copies, skip = set(task["copies"]), set(task["skip"])
            row, first = 0, 0  # first: windows of this part before this document
            fs, path = open_fs(task["path"])
            with fs.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1024):
                    for part in slices(batch, "text"):
                        kept, n_words, n_removed = [], [], []
                        for words in (t.split() for t in texts(part.column("text"))):
                            n, cut = len(words), 0
                            m = max(0, n - window + 1)
                            if row in copies:
                                cut, words = (n, []) if m else (0, words)
                            elif m:
                                at = repeated[np.searchsorted(repeated, first) : np.searchsorted(repeated, first + m)] - first
                                if len(at):
                                    cover = np.zeros(n + 1, np.int64)
                                    np.add.at(cover, at, 1)
                                    np.add.at(cover, at + window, -1)
                                    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
                                    cut, words = n - len(stay), [words[i] for i in stay]
                            if row not in skip:
                                first += m
                            row += 1
                            kept.append(b" ".join(words))
                            n_words.append(n)
                            n_removed.append(cut)
                        columns = {c: part.column(c) for c in names} | {"text": pa.array(kept, pa.binary()).cast(pa.string())}
                        columns |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
                        yield pa.RecordBatch.from_pydict(columns)

    return spread(parts.select("part", "path", "skip", "copies").join(known, "part", "left")).mapInArrow(remove, schema)


_SENT = "part long, d int, r long, n long, data binary"


def _sent(part: int, d: int, r: int, data: bytes, n: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([d], pa.int32()), pa.array([r], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "d", "r", "n", "data"])


def _answer(group: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    kept = {c: group.column(c) for c in ("part", "d", "r")}
    return pa.table(kept | {"n": pa.array([len(b) for b in bits], pa.int64()), "data": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _counter(hashes: tuple[np.ndarray, np.ndarray], d: int, width_bits: int) -> np.ndarray:
    """Counter numbers of the windows in sketch row d."""
    h = hashes[0] + np.uint64(d) * hashes[1]
    return (h if d < 2 else mixed(h)) >> np.uint64(64 - width_bits)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _write_side(folder: str, part: int, place: np.ndarray, new: np.ndarray) -> None:
    """Where a part's surviving windows are; a task that runs again writes the same bytes."""
    fs, root = open_fs(folder)
    temporary = f"{root}/{part}-{uuid.uuid4().hex[:12]}"
    with fs.open_output_stream(temporary) as out:
        out.write(struct.pack("<Q", len(place)) + place.astype("<u4").tobytes() + np.packbits(new).tobytes())
    fs.move(temporary, f"{root}/{part}.bin")


def _read_side(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    fs, root = open_fs(folder)
    with fs.open_input_file(f"{root}/{part}.bin") as source:
        data = source.read()
    (n,) = struct.unpack_from("<Q", data)
    return np.frombuffer(data, "<u4", n, 8).astype(np.int64), np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 4 * n), count=n).astype(bool)
