"""Token files under static range asymmetric numeral systems (rANS).

File: segments one after another, then a JSON index, its length (8 bytes) and a magic word. A segment holds up to
SEGMENT ids and starts with its frequency table, which all its blocks share. A block holds up to BLOCK ids and is
coded by itself: id i goes to lane i mod lanes, all lanes step together (one numpy operation a step), and lanes
emit 32-bit words into one stream. The index keeps each block's place, id count and CRC-32, the document ends
(ids before them), and checkpoints: the lane states and the word position every CHECKPOINT steps, from which a
decoder may start inside a block. So files, blocks and parts of blocks decode independently.

Frequencies are scaled to 2^20 with every id that occurs at 1 or more. Lane states stay in [2^31, 2^63).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, open_fs, tasks_of
from .tokens import default_path, encoded

BITS = 20
LANES = 1024
BLOCK = 1 << 18
SEGMENT = 1 << 22
CHECKPOINT = 128
#: Ids that a reading task takes, about.
SPAN = 1 << 22
MAGIC = b"QRANS001"
LOW = np.uint64(1 << 31)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, 1 at least for each id that occurs."""
    total, whole = int(counts.sum()), 1 << BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * whole // total), 0).astype(np.int64)
    rest = whole - int(freq.sum())
    if rest > 0:
        freq[int(np.argmax(freq))] += rest
    while rest < 0:  # many rare ids: take from the most frequent
        order = np.argsort(-freq, kind="stable")[: max(1, min(len(freq), -rest))]
        order = order[freq[order] > 1]
        cut = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -rest // whole))
        cut = np.where(np.cumsum(cut) <= -rest, cut, 0)
        if not cut.any():
            cut[0] = min(int(freq[order[0]]) - 1, -rest)
        freq[order] -= cut
        rest += int(cut.sum())
    return freq


class Table:
    """A frequency table ready for coding."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.base = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts).astype(np.uint32)
        return cls(symbols, scaled(counts[symbols]))

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[Table, int]:
        (n,) = struct.unpack_from("<I", data)
        symbols = np.frombuffer(data, "<u4", n, 4)
        return cls(symbols, np.frombuffer(data, "<u4", n, 4 + 4 * n)), 4 + 8 * n

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))


def encode_block(coded: np.ndarray, table: Table) -> tuple[bytes, list[tuple[int, int]], bytes]:
    """Symbol numbers to (lane states and words, checkpoints as (step, word position), states at these)."""
    n = len(coded)
    lanes = min(LANES, n)
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    shift32, bits, up = np.uint64(32), np.uint64(BITS), np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        s = coded[step * lanes : (step + 1) * lanes]
        f, b = table.freq[s], table.base[s]
        own = x[: len(s)]
        full = own >= (f << up)
        if full.any():
            words.append(own[full].astype(np.uint32))
            own = np.where(full, own >> shift32, own)
        else:
            words.append(np.zeros(0, np.uint32))
        q = own // f
        x[: len(s)] = (q << bits) + (own - q * f) + b
        if step and step % CHECKPOINT == 0:
            marks.append((step, x.copy()))
    words.reverse()
    sizes = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    marks.reverse()
    stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
    body = struct.pack("<I", lanes) + x.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
    return body, [(k, int(sizes[k])) for k, _ in marks], b"".join(m.astype("<u8").tobytes() for _, m in marks)


def decode_block(body: memoryview, n: int, table: Table, slots: np.ndarray, start: tuple[int, int, np.ndarray] | None = None) -> np.ndarray:
    """The first n ids of a block, or those of them from a checkpoint (step, word position, states) on."""
    (lanes,) = struct.unpack_from("<I", body)
    x = np.frombuffer(body, "<u8", lanes, 4).copy()
    stream = np.frombuffer(body, "<u4", offset=4 + 8 * lanes)
    step, at = 0, 0
    if start:
        step, at, x = start[0], start[1], start[2].copy()
    out = np.empty(n - step * lanes, np.int32)
    mask, bits, shift32, done = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), 0
    while done < len(out):
        m = min(lanes, len(out) - done)
        own = x[:m]
        slot = own & mask
        s = slots[slot.astype(np.int64)]
        out[done : done + m] = s
        own = table.freq[s] * (own >> bits) + slot - table.base[s]
        low = own < LOW
        k = int(np.count_nonzero(low))
        if k:
            own[low] = (own[low] << shift32) | stream[at : at + k].astype(np.uint64)
            at += k
        x[:m] = own
        done += m
    return table.symbols[out]


class Writer:
    """Writes a token file; documents come in order."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.buffer: list[np.ndarray] = []
        self.held, self.total = 0, 0
        self.segments: list[dict] = []
        self.docs, self.ends = [], []

    def add(self, ids: np.ndarray, docs: list, lengths: list[int]) -> None:
        """Ids of some documents, one after another."""
        self.docs += docs
        self.ends += (self.total + np.cumsum(lengths)).tolist()
        self.total += len(ids)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= SEGMENT:
            held = np.concatenate(self.buffer)
            whole = len(held) // SEGMENT * SEGMENT
            for k in range(0, whole, SEGMENT):
                self.segment(held[k : k + SEGMENT])
            self.buffer, self.held = [held[whole:]], len(held) - whole

    def put(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def segment(self, ids: np.ndarray) -> None:
        table = Table.of(ids)
        number = np.zeros(int(table.symbols[-1]) + 1, np.int32)
        number[table.symbols] = np.arange(len(table.symbols), dtype=np.int32)
        entry = {"table": self.put(table.to_bytes()), "blocks": []}
        for k in range(0, len(ids), BLOCK):
            part = ids[k : k + BLOCK]
            body, marks, states = encode_block(number[part], table)
            at = self.put(body)
            entry["blocks"].append({"at": at, "size": len(body), "ids": len(part), "crc": zlib.crc32(body), "marks": marks, "states": self.put(states)})
        self.segments.append(entry)

    def close(self) -> None:
        held = np.concatenate(self.buffer) if self.buffer else np.zeros(0, np.uint32)
        if len(held):
            self.segment(held)
        index = zlib.compress(json.dumps({"total": self.total, "segments": self.segments, "docs": self.docs, "ends": self.ends}).encode(), 1)
        self.put(index)
        self.put(struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)


class Reader:
    """Reads a token file that supports seek: whole, by block, or from a checkpoint inside a block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, crc = struct.unpack("<QI", self.read(size - 20, 12))
        if bytes(self.read(size - 8, 8)) != MAGIC:
            raise ValueError("not a token file")
        index = self.read(size - 20 - n, n)
        if zlib.crc32(index) != crc:
            raise ValueError("the index is damaged")
        self.index = json.loads(zlib.decompress(index))

    def read(self, at: int, n: int) -> memoryview:
        self.source.seek(at)
        return memoryview(self.source.read(n))

    def lanes(self, block: dict) -> int:
        return struct.unpack("<I", self.read(block["at"], 4))[0]

    def table(self, segment: dict) -> Table:
        end = segment["blocks"][0]["at"]
        return Table.read(self.read(segment["table"], end - segment["table"]))[0]

    def block(self, block: dict, table: Table, slots: np.ndarray, mark: int | None = None, until: int | None = None) -> np.ndarray:
        """Ids of a block: from its checkpoint `mark` on, up to its id `until`, if given."""
        body = self.read(block["at"], block["size"])
        if zlib.crc32(body) != block["crc"]:
            raise ValueError(f"the block at {block['at']} is damaged")
        start = None
        if mark is not None:
            (lanes,) = struct.unpack_from("<I", body)
            states = np.frombuffer(self.read(block["states"] + 8 * lanes * mark, 8 * lanes), "<u8")
            start = (*block["marks"][mark], states)
        return decode_block(body, block["ids"] if until is None else until, table, slots, start)

    def blocks(self) -> Iterator[np.ndarray]:
        yield from self.stream(0, self.index["total"])

    def stream(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """The ids from place `begin` to place `end`, a block or less at a time; starts at the last checkpoint before."""
        at = 0
        for segment in self.index["segments"]:
            size = sum(b["ids"] for b in segment["blocks"])
            if at + size <= begin or at >= end:
                at += size
                continue
            table = self.table(segment)
            slots = table.slots()
            for block in segment["blocks"]:
                n = block["ids"]
                if at + n > begin and at < end:
                    skip, until, mark, from_id = max(0, begin - at), min(n, end - at), None, 0
                    if skip:
                        lanes = self.lanes(block)
                        passed = [k for k, (step, _) in enumerate(block["marks"]) if step * lanes <= skip]
                        if passed:
                            mark = passed[-1]
                            from_id = block["marks"][mark][0] * lanes
                    yield self.block(block, table, slots, mark, until)[skip - from_id :]
                at += n

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[object, int, int]]:
        """(document, number of ids, CRC-32 of its ids) of the documents from `first` to before `last`, in file order.

        Holds one block at a time; what lies before and after these documents isn't decoded.
        """
        docs, ends = self.index["docs"][first:last], self.index["ends"][first:last]
        begin = self.index["ends"][first - 1] if first else 0
        stream, held, at = self.stream(begin, ends[-1] if ends else begin), np.zeros(0, np.uint32), 0
        for doc, end in zip(docs, ends):
            crc, left = 0, end - begin
            while left:
                if at == len(held):
                    held, at = next(stream).astype("<u4"), 0
                part = held[at : at + left]
                crc = zlib.crc32(part, crc)
                at += len(part)
                left -= len(part)
            yield doc, end - begin, crc
            begin = end

    def spans(self, size: int) -> list[tuple[int, int, int]]:
        """The documents in runs of about `size` ids: (first, one past the last, ids before)."""
        ends = np.array(self.index["ends"], np.int64)
        found, first = [], 0
        while first < len(ends):
            begin = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + size, side="right")))
            found.append((first, last, begin))
            first = last
        return found


def write_files(docs: DataFrame, folder: str, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Tokenise documents and write them in ascending doc_id order (null first, ties by text), a file per range.

    Returns the manifest: part, path, ids. A task that runs again writes a file of another name; only the one
    in the manifest counts, so write the manifest before using it.
    """
    path = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        name, writer = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.rans", None
        with fs.open_output_stream(f"{root}/{name}") as out:
            writer = Writer(out)
            for batch, ids, offsets in encoded(batches, path):
                n = batch.num_rows
                places = np.arange(1, n + 1) + offsets[1:]
                whole = np.empty(len(ids) + n, np.uint32)
                ends = np.zeros(len(whole), bool)
                ends[places - 1] = True
                whole[ends] = end_id
                whole[~ends] = ids
                writer.add(whole, batch.column("doc_id").to_pylist(), (np.diff(offsets) + 1).tolist())
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "ids": pa.array([writer.total], pa.int64())})

    n = _ranges(docs)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part int, path string, ids long")


def _ranges(docs: DataFrame) -> int:
    """As many ranges as the input has partitions, so that a file's size doesn't depend on the table's."""
    return max(1, docs.rdd.getNumPartitions())


def read_files(manifest: DataFrame, span: int = SPAN) -> DataFrame:
    """Decode the files of a manifest: doc_id, start, n_tokens, ids_crc32.

    Files are cut in runs of documents of about `span` ids; each run is decoded on its own, from the checkpoint before
    it, so a large file is the work of many tasks.
    """
    spark = manifest.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as source:
                    runs = Reader(source).spans(span)
                columns = list(zip(*((uri, a, b, start + at) for a, b, at in runs))) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "first", "last", "start"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first, last, at in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last", "start"))):
                fs, path = open_fs(uri)
                rows = []
                with fs.open_input_file(path) as source:
                    for doc, n, crc in Reader(source).documents(first, last):
                        rows.append((doc, at, n, crc))
                        at += n
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select("part", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    runs = placed.repartitionByRange(max(1, min(files, tasks_of(spark, manifest))), "part").mapInArrow(cut, "path string, first long, last long, start long")
    return runs.repartition(max(1, files, ids // span), "path", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Write documents as token files in the shared folder and return what the files hold for each.

    Edge cases: a null or empty text holds only the end id; a null doc_id comes first; rows of one doc_id are
    ordered by text; an empty table gives no rows; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "rans")
    manifest = ws.save(write_files(docs, ws.folder("files"), end_id, tokenizer), "manifest")
    return read_files(manifest)
