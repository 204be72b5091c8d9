"""A library on the session's file system: Parquet data under versioned folders, and a manifest that is swapped by one rename.

Layout under the root: manifest.json, chunks/<source_id>/<version>/, vectors/<tier>/<source_id>/<version>/. Data is
written first, the manifest last, so a reader sees a change whole or not at all; a manifest that can't be read
counts as empty. The root is a URI or a path of the session's default file system, so that executors share it.
"""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import constants as C, schemas
from quire.errors import NoTextLayerError, SourceNotFoundError
from quire.functions.cite import title_from_filename
from quire.functions.format import library_warning
from quire.operators.chunks import check_window, chunk_pages
from quire.operators.library_ops import resolve_source, resolve_sources, stale, tier_gap
from quire.operators.pages import clean_pages, scan_report
from quire.scratch import open_fs, qualified, remove
from quire.sources.embedder import Embedder, check_tier

Notify = Callable[[str], None]


class Library:
    """Sources, chunks and vectors under one root; every operator of the engine takes its tables.

    `embedders` (tier -> embedder) serve rebuilds of tiers that a call doesn't name itself.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, embedders: dict[str, Embedder] | None = None):
        self.spark, self.embedders = spark, embedders or {}
        self.root = qualified(spark, root or os.environ.get("QUIRE_HOME", str(Path.home() / ".quire"))).rstrip("/")
        self.fs, self.base = open_fs(self.root)

    # -- manifest ---------------------------------------------------------------------------------------------
    def _read(self) -> dict:
        try:
            with self.fs.open_input_stream(f"{self.base}/manifest.json") as source:
                found = json.loads(source.read())
            return found if isinstance(found, dict) and isinstance(found.get("sources"), list) else {"sources": [], "rates": {}}
        except (OSError, ValueError):
            return {"sources": [], "rates": {}}

    def _write(self, manifest: dict) -> None:
        self.fs.create_dir(self.base, recursive=True)
        name = f"manifest-{uuid.uuid4().hex}.json"
        with self.fs.open_output_stream(f"{self.base}/{name}") as out:
            out.write(json.dumps(manifest, ensure_ascii=False).encode())
        if isinstance(self.fs, pafs.LocalFileSystem):
            self.fs.move(f"{self.base}/{name}", f"{self.base}/manifest.json")
            return
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        rename = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(self.spark._jvm.java.net.URI(self.root), conf)
        context.rename(hadoop.Path(self._at(name)), hadoop.Path(self._at("manifest.json")), how)

    def _put(self, entry: dict) -> None:
        """Replace a source in place, or add it last."""
        manifest = self._read()
        at = next((i for i, s in enumerate(manifest["sources"]) if s["source_id"] == entry["source_id"]), None)
        if at is None:
            manifest["sources"].append(entry)
        else:
            manifest["sources"][at] = entry
        self._write(manifest)

    def _entry(self, source_id: str) -> dict | None:
        return next((s for s in self._read()["sources"] if s["source_id"] == source_id), None)

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _there(self, path: str) -> bool:
        return self.fs.get_file_info(f"{self.base}/{path}").type == pafs.FileType.Directory

    # -- tables -----------------------------------------------------------------------------------------------
    def sources(self) -> DataFrame:
        rows = []
        for k, s in enumerate(self._read()["sources"]):
            added = datetime.date.fromisoformat(s["added"]) if s.get("added") else None
            rows.append((s["source_id"], k, s.get("filename", ""), s.get("title", ""), s.get("author", ""), added, s.get("page_count", 0), s.get("chunk_count", 0),
                         s.get("chunk_size", C.CHUNK_SIZE), s.get("overlap", C.CHUNK_OVERLAP), s.get("tiers", []), s.get("index_version", 0), s.get("path")))
        return self.spark.createDataFrame(rows, schemas.SOURCES)

    def _table(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*map(self._at, paths)) if paths else self.spark.createDataFrame([], schema)

    def chunks(self, only: list[str] | None = None) -> DataFrame:
        return self._table([s["chunks"] for s in self._read()["sources"] if s.get("chunks") and (only is None or s["source_id"] in only)], schemas.CHUNKS)

    def vectors(self, tier: str | None = None, only: list[str] | None = None) -> DataFrame:
        kept = [s for s in self._read()["sources"] if only is None or s["source_id"] in only]
        return self._table([p for s in kept for t, p in s.get("vectors", {}).items() if tier in (None, t) and self._there(p)], schemas.VECTORS)

    def rates(self) -> DataFrame:
        return self.spark.createDataFrame(list(self._read().get("rates", {}).items()), schemas.RATES)

    # -- changes ----------------------------------------------------------------------------------------------
    def add(self, pages: DataFrame, source_id: str, filename: str, embedder: Embedder, title: str | None = None, author: str | None = None, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, path: str | None = None) -> dict:
        """Add one source's book pages; the same bytes (source_id) again change nothing.

        Stale sources are rebuilt, known ones only get the tier they lack. Returns what happened: source, state
        (added, embedded, reindexed, unchanged), warning.
        """
        check_window(size, overlap)
        known = self._entry(source_id)
        if known and known.get("chunks") and known.get("index_version", 0) < C.INDEX_VERSION:
            return self._said(self.reindex(source_id, pages, embedder), "reindexed")
        if known and known.get("chunks"):
            if embedder.tier in known["tiers"] and self._there(known["vectors"].get(embedder.tier, "?")):
                return self._said(known, "unchanged")
            return self._said(self.embed(source_id, embedder), "embedded")
        name = title_from_filename(F.lit(filename))
        derived = (title or "").strip() or self.spark.range(1).select(name).first()[0]
        entry = {"source_id": source_id, "filename": filename, "title": derived, "author": (author or "").strip(), "added": datetime.date.today().isoformat(), "tiers": [], "vectors": {}, "path": path}
        entry |= self._chunk(pages, source_id, size, overlap)
        self._put(entry)
        return self._said(self.embed(source_id, embedder), "added")

    def _said(self, entry: dict, state: str) -> dict:
        n = len(self._read()["sources"])
        warning = self.spark.range(1).select(library_warning(F.lit(n))).first()[0]
        return {"source": entry, "state": state, "warning": warning}

    def _chunk(self, pages: DataFrame, source_id: str, size: int, overlap: int) -> dict:
        own = pages.where(F.col("source_id") == source_id)
        report = scan_report(own).first()
        if report is None or report["is_scan"]:
            raise NoTextLayerError(f"{source_id[:8]} has no text layer")
        at = f"chunks/{source_id}/{uuid.uuid4().hex}"
        chunk_pages(clean_pages(own), size, overlap).write.parquet(self._at(at))
        return {"chunks": at, "page_count": report["page_count"], "chunk_count": self.spark.read.parquet(self._at(at)).count(), "chunk_size": size, "overlap": overlap, "index_version": C.INDEX_VERSION}

    def _vectors(self, entry: dict, embedder: Embedder) -> str:
        """Write the vectors of an entry's chunks; where they are."""
        tier = check_tier(embedder.tier)
        at = f"vectors/{tier}/{entry['source_id']}/{uuid.uuid4().hex}"
        chunks = self._table([entry["chunks"]], schemas.CHUNKS)
        chunks.select(F.lit(tier).alias("tier"), "source_id", "chunk_id", embedder.embed(F.col("text")).alias("embedding")).write.parquet(self._at(at))
        return at

    def embed(self, source_id: str, embedder: Embedder) -> dict:
        """Write one tier's vectors of a source; chunks and other tiers stay."""
        tier, entry = check_tier(embedder.tier), self._entry(source_id)
        if not entry or not entry.get("chunks"):
            raise SourceNotFoundError(f"{source_id[:8]} has no chunks")
        began = time.monotonic()
        entry["vectors"] = entry.get("vectors", {}) | {tier: self._vectors(entry, embedder)}
        entry["tiers"] = [t for t in C.TIERS if t in {*entry["tiers"], tier}]
        self._put(entry)
        self._record(tier, entry["page_count"], time.monotonic() - began)
        return entry

    def _record(self, tier: str, pages: int, seconds: float) -> None:
        manifest = self._read()
        rates = manifest.setdefault("rates", {})
        if tier not in rates and pages >= C.MIN_PAGES_FOR_RATE and seconds > 0:
            rates[tier] = round(pages / seconds, 2)
            self._write(manifest)

    def reindex(self, source_id: str, pages: DataFrame, embedder: Embedder | dict[str, Embedder]) -> dict:
        """Chunk and embed again, for all tiers the source has and those given; title and author stay.

        A tier without an embedder (given, or of the library) is an error before anything changes. Chunks and all
        vectors are written first and come into view together; the old ones go last.
        """
        entry = self._entry(source_id)
        if not entry:
            raise SourceNotFoundError(source_id)
        given = embedder if isinstance(embedder, dict) else {embedder.tier: embedder}
        by_tier = self.embedders | given
        tiers = [t for t in C.TIERS if t in {*entry["tiers"], *given}]
        lacking = [t for t in tiers if t not in by_tier]
        if lacking:
            raise ValueError(f"{source_id[:8]} has vectors of {', '.join(lacking)}, for which no embedder is given")
        old = [p for p in (entry.get("chunks"), *entry.get("vectors", {}).values()) if p]
        made = entry | self._chunk(pages, source_id, entry.get("chunk_size", C.CHUNK_SIZE), entry.get("overlap", C.CHUNK_OVERLAP))
        made |= {"tiers": tiers, "vectors": {t: self._vectors(made, by_tier[t]) for t in tiers}}
        self._put(made)
        for p in old:
            remove(self._at(p))
        return made

    def upgrade_stale(self, pages_of: Callable[[dict], DataFrame | None], embedder: Embedder, notify: Notify = lambda _: None) -> list[str]:
        """Rebuild sources of an older index version with all their tiers.

        One whose pages can't be had, or that has a tier without an embedder, is reported and left as it is.
        """
        done = []
        for row in stale(self.sources()).collect():  # the catalog is small; each rebuild is a distributed job
            entry = self._entry(row["source_id"])
            pages = pages_of(entry)
            if pages is None:
                notify(f"{entry['title']}: its file is gone; the old index is used")
                continue
            try:
                self.reindex(row["source_id"], pages, embedder)
            except ValueError as e:
                notify(f"{entry['title']}: {e}; the old index is used")
                continue
            done.append(row["source_id"])
        return done

    def edit(self, needle: str, title: str | None = None, author: str | None = None) -> dict:
        """Set title or author; None keeps, an empty string clears."""
        if title is None and author is None:
            raise ValueError("give a title or an author")
        entry = self._entry(resolve_source(self.sources(), needle).first()["source_id"])
        entry |= {k: v.strip() for k, v in (("title", title), ("author", author)) if v is not None}
        self._put(entry)
        return entry

    def edit_many(self, edits: list[dict]) -> list[dict]:
        return [self.edit(e["source_id"], e.get("title"), e.get("author")) for e in edits]

    def remove(self, needle: str) -> dict:
        """Drop a source: the manifest first, then its data."""
        source_id = resolve_source(self.sources(), needle).first()["source_id"]
        manifest = self._read()
        gone = next(s for s in manifest["sources"] if s["source_id"] == source_id)
        manifest["sources"] = [s for s in manifest["sources"] if s["source_id"] != source_id]
        self._write(manifest)
        for p in (f"chunks/{source_id}", *(f"vectors/{t}/{source_id}" for t in C.TIERS)):
            remove(self._at(p))
        return gone

    # -- questions --------------------------------------------------------------------------------------------
    def scope(self, needle: str | None = None) -> DataFrame:
        return self.sources() if needle is None else resolve_sources(self.sources(), needle)

    def gap(self, tier: str, needle: str | None = None) -> DataFrame:
        return tier_gap(self.scope(needle), self.vectors(), check_tier(tier), C.PAGES_PER_SECOND | self._read().get("rates", {}))

    def size_bytes(self) -> int:
        found = self.fs.get_file_info(pafs.FileSelector(self.base, allow_not_found=True, recursive=True))
        return sum(f.size for f in found if f.type == pafs.FileType.File)

    def diagnostics(self) -> DataFrame:
        """One row: versions, settings that matter, and the library's totals."""
        entries = self._read()["sources"]
        conf = self.spark.conf
        row = (self.spark.version, conf.get("spark.sql.shuffle.partitions"), conf.get("spark.sql.adaptive.enabled"), self.root, len(entries), sum(e.get("chunk_count", 0) for e in entries), self.size_bytes())
        return self.spark.createDataFrame([row], "spark string, shuffle_partitions string, adaptive string, root string, sources int, chunks int, bytes bigint")
