"""Writing a layer as one PMTiles archive from many tasks.

The file is laid out as header, root directory, metadata, tile data, leaf
directories. Where a blob goes is known before it is written (its layout
offset), so tasks write their blobs at their places in the unfinished file;
a task that runs again writes the same bytes to the same places. Leaf
directories are made by tasks too; the driver only gets the number and size of
leaves, writes root and header last and then renames the file.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from .pmtiles import HEADER_BYTES, ROOT_BYTES, Entry, Header, pack_directory

#: Entries in a leaf at first; doubled until the root fits its place.
LEAF_ENTRIES = 4_096
#: Bytes that are written at once, about.
STEP = 8 << 20


def packed_metadata(metadata: dict) -> bytes:
    return gzip.compress(json.dumps(metadata, ensure_ascii=False).encode(), mtime=0)


def write_blobs(blobs: DataFrame, path: str, base: int, partitions: int) -> int:
    """Writes ``blobs(layout_offset, payload)`` into the file from byte ``base`` on; bytes written.

    Each task has neighbours in the file and writes up to STEP bytes of them at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        file = os.open(path, os.O_WRONLY)
        try:
            begin, waiting, size = 0, [], 0
            for b in batches:
                for at, payload in zip(b.column(0), b.column(1), strict=True):
                    if waiting and (at.as_py() != begin + size or size >= STEP):
                        total += os.pwrite(file, b"".join(waiting), base + begin)
                        waiting, size = [], 0
                    if not waiting:
                        begin = at.as_py()
                    waiting.append(payload.as_py())
                    size += len(waiting[-1])
            total += os.pwrite(file, b"".join(waiting), base + begin)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["bytes"])

    ordered = blobs.select("layout_offset", "payload").repartitionByRange(partitions, "layout_offset").sortWithinPartitions("layout_offset")
    return ordered.mapInArrow(run, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def leaf_tables(entries: DataFrame, partitions: int, size: int) -> DataFrame:
    """(tile_id, n, directory binary) of leaves over ``entries`` in order of tile id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Entry] = []

        def leaf(some: list[Entry]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([some[0].tile_id], pa.int64()), pa.array([len(some)], pa.int64()), pa.array([pack_directory(some)], pa.binary())], names=["tile_id", "n", "directory"])

        for b in batches:
            waiting.extend(map(Entry, *(c.to_pylist() for c in b.columns)))
            while len(waiting) >= size:
                yield leaf(waiting[:size])
                waiting = waiting[size:]
        if waiting:
            yield leaf(waiting)

    ordered = entries.select("tile_id", "offset", "length", "run_length").repartitionByRange(partitions, "tile_id").sortWithinPartitions("tile_id")
    return ordered.mapInArrow(run, "tile_id long, n long, directory binary")


def write_layer(runs: DataFrame, blobs: DataFrame, payloads: DataFrame, stats: Row, metadata: dict, source: Header, path: str, partitions: int) -> None:
    """Writes ``runs(tile_id, run_length, digest)``, ``blobs(digest, length, layout_offset)`` and ``payloads(layout_offset, payload)``.

    All are written tables or read once; ``stats`` is the layer's row of
    ``layer_stats``. Payloads are put into the file's order here and nowhere else.
    """
    size = blobs.agg(F.sum("length")).first()[0]
    described = packed_metadata(metadata)
    base = ROOT_BYTES + len(described)
    unfinished = f"{path}.tmp"
    try:
        with open(unfinished, "wb") as file:
            file.seek(ROOT_BYTES)
            file.write(described)
            file.truncate(base + size)
        written = write_blobs(payloads, unfinished, base, partitions)
        if written != size:
            raise OSError(f"{written} bytes of tiles were written to {unfinished}, not {size}")
        placed = runs.join(blobs.select("digest", "length", F.col("layout_offset").alias("offset")), "digest")
        leaf_at = base + size
        leaf_length, root = _write_directories(placed, stats["entries"], unfinished, leaf_at, partitions)
        header = replace(
            source, root_offset=HEADER_BYTES, root_length=len(root), metadata_offset=ROOT_BYTES, metadata_length=len(described), leaf_offset=leaf_at, leaf_length=leaf_length, data_offset=base, data_length=size,
            addressed_tiles=stats["addressed_tiles"], tile_entries=stats["entries"], tile_contents=stats["contents"], clustered=1, min_zoom=stats["min_zoom"], max_zoom=stats["max_zoom"], center_zoom=min(max(source.center_zoom, stats["min_zoom"]), stats["max_zoom"]),
        )
        with open(unfinished, "r+b") as file:
            file.write(header.pack() + root)
        os.replace(unfinished, path)
    except BaseException:
        if os.path.exists(unfinished):
            os.remove(unfinished)
        raise


def _write_directories(placed: DataFrame, n: int, path: str, at: int, partitions: int) -> tuple[int, bytes]:
    """(bytes of leaves, root). Few entries go into the root itself."""
    room = ROOT_BYTES - HEADER_BYTES
    if n <= LEAF_ENTRIES:
        entries = sorted(Entry(*r) for r in placed.select("tile_id", "offset", "length", "run_length").collect())
        root = pack_directory(entries)
        if len(root) <= room:
            return 0, root
    size = LEAF_ENTRIES
    while True:
        tasks = max(1, min(partitions, n // size))
        tables = materialize(leaf_tables(placed, tasks, size), "leaves")
        sizes = tables.select("tile_id", F.octet_length("directory").alias("length")).orderBy("tile_id").collect()  # one row for each leaf
        pointers, offset = [], 0
        for r in sizes:
            pointers.append(Entry(r["tile_id"], offset, r["length"], 0))
            offset += r["length"]
        root = pack_directory(pointers)
        if len(root) <= room:
            break
        discard(tables)
        size *= 2
    place = {p.tile_id: p.offset for p in pointers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(path, os.O_WRONLY)
        total = 0
        try:
            for b in batches:
                for tile, directory in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    os.pwrite(file, directory, at + place[tile])
                    total += len(directory)
            os.fsync(file)
        finally:
            os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["bytes"])

    written = tables.select("tile_id", "directory").mapInArrow(run, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    discard(tables)
    if written != offset:
        raise OSError(f"{written} bytes of directories were written to {path}, not {offset}")
    return offset, root
