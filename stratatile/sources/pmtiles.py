"""PMTiles version 3: header and directories, as the public specification has them."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, fields
from typing import Any, BinaryIO, NamedTuple

from ..functions.varint import put, take

HEADER_BYTES = 127
#: The header and the root directory lie in so many bytes at the start.
ROOT_BYTES = 16_384
MAGIC = b"PMTiles"
GZIP, MVT = 2, 1
_LAYOUT = "<7sB11QBBBBBBiiiiBii"


class Entry(NamedTuple):
    """A run of tile ids and its bytes; run_length 0 points to a leaf directory."""

    tile_id: int
    offset: int
    length: int
    run_length: int


@dataclass(frozen=True)
class Header:
    root_offset: int = HEADER_BYTES
    root_length: int = 0
    metadata_offset: int = 0
    metadata_length: int = 0
    leaf_offset: int = 0
    leaf_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    addressed_tiles: int = 0
    tile_entries: int = 0
    tile_contents: int = 0
    clustered: int = 0
    internal_compression: int = GZIP
    tile_compression: int = GZIP
    tile_type: int = MVT
    min_zoom: int = 0
    max_zoom: int = 0
    min_lon_e7: int = 0
    min_lat_e7: int = 0
    max_lon_e7: int = 0
    max_lat_e7: int = 0
    center_zoom: int = 0
    center_lon_e7: int = 0
    center_lat_e7: int = 0

    def pack(self) -> bytes:
        return struct.pack(_LAYOUT, MAGIC, 3, *(getattr(self, f.name) for f in fields(self)))


def parse_header(data: bytes) -> Header:
    if len(data) < HEADER_BYTES or data[:7] != MAGIC:
        raise ValueError("not a PMTiles archive")
    if data[7] != 3:
        raise ValueError(f"a PMTiles archive of version {data[7]}; version 3 is read")
    return Header(*struct.unpack(_LAYOUT, data[:HEADER_BYTES])[2:])


def pack_directory(entries: Sequence[Entry]) -> bytes:
    """Gzipped directory of entries in order of tile id."""
    out = bytearray()
    put(out, len(entries))
    last = 0
    for e in entries:
        put(out, e.tile_id - last)
        last = e.tile_id
    for e in entries:
        put(out, e.run_length)
    for e in entries:
        put(out, e.length)
    expected = None
    for e in entries:
        put(out, 0 if e.offset == expected else e.offset + 1)
        expected = e.offset + e.length
    return gzip.compress(bytes(out), mtime=0)


def parse_directory(data: bytes) -> list[Entry]:
    raw = gzip.decompress(data)
    n, at = take(raw, 0)
    columns: list[list[int]] = []
    for _ in range(4):
        column = []
        for _ in range(n):
            value, at = take(raw, at)
            column.append(value)
        columns.append(column)
    ids, runs, lengths, offsets = columns
    out: list[Entry] = []
    tile = 0
    for i in range(n):
        tile += ids[i]
        offset = offsets[i] - 1 if offsets[i] else out[-1].offset + out[-1].length
        out.append(Entry(tile, offset, lengths[i], runs[i]))
    return out


@dataclass(frozen=True)
class Archive:
    """What the driver reads of an archive before any task starts."""

    path: str
    header: Header
    root: list[Entry] = field(default_factory=list)
    metadata: Any = field(default_factory=dict)


def read_range(file: BinaryIO, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) < length:
        raise ValueError(f"{file.name} ends before byte {offset + length}")
    return data


def open_archive(path: str) -> Archive:
    """Header, root directory and metadata, checked: gzipped vector tiles, gzipped directories, not truncated."""
    with open(path, "rb") as file:
        try:
            header = parse_header(file.read(HEADER_BYTES))
        except ValueError as error:
            raise ValueError(f"{path}: {error}") from None
        if header.tile_type != MVT:
            raise ValueError(f"{path} holds tiles of type {header.tile_type}, not Mapbox Vector Tiles")
        if header.tile_compression != GZIP or header.internal_compression != GZIP:
            raise ValueError(f"{path} is compressed other than by gzip")
        if header.root_offset + header.root_length > ROOT_BYTES:
            raise ValueError(f"{path}: the root directory reaches past the first {ROOT_BYTES} bytes")
        size = file.seek(0, 2)
        ends = {"root directory": header.root_offset + header.root_length, "metadata": header.metadata_offset + header.metadata_length, "leaf directories": header.leaf_offset + header.leaf_length, "tile data": header.data_offset + header.data_length}
        for what, end in ends.items():
            if end > size:
                raise ValueError(f"{path} is truncated: its {what} end at byte {end}, the file at {size}")
        root = parse_directory(read_range(file, header.root_offset, header.root_length))
        raw = read_range(file, header.metadata_offset, header.metadata_length)
        return Archive(path, header, root, json.loads(gzip.decompress(raw)) if raw else {})


def split(directory: Sequence[Entry], start: int, limit: int, end: int) -> tuple[list[Entry], list[tuple[Entry, int]]]:
    """(runs, leaves) of a directory that touch [start, limit).

    A leaf covers the ids up to the next entry's, the last up to ``end``,
    where the directory ends; it comes with that bound.
    """
    runs: list[Entry] = []
    leaves: list[tuple[Entry, int]] = []
    for i, e in enumerate(directory):
        if e.tile_id >= limit:
            break
        if e.run_length:
            if e.tile_id + e.run_length > start:
                runs.append(e)
        else:
            upto = directory[i + 1].tile_id if i + 1 < len(directory) else end
            if upto > start:
                leaves.append((e, upto))
    return runs, leaves


def walk(leaf: Entry, upto: int, read: Callable[[Entry], bytes], start: int, limit: int) -> Iterable[Entry]:
    """Runs below a leaf, however deep its directories are nested."""
    waiting = [(leaf, upto)]
    while waiting:
        at, end = waiting.pop()
        runs, leaves = split(parse_directory(read(at)), start, limit, end)
        yield from runs
        waiting.extend(leaves)
