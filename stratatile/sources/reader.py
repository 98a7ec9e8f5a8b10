"""The data source ``pmtiles``: entries, header or leaf pointers of an archive; and its tiles' bytes.

Options: path; min_zoom and max_zoom (default: the archive's); part: entries
(default), header or leaves. The driver reads and checks the header and root
directory before any task starts; each group of leaf directories that touches
the zoom range is a partition, others are never read. The path must be
reachable as a file from every executor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tileid import zoom_bounds
from ..operators.entries import share_cut
from ..shipping import ship
from .pmtiles import Archive, Entry, Header, open_archive, read_range, split, walk

ENTRIES = "tile_id bigint, offset bigint, length bigint, run_length bigint"
HEADER = ", ".join(f"{name} bigint" for name in asdict(Header())) + ", metadata_json string"
LEAVES = "tile_id bigint, next_id bigint, offset bigint, length bigint"
#: Bytes of leaf directories in a partition, and bytes between blobs that are read through rather than skipped.
LEAF_BYTES, GAP_BYTES, SPAN_BYTES = 4 << 20, 64 << 10, 16 << 20


def id_range(archive: Archive, min_zoom: int | None, max_zoom: int | None) -> tuple[int, int]:
    """Id range of the zooms asked for that the archive holds; ValueError if it holds none."""
    low = max(archive.header.min_zoom, min_zoom or 0)
    high = archive.header.max_zoom if max_zoom is None else min(archive.header.max_zoom, max_zoom)
    if low > high:
        raise ValueError(f"{archive.path} holds zooms {archive.header.min_zoom} to {archive.header.max_zoom}, none of those asked for")
    return zoom_bounds(low, high)


class Leaves(InputPartition):
    def __init__(self, leaves: list[tuple[Entry, int]]) -> None:
        super().__init__(None)
        self.leaves = leaves


class Rows(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        super().__init__(None)
        self.rows = rows


class PmtilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.part = options.get("part", "entries")
        archive = open_archive(options["path"])
        zoom = lambda key: int(options[key]) if options.get(key) else None
        self.path, self.header = archive.path, archive.header
        self.start, self.limit = id_range(archive, zoom("min_zoom"), zoom("max_zoom"))
        self.runs, self.leaves = split(archive.root, self.start, self.limit, self.limit)
        self.metadata = archive.metadata

    def partitions(self) -> list[InputPartition]:
        if self.part == "header":
            return [Rows([(*asdict(self.header).values(), json.dumps(self.metadata, ensure_ascii=False))])]
        if self.part == "leaves":
            return [Rows([(e.tile_id, upto, e.offset, e.length) for e, upto in self.leaves])]
        found: list[InputPartition] = [Rows([tuple(e) for e in self.runs])] if self.runs or not self.leaves else []
        group: list[tuple[Entry, int]] = []
        size = 0
        for leaf in self.leaves:
            if group and size + leaf[0].length > LEAF_BYTES:
                found.append(Leaves(group))
                group, size = [], 0
            group.append(leaf)
            size += leaf[0].length
        return [*found, Leaves(group)] if group else found

    def read(self, partition: InputPartition) -> Iterator:
        if isinstance(partition, Rows):
            yield from partition.rows
            return
        with open(self.path, "rb") as file:
            for leaf, upto in partition.leaves:
                for e in walk(leaf, upto, lambda x: read_range(file, self.header.leaf_offset + x.offset, x.length), self.start, self.limit):
                    yield tuple(e)


class PmtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return {"entries": ENTRIES, "header": HEADER, "leaves": LEAVES}[self.options.get("part", "entries")]

    def reader(self, schema) -> DataSourceReader:
        return PmtilesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PmtilesSource)


def read_entries(spark: SparkSession, path: str, min_zoom: int | None = None, max_zoom: int | None = None, part: str = "entries") -> DataFrame:
    """Entries of the zoom range (runs over its ends kept whole), the header row, or the leaf pointers."""
    register(spark)
    options = {"path": path, "part": part} | {k: str(v) for k, v in (("min_zoom", min_zoom), ("max_zoom", max_zoom)) if v is not None}
    return spark.read.format("pmtiles").options(**options).load()


def spans(rows: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Indexes of blobs, in order of offset, that one read covers."""
    some: list[int] = []
    begin = end = 0
    for i, (offset, length) in enumerate(rows):
        if some and (offset > end + GAP_BYTES or offset + length - begin > SPAN_BYTES):
            yield some
            some = []
        if not some:
            begin, end = offset, offset
        some.append(i)
        end = max(end, offset + length)
    if some:
        yield some


def read_blobs(blobs: DataFrame, archive: Archive, partitions: int) -> DataFrame:
    """Adds payload to ``blobs(offset, length)`` and keeps other columns.

    Each task gets neighbours in the file, of about as many bytes as the other
    tasks, and reads them in few long reads.
    """
    dealt = share_cut(blobs, partitions).repartitionById(partitions, F.col("share"))
    ordered = dealt.drop("share").sortWithinPartitions("offset", "length")
    schema = ordered.select("*", F.lit(None).cast("binary").alias("payload")).schema
    path, base = archive.path, archive.header.data_offset
    at = [ordered.columns.index(c) for c in ("offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            for b in batches:
                rows = list(zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True))
                for some in spans(rows):
                    begin = rows[some[0]][0]
                    data = read_range(file, base + begin, max(o + n for o, n in (rows[i] for i in some)) - begin)
                    payload = [data[o - begin : o - begin + n] for o, n in (rows[i] for i in some)]
                    part = b.slice(some[0], len(some))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary())], names=[f.name for f in schema])

    return ordered.mapInArrow(run, schema)
