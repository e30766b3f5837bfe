"""METIS graphs as a Spark data source: `spark.read.format("metis").option("path", ..).option("rows", "edges" or "vertices").load()`.

Files are cut into byte ranges; a range owns the lines that begin in it, and a task reads as many that follow each other as hold TASK_BYTES, one after another. A line's number is its place in the range plus the lines of all ranges before.
`read_graph` counts these in a pass on the cluster and hands them on; a plain load counts them while the read is planned. Options: `path`, a file or a folder whose
parts, by name, make the file, on a file system that Arrow knows; `rows`; `range_bytes`, the size of a range. Columns: `edges` (u, v, w), `vertices` (u, vw); ids from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meshwork.sources.graph import Graph

RANGE_BYTES = 32 << 20
SCHEMAS = {"edges": "u long, v long, w long", "vertices": "u long, vw long", "lines": "file string, start long, n long, head string"}
#: Bytes of small ranges that one task reads.
TASK_BYTES = 1 << 20
#: Read beyond a range at a time, for the end of its last line.
BEYOND = 1 << 16


class Range:
    def __init__(self, file: str, start: int, end: int, first: int = 0):
        self.file, self.start, self.end, self.first = file, start, end, first


class Ranges(InputPartition):
    """The ranges of one task."""

    def __init__(self, ranges: list[Range]):
        super().__init__([(r.file, r.start, r.end, r.first) for r in ranges])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of a folder's parts in the order of their names."""
    fs, at = file_system(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    parts = sorted((f for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
    return [(prefix + f.path, f.size) for f in parts if f.size]


def lines_of(file: str, start: int, end: int) -> list[bytes]:
    """The lines that begin in [start, end): a line begins at the file's start and behind each line feed."""
    fs, at = file_system(file)
    with fs.open_input_file(at) as f:
        size = f.size()
        low = max(0, start - 1)
        data = f.read_at(min(end, size) - low, low)
        while min(end, size) < size and not data.endswith(b"\n"):
            more = f.read_at(min(BEYOND, size - low - len(data)), low + len(data))
            if not more:
                break
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            if cut >= 0:
                break
    if start:
        cut = data.find(b"\n")
        data = b"" if cut < 0 else data[cut + 1 :]
    lines = data.split(b"\n")
    if lines and not lines[-1]:
        lines.pop()
    # what was read beyond the range ends the last line only
    return lines


def counted(lines: list[bytes]) -> list[bytes]:
    """Lines without comments: those that are the header or a vertex."""
    return [x for x in lines if not x.startswith(b"%")]


def header_of(line: bytes) -> str:
    """`n,has vertex weights,has edge weights` of a header `n m [fmt]`."""
    fields = line.split()
    fmt = (fields[2].decode() if len(fields) > 2 else "0").zfill(3)
    return f"{int(fields[0])},{int(fmt[-2] == '1')},{int(fmt[-1] == '1')}"


class MetisReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.size = options.get("rows", "edges"), int(options.get("range_bytes", RANGE_BYTES))
        if self.rows not in SCHEMAS:
            raise ValueError(f"rows must be one of {', '.join(SCHEMAS)}")
        self.ranges = [Range(file, a, min(a + self.size, n)) for file, n in files_of(options["path"]) for a in range(0, n, self.size)]
        self.header = options.get("header")
        starts = options.get("starts")
        if self.rows == "lines":
            return
        if starts is None:  # a plain load: lines are counted while the read is planned
            lines = [counted(lines_of(r.file, r.start, r.end)) if r.start or not self.header else [] for r in self.ranges]
            first = next((x[0] for x in lines if x), None)
            if first is None:
                raise ValueError("no header")
            self.header, many = header_of(first), [len(x) for x in lines]
        else:
            many = [int(x) for x in starts.split(",")]
        at = 0
        for r, n in zip(self.ranges, many, strict=True):
            r.first, at = at, at + n

    def __getstate__(self) -> dict:
        """What a task gets besides its own ranges: not those of all others."""
        return self.__dict__ | {"ranges": []}

    def partitions(self) -> list[Ranges]:
        out, size = [], TASK_BYTES
        for r in self.ranges:
            if size + r.end - r.start > TASK_BYTES:
                out.append([])
                size = 0
            out[-1].append(r)
            size += r.end - r.start
        return [Ranges(x) for x in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for x in partition.value:
            yield from self.read_range(Range(*x))

    def read_range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lines = counted(lines_of(partition.file, partition.start, partition.end))
        if self.rows == "lines":
            head = lines[0].decode()[:1000] if lines else None
            yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([partition.start]), pa.array([len(lines)]), pa.array([head], pa.string())], names=["file", "start", "n", "head"])
            return
        n, has_v, has_e = (int(x) for x in self.header.split(","))
        first = partition.first - 1  # the header is line 0
        if first < 0:
            lines, first = lines[1:], 0
        lines = lines[: max(0, n - first)]
        ids = np.arange(first, first + len(lines))
        fields = np.array([len(x.split()) for x in lines], np.int64)
        numbers = np.array(b" ".join(lines).split(), np.int64)
        begin = np.cumsum(fields) - fields
        if self.rows == "vertices":
            weight = numbers[begin] if has_v and len(lines) else np.ones(len(lines), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(weight)], names=["u", "vw"])
            return
        many = (fields - has_v) // (1 + has_e)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        place = np.repeat(begin + has_v, many) + (1 + has_e) * nth
        w = numbers[place + 1] if has_e else np.ones(len(place), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, many)), pa.array(numbers[place] - 1), pa.array(w)], names=["u", "v", "w"])


class MetisSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metis"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "edges")]

    def reader(self, schema) -> DataSourceReader:
        return MetisReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetisSource)


def read_graph(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> Graph:
    """The graph of a METIS file of any size: a first pass counts the lines of each range on the cluster (the driver sees a row for each range), the second reads them."""
    register(spark)
    load = lambda rows, **more: spark.read.format("metis").options(path=path, rows=rows, range_bytes=str(range_bytes), **more).load()
    counts = {(r["file"], r["start"]): (r["n"], r["head"]) for r in load("lines").collect()}
    order = [counts[file, a] for file, n in files_of(path) for a in range(0, n, range_bytes)]
    head = next((h for n, h in order if n), None)
    if head is None:
        raise ValueError("no header")
    found = {"starts": ",".join(str(n) for n, _ in order), "header": header_of(head.encode())}
    n, m = (int(x) for x in head.split()[:2])
    graph = Graph(load("vertices", **found), load("edges", **found))
    have = graph.vertices.count(), graph.edges.count()
    if have != (n, 2 * m):
        raise ValueError(f"the header says {n} vertices and {2 * m} arcs, the file has {have[0]} and {have[1]}")
    return graph
