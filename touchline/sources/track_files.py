"""Track files as a Spark data source, `tracks`: filters on ids and frames reach the reader, broken lines are refused by file and line, and a write counts as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "frame_proc int, global_id int, x double, y double, w double, h double, confidence double"
NAMES = ["frame", "global_id", "x", "y", "w", "h", "confidence"]
OUT = pa.schema([("frame_proc", pa.int32()), ("global_id", pa.int32()), *[(n, pa.float64()) for n in NAMES[2:]]])
#: Bytes of a file that one partition reads, unless the option `split` says otherwise; bytes read at once.
SPLIT, CHUNK = 64 << 20, 1 << 20
#: Filters that the reader takes over, as what they ask of a column and a value.
TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
VERSIONS = "_versions"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or of a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """A file itself; of a folder with versions those of the last one that is complete, of another one all but hidden ones."""
    at = store.get_file_info(path)
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if at.type == fs.FileType.File:
        return [at]
    version = current(store, path)
    if version is not None:
        return [i for i in store.get_file_info([f"{path}/{f}" for f in version]) if i.size]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((i for i in found if i.type == fs.FileType.File and i.size and not i.base_name.startswith((".", "_"))), key=lambda i: i.path)


def pointers(store: fs.FileSystem, path: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(f"{path}/{VERSIONS}", allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.endswith(".json"))


def current(store: fs.FileSystem, path: str) -> list[str] | None:
    """The files of the last version whose pointer is whole; one that was cut off while it was written doesn't count."""
    for p in reversed(pointers(store, path)):
        with store.open_input_stream(p) as f:
            try:
                return json.loads(f.read())["files"]
            except (ValueError, KeyError):
                continue
    return None


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class TrackReader(DataSourceReader):
    """A partition for each stretch of a file; a line belongs to the stretch in which it begins."""

    def __init__(self, options: dict):
        self.path, self.split, self.strict = options["path"], int(options.get("split", SPLIT)), options.get("strict", "true").lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters):
        """Takes over comparisons of frame_proc and global_id with a value; hands the others back."""
        for f in filters:
            if type(f) in (*TESTS, In, IsNotNull) and f.attribute[-1] in ("frame_proc", "global_id"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Piece]:
        store, path = place(self.path)
        pieces = [Piece(i.path, a, min(a + self.split, i.size)) for i in files(store, path) for a in range(0, i.size, self.split)]
        return pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        store, _ = place(self.path)
        with store.open_input_file(piece.path) as f:
            at, rest = piece.start, b""
            if at:
                # the line that reaches into the stretch belongs to the one before
                f.seek(at - 1)
                while True:
                    got = f.read(CHUNK)
                    k = got.find(b"\n")
                    if k >= 0 or not got:
                        break
                    at += len(got)
                at = at + k if k >= 0 and got else piece.end
            f.seek(at)
            while at < piece.end:
                got = f.read(CHUNK)
                block = rest + got
                if got and len(got) == CHUNK and at + CHUNK < piece.end:
                    k = block.rfind(b"\n") + 1
                    block, rest = block[:k], block[k:]
                    at += len(got)
                else:
                    # to the end of the last line that begins here
                    base = at - len(rest)
                    while block.find(b"\n", max(0, piece.end - base - 1)) < 0 and got:
                        got = f.read(CHUNK)
                        block += got
                    k = block.find(b"\n", max(0, piece.end - base - 1))
                    block, at = block if k < 0 else block[: k + 1], piece.end
                out = self.parsed(block, piece)
                if out is not None and out.num_rows:
                    yield from out.to_batches()

    def parsed(self, block: bytes, piece: Piece) -> pa.Table | None:
        if not block.strip():
            return None
        bad: list = []

        def odd(row):
            bad.append(row)
            return "skip"

        wide = csv.ReadOptions(column_names=[*NAMES, "a", "b", "c"])
        kinds = csv.ConvertOptions(column_types={n: pa.float64() for n in NAMES} | {c: pa.string() for c in "abc"}, null_values=[])
        try:
            t = csv.read_csv(pa.BufferReader(block), wide, csv.ParseOptions(invalid_row_handler=odd), kinds)
            if bad or pc.any(pc.less(t["frame"], 1.0)).as_py() or not pc.all(pc.and_(pc.is_finite(t["frame"]), pc.is_finite(t["global_id"]))).as_py():
                raise pa.ArrowInvalid
        except pa.ArrowInvalid:
            t = self.by_line(block, piece)
        whole = lambda n, less: pc.cast(pc.subtract(pc.trunc(t[n]), float(less)), pa.int32())
        t = pa.Table.from_arrays([whole("frame", 1), whole("global_id", 0), *[t[n] for n in NAMES[2:]]], schema=OUT)
        for f in self.filters:
            c = t[f.attribute[-1]]
            if isinstance(f, In):
                t = t.filter(pc.is_in(c, value_set=pa.array(list(f.value), pa.int32())))
            elif not isinstance(f, IsNotNull):
                t = t.filter(TESTS[type(f)](c, f.value))
        return t

    def by_line(self, block: bytes, piece: Piece) -> pa.Table:
        """The good lines of a block that has others; those are refused by file and line when reading strictly, and left out else."""
        good: list[list[float]] = []
        for line in block.split(b"\n"):
            text = line.strip()
            if not text:
                continue
            try:
                v = [float(x) for x in text.split(b",")[: len(NAMES)]]
                if len(v) < len(NAMES) or not v[0] >= 1 or not np.isfinite(v[:2]).all():
                    raise ValueError
                good.append(v)
            except ValueError:
                if self.strict:
                    raise ValueError(f"{piece.path}, line {self.number(piece.path, line)}: not a detection: {text[:80].decode(errors='replace')}") from None
        return pa.table({n: pa.array([r[k] for r in good], pa.float64()) for k, n in enumerate(NAMES)})

    def number(self, path: str, line: bytes) -> int:
        """The number of the first such line; the file is read through, for the message only."""
        store, _ = place(self.path)
        n, rest = 0, b""
        with store.open_input_stream(path) as f:
            while got := f.read(CHUNK):
                *whole, rest = (rest + got).split(b"\n")
                if line in whole:
                    return n + whole.index(line) + 1
                n += len(whole)
        return n + 1


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class TrackWriter(DataSourceArrowWriter):
    """Parts are files that nobody reads until a pointer names them all; the pointer is written last, under the next number."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, path = place(self.path)
        name, out = f"{self.run}/part-{uuid.uuid4().hex}.txt", None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(f"{path}/{self.run}", recursive=True)
                out = store.open_output_stream(f"{path}/{name}")
            frame, gid, *rest = (b.column(b.schema.get_field_index(n)).to_pylist() for n in OUT.names)
            out.write("".join(f"{f + 1},{g},{x:.1f},{y:.1f},{w:.1f},{h:.1f},{c:.3f},-1,-1,-1\n" for f, g, x, y, w, h, c in zip(frame, gid, *rest)).encode())
        if out is not None:
            out.close()
        return Part(name if out is not None else None)

    def commit(self, messages) -> None:
        store, path = place(self.path)
        mine = [m.name for m in messages if m and m.name]
        before = [] if self.overwrite else current(store, path) or []
        known = pointers(store, path)
        number = int(known[-1].rsplit("/", 1)[1].split(".")[0]) + 1 if known else 1
        store.create_dir(f"{path}/{VERSIONS}", recursive=True)
        with store.open_output_stream(f"{path}/{VERSIONS}/{number:08d}.json") as f:
            f.write(json.dumps({"files": before + sorted(mine)}).encode())

    def abort(self, messages) -> None:
        store, path = place(self.path)
        if store.get_file_info(f"{path}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.run}")


class TrackSource(DataSource):
    """spark.read.format("tracks").load(path) and df.write.format("tracks").mode("append" or "overwrite").save(path).

    Options of reading: `split`, the bytes of a partition, and `strict`, true by default: a line that isn't a detection fails the query, else it is left out. frame_proc counts from 0, files from 1.
    Each write is a new version of the folder; one that is broken off leaves the version before it as it was. One writer at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TrackReader:
        return TrackReader(self.options)

    def writer(self, schema, overwrite: bool) -> TrackWriter:
        lacking = {n for n in OUT.names} - set(schema.names)
        if lacking:
            raise ValueError(f"columns are lacking: {sorted(lacking)}")
        return TrackWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes `tracks` known to the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrackSource)
