"""Paged files of any size read by many tasks.

A first job skims every file, over data of fixed width by seeking alone, and writes an index: a row for each run of rows
of a page, with the bytes it lies in (of each column, where columns are stored one after another) and the page's
parameters. Reading takes the index's rows that it needs, so pages are chosen by number or parameter before any data is
read, and deals them to tasks by their bytes. Columns that are not asked for are not read where the layout stores them
apart. Files are opened by pyarrow's file systems; no task holds more than one run of rows.

Defined cases: pages without rows are in the index and give no rows; a file that ends inside a page is an error, unless
whole is false, which keeps the pages before it; files whose columns differ from the first file's are an error; a
folder without files is an error, as nothing gives the columns.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.frame import Paged
from quire.sources.paged_file import SPARK_TYPES, TYPES, FormatError, Layout, Lines, header_bytes, read_header, split_row, text_pages, text_value
from quire.sources.shared import shared_folder

ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0)}
RUN = 1 << 16  # rows
TASK_BYTES = 128 << 20
PIECES = "__f bigint, __part bigint, __i bigint, __named binary, __path string, __at bigint, __n bigint, __size bigint"
INDEX = "__file string, __page int, __first bigint, __n bigint, __rows bigint, __at array<bigint>, __to array<bigint>"


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))


def _opened(path: str) -> io.BufferedReader:
    system, name = _located(path)
    return io.BufferedReader(system.open_input_file(name), 1 << 20)


def header_of(f: io.BufferedReader) -> Layout:
    """The header, from as many bytes as it takes."""
    size, raw = 1 << 16, b""
    while True:
        f.seek(0)
        before, raw = len(raw), f.read(size)
        try:
            layout = read_header(raw)
            if layout.end < len(raw) or len(raw) == before or len(raw) < size:
                return layout
        except (FormatError, ValueError):
            if len(raw) < size:
                raise
        size *= 4


@dataclass
class Run:
    page: int
    first: int
    n: int
    rows: int
    at: list[int]
    to: list[int]
    parameters: list


class _Skim:
    """Walks over binary pages."""

    def __init__(self, f: io.BufferedReader, layout: Layout):
        self.f, self.layout, self.order = f, layout, ">" if layout.big_endian else "<"
        f.seek(0, 2)
        self.size = f.tell()
        f.seek(layout.end)

    def integer(self) -> int:
        return struct.unpack(self.order + "i", self.f.read(4))[0]

    def skip(self, kind: str, n: int) -> None:
        if kind == "string":
            for _ in range(n):
                self.f.seek(self.integer(), 1)
        else:
            self.f.seek(np.dtype(TYPES[kind][1]).itemsize * n, 1)

    def value(self, kind: str):
        if kind == "string":
            return self.f.read(self.integer()).decode("utf-8", "replace")
        dtype = np.dtype(TYPES[kind][1]).newbyteorder(self.order)
        x = np.frombuffer(self.f.read(dtype.itemsize), dtype)[0]
        return x.decode("latin-1") if kind == "character" else float(x) if dtype.kind == "f" else int(x)

    def runs(self, run: int) -> Iterator[Run]:
        layout, page = self.layout, 0
        kinds = [c["type"] for c in layout.columns]
        while self.f.tell() < self.size:
            page += 1
            n = self.integer()
            if n == -(1 << 31):
                n = struct.unpack(self.order + "q", self.f.read(8))[0]
            if n < 0:
                raise FormatError("a negative number of rows")
            parameters = [text_value(p["fixed_value"], p["type"]) if "fixed_value" in p else self.value(p["type"]) for p in layout.parameters]
            for a in layout.arrays:
                self.skip(a["type"], int(np.prod([self.integer() for _ in range(int(a.get("dimensions", "1")))])))
            firsts = range(0, max(n, 1), run)
            apart = [[k] for k in kinds] if layout.flag("column_major_order") else [kinds]
            bounds = [self.bounds(part, n, run) for part in apart]
            if self.f.tell() > self.size:
                raise FormatError("the file ends inside a page")
            for i, first in enumerate(firsts):
                yield Run(page, first, min(run, n - first), n, [b[i] for b in bounds], [b[i + 1] for b in bounds], parameters)

    def bounds(self, kinds: list[str], n: int, run: int) -> list[int]:
        """Where runs of n records of these kinds begin, and the end."""
        start = self.f.tell()
        if "string" not in kinds:
            width = sum(np.dtype(TYPES[k][1]).itemsize for k in kinds)
            self.f.seek(n * width, 1)
            return [start + min(i, n) * width for i in range(0, max(n, 1), run)] + [start + n * width]
        out = []
        for i in range(n):
            if i % run == 0:
                out.append(self.f.tell())
            for k in kinds:
                self.skip(k, 1)
        return (out or [start]) + [self.f.tell()]


def _text_runs(f: io.BufferedReader, layout: Layout, run: int) -> Iterator[Run]:
    f.seek(layout.end)
    lines = Lines(f)

    def marks(rows: Iterator[str]) -> list[tuple[int, int]]:
        """(row, where it begins) of every run's first row; then the number of rows and the end."""
        out, i, at = [(0, lines.at)], 0, lines.at
        for i, _ in enumerate(rows, 1):
            at = lines.at
            if i % run == 0:
                out.append((i, at))
        return out + [(i, at)] if out[-1][0] < i or i == 0 else out

    for number, page in enumerate(text_pages(lines, layout, marks), 1):
        rows = page["rows"] or [(0, 0), (0, 0)]
        for (i, at), (j, to) in zip(rows[:-1], rows[1:], strict=True):
            yield Run(number, i, j - i, rows[-1][0], [at], [to], [page["parameters"][p["name"]] for p in layout.parameters])


def runs_of(path: str, run: int = RUN) -> tuple[Layout, Iterator[Run]]:
    f = _opened(path)
    layout = header_of(f)
    return layout, (_Skim(f, layout).runs(run) if layout.binary else _text_runs(f, layout, run))


def _strings(raw: bytes, n: int, order: str) -> list[str]:
    out, at, size = [], 0, struct.Struct(order + "i").unpack_from
    for _ in range(n):
        end = at + 4 + size(raw, at)[0]
        out.append(raw[at + 4 : end].decode("utf-8", "replace"))
        at = end
    return out


def _records(raw: bytes, kinds: list[str], n: int, order: str) -> list[list]:
    """Columns of records that hold strings."""
    out, at, size = [[] for _ in kinds], 0, struct.Struct(order + "i").unpack_from
    kinds = [None if k == "string" else np.dtype(TYPES[k][1]).newbyteorder(order) for k in kinds]
    parts = [bytearray() if k is not None else [] for k in kinds]
    for _ in range(n):
        for part, k in zip(parts, kinds, strict=True):
            if k is None:
                end = at + 4 + size(raw, at)[0]
                part.append(raw[at + 4 : end].decode("utf-8", "replace"))
            else:
                end = at + k.itemsize
                part += raw[at:end]
            at = end
    return [p if k is None else np.frombuffer(bytes(p), k) for p, k in zip(parts, kinds, strict=True)] if n else out


def run_columns(f: io.BufferedReader, layout: Layout, at: Sequence[int], to: Sequence[int], n: int, wanted: Sequence[int]) -> list:
    """Values of the wanted columns of a run of rows."""
    kinds, order = [c["type"] for c in layout.columns], ">" if layout.big_endian else "<"

    def part(i: int) -> bytes:
        f.seek(at[i])
        raw = f.read(to[i] - at[i])
        if len(raw) < to[i] - at[i]:
            raise FormatError("the file ends inside a page")
        return raw

    if not layout.binary:
        lines = Lines(io.BytesIO(part(0)))
        rows = [split_row(r) for r in (lines.block() if layout.flag("no_row_counts") else lines.grouped(n, layout))]
        if any(len(r) < len(kinds) for r in rows):
            raise FormatError("a row is short")
        return [[text_value(r[c], kinds[c]) for r in rows] for c in wanted]
    fixed = lambda raw, kind: np.frombuffer(raw, np.dtype(TYPES[kind][1]).newbyteorder(order))
    if layout.flag("column_major_order"):
        return [_strings(part(c), n, order) if kinds[c] == "string" else fixed(part(c), kinds[c]) for c in wanted]
    if "string" in kinds:
        found = _records(part(0), kinds, n, order)
        return [found[c] for c in wanted]
    table = np.frombuffer(part(0), np.dtype([(f"c{i}", np.dtype(TYPES[k][1]).newbyteorder(order)) for i, k in enumerate(kinds)]), n)
    return [table[f"c{c}"] for c in wanted]


def _arrow(values, kind: str) -> pa.Array:
    type_ = ARROW[TYPES[kind][0]]
    if isinstance(values, list):
        return pa.array(values, type_)
    if kind == "character":
        return pa.array([x.decode("latin-1") for x in values.tolist()], type_)
    if pa.types.is_decimal(type_):
        return pa.array(values.astype("u8")).cast(pa.decimal128(20, 0))
    return pa.array(np.ascontiguousarray(values.astype(type_.to_pandas_dtype())), type_)


@dataclass(frozen=True)
class PagedFiles:
    """Files whose index is written; index holds INDEX and the parameters."""

    layout: Layout
    index: DataFrame

    def parameters(self, where: Column | None = None) -> DataFrame:
        """A row for each page: __file, __page, __rows and its parameters."""
        return self._chosen(where).filter("__first = 0").select("__file", "__page", "__rows", *[f"`{p['name']}`" for p in self.layout.parameters])

    def _chosen(self, where: Column | None) -> DataFrame:
        return self.index if where is None else self.index.filter(where)

    def rows(self, columns: Sequence[str] | None = None, where: Column | None = None, every: int = 1, offset: int = 0, last: int | None = None) -> Paged:
        """Pages (__file, __page) of rows __row with the columns (all, if none are named) of the pages that where, a condition on
        __page, __rows and parameters, chooses; of each page every so many rows from offset on, or its last rows. Runs
        of rows without any of these are not read."""
        if every < 1 or offset < 0 or (last is not None and last < 0):
            raise ValueError("every must be positive, offset and last not negative")
        names = [c["name"] for c in self.layout.columns]
        columns = names if columns is None else list(columns)
        wanted, layout = [names.index(c) for c in columns], self.layout
        runs = self._chosen(where).filter("__n > 0")
        end = F.col("__first") + F.col("__n")
        if last is not None:
            runs = runs.filter(end > F.col("__rows") - last)
        step = F.lit(every)
        following = F.greatest(F.lit(offset), F.ceil((F.col("__first") - offset) / step) * step + offset)  # first row asked for, in or after the run
        runs = runs.filter(following < end)
        size = reduce(lambda a, b: a + b, [F.col("__to")[i] - F.col("__at")[i] for i in (wanted if layout.binary and layout.flag("column_major_order") else [0])], F.lit(0))
        total, n = runs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
        tasks = max(1, min(n, max(runs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))))
        runs = runs.select(*[c.split()[0] for c in INDEX.split(", ")]).repartition(tasks, "__file", "__page", "__first")

        def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, f = None, None
            for batch in it:
                for r in batch.to_pylist():
                    if r["__file"] != path:
                        path, f = r["__file"], _opened(r["__file"])
                    row = r["__first"] + np.arange(r["__n"])
                    keep = (row >= offset) & ((row - offset) % every == 0)
                    if last is not None:
                        keep &= row >= r["__rows"] - last
                    arrays = [_arrow(x, layout.columns[c]["type"]) for x, c in zip(run_columns(f, layout, r["__at"], r["__to"], r["__n"], wanted), wanted, strict=True)]
                    k = np.flatnonzero(keep)
                    head = [pa.array([r["__file"]] * len(k), pa.string()), pa.array(np.full(len(k), r["__page"], np.int32)), pa.array(row[k])]
                    yield pa.RecordBatch.from_arrays([*head, *[a if len(k) == len(a) else a.take(pa.array(k)) for a in arrays]], ["__file", "__page", "__row", *columns])

        kinds = "".join(f", `{names[c]}` {TYPES[layout.columns[c]['type']][0]}" for c in wanted)
        return Paged(runs.mapInArrow(read, "__file string, __page int, __row bigint" + kinds), ("__file", "__page"), ("__row",), self.parameters(where))


def open_files(spark: SparkSession, path: str, whole: bool = True, run: int = RUN) -> PagedFiles:
    """Skims all files at path, a file in one task, and writes their index to the shared folder."""
    files = spark.read.format("binaryFile").load(path).select("path")  # names only: contents are not read
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise FormatError(f"no files at {path}")
    layout = header_of(_opened(first))
    parameters = layout.parameters
    kinds = "".join(f", `{p['name']}` {TYPES[p['type']][0]}" for p in parameters)
    same = [(c["name"], c["type"]) for c in layout.columns], [(p["name"], p["type"]) for p in parameters], layout.data.get("mode"), layout.flag("column_major_order"), layout.big_endian

    def skim(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [ARROW["string"], pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2]
        names = [c.split()[0] for c in INDEX.split(", ")] + [p["name"] for p in parameters]

        def batch(path: str, runs: list[Run]) -> pa.RecordBatch:
            cells = [[path] * len(runs), *([getattr(r, k) for r in runs] for k in ("page", "first", "n", "rows", "at", "to"))]
            arrays = [pa.array(x, t) for x, t in zip(cells, schema, strict=True)]
            arrays += [pa.array([r.parameters[i] for r in runs], ARROW[TYPES[p["type"]][0]]) for i, p in enumerate(parameters)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for paths in it:
            for p in paths.column(0).to_pylist():
                of, runs = runs_of(p, run)
                if ([(c["name"], c["type"]) for c in of.columns], [(x["name"], x["type"]) for x in of.parameters], of.data.get("mode"), of.flag("column_major_order"), of.big_endian) != same:
                    raise FormatError(f"{p} has other columns than {first}")
                found: list[Run] = []
                try:
                    for r in runs:
                        found.append(r)
                        if len(found) == 1 << 12:
                            yield batch(p, found)
                            found = []
                except (FormatError, struct.error, StopIteration, RuntimeError, IndexError):
                    if whole:
                        raise
                yield batch(p, found)

    folder = shared_folder(spark, "index")
    files.mapInArrow(skim, INDEX + kinds).write.parquet(folder)
    return PagedFiles(layout, spark.read.parquet(folder))


def write_files(p: Paged, folder: str, magic: str, files: int = 8, part_rows: int = 1 << 19) -> None:
    """All pages of p in `files` binary files under folder, each page whole in one file, rows in order. Parts of the sorted
    rows, about part_rows each however long a page is, are first written by a task each; then a task for each file streams
    its pages together from the parts, as a page begins with its number of rows. Nulls are refused in numbers and become
    empty texts."""
    page, order = list(p.page), list(p.order)
    columns = [c for c in p.rows.columns if c not in page]
    kinds = dict(p.rows.dtypes)
    item = lambda c: {"name": c, "type": SPARK_TYPES[kinds[c]]}
    layout = Layout([item(c) for c in columns], [item(c) for c in page], [], {"mode": "binary"})
    head = header_bytes(magic, layout)
    fixed = all(c["type"] != "string" for c in layout.columns)
    rows = p.rows.select(*page, *columns, F.pmod(F.xxhash64(*page), F.lit(files)).alias("__f"))
    parts = max(files, -(-rows.count() // part_rows))
    rows = rows.repartitionByRange(parts, "__f", *page, *order).sortWithinPartitions("__f", *page, *order)
    scratch = f"{folder}/.parts-{uuid.uuid4().hex}"

    def cell(kind: str, x) -> bytes:
        if kind == "string":
            b = ("" if x is None else x).encode()
            return struct.pack("<i", len(b)) + b
        return np.array([x], np.dtype(TYPES[kind][1])).tobytes()

    def put(batch: pa.RecordBatch) -> bytes:
        data = [batch.column(c) for c in columns]
        if any(a.null_count for a, c in zip(data, layout.columns, strict=True) if c["type"] != "string"):
            raise ValueError("a number is null, which the format cannot hold")
        if fixed:
            table = np.empty(len(batch), np.dtype([(f"c{i}", "<" + TYPES[c["type"]][1]) for i, c in enumerate(layout.columns)]))
            for i, a in enumerate(data):
                table[f"c{i}"] = a.to_numpy(zero_copy_only=False)
            return table.tobytes()
        parts = []
        for a, c in zip(data, layout.columns, strict=True):
            if c["type"] == "string":
                parts.append([cell("string", x) for x in a.to_pylist()])
            else:
                raw, w = a.to_numpy(zero_copy_only=False).astype("<" + TYPES[c["type"]][1]).tobytes(), np.dtype(TYPES[c["type"]][1]).itemsize
                parts.append([raw[i : i + w] for i in range(0, len(raw), w)])
        return b"".join(b"".join(r) for r in zip(*parts, strict=True))

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the rows of a part; of each piece of a page in it, where it lies and the page's head without the number."""
        from pyspark import TaskContext

        part, path, out, at, pieces = TaskContext.get().partitionId(), f"{scratch}/{uuid.uuid4().hex}", None, 0, []
        for batch in it:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("__f", *page)], strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if out is None:
                    system, base = _located(path)
                    system.create_dir(base.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(base)
                raw = put(batch.slice(i, j - i))
                out.write(raw)
                if pieces and pieces[-1][0] == keys[i]:
                    pieces[-1][2] += j - i
                    pieces[-1][3] += len(raw)
                else:
                    pieces.append([keys[i], at, j - i, len(raw)])
                at += len(raw)
        if out is not None:
            out.close()
        named = [b"".join(cell(c["type"], x) for c, x in zip(layout.parameters, k[1:], strict=True)) for k, *_ in pieces]
        cells = [[k[0] for k, *_ in pieces], [part] * len(pieces), list(range(len(pieces))), named, [path] * len(pieces), *([x[i] for x in pieces] for i in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), *[pa.int64()] * 3), strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _located(folder)
        number, out, name = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                system.move(name, f"{base}/{number:05d}.paged")  # a task that runs twice leaves one whole file

        for batch in it:
            for r in batch.to_pylist():
                if r["__f"] != number:
                    close()
                    number = r["__f"]
                    name = f"{base}/.{number}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                    out.write(head)
                if r["__starts"]:
                    n = r["__rows"]
                    out.write((struct.pack("<i", n) if n < 1 << 31 else struct.pack("<iq", -(1 << 31), n)) + r["__named"])
                with system.open_input_file(_located(r["__path"])[1]) as piece:
                    piece.seek(r["__at"])
                    left = r["__size"]
                    while left:
                        raw = piece.read(min(left, 1 << 22))
                        if not raw:
                            raise FormatError("a part ended early")
                        out.write(raw)
                        left -= len(raw)
        close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    index = shared_folder(rows.sparkSession, "pieces")
    rows.mapInArrow(split, PIECES).write.parquet(index)  # written, as a part that ran again would name other files
    pieces = rows.sparkSession.read.parquet(index)
    lengths = pieces.groupBy("__f", "__named").agg(F.sum("__n").alias("__rows"), F.min(F.struct("__part", "__i")).alias("__first"))
    pieces = pieces.join(lengths, ["__f", "__named"]).withColumn("__starts", F.struct("__part", "__i") == F.col("__first")).drop("__first")
    pieces = pieces.repartition(files, "__f").sortWithinPartitions("__f", "__part", "__i")
    pieces.mapInArrow(save, "done int").agg(F.sum("done")).collect()
    system, base = _located(scratch)
    if system.get_file_info(base).type.name == "Directory":
        system.delete_dir(base)
